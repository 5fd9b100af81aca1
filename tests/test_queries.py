"""Every core query runs, and equals its SQL where it has one."""

import subprocess
import sys
from pathlib import Path

import pytest

from datelore.plans import registry
from tests.compare import by_duckdb, rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(found) == rows(by_duckdb(registry.ORACLE_SQL[name], sf_dir))
    else:
        assert len(found.columns) > 0


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_is_imported_without_a_session():
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
