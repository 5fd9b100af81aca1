"""All queries of the core library and their SQL, gathered from the query modules."""

from __future__ import annotations

from functools import wraps

from datelore.plans import audits, catalogs, choices, claims, decide, endpoints, evidence, fits, flows, known, landings, proofs, records, registers, reviews, texts, wordings
from datelore.plans.views import plain

_MODULES = (known, records, decide, catalogs, audits, proofs, choices, reviews, claims, endpoints, evidence, texts, wordings, flows, fits, landings, registers)


def _plain(query):
    @wraps(query)
    def run(spark, sf_dir):
        return plain(query(spark, sf_dir))

    return run


QUERIES = {name: _plain(query) for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
