"""Results as sorted tuples of plain values, so that two engines can be compared."""

import os

import duckdb
import pandas as pd


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    kind = type(v).__name__
    if kind.startswith("bool"):
        return bool(v)
    if kind.startswith(("float", "int", "uint", "Decimal")):
        return int(v) if float(v).is_integer() else float(v)
    return str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(cell, r))) for r in frame.astype(object).itertuples(index=False, name=None))


def by_duckdb(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con.execute(sql).df()
