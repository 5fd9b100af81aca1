"""Exports: a flat file of features, a list of repairs with its summary, a document of results for each company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelore.sources.files import ExpectationError


def flat_features(rows: DataFrame, identifiers: list[str], fields: list[str]) -> DataFrame:
    """rows as text columns in a fixed order: booleans 1 and 0, a missing cell (null or NaN) empty. Identifiers come first."""
    kinds = dict(rows.dtypes)

    def shown(c: str):
        value = F.col(c).cast("int") if kinds[c] == "boolean" else F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        return F.coalesce(value.cast("string"), F.lit("")).alias(c)

    return rows.select(*map(shown, [*identifiers, *fields]))


def write_flat_features(rows: DataFrame, identifiers: list[str], fields: list[str], path: str) -> None:
    flat_features(rows, identifiers, fields).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def repair_summary(repairs: DataFrame, cutoff: str) -> DataFrame:
    """One row of what a list of repairs (issue, ...) holds: its size and its issues with their counts, sorted."""
    counts = repairs.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    told = F.array_sort(F.collect_list(F.struct("issue", "n")))  # as many as there are kinds of issues
    return counts.agg(F.lit(cutoff).alias("audit_cutoff"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"), F.map_from_entries(told).alias("issue_counts"))


def write_repairs(repairs: DataFrame, cutoff: str, path: str) -> None:
    """The full list and, once it is there, its summary."""
    repairs.write.mode("overwrite").json(f"{path}/rows")
    repair_summary(repairs.sparkSession.read.schema(repairs.schema).json(f"{path}/rows"), cutoff).write.mode("overwrite").json(f"{path}/summary")


def company_results(reference: DataFrame, results: DataFrame, key: str, name: str) -> DataFrame:
    """A row (key, document as JSON) for each company of the reference, with what was extracted for it; status not_extracted where nothing was.

    A result that stands twice or that the reference does not know is an error: nothing is dropped unseen. Its own name counts before the reference's.
    """
    odd = results.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(reference.select(key, F.lit(True).alias("known")).distinct(), key, "left").where("n > 1 or known is null")
    if found := [str(r[0]) for r in odd.select(key).orderBy(key).limit(5).collect()]:
        raise ExpectationError(f"results that are repeated or without a reference: {', '.join(found)}")
    values = [c for c in results.columns if c not in (key, name)]
    told = results.select(key, F.col(name).alias("_name"), F.struct(F.lit("extracted").alias("status"), *values).alias("_r"))
    both = reference.join(told, key, "left")
    others = [c for c in reference.columns if c not in (key, name)]
    company = F.struct(F.col(key).cast("string").alias("id"), F.coalesce("_name", F.col(name)).alias("name"), *others)
    empty = F.struct(F.lit("not_extracted").alias("status"), *[F.lit(None).cast(results.schema[c].dataType).alias(c) for c in values])
    return both.select(key, F.to_json(F.struct(company.alias("company"), F.coalesce("_r", empty).alias("result"))).alias("document"))
