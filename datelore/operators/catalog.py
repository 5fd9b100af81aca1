"""Source catalogs: reviews and their freshness, collection status, rollups by company and category, sets of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a source, from the one that needs attention most.
PRIORITY = ("failed", "expired", "pending", "changed", "verified")


def review_window_ok(checked: str, until: str, days: int = 30) -> Column:
    """Whether a review is valid for at most so many days, and not for less than none."""
    return (F.col(until) >= F.col(checked)) & (F.col(until) <= F.col(checked) + F.make_interval(days=F.lit(days)))


def freshness(checked: str, until: str, reviewed_hash: str, served_hash: str, now: Column) -> Column:
    """What a review says at a time: invalid, changed (other bytes are served), expired (from the instant it is valid until), or verified, in that order; none without a review."""
    return (
        F.when(F.col(checked).isNull(), "none").when(~F.coalesce(review_window_ok(checked, until), F.lit(False)), "invalid")
        .when(~F.col(reviewed_hash).eqNullSafe(F.col(served_hash)), "changed").when(F.col(until) <= now, "expired").otherwise("verified")
    )


def collection_status(task: str, document: str) -> Column:
    """An unfinished or failed task decides; else a source is available if it has a document."""
    return F.when(F.col(task).isin("queued", "running"), "pending").when(F.col(task) == "failed", "failed").when(F.col(document).isNotNull(), "available").otherwise("missing")


def rollup(sources: DataFrame, key: str, category: str, status: str, checked: str) -> DataFrame:
    """(key, category): sources by status, the status that needs attention most, and the last check."""
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col(status))
    return sources.groupBy(key, category).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == "verified").alias("n_verified"), F.count_if(F.col(status).isin("failed", "expired")).alias("n_open"),
        F.min_by(status, F.when(order > 0, order)).alias("status"), F.max(checked).alias("last_check"),
    )


def all_categories(rows: DataFrame, key: str, category: str, n: int) -> DataFrame:
    """Keys that have rows in n categories."""
    return rows.groupBy(key).agg(F.countDistinct(category).alias("_n")).where(F.col("_n") == n).select(key)


def merged_source(stored: DataFrame, new: DataFrame, keys: list[str], fields: list[str], review: str) -> DataFrame:
    """Stored and newly registered sources in one: new fields replace old ones, a stored review stays unless a new one is given."""
    a = stored.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields], F.col(review).alias("_a_review"))
    b = new.select(*keys, F.lit(True).alias("_new"), *[F.col(f).alias(f"_b_{f}") for f in fields], F.col(review).alias("_b_review"))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("_new"), F.col(f"_b_{f}")).otherwise(F.col(f"_a_{f}")).alias(f) for f in fields], F.coalesce("_b_review", "_a_review").alias(review))


def components_add_up(parts: DataFrame, totals: DataFrame, keys: list[str], label: str, value: str, total: str) -> DataFrame:
    """totals with whether its two or three differently labelled components sum to it exactly, in decimals."""
    d = lambda c: F.col(c).cast("decimal(38,6)")
    sums = parts.groupBy(*keys).agg(F.sum(d(value)).alias("_sum"), F.count(F.lit(1)).alias("n_parts"), F.countDistinct(label).alias("_labels"))
    ok = F.col("n_parts").between(2, 3) & (F.col("n_parts") == F.col("_labels")) & (F.col("_sum") == d(total))
    return totals.join(sums, keys, "left").withColumn("adds_up", F.coalesce(ok, F.lit(False))).drop("_sum", "_labels")


def missing_items(universe: DataFrame, key: str, found: DataFrame, item: str, wanted: list[str]) -> DataFrame:
    """(key, missing): which of a fixed list of items each key lacks, sorted; keys that lack none have an empty list."""
    have = found.where(F.col(item).isin(wanted)).groupBy(key).agg(F.collect_set(item).alias("_have"))
    want = F.array(*[F.lit(w) for w in sorted(wanted)])
    return universe.select(key).join(have, key, "left").select(key, F.array_except(want, F.coalesce("_have", F.array().cast("array<string>"))).alias("missing"))


def partitioned(rows: DataFrame, verified: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reused, to_fetch): rows whose keys are verified, and the others."""
    known = verified.select(*keys).distinct()
    return rows.join(known, keys, "left_semi"), rows.join(known, keys, "left_anti")
