"""Latest state per key, fact selection by period, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (null keys are a key of their own)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


#: Forms that report a whole year, and forms that report a quarter; an amendment adds "/A". Instants may stand in any of them.
ANNUAL_FORMS = ("10-K", "20-F", "40-F")
QUARTER_FORMS = ("10-Q", "10-K", "8-K", "20-F", "6-K")


def period_kind(form: str, start: str, end: str, fp: str) -> Column:
    """annual (an annual form of fiscal period FY over 300 to 430 days), quarter (60 to 120 days), instant (no start), else null; both ends count.

    Facts of other forms, and periods of other lengths, such as those from the year's start, are none of them.
    """
    days = F.date_diff(F.col(end), F.col(start)) + 1
    of = F.regexp_replace(F.col(form), "/A$", "")
    annual, quarter = of.isin(*ANNUAL_FORMS), of.isin(*QUARTER_FORMS)
    return F.when(F.col(start).isNull() & (annual | quarter), "instant").when(annual & (F.col(fp) == "FY") & days.between(300, 430), "annual").when(quarter & days.between(60, 120), "quarter")


def select_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One fact for each key: newest period end, then concept priority, then newest filing date, then accession (then value); whether it is an amendment;
    with the number of different values published for the selected period (start and end) and concept, and whether they differ."""
    chosen = first_by(facts, keys, [F.col("period_end").desc_nulls_last(), F.col("priority"), F.col("filed").desc_nulls_last(), F.col("accession").desc(), F.col("value").desc()])
    same = [*keys, "period_start", "period_end", "priority"]
    told = facts.groupBy(*same).agg(F.countDistinct("value").alias("n_values"), F.count(F.lit(1)).alias("n_published"))
    matches = [chosen[c].eqNullSafe(told[c]) for c in same]
    return chosen.join(told, matches).select(*[chosen[c] for c in chosen.columns], "n_values", "n_published", (F.col("n_values") > 1).alias("is_disputed"), F.endswith(chosen["form"], F.lit("/A")).alias("is_amendment"))


def merged_values(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Values of a key that lie within a tolerance are one (the smallest stands for them), others conflict and give null and their list."""
    low, high = F.min(value), F.max(value)
    return rows.groupBy(*keys).agg(
        F.when(high - low <= tolerance, low).alias("value"), F.when(high - low > tolerance, F.array_sort(F.collect_set(value))).alias("candidates"),
        F.when(low.isNull(), "missing").when(high - low > tolerance, "conflicting").otherwise("agreed").alias("status"), F.count(F.lit(1)).alias("n"),
    )


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the named values as JSON with nulls."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """stored and new in one, a row for each key: first and last time seen over both, other columns from the newest row."""
    both = stored.unionByName(new)
    others = [c for c in both.columns if c not in (*keys, seen)]
    return both.groupBy(*keys).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), *[F.max_by(c, F.struct(seen, *[o for o in others])).alias(c) for c in others])


def current_flags(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key of two snapshots with is_current (in the new one) and change: added, kept or dropped."""
    a, b = old.select(F.col(key).alias("_a")).distinct(), new.select(F.col(key).alias("_b")).distinct()
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "dropped").otherwise("kept")
    return both.select(F.coalesce("_b", "_a").alias(key), F.col("_b").isNotNull().alias("is_current"), change.alias("change"))


def disagreements(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Keys whose values differ by more than a tolerance, or are there on one side only; left and right hold keys and value."""
    both = left.select(*keys, F.col("value").alias("left_value"), F.lit(True).alias("_l")).join(right.select(*keys, F.col("value").alias("right_value"), F.lit(True).alias("_r")), keys, "full_outer")
    issue = (
        F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left")
        .when(F.col("left_value").isNull() != F.col("right_value").isNull(), "one_is_null").when(F.abs(F.col("left_value") - F.col("right_value")) > tolerance, "different")
    )
    return both.withColumn("issue", issue).where("issue is not null").drop("_l", "_r")
