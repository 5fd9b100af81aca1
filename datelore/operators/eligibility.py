"""Which labels may be used for a target, which values may stand, and warnings in their first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.functions.text import iso_date

#: Statuses that may carry a value; endings of fields whose conversion may turn a sign.
WITH_VALUE = ("reported", "company_estimate", "company_target")
SIGNED = ("_change_pct", "_reduction_pct", "_progress_pct")


def label_exclusions(rows: DataFrame, score: str, published: str, authorised: str) -> DataFrame:
    """rows (row_id, company_cik, assessment_cycle, prediction_as_of as text, ...) with the reason why a target's label may not be used, null where it may.

    missing_or_invalid_label: no score, or none of 0 to 100. missing_label_provenance: no strict ISO date of publication or prediction, no authorisation, no company, no cycle.
    repeated_row: a row_id that stands twice, which no row of it survives, or none.
    """
    named = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    times = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("_times"))
    usable = F.coalesce(F.col(score).between(0, 100) & ~F.isnan(F.col(score)), F.lit(False))
    proven = iso_date(F.col(published)).isNotNull() & iso_date(F.col("prediction_as_of")).isNotNull() & named(authorised) & named("company_cik") & named("assessment_cycle")
    once = named("row_id") & F.coalesce(F.col("_times") == 1, F.lit(False))
    reason = F.when(~once, "repeated_row").when(~usable, "missing_or_invalid_label").when(~proven, "missing_label_provenance")
    return rows.join(times, "row_id", "left").withColumn("reason", reason).drop("_times")


def exclusion_counts(judged: DataFrame, target: str) -> DataFrame:
    """(target, reason, n): how many labels are used (reason used), and how many not, by reason."""
    return judged.groupBy(F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(target).alias("target"), "reason", "n")


def evidence_issue(name: Column, is_boolean: Column, value: Column, status: Column, has_evidence: Column, raw: Column, unit: Column, scale: Column) -> Column:
    """Why a present value may not stand, null where it may or is absent: it has no evidence, a status that carries none, a number without raw value, unit or scale, or a scale of no sense."""
    turns = F.lit(False)
    for ending in SIGNED:
        turns = turns | F.endswith(name, F.lit(ending))
    return (
        F.when(value.isNull(), None).when(~F.coalesce(has_evidence, F.lit(False)), "no_evidence").when(~F.coalesce(status.isin(*WITH_VALUE), F.lit(False)), "status_without_value")
        .when(~is_boolean & (raw.isNull() | unit.isNull() | scale.isNull()), "incomplete_evidence").when(~is_boolean & ((scale == 0) | (scale < 0) & ~turns), "scale_sign")
    )


def years_out_of_order(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, family) of targets in long rows (keys, name, value) whose target_year does not lie after their baseline_year; families are names without these endings."""
    ending = F.regexp_extract(name, "_(baseline|target)_year$", 1)
    told = rows.where((ending != "") & F.col(value).isNotNull()).select(*keys, F.regexp_replace(name, "_(baseline|target)_year$", "").alias("family"), ending.alias("_end"), F.col(value).alias("_v"))
    of = lambda end: F.max(F.when(F.col("_end") == end, F.col("_v")))
    return told.groupBy(*keys, "family").agg(of("baseline").alias("_b"), of("target").alias("_t")).where("_t <= _b").select(*keys, "family")


def warnings_once(warnings: DataFrame, keys: list[str], order: str, warning: str) -> DataFrame:
    """(keys, place, warning): each warning of a key once, where it first stood, numbered from 1 in that order."""
    first = warnings.where(F.col(warning).isNotNull()).groupBy(*keys, warning).agg(F.min(order).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", warning))).select(*keys, "place", warning)
