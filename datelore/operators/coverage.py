"""Coverage, missingness and audit aggregates over long feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(long: DataFrame, keys: list[str], features: list[str], value: str = "value") -> DataFrame:
    """One row for each key with a column for each feature; the list fixes the schema, so absent features are null columns."""
    return long.groupBy(*keys).pivot("feature_name", features).agg(F.first(value))


def long_cells(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """The inverse of wide, with a row for every cell, null or not."""
    return rows.unpivot(keys, features, "feature_name", "value")


def level(share: Column) -> Column:
    """none, low, medium or high, at 0, .33 and .67."""
    return F.when(share <= 0, "none").when(share < 0.33, "low").when(share < 0.67, "medium").otherwise("high")


def coverage(cells: DataFrame, keys: list[str], category: Column) -> DataFrame:
    """Counts of cells and of values for each key and category, and for each key over all (category null), with share and level."""
    seen = cells.withColumn("category", category)
    view = seen.groupingSets([[*(F.col(k) for k in keys), F.col("category")], [F.col(k) for k in keys]], *(F.col(k) for k in keys), F.col("category")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("value").alias("n_values"), F.grouping("category").alias("is_total")
    )
    share = F.col("n_values") / F.col("n_cells")
    return view.select(*keys, F.when(F.col("is_total") == 0, F.col("category")).alias("category"), "n_cells", "n_values", F.round(share, 6).alias("share"), level(share).alias("level"))


def support(cells: DataFrame, by: list[str], minimum: int, fraction: float, distinct: int) -> DataFrame:
    """Features with counts of values, distinct values and zeros, and the reasons why they may not enter a model.

    A feature needs max(minimum, ceil(fraction * its cells, with or without a value)) values, and distinct different ones. A reported zero is a value.
    """
    need = F.greatest(F.lit(minimum), F.ceil(F.lit(fraction) * (F.col("n_values") + F.col("n_missing"))))
    found = cells.groupBy(*by, "feature_name").agg(
        F.count("value").alias("n_values"), F.countDistinct("value").alias("n_distinct"), F.count_if(F.col("value") == 0).alias("n_zero"), F.count_if(F.col("value").isNull()).alias("n_missing")
    )
    reasons = F.array_compact(F.array(F.when(F.col("n_values") < need, "observed_count_below_minimum"), F.when(F.col("n_distinct") < distinct, "distinct_values_below_minimum")))
    return found.withColumn("reasons", F.array_join(reasons, ",")).withColumn("is_eligible", F.col("reasons") == "")


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def repair_list(rows: DataFrame) -> DataFrame:
    """Undated values and nulls without a reason, as (company_cik, feature_name, document_id, issue)."""
    issue = F.when(F.col("value").isNotNull() & F.col("publication_date").isNull(), "undated_value").when(F.col("value").isNull(), "ambiguous_null")
    return rows.withColumn("issue", issue).where("issue is not null").select("company_cik", "feature_name", "document_id", "issue")


def basis_counts(rows: DataFrame, cutoff: str) -> DataFrame:
    """For each feature: values with a publisher's date by the cutoff, with an acquisition date only, dated after the cutoff, and undated."""
    day, when = F.lit(cutoff).cast("date"), F.coalesce("publication_date", "acquired_date")
    return rows.where("value is not null").groupBy("feature_name").agg(
        F.count_if(F.col("publication_date") <= day).alias("n_publisher"),
        F.count_if(F.col("publication_date").isNull() & (F.col("acquired_date") <= day)).alias("n_acquired"),
        F.count_if(when > day).alias("n_after_cutoff"), F.count_if(when.isNull()).alias("n_undated"),
    )
