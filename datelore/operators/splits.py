"""Train, validation and test splits without leakage, baselines and prediction metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datelore.operators import asof


def expanding_folds(rows: DataFrame, n_folds: int) -> DataFrame:
    """(fold, role, company_cik, cycle, as_of): for each of the last n_folds cycles, rows of that cycle are held out, the last one as test, others for
    validation, and rows of earlier cycles whose scores were published by its first as_of train. Cycles are few; rows are joined to them by one range join.
    """
    cycles = rows.groupBy("cycle").agg(F.min("as_of").alias("_cutoff"))
    back = F.row_number().over(Window.orderBy(F.col("cycle").desc()))  # one row for each cycle
    held = cycles.withColumn("_back", back).where(F.col("_back") <= n_folds).select(F.col("cycle").alias("fold"), "_cutoff", F.when(F.col("_back") == 1, "test").otherwise("validation").alias("_role"))
    cols = ["company_cik", "cycle", "as_of"]
    out = rows.join(F.broadcast(held), F.col("cycle") == F.col("fold")).select("fold", F.col("_role").alias("role"), *cols)
    train = rows.join(F.broadcast(held), (F.col("cycle") < F.col("fold")) & (F.col("published_date") <= F.col("_cutoff"))).select("fold", F.lit("train").alias("role"), *cols)
    return out.unionByName(train)


def group_folds(rows: DataFrame, group: str, folds: int, test_share: float, seed: int) -> DataFrame:
    """rows with fold: test, or 0 to folds - 1. It depends on the group's hash alone, so a group is never in two of them, whatever the other rows are."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(10_000)) / 10_000
    inner = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(group)), F.lit(folds)).cast("string")
    return rows.withColumn("fold", F.when(place < test_share, "test").otherwise(inner))


def group_folds_by_size(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """rows with fold 0 to folds - 1 of about equal numbers of groups, in the order of their md5."""
    ordered = rows.select(group).distinct().withColumn("_h", F.md5(F.col(group).cast("string").cast("binary")))
    cut = ordered.withColumn("fold", F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")).drop("_h")
    return rows.join(cut, group)


def baselines(folds: DataFrame, by: str) -> DataFrame:
    """Held-out rows (fold, role, by, score) with the median score of the training rows, and that of the training rows of their group, or else the former."""
    train = folds.where("role = 'train'")
    overall = train.groupBy("fold").agg(F.median("score").alias("global_median"))
    own = train.groupBy("fold", by).agg(F.median("score").alias("_own"))
    held = folds.where("role <> 'train'").join(F.broadcast(overall), "fold", "left").join(own, ["fold", by], "left")
    return held.withColumn("group_median", F.coalesce("_own", "global_median")).drop("_own")


def previous_score_baseline(folds: DataFrame) -> DataFrame:
    """Held-out rows (fold, role, company_cik, cycle, as_of, published_date, score) with the last score of their company among their fold's training rows that was published by their date."""
    train = folds.where("role = 'train'")
    return asof.previous_scores(folds.where("role <> 'train'"), train, ("fold", "company_cik"))


def errors(rows: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """Mean absolute error, root mean square error and the number of rows with both values."""
    gap = F.col(predicted) - F.col(actual)
    return rows.groupBy(*by).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(gap).alias("n"))


def rank_correlation(rows: DataFrame, group: str, a: str, b: str, least: int = 3) -> DataFrame:
    """Spearman's correlation within each group, ties at their mean rank; null for groups of fewer than least rows or without variation."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    place = lambda c: F.rank().over(Window.partitionBy(group).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(group, c)) - 1) / 2
    ranks = both.select(group, place(a).cast("double").alias("_a"), place(b).cast("double").alias("_b"))
    moments = ranks.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("_c"), F.stddev_pop("_a").alias("_x"), F.stddev_pop("_b").alias("_y"))
    ok = (F.col("n") >= least) & (F.col("_x") > 0) & (F.col("_y") > 0)
    return moments.select(group, "n", F.when(ok, F.col("_c")).alias("spearman"))


def choose_simplest(means: DataFrame, tolerance_col: str) -> DataFrame:
    """The row with the fewest features among those whose mean error is within the best one's standard error: means holds (name, mean, tolerance, size)."""
    best = means.agg(F.min(F.struct("mean", "size", "name")).alias("b"), F.min_by(tolerance_col, F.struct("mean", "size", "name")).alias("t"))
    return means.join(F.broadcast(best), F.col("mean") <= F.col("b.mean") + F.coalesce("t", F.lit(0.0))).orderBy("size", "mean", "name").limit(1).drop("b", "t")


def standard_error(value: str):
    """Sample standard deviation over the root of the count; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
