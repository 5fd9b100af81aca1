"""Two regressors on dated feature rows: an additive one whose terms are a table, and boosted trees; scoring, contributions and one-field search."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS = "feature_name string, bin int, low double, high double, term double"
_INF = float("inf")


def _cuts(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Quantile cuts of each feature from mergeable sketches: bins - 1 numbers for each come to the driver."""
    found = rows.approxQuantile(features, [k / bins for k in range(1, bins)], 0.001)
    return {f: sorted(set(c)) for f, c in zip(features, found, strict=True)}


def _bin(value: Column, cuts: list[float]) -> Column:
    """0 for a missing value (null or NaN), else 1 plus the number of cuts at or below it."""
    above = sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(1))
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(above).cast("double")


def fit_additive(rows: DataFrame, features: list[str], label: str, bins: int = 8, ridge: float = 0.1, cuts: dict[str, list[float]] | None = None) -> tuple[DataFrame, float]:
    """(terms, intercept): a score is the intercept plus one term for each feature, by the range its value lies in; a missing value has a term of its own.

    Features are cut at quantiles (or where cuts says), one-hot encoded and fitted by one ridge regression. terms is a small table: features times bins rows.
    """
    cuts = _cuts(rows, features, bins) if cuts is None else cuts
    binned = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *[_bin(F.col(f), cuts[f]).alias(f"_{f}") for f in features])
    indexed = [f"_{f}" for f in features]
    # The encoder has a place for each bin up to the highest that a training row fills; the terms of others are 0.
    encoder = OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_v" for c in indexed], dropLast=False, handleInvalid="keep")
    stages = [encoder, VectorAssembler(inputCols=[f"{c}_v" for c in indexed], outputCol="features"), LinearRegression(regParam=ridge, elasticNetParam=0.0)]
    model = Pipeline(stages=stages).fit(binned)
    weights, sizes = model.stages[-1].coefficients.toArray().tolist(), [int(n) for n in model.stages[0].categorySizes]
    out, start = [], 0
    for f, size in zip(features, sizes, strict=True):
        edges = [-_INF, *cuts[f], _INF]
        for k in range(len(cuts[f]) + 2):
            term = weights[start + k] if k < size else 0.0
            out.append((f, k, None if k == 0 else edges[k - 1], None if k == 0 else edges[k], float(term)))
        start += size + 1  # "keep" adds a place for bins never seen
    return rows.sparkSession.createDataFrame(out, TERMS), float(model.stages[-1].intercept)


def contributions(long: DataFrame, terms: DataFrame) -> DataFrame:
    """long (key columns, feature_name, value) with the term of each cell; features without terms are left out."""
    table = F.broadcast(terms.withColumnRenamed("feature_name", "_f"))  # features times bins
    missing = F.col("value").isNull() | F.isnan("value")
    inside = F.when(missing, F.col("bin") == 0).otherwise((F.col("bin") > 0) & (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
    return long.join(table, (F.col("feature_name") == F.col("_f")) & inside).drop("_f", "low", "high", "bin").withColumnRenamed("term", "contribution")


def score_additive(long: DataFrame, keys: list[str], terms: DataFrame, intercept: float) -> DataFrame:
    """(keys, score): the sum of a row's terms and the intercept."""
    return contributions(long, terms).groupBy(*keys).agg((F.sum("contribution") + intercept).alias("score"))


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    """Missing values filled by a constant below all others, and a column that tells them."""
    return rows.select("*", *[F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(-1e12)).alias(f"{f}_x") for f in features], *[F.col(f).isNull().cast("double").alias(f"{f}_m") for f in features])


def fit_trees(rows: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 3, seed: int = 1) -> PipelineModel:
    columns = [f"{f}_x" for f in features] + [f"{f}_m" for f in features]
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed, labelCol=label)]
    return Pipeline(stages=stages).fit(_filled(rows.where(F.col(label).isNotNull()), features))


def score_trees(rows: DataFrame, features: list[str], model: PipelineModel) -> DataFrame:
    return model.transform(_filled(rows, features)).drop("features", *[f"{f}_{s}" for f in features for s in "xm"])


def training_ranges(long: DataFrame) -> DataFrame:
    return long.groupBy("feature_name").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def range_warnings(long: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells outside what training saw: below, above, or of a feature that had no value there."""
    both = long.join(ranges, "feature_name", "left")
    issue = F.when(F.col("value").isNotNull() & F.col("low").isNull(), "no_training_value").when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above")
    return both.withColumn("warning", issue).where("warning is not null").select(*keys, "feature_name", "value", "warning")


def search_one_field(long: DataFrame, ranges: DataFrame, candidates: Column, keys: list[str], terms: DataFrame, intercept: float, target: float) -> DataFrame:
    """(keys, feature_name, candidate, score, gap): for each row and feature the candidate value whose score comes nearest to the target.

    candidates is an array over the columns of long and of ranges (feature_name, ...), a short table. Only the changed feature's term differs, so a candidate's score is the
    row's score less the old term plus the new one. Candidates are made and scored where their cell lies: no row for each of them is shuffled or sorted.
    """
    now = contributions(long, terms)
    total = now.groupBy(*keys).agg((F.sum("contribution") + intercept).alias("_score"))
    of_feature = terms.where("feature_name is not null").groupBy("feature_name").agg(F.collect_list(F.struct("bin", "low", "high", "term")).alias("_terms"))  # as many as bins

    def term(v: Column) -> Column:
        missing = v.isNull() | F.isnan(v)
        return F.get(F.filter("_terms", lambda t: F.when(missing, t.bin == 0).otherwise((t.bin > 0) & (v >= t.low) & (v < t.high))), F.lit(0))["term"]

    dealt = now.join(total, keys).repartition(*keys)  # a small table lies in one file, the work on it should not
    cells = dealt.join(F.broadcast(of_feature), "feature_name").join(F.broadcast(ranges), "feature_name")
    tried = F.transform(candidates, lambda v: F.struct(v.alias("candidate"), (F.col("_score") - F.col("contribution") + term(v)).alias("score")))
    tried = F.transform(F.filter(tried, lambda t: t.score.isNotNull()), lambda t: F.struct(F.abs(t.score - target).alias("gap"), F.abs(t.candidate).alias("size"), t.candidate.alias("candidate"), t.score.alias("score")))
    best = cells.select(*keys, "feature_name", F.explode_outer(F.array(F.array_min(tried))).alias("b")).where("b is not null")  # a filter on the expression itself would compute it twice
    return best.select(*keys, "feature_name", "b.candidate", "b.score", "b.gap")
