"""Several additive models at once: scores of every target by one join, cohorts ranked by weights of categories, scenarios before and after, and what two families agree on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.operators import models, ranking

#: A table of terms of several models: models.TERMS with the target that each is for. A term without a feature is the target's intercept.
TERMS = f"target string, {models.TERMS}"


def _parts(long: DataFrame, keys: list[str], terms: DataFrame) -> DataFrame:
    """(keys, target, feature_name, contribution): the term of every cell for every target; terms are features times bins times targets, a small table."""
    table = F.broadcast(terms.where("feature_name is not null").withColumnRenamed("feature_name", "_f"))
    missing = F.col("value").isNull() | F.isnan("value")
    inside = F.when(missing, F.col("bin") == 0).otherwise((F.col("bin") > 0) & (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
    return long.join(table, (F.col("feature_name") == F.col("_f")) & inside).select(*keys, "target", "feature_name", F.col("term").alias("contribution"))


def _intercepts(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms.where("feature_name is null").select("target", F.col("term").alias("_intercept")))


def scores_by_target(long: DataFrame, keys: list[str], terms: DataFrame) -> DataFrame:
    """(keys, target, score, n_features, n_missing) of long rows (keys, feature_name, value) by every target's model; a missing value has a term of its own, features without terms play no part."""
    seen = long.withColumn("_missing", (F.col("value").isNull() | F.isnan("value")).cast("int"))
    features = F.broadcast(terms.where("feature_name is not null").select("target", F.col("feature_name").alias("_f")).distinct())
    counts = seen.join(features, F.col("feature_name") == F.col("_f")).groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("n_features"), F.sum("_missing").alias("n_missing"))
    sums = _parts(long, keys, terms).groupBy(*keys, "target").agg(F.sum("contribution").alias("_sum"))
    both = counts.join(sums, [*keys, "target"], "left").join(_intercepts(terms), "target", "left")
    return both.select(*keys, "target", (F.coalesce("_sum", F.lit(0.0)) + F.coalesce("_intercept", F.lit(0.0))).alias("score"), "n_features", "n_missing")


def cohort_ranking(long: DataFrame, key: str, terms: DataFrame, categories: dict[str, str], weights: dict[str, float], cohort: Column) -> DataFrame:
    """(key, target, raw, personalized, rank_before, rank_after, rank_change) of the rows of a cohort (a condition on long): each category's contributions count by its weight.

    Ranks go by score, then by key, within a target: targets are few, and each is ranked by a range partitioning. Features without a category count once.
    """
    named = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]) if categories else F.create_map(F.lit(""), F.lit(""))
    parts = _parts(long.where(cohort), [key], terms).withColumn("category", F.coalesce(F.element_at(named, F.col("feature_name")), F.lit("context")))
    of = {r.target: r.term for r in terms.where("feature_name is null").collect()}  # one row for each target
    targets = sorted({r.target for r in terms.select("target").distinct().collect()})

    def one(target: str) -> DataFrame:
        scores = ranking.reweighted(parts.where(F.col("target") == target), key, weights, of.get(target, 0.0))
        return ranking.rank_change(scores, "raw", "personalized", key).select(key, F.lit(target).alias("target"), "raw", "personalized", "rank_before", "rank_after", "rank_change")

    return reduce(DataFrame.unionByName, map(one, targets))


def scenario_scores(long: DataFrame, keys: list[str], terms: DataFrame, changed: Column) -> DataFrame:
    """(keys, target, before, after, difference): every target's score of long rows as they are, and with their values replaced by changed (an expression over a row)."""
    both = long.select(*keys, "feature_name", F.inline(F.array(F.struct(F.lit("before").alias("_variant"), F.col("value").alias("value")), F.struct(F.lit("after").alias("_variant"), changed.alias("value")))))
    scores = scores_by_target(both, [*keys, "_variant"], terms).groupBy(*keys, "target").pivot("_variant", ["before", "after"]).agg(F.first("score"))
    return scores.withColumn("difference", F.col("after") - F.col("before"))


def agreement(differences: DataFrame, keys: list[str], family: str, dead_band: float = 1e-9) -> DataFrame:
    """(keys, ensemble, direction): the mean difference over families, and up, down or unchanged where all families say so, else disagree."""
    way = F.when(F.abs("difference") <= dead_band, "unchanged").when(F.col("difference") > 0, "up").otherwise("down")
    one = F.when(F.min(way) == F.max(way), F.min(way)).otherwise("disagree")
    return differences.groupBy(*keys).agg(F.avg("difference").alias("ensemble"), one.alias("direction"), F.countDistinct(family).alias("n_families"))
