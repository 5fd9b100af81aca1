"""Ranks, percentiles, weighted scores, shares, scenarios and largest-remainder splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.plans.lineage import checkpointed, numbered


def ranked(rows: DataFrame, score: str, key: str, name: str = "rank") -> DataFrame:
    """rows with their rank in the whole table: highest score first, then by key; null scores come last."""
    return numbered(rows, [F.col(score).desc_nulls_last(), F.col(key)], name)


def rank_change(rows: DataFrame, before: str, after: str, key: str) -> DataFrame:
    """rows with rank_before, rank_after and their difference (positive: moved up)."""
    both = ranked(ranked(rows, before, key, "rank_before"), after, key, "rank_after")
    return both.withColumn("rank_change", F.col("rank_before") - F.col("rank_after"))


def percentiles(rows: DataFrame, value: str, higher_is_better: bool, name: str) -> DataFrame:
    """rows with the percentile of a value from 0 (worst) to 1 (best); ties share their mean place, a lone value gets 1, null stays null.

    Places come from counts of the distinct values, whose running sum is numbered over partitions, so no task holds all rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_ties"))
    placed = below_each(counts)
    total = rows.agg(F.count(value)).first()[0]
    middle = (F.col("_below") + (F.col("_ties") - 1) / 2) / F.lit(max(total - 1, 1))
    share = F.lit(1.0) if total == 1 else middle if higher_is_better else 1 - middle
    return rows.join(placed.withColumn(name, share.cast("double")).select("_v", name), F.col(value) == F.col("_v"), "left").drop("_v")


def below_each(counts: DataFrame) -> DataFrame:
    """counts (_v, _ties) with _below, the sum of _ties of smaller values: a sum within each range of values, plus what the ranges before hold."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(counts.repartitionByRange(parts, "_v").withColumn("_part", F.spark_partition_id()))
    starts, before = [], 0
    for r in dealt.groupBy("_part").agg(F.sum("_ties").alias("n")).orderBy("_part").collect():  # one row for each partition
        starts.append((r["_part"], before))
        before += r["n"]
    first = F.broadcast(counts.sparkSession.createDataFrame(starts, "_part int, _first long"))
    within = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(first, "_part").withColumn("_below", F.col("_first") + F.coalesce(F.sum("_ties").over(within), F.lit(0))).drop("_part", "_first")


def weighted(parts: dict[str, tuple[str, float]], least: int = 1) -> Column:
    """The mean of the columns that are there, by their weights; null where fewer than least are."""
    there = [(F.col(c), w) for c, w in parts.values()]
    count = sum((c.isNotNull().cast("int") for c, _ in there), F.lit(0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in there), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in there), F.lit(0.0))
    return F.when(count >= least, total / weight)


def reweighted(contributions: DataFrame, key: str, weights: dict[str, float], intercept: float) -> DataFrame:
    """(key, raw, personalized) of long contributions (key, category, contribution): the plain sum, and the sum with (weight - 1) times each category added.

    A category without a weight counts once, so unit weights give the raw score back.
    """
    pairs = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    extra = (F.coalesce(F.element_at(pairs, F.col("category")), F.lit(1.0)) - 1) * F.col("contribution")
    return contributions.groupBy(key).agg((F.sum("contribution") + intercept).alias("raw"), (F.sum("contribution") + F.sum(extra) + intercept).alias("personalized"))


def shares(rows: DataFrame, group: str, before: str, after: str, dead_band: float = 1e-12) -> DataFrame:
    """Sums of two scores by group, their shares in the whole, the change of share and its direction."""
    sums = rows.groupBy(group).agg(F.sum(before).alias("sum_before"), F.sum(after).alias("sum_after"))
    everything = Window.partitionBy()  # one row for each group
    both = sums.withColumns({"share_before": F.col("sum_before") / F.sum("sum_before").over(everything), "share_after": F.col("sum_after") / F.sum("sum_after").over(everything)})
    change = F.col("share_after") - F.col("share_before")
    return both.withColumns({"share_change": change, "direction": F.when(F.abs(change) <= dead_band, "unchanged").when(change > 0, "up").otherwise("down")})


def remainder_split(groups: DataFrame, share: str, key: str, cents: int) -> DataFrame:
    """Whole cents by share: floors first, then one cent each by the largest fraction (ties by key). groups is a small table, one row for each part."""
    exact = F.col(share) * F.lit(cents)
    everything = Window.partitionBy()
    floored = groups.withColumn("_floor", F.floor(exact)).withColumn("_left", F.lit(cents) - F.sum("_floor").over(everything))
    order = F.row_number().over(everything.orderBy((exact - F.col("_floor")).desc(), key))
    return floored.withColumn("cents", F.col("_floor") + (order <= F.col("_left")).cast("bigint")).drop("_floor", "_left")


def capped_scenario(value: str, factor: float, cap: float = 100.0) -> Column:
    """min(cap, value * factor); a missing value stays missing."""
    return F.when(F.col(value).isNotNull(), F.least(F.lit(cap), F.col(value) * factor))  # least passes nulls over


def adjusted(long: DataFrame, changes: list[tuple[str, str, float]]) -> DataFrame:
    """long (feature_name, value) with changes (feature, operation, amount) applied: add, percent or set.

    new_value is the value after the change, outcome changed, unchanged, or missing_base where a relative change has no base to change.
    """
    table = F.broadcast(long.sparkSession.createDataFrame(changes, "_feature string, _operation string, _amount double"))  # a fixed list
    both = long.join(table, F.col("feature_name") == F.col("_feature"), "left")
    new = (
        F.when(F.col("_operation") == "set", F.col("_amount")).when(F.col("_operation") == "add", F.col("value") + F.col("_amount"))
        .when(F.col("_operation") == "percent", F.col("value") * (1 + F.col("_amount") / 100)).otherwise(F.col("value"))
    )
    outcome = F.when(F.col("_operation").isNull() | new.eqNullSafe(F.col("value")) & F.col("value").isNotNull(), "unchanged").when(new.isNull(), "missing_base").otherwise("changed")
    return both.withColumns({"new_value": new, "outcome": outcome}).drop("_feature", "_operation", "_amount")


def observed_points(long: DataFrame, ranges: DataFrame, points: int = 21) -> DataFrame:
    """ranges (feature_name, low, high) with what value_grid asks of the values seen in long (feature_name, value) within them.

    observed: up to points of the distinct values, evenly spaced by place from the first to the last; least_positive: the smallest one above zero. Both are null
    where no value lies in the range. Places are numbered over partitions, so no task holds all values of a feature.
    """
    seen = long.where("value is not null and not isnan(value)").join(F.broadcast(ranges), "feature_name").where("value between low and high")  # a row for each feature
    placed = checkpointed(numbered(seen.select("feature_name", "value").distinct(), [F.col("feature_name"), F.col("value")], "_n"))
    spans = placed.groupBy("feature_name").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_all"), F.min(F.when(F.col("value") > 0, F.col("value"))).alias("least_positive"))
    steps = F.least(F.lit(points - 1), F.col("_all") - 1)
    places = F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda k: F.col("_first") + F.coalesce(F.rint(F.try_divide(k * (F.col("_all") - 1), steps)), F.lit(0.0)).cast("long"))
    wanted = spans.select("feature_name", F.explode(F.array_distinct(places)).alias("_n"))
    chosen = placed.join(F.broadcast(wanted), ["feature_name", "_n"]).groupBy("feature_name").agg(F.array_sort(F.collect_list("value")).alias("observed"))  # at most points a feature
    return ranges.join(chosen, "feature_name", "left").join(spans.select("feature_name", "least_positive"), "feature_name", "left")


def value_grid(current: Column, low: Column, high: Column, observed: Column, least_positive: Column, unit: Column) -> Column:
    """Candidate values for a search between low and high, without the current one: both ends, the observed points (observed_points), multiples of the current
    value that lie between, and for percents all steps of five, for years every year, for others from zero up 15 points in equal ratios. Counts are whole numbers."""
    none = F.array().cast("array<double>")
    first, last = F.ceil(low), F.floor(high)
    years = F.when(first <= last, F.transform(F.sequence(first, last), lambda y: y.cast("double")))
    start = F.greatest(low, F.coalesce(least_positive, high))
    ratio = F.ln(high) - F.ln(start)
    logs = F.when((low >= 0) & (high > 0) & (start > 0) & (high > start), F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.exp(F.ln(start) + k * ratio / 14)))
    steps = F.when(unit.eqNullSafe("percent"), F.array(*[F.lit(float(p)) for p in range(0, 101, 5)])).when(unit.eqNullSafe("year"), years).otherwise(logs)
    multiples = F.transform(F.array(*[F.lit(m) for m in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.1, 1.25, 1.5, 2.0, 4.0, 10.0)]), lambda m: current * m)
    multiples = F.filter(multiples, lambda x: (x >= low) & (x <= high))
    every = F.concat(F.array(low, high), *[F.coalesce(x, none) for x in (observed, steps, multiples)])
    whole = unit.eqNullSafe("count")
    every = F.transform(every, lambda x: F.when(whole, F.rint(F.greatest(low, F.least(high, x)))).otherwise(F.greatest(low, F.least(high, x))))
    now = F.when(whole, F.signum(current) * F.floor(F.abs(current))).otherwise(current)
    return F.filter(F.array_sort(F.array_distinct(every)), lambda x: x.isNotNull() & ~x.eqNullSafe(now))
