"""Extracted values against their evidence: citations, quotes, numbers, ranges, families and endpoints; trend scores from dated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.functions.text import numbers_in, reported_number, source_text


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether two numbers differ by no more than a tolerance, relative to the larger one, or absolute."""
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def check_evidence(values: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """values (value_id, key, cited, quote, raw, scale, value, unit) with the reason for which each is rejected, or null.

    The first rule that fails tells: no_citation, unknown_line (a cited line_no that the document does not have), out_of_order, quote_not_in_lines, number_not_in_quote,
    value_differs (from raw times scale), out_of_range (a percentage above 100), negative, duplicate (an equal value of the same document that comes first).
    Citations meet lines by an equi-join; texts are compared without layout, tags and digit grouping.
    """
    cited = values.select("value_id", key, F.posexplode("cited").alias("_at", "line_no"))
    found = cited.join(lines.select(key, "line_no", "line"), [key, "line_no"], "left")
    text = found.groupBy("value_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("line").alias("_known"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"]), " ").alias("_text")
    )
    both = values.join(text, "value_id", "left")
    number = reported_number(F.col("raw"))
    again = F.row_number().over(Window.partitionBy(key, "quote", "raw", "unit").orderBy("value_id")) > 1
    reason = (
        F.when(F.col("_n").isNull(), "no_citation").when(F.col("_known") < F.col("_n"), "unknown_line").when(F.array_sort("cited") != F.col("cited"), "out_of_order")
        .when(~source_text(F.col("_text")).contains(source_text(F.col("quote"))), "quote_not_in_lines")
        .when(number.isNull() | ~F.array_contains(F.transform(numbers_in(F.col("quote")), lambda x: x.cast("double")), number), "number_not_in_quote")
        .when(~F.coalesce(close(F.col("value"), number * F.col("scale")), F.lit(False)), "value_differs").when((F.col("unit") == "percent") & (F.col("value") > 100), "out_of_range")
        .when(F.col("value") < 0, "negative").when(again, "duplicate")
    )
    return both.withColumn("reason", reason).drop("_n", "_known", "_text")


def family_valid(rows: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """rows with family_valid: one bad member makes all rows of its family (keys) invalid."""
    return rows.withColumn("family_valid", ~F.coalesce(F.bool_or(bad).over(Window.partitionBy(*keys)), F.lit(False)))


def endpoints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of long endpoints (keys, bound, value; bound is min, max or point): low and high, a point being both, and whether they are in order."""
    wide = rows.groupBy(*keys).pivot("bound", ["min", "max", "point"]).agg(F.max("value"))
    low, high = F.coalesce("point", "min"), F.coalesce("point", "max")
    status = F.when(low.isNull() & high.isNull(), "no_value").when(low > high, "out_of_order").otherwise("ok")
    return wide.select(*keys, low.alias("low"), high.alias("high"), status.alias("status"))


def trend_scores(rows: DataFrame, key: str, year: str, value: str, latest: int) -> DataFrame:
    """(key, current, base_year, rate, score) for keys with a value in the latest year: the nearest earlier year with a value is the base, and if that value is zero there is no trend.

    rate is the annualised reduction in percent, 100 * (1 - (current / base) ** (1 / years)), and the score 50 + 5 * rate from 0 to 100. Negative values count as missing.
    """
    known = rows.where(F.col(value).isNotNull() & (F.col(value) >= 0))
    now = known.where(F.col(year) == latest).select(key, F.col(value).alias("current"))
    base = known.where(F.col(year) < latest).groupBy(key).agg(F.max(F.struct(F.col(year).alias("y"), F.col(value).alias("v"))).alias("b"))
    both = now.join(base, key, "left").select(key, "current", F.col("b.y").alias("base_year"), F.col("b.v").alias("_base"))
    rate = 100 * (1 - F.pow(F.try_divide(F.col("current"), F.when(F.col("_base") > 0, F.col("_base"))), F.lit(1.0) / (F.lit(latest) - F.col("base_year"))))
    score = F.when(F.col("rate").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 5 * F.col("rate"))))  # least and greatest pass nulls over
    return both.withColumn("rate", rate).withColumn("score", score).drop("_base")


def mean_of_available(rows: DataFrame, key: str, topic: str, score: str) -> DataFrame:
    """(key, score, n_topics): the mean of the topic means; missing topics are left out, not counted as zero."""
    return rows.groupBy(key, topic).agg(F.avg(score).alias("_m")).groupBy(key).agg(F.avg("_m").alias("score"), F.count("_m").alias("n_topics"))
