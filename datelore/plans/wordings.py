"""Queries: how numbers are worded, over the prices and quantities of lines and the texts of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.functions import wording
from datelore.plans import views

#: Some units of quantities, and topics to look for.
QUANTITIES = {"gwh": ("MWh", "1000"), "kwh": ("MWh", "0.001"), "m3": ("m3", "1"), "metric tons": ("t", "1"), "percent": ("%", "1")}
TOPICS = {"license": "license", "link": "https?://", "address": "@[a-z]", "number": "[0-9]{3}"}


def _one_of(number: Column, values: list) -> Column:
    """The value at a number's remainder."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def hedged(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.format_number(F.col("l_quantity") * 1000, 0)
    raw = _one_of(F.col("l_partkey"), [F.concat(F.lit("about "), whole), F.concat(F.lit("FY"), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0")), "Zero", F.concat(F.lit("More than "), whole), "overall 5", F.concat(F.lit("≈ "), F.format_number(F.col("l_extendedprice"), 2))])
    items = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", wording.hedged_number(F.col("raw")).alias("number"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _one_of(F.col("l_partkey"), ["5 million", "7k", "3 bn", "12", "9 Thousand"])
    of_unit = _one_of(F.col("l_suppkey"), [1.0, 1000.0, 1e6])
    found = views.table(spark, sf_dir, "lineitem").select(raw.alias("raw"), of_unit.alias("of_unit"))
    return found.withColumn("factor", wording.agreed_factor(F.col("of_unit"), wording.magnitude(F.col("raw")))).groupBy("raw", "of_unit", "factor").agg(F.count(F.lit(1)).alias("n"))


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, unit = _one_of(F.col("l_partkey"), ["1,234.5", "12,34", "-7", "x", "1.2.3"]), _one_of(F.col("l_suppkey"), ["GWh", "m3", "Metric  tons", "furlong"])
    found = views.table(spark, sf_dir, "lineitem").select(raw.alias("raw"), unit.alias("of"), wording.quantity(raw, unit, QUANTITIES).alias("q"))
    return found.groupBy("raw", "of", F.col("q.value").cast("double").alias("value"), "q.unit", "q.status").agg(F.count(F.lit(1)).alias("n"))


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = _one_of(F.col("l_partkey"), ["Amounts in $ millions", "(Dollars in thousands)", "Net sales", "in millions and in billions", "In millions, except shares in thousands"])
    context = _one_of(F.col("l_suppkey"), ["All figures in billions", ""])
    found = views.table(spark, sf_dir, "lineitem").select(block.alias("block"), context.alias("context"), wording.currency_scale(block, context).alias("c"))
    return found.groupBy("block", "context", "c.scale", "c.status").agg(F.count(F.lit(1)).alias("n"))


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.format_number(F.col("l_extendedprice"), 2)
    quote = F.concat(F.lit("Net | "), _one_of(F.col("l_partkey"), [printed, F.concat(F.lit("("), printed, F.lit(")")), "—"]), F.lit(" | n/a"))
    value = _one_of(F.col("l_suppkey"), [F.col("l_extendedprice"), -F.col("l_extendedprice"), F.lit(0.0), F.round(F.col("l_extendedprice") * 1000, 2)])
    held = wording.row_supports(quote, value, _one_of(F.col("l_suppkey"), [1, 1, 1, 1000]), F.col("l_linenumber") == 1)
    return views.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 3).alias("printed_as"), (F.col("l_suppkey") % 4).alias("claimed"), (F.col("l_linenumber") == 1).alias("is_outflow"), held.alias("is_supported")).agg(F.count(F.lit(1)).alias("n"))


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.format_number(F.col("l_extendedprice"), 2)
    quote, raw = F.concat(F.lit("Total "), shown, F.lit(" of v1.99 at 12 %")), _one_of(F.col("l_partkey"), [F.translate(shown, ",", ""), "12%", "99", "n/a"])
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", wording.printed_token(quote, raw).alias("token"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.table(spark, sf_dir, "documents").select("doc_id", wording.context_of(F.col("text"), F.lit("license")).alias("quote"))
    return found.where("quote is not null").select("doc_id", F.length("quote").alias("n_chars"), F.md5("quote").alias("digest"))


def decreases(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = _one_of(F.col("l_partkey"), ["Emissions fell 1,200 t", "Reduced by 12.5 %", "It rose by 1,200", "decreased 7 and 7", "4 ↓"])
    raw, size = _one_of(F.col("l_partkey"), ["1200", "-12.5", "1200", "7", "4"]), _one_of(F.col("l_partkey"), [1200.0, 12.5, 1200.0, 7.0, 5.0])
    found = views.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).alias("kind"), (F.col("l_suppkey") % 2).alias("sign"), wording.decrease(quote, raw, F.when(F.col("l_suppkey") % 2 == 0, -size).otherwise(size)).alias("d"))
    return found.groupBy("kind", "sign", F.col("d.raw").alias("raw"), F.col("d.scale").alias("scale")).agg(F.count(F.lit(1)).alias("n"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = _one_of(F.col("l_partkey"), ["Use\nat least 1,200 t", "1,200 t\nless than 5", "> 1200 t", "1,200 and\nmore than 1,200", "about 1,200"])
    held = wording.is_bound(quote, _one_of(F.col("l_suppkey"), ["1200", "77"]))
    return views.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 5).alias("kind"), (F.col("l_suppkey") % 2).alias("of"), held.alias("is_bound")).agg(F.count(F.lit(1)).alias("n"))


def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cover lines, one in nine without a year; a customer's year holds where all its lines of a priority name the same."""
    line = F.concat(F.lit("Form 10-K for the fiscal year ended "), F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise("soon"))
    named = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", wording.fiscal_year(line).alias("y"))
    return named.groupBy("o_custkey", "o_orderpriority").agg(F.when(F.min("y") == F.max("y"), F.min("y")).alias("fiscal_year"), F.count("y").alias("n_lines"))


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(wording.topics(F.col("text"), TOPICS), ",").alias("topics"))


def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus"))).alias("kinds"))
    return sets.select("o_custkey", wording.allowed_only(F.col("kinds"), ("F", "O")).alias("is_allowed"))


QUERIES = {
    "h09_hedged_numbers": hedged, "h10_factors_agreed": factors, "h07_quantities": quantities, "h37_currency_scales": scales, "h12_rows_supported": supported, "h15_printed_tokens": printed,
    "h16_contexts": contexts, "h38_decreases": decreases, "b57_bounds": bounds, "h18_fiscal_years": fiscal_years, "h20_topics": touched, "h32_allowed_only": allowed,
}

ORACLE_SQL = {
    "h09_hedged_numbers": """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN 2000.0 + l_suppkey % 100 WHEN 2 THEN 0.0 WHEN 3 THEN l_quantity * 1000 WHEN 5 THEN l_extendedprice END AS number FROM lineitem""",
    "h10_factors_agreed": """WITH w AS (SELECT ['5 million', '7k', '3 bn', '12', '9 Thousand'][l_partkey % 5 + 1] AS raw, [1e6, 1e3, 1e9, 1.0, 1e3][l_partkey % 5 + 1] AS m, [1.0, 1000.0, 1e6][l_suppkey % 3 + 1] AS of_unit FROM lineitem)
        SELECT raw, of_unit, CASE WHEN m = 1 OR m = of_unit THEN of_unit WHEN of_unit = 1 THEN m END AS factor, count(*) AS n FROM w GROUP BY ALL""",
    "h07_quantities": """WITH w AS (SELECT ['1,234.5', '12,34', '-7', 'x', '1.2.3'][l_partkey % 5 + 1] AS raw, [1234.5, NULL, -7, NULL, NULL][l_partkey % 5 + 1] AS v, ['GWh', 'm3', 'Metric  tons', 'furlong'][l_suppkey % 4 + 1] AS "of", l_suppkey % 4 AS u FROM lineitem),
        t AS (SELECT *, v IS NOT NULL AND u <> 3 AS ok FROM w)
        SELECT raw, "of", CAST(CASE WHEN ok THEN v * CASE u WHEN 0 THEN 1000 ELSE 1 END END AS DOUBLE) AS value, CASE WHEN ok THEN ['MWh', 'm3', 't'][u + 1] END AS unit, CASE WHEN ok THEN 'source_linked' ELSE 'needs_review' END AS status, count(*) AS n FROM t GROUP BY ALL""",
    "h37_currency_scales": """WITH w AS (SELECT l_partkey % 5 AS b, l_suppkey % 2 AS c FROM lineitem)
        SELECT ['Amounts in $ millions', '(Dollars in thousands)', 'Net sales', 'in millions and in billions', 'In millions, except shares in thousands'][b + 1] AS block, ['All figures in billions', ''][c + 1] AS context,
        CASE WHEN b IN (0, 4) THEN 1e6 WHEN b = 1 THEN 1e3 WHEN b = 2 THEN CASE c WHEN 0 THEN 1e9 ELSE 1.0 END END AS scale, CASE WHEN b = 3 THEN 'several_scales' WHEN b = 2 AND c = 1 THEN 'unscaled' ELSE 'declared' END AS status, count(*) AS n FROM w GROUP BY ALL""",
    "h12_rows_supported": """WITH w AS (SELECT l_partkey % 3 AS k, l_suppkey % 4 AS s, l_linenumber = 1 AS o FROM lineitem)
        SELECT k AS printed_as, s AS claimed, o AS is_outflow, CASE WHEN k = 2 THEN s = 2 WHEN s = 2 THEN false WHEN o THEN true WHEN k = 0 THEN s IN (0, 3) ELSE s = 1 END AS is_supported, count(*) AS n FROM w GROUP BY ALL""",
    "h15_printed_tokens": "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN format('{:,.2f}', l_extendedprice) WHEN 1 THEN '12 %' WHEN 2 THEN '99' ELSE 'n/a' END AS token FROM lineitem",
    "h16_contexts": r"""WITH s AS (SELECT doc_id, string_split(text, 'license') AS x FROM documents), t AS (SELECT doc_id, array_to_string(string_split(x[1], chr(10))[-3:], chr(10)) AS h, array_to_string(string_split(x[2], chr(10))[:3], chr(10)) AS e FROM s WHERE len(x) = 2),
        q AS (SELECT doc_id, trim(CASE WHEN length(trim(h || 'license' || e)) <= 1600 THEN h || 'license' || e ELSE right(h, 700) || 'license' || left(e, 700) END) AS quote FROM t)
        SELECT doc_id, length(quote) AS n_chars, md5(quote) AS digest FROM q""",
    "h38_decreases": """WITH w AS (SELECT l_partkey % 5 AS kind, l_suppkey % 2 AS sign FROM lineitem)
        SELECT kind, sign, CASE WHEN sign = 0 THEN CASE kind WHEN 0 THEN '1,200' WHEN 1 THEN '12.5' END END AS raw, CASE WHEN sign = 0 AND kind < 2 THEN -1.0 END AS scale, count(*) AS n FROM w GROUP BY ALL""",
    "b57_bounds": "SELECT l_partkey % 5 AS kind, l_suppkey % 2 AS \"of\", l_suppkey % 2 = 0 AND l_partkey % 5 IN (0, 2) AS is_bound, count(*) AS n FROM lineitem GROUP BY ALL",
    "h18_fiscal_years": """WITH y AS (SELECT o_custkey, o_orderpriority, CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate) END AS y FROM orders)
        SELECT o_custkey, o_orderpriority, CASE WHEN min(y) = max(y) THEN min(y) END AS fiscal_year, count(y) AS n_lines FROM y GROUP BY ALL""",
    "h20_topics": """SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN contains(lower(text), 'http://') OR contains(lower(text), 'https://') THEN 'link' END,
        CASE WHEN regexp_matches(lower(text), '@[a-z]') THEN 'address' END, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'number' END) AS topics FROM documents""",
    "h32_allowed_only": """SELECT o_custkey, coalesce(bool_and(o_orderstatus IN ('F', 'O')) FILTER (o_orderkey % 4 <> 0), false) AS is_allowed FROM orders GROUP BY 1""",
}
