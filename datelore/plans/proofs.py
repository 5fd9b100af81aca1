"""Queries: values against evidence, families, endpoints and trend scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import evidence
from datelore.plans import views


def evidence_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each line that names a license, as an extracted value; every few have a wrong line, quote, number or value."""
    lines = views.lines(spark, sf_dir)
    raw = F.regexp_extract("line", r"(\d+(?:\.\d+)?)", 1)
    k = F.pmod(F.col("doc_id"), F.lit(7))
    values = lines.where(F.lower("line").contains("license")).select(
        F.concat_ws("/", "doc_id", "line_no").alias("value_id"), "doc_id", F.when(k == 1, F.array(F.col("line_no") + 100000)).when(k == 2, F.array().cast("array<int>")).otherwise(F.array("line_no")).alias("cited"),
        F.when(k == 3, F.concat("line", F.lit(" more"))).otherwise(F.upper("line")).alias("quote"), F.when(k == 4, "77").otherwise(raw).alias("raw"), F.lit(1.0).alias("scale"),
        F.when(k == 5, F.lit(-1.0)).otherwise(raw.try_cast("double")).alias("value"), F.lit("count").alias("unit"),
    )
    return evidence.check_evidence(values, lines, "doc_id").select("value_id", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders")
    found = evidence.family_valid(rows, ["o_custkey", "o_orderpriority"], F.col("o_totalprice") > 480000)
    return found.groupBy("o_custkey").agg(F.count_if("family_valid").alias("n_valid"), F.count_if(~F.col("family_valid")).alias("n_invalid"))


def endpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem")
    bound = F.when(F.col("l_linenumber") == 7, "point").when(F.col("l_linenumber") % 2 == 0, "min").otherwise("max")
    return evidence.endpoints(items.select("l_orderkey", bound.alias("bound"), F.col("l_quantity").alias("value")), ["l_orderkey"])


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = views.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y"), "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    each = None
    for flag in ("A", "N", "R"):
        one = evidence.trend_scores(yearly.where(F.col("l_returnflag") == flag), "l_suppkey", "y", "v", 2000).select("l_suppkey", F.lit(flag).alias("topic"), "score")
        each = one if each is None else each.unionByName(one)
    found = evidence.mean_of_available(each, "l_suppkey", "topic", "score")
    return found.select("l_suppkey", F.round("score", 4).alias("score"), "n_topics")


QUERIES = {"b34_evidence_checked": evidence_checked, "b37_families": families, "b53_endpoints": endpoint_rows, "h26_trend_scores": trends}

ORACLE_SQL = {
    "b34_evidence_checked": views.with_views("v_lines") + r""", v AS (SELECT doc_id || '/' || line_no AS value_id, doc_id, line_no, line, doc_id % 7 AS k, regexp_extract(line, '(\d+(?:\.\d+)?)', 1) AS raw FROM v_lines WHERE contains(lower(line), 'license')),
        o AS (SELECT *, CASE WHEN k = 1 THEN 'unknown_line' WHEN k = 2 THEN 'no_citation' WHEN k = 3 THEN 'quote_not_in_lines' WHEN k = 4 OR raw = '' THEN 'number_not_in_quote' WHEN k = 5 THEN 'value_differs' END AS r,
              row_number() OVER (PARTITION BY doc_id, CASE WHEN k = 3 THEN line || ' more' ELSE upper(line) END, CASE WHEN k = 4 THEN '77' ELSE raw END ORDER BY value_id) AS n FROM v)
        SELECT value_id, coalesce(r, CASE WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END) AS outcome FROM o""",
    "b37_families": """SELECT o_custkey, count(*) FILTER (NOT bad) AS n_valid, count(*) FILTER (bad) AS n_invalid FROM (SELECT o_custkey, bool_or(o_totalprice > 480000) OVER (PARTITION BY o_custkey, o_orderpriority) AS bad FROM orders) GROUP BY 1""",
    "b53_endpoints": """WITH w AS (SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 7) AS p, max(l_quantity) FILTER (l_linenumber <> 7 AND l_linenumber % 2 = 0) AS mn, max(l_quantity) FILTER (l_linenumber <> 7 AND l_linenumber % 2 = 1) AS mx FROM lineitem GROUP BY 1)
        SELECT l_orderkey, coalesce(p, mn) AS low, coalesce(p, mx) AS high, CASE WHEN coalesce(p, mn) > coalesce(p, mx) THEN 'out_of_order' ELSE 'ok' END AS status FROM w""",
    "h26_trend_scores": """WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, l_returnflag AS f, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
        b AS (SELECT l_suppkey, f, max(y) AS y, max_by(v, y) AS v FROM y WHERE y < 2000 AND v >= 0 GROUP BY ALL),
        s AS (SELECT l_suppkey, f, CASE WHEN b.v > 0 THEN greatest(0.0, least(100.0, 50 + 5 * (100 * (1 - pow(n.v / b.v, 1.0 / (2000 - b.y)))))) END AS score FROM (SELECT * FROM y WHERE y = 2000) n LEFT JOIN b USING (l_suppkey, f))
        SELECT l_suppkey, round(avg(CASE WHEN score IS NOT NULL THEN score END), 4) AS score, count(score) AS n_topics FROM s GROUP BY 1""",
}
