"""Queries: freshness, rollups, merged sources, sums of components, sets of what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import catalog
from datelore.plans import views

NOW = "1999-06-30 00:00:00"
_WANTED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviewed sources: some reviews run too long, some bytes have changed since, some tasks failed."""
    orders = views.table(spark, sf_dir, "orders").withColumn("checked", F.col("o_orderdate").cast("timestamp"))
    days = F.when(F.col("o_orderkey") % 11 == 0, 45).otherwise((F.col("o_orderkey") % 31).cast("int"))
    return orders.select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderkey") % 13 != 0, F.col("checked")).alias("checked"),
        (F.col("checked") + F.make_interval(days=days)).alias("until"), F.md5(F.col("o_orderstatus").cast("binary")).alias("reviewed"),
        F.md5(F.when(F.col("o_orderkey") % 7 == 0, F.lit("P")).otherwise(F.col("o_orderstatus")).cast("binary")).alias("served"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).withColumn("status", catalog.freshness("checked", "until", "reviewed", "served", F.lit(NOW).cast("timestamp")))


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_source"))


def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.rollup(_judged(spark, sf_dir), "o_custkey", "o_orderpriority", "status", "checked")
    return found.withColumn("last_check", F.date_format("last_check", "yyyy-MM-dd"))


def in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.all_categories(views.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", 5)


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_size") > 25, F.col("p_type")).alias("review"))
    stored, new = base.where("p_partkey % 3 <> 0"), base.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100)
    new = new.withColumn("review", F.when(F.col("p_partkey") % 4 == 0, F.lit("new")))
    return catalog.merged_source(stored, new, ["p_partkey"], ["p_brand", "p_size"], "review")


def sums_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    totals = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).otherwise(0)).alias("total"))
    return catalog.components_add_up(items, totals, ["l_orderkey"], "l_linenumber", "l_quantity", "total")


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.missing_items(views.companies(spark, sf_dir), "company_cik", views.observations(spark, sf_dir), "feature_name", _WANTED)
    return found.select("company_cik", F.array_join("missing", ",").alias("missing"))


def to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rest = catalog.partitioned(views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), views.table(spark, sf_dir, "orders").where("o_orderdate >= '2001-01-01'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return rest


QUERIES = {
    "b16_freshness": fresh, "d29_catalog_rollup": rolled_up, "d06_in_all_categories": in_all, "a31_merged_sources": merged_sources, "d34_sums_checked": sums_checked, "g03_missing_items": missing, "g05_to_fetch": to_fetch,
}

_S = f"""WITH s AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS checked, CASE WHEN o_orderkey % 11 = 0 THEN 45 ELSE o_orderkey % 31 END AS days, o_orderdate,
    o_orderkey % 7 = 0 AND o_orderstatus <> 'P' AS changed FROM orders),
    j AS (SELECT *, CASE WHEN checked IS NULL THEN 'none' WHEN days > 30 THEN 'invalid' WHEN changed THEN 'changed' WHEN o_orderdate + to_days(CAST(days AS INTEGER)) <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'verified' END AS status FROM s)"""
ORACLE_SQL = {
    "b16_freshness": _S + " SELECT o_orderpriority, status, count(*) AS n, min(o_orderkey) AS first_source FROM j GROUP BY ALL",
    "d29_catalog_rollup": _S + """ SELECT o_custkey, o_orderpriority, count(*) AS n, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (status = 'expired') AS n_open,
        arg_min(status, CASE status WHEN 'failed' THEN 1 WHEN 'expired' THEN 2 WHEN 'pending' THEN 3 WHEN 'changed' THEN 4 WHEN 'verified' THEN 5 END) AS status, strftime(max(checked), '%Y-%m-%d') AS last_check FROM j GROUP BY ALL""",
    "d06_in_all_categories": "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5",
    "a31_merged_sources": """WITH b AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size > 25 THEN p_type END AS review FROM part)
        SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_partkey % 4 = 0 THEN 'new' WHEN p_partkey % 3 <> 0 THEN review END AS review FROM b WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""",
    "d34_sums_checked": """SELECT l_orderkey, sum(CASE WHEN l_linenumber < 7 THEN l_quantity ELSE 0 END) AS total, count(*) AS n_parts,
        count(*) BETWEEN 2 AND 3 AND count(*) = count(DISTINCT l_linenumber) AND sum(l_quantity) = sum(CASE WHEN l_linenumber < 7 THEN l_quantity ELSE 0 END) AS adds_up FROM lineitem GROUP BY 1""",
    "g03_missing_items": views.with_views("v_company", "v_observation") + """ SELECT company_cik, concat_ws(',', CASE WHEN NOT coalesce(bool_or(feature_name = '1-URGENT'), false) THEN '1-URGENT' END, CASE WHEN NOT coalesce(bool_or(feature_name = '2-HIGH'), false) THEN '2-HIGH' END,
        CASE WHEN NOT coalesce(bool_or(feature_name = '3-MEDIUM'), false) THEN '3-MEDIUM' END) AS missing FROM v_company LEFT JOIN v_observation USING (company_cik) GROUP BY 1""",
    "g05_to_fetch": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')",
}
