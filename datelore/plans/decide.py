"""Queries: ranks, percentiles, resilience scores, scenarios, shares and allocations over the financial view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import allocate, asof, ranking
from datelore.plans import views

FUND_CENTS, MAX_COMPANIES = 100_000_000_00 + 7, 25
_PARTS = {"margin": ("p_margin", 0.5), "balance": ("p_balance", 0.3), "debt": ("p_debt", 0.2)}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.financials(spark, sf_dir).select("company_cik", "industry", "sector", F.round(F.col("balance") / 100, 4).alias("score"), "units", "revenue")
    return rows.withColumn("coverage", F.when(F.col("units").isNull(), 0.0).otherwise(F.round(F.pmod(F.crc32(F.col("company_cik").cast("binary")), F.lit(100)) / 100, 2)))


def rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(views.financials(spark, sf_dir).select("company_cik", "balance"), "balance", "company_cik")


def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.financials(spark, sf_dir).select("company_cik", "balance", "revenue")
    return ranking.rank_change(rows, "balance", "revenue", "company_cik")


def percentile_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    both = ranking.percentiles(ranking.percentiles(parts, "p_size", True, "best_high"), "p_size", False, "best_low")
    return both.select("p_partkey", F.round("best_high", 9).alias("best_high"), F.round("best_low", 9).alias("best_low"))


def resilience(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.financials(spark, sf_dir).select(
        "company_cik", F.round(asof.ratio("cost", "revenue"), 9).alias("margin"), F.when(F.col("balance") > 0, F.col("balance")).alias("balance"), F.round(asof.ratio("balance", "units"), 9).alias("debt")
    )
    for name, up in (("margin", True), ("balance", True), ("debt", False)):
        rows = ranking.percentiles(rows, name, up, f"p_{name}")
    return rows.select("company_cik", F.round(ranking.weighted(_PARTS, least=2), 6).alias("objective_score"))


def reweighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.financials(spark, sf_dir).select("company_cik", F.col("balance").alias("financial"), F.col("cost").alias("climate")).unpivot("company_cik", ["financial", "climate"], "category", "contribution")
    found = ranking.reweighted(long, "company_cik", {"financial": 1.5, "climate": 0.25}, 10.0)
    return found.select("company_cik", F.round("raw", 4).alias("raw"), F.round("personalized", 4).alias("personalized"))


def sector_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.financials(spark, sf_dir).withColumn("after", ranking.capped_scenario("units", 1.2, 40000.0))
    found = ranking.shares(rows, "sector", "units", "after")
    split = ranking.remainder_split(found.where("sum_before is not null"), "share_before", "sector", 100_000_000_000)
    return split.select("sector", F.round("share_before", 9).alias("share_before"), F.round("share_after", 9).alias("share_after"), "direction", "cents")


def scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.financials(spark, sf_dir).unpivot("company_cik", ["revenue", "cost", "units", "balance"], "feature_name", "value")
    found = ranking.adjusted(long, [("revenue", "percent", 10.0), ("cost", "add", -5.0), ("units", "set", 100.0)])
    return found.select("company_cik", "feature_name", F.round("new_value", 4).alias("new_value"), "outcome")


def search_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.financials(spark, sf_dir).select("company_cik", F.lit("balance").alias("feature_name"), F.col("balance").alias("value"))
    ranges = ranking.observed_points(long, spark.createDataFrame([("balance", 0.0, 9000.0)], "feature_name string, low double, high double"))
    values = ranking.value_grid(F.col("value"), F.col("low"), F.col("high"), F.col("observed"), F.col("least_positive"), F.lit("usd"))
    grid = long.join(F.broadcast(ranges), "feature_name").select("company_cik", F.explode(values).alias("candidate"))
    gap = F.abs(F.col("candidate") - 4321.0)
    return grid.groupBy("company_cik").agg(F.count(F.lit(1)).alias("n"), F.round(F.min_by("candidate", F.struct(gap, "candidate")), 4).alias("best"))


def greedy_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = allocate.eligible(_scored(spark, sf_dir), 0.1)
    return allocate.greedy(rows, "score", "company_cik", "industry", FUND_CENTS, MAX_COMPANIES, 0.07, 0.12).select("company_cik", "industry", "rank", "amount_cents")


def equal_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = allocate.eligible(_scored(spark, sf_dir), 0.1)
    return allocate.equal(rows, "score", "company_cik", "industry", FUND_CENTS, MAX_COMPANIES, 0.2, 0.12).select("company_cik", "industry", "rank", "amount_cents")


def top_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.top_share(_scored(spark, sf_dir), "score", "company_cik", 0.25).select("company_cik", "score")


QUERIES = {
    "e10_rank": rank_rows, "e11_rank_changes": rank_changes, "e12_percentile_ties": percentile_ties, "e13_resilience": resilience, "d25_reweighting": reweighting,
    "d27_sector_shares": sector_shares, "h33_scenario": scenario, "h36_search_grid": search_grid, "e14_greedy_allocation": greedy_allocation,
    "e15_equal_allocation": equal_allocation, "e17_top_quarter": top_quarter,
}

_F = views.with_views("v_financials")


def _percentile(column: str, name: str, up: bool, of: str) -> str:
    middle = f"(rank() OVER (ORDER BY {column}) - 1 + (count(*) OVER (PARTITION BY {column}) - 1) / 2) / greatest(count(*) OVER () - 1, 1)"
    return f"p_{name} AS (SELECT company_cik, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE {middle if up else '1 - ' + middle} END AS p_{name} FROM {of} WHERE {column} IS NOT NULL)"


#: crc32 of a company's id, digit by digit.
_CRC = """, crc_table AS (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)), crc AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
        h AS (SELECT company_cik, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(company_cik, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM v_financials, crc)"""

ORACLE_SQL = {
    "e14_greedy_allocation": _F + _CRC + """, e AS (SELECT company_cik, industry, round(balance / 100, 4) AS s FROM v_financials JOIN h USING (company_cik) WHERE units IS NOT NULL AND crc % 100 >= 10),
        k AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY s DESC, company_cik) AS k FROM e), w AS (SELECT *, least(700000000, 1200000000 - (k - 1) * 700000000) AS want FROM k WHERE k <= 2 ORDER BY s DESC, company_cik LIMIT 25),
        r AS (SELECT *, row_number() OVER (ORDER BY s DESC, company_cik) AS rank, coalesce(sum(want) OVER (ORDER BY s DESC, company_cik ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
        SELECT company_cik, industry, CAST(rank AS INTEGER) AS rank, CAST(least(want, 10000000007 - before) AS BIGINT) AS amount_cents FROM r WHERE before < 10000000007""",
    "e10_rank": _F + " SELECT company_cik, balance, row_number() OVER (ORDER BY balance DESC, company_cik) AS rank FROM v_financials",
    "e11_rank_changes": _F + """ SELECT company_cik, balance, revenue, a AS rank_before, b AS rank_after, a - b AS rank_change FROM (SELECT *, row_number() OVER (ORDER BY balance DESC NULLS LAST, company_cik) AS a,
        row_number() OVER (ORDER BY revenue DESC NULLS LAST, company_cik) AS b FROM v_financials)""",
    "e12_percentile_ties": """SELECT p_partkey, round(m, 9) AS best_high, round(1 - m, 9) AS best_low FROM (SELECT p_partkey,
        (rank() OVER (ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_size) - 1) / 2) / (count(*) OVER () - 1) AS m FROM part)""",
    "e13_resilience": _F + ", r AS (SELECT company_cik, CASE WHEN revenue > 0 THEN round(cost / revenue, 9) END AS margin, CASE WHEN balance > 0 THEN balance END AS balance, CASE WHEN units > 0 THEN round(balance / units, 9) END AS debt FROM v_financials), "
        + ", ".join([_percentile("margin", "margin", True, "r"), _percentile("balance", "balance", True, "r"), _percentile("debt", "debt", False, "r")])
        + """ SELECT company_cik, CASE WHEN (p_margin IS NOT NULL)::INT + (p_balance IS NOT NULL)::INT + (p_debt IS NOT NULL)::INT >= 2 THEN
        round((coalesce(p_margin * .5, 0) + coalesce(p_balance * .3, 0) + coalesce(p_debt * .2, 0)) / (CASE WHEN p_margin IS NULL THEN 0 ELSE .5 END + CASE WHEN p_balance IS NULL THEN 0 ELSE .3 END + CASE WHEN p_debt IS NULL THEN 0 ELSE .2 END), 6) END AS objective_score
        FROM r LEFT JOIN p_margin USING (company_cik) LEFT JOIN p_balance USING (company_cik) LEFT JOIN p_debt USING (company_cik)""",
    "d25_reweighting": _F + " SELECT company_cik, round(balance + cost + 10, 4) AS raw, round(1.5 * balance + .25 * cost + 10, 4) AS personalized FROM v_financials",
    "d27_sector_shares": _F + """, a AS (SELECT sector, sum(units) AS b, sum(CASE WHEN units IS NOT NULL THEN least(40000.0, units * 1.2) END) AS a FROM v_financials GROUP BY 1),
        s AS (SELECT sector, b / sum(b) OVER () AS sb, a / sum(a) OVER () AS sa FROM a),
        f AS (SELECT *, CAST(floor(sb * 100000000000) AS BIGINT) AS fl, sb * 100000000000 - floor(sb * 100000000000) AS fr FROM s)
        SELECT sector, round(sb, 9) AS share_before, round(sa, 9) AS share_after, CASE WHEN abs(sa - sb) <= 1e-12 THEN 'unchanged' WHEN sa > sb THEN 'up' ELSE 'down' END AS direction,
        CAST(fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, sector) <= 100000000000 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS cents FROM f""",
    "h33_scenario": _F + """, l AS (SELECT company_cik, 'revenue' AS feature_name, revenue AS value FROM v_financials UNION ALL SELECT company_cik, 'cost', cost FROM v_financials
        UNION ALL SELECT company_cik, 'units', units FROM v_financials UNION ALL SELECT company_cik, 'balance', balance FROM v_financials),
        n AS (SELECT *, CASE feature_name WHEN 'revenue' THEN value * (1 + 10.0 / 100) WHEN 'cost' THEN value - 5 WHEN 'units' THEN 100.0 ELSE value END AS nv FROM l)
        SELECT company_cik, feature_name, round(nv, 4) AS new_value, CASE WHEN feature_name = 'balance' OR nv = value THEN 'unchanged' WHEN nv IS NULL THEN 'missing_base' ELSE 'changed' END AS outcome FROM n""",
    "e17_top_quarter": _F + " SELECT company_cik, round(balance / 100, 4) AS score FROM v_financials QUALIFY row_number() OVER (ORDER BY round(balance / 100, 4) DESC, company_cik) <= ceil(count(*) OVER () * .25)",
}
