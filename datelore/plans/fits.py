"""Queries: additive scores, contributions, trees and one-field search over the financial view and the scores of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import allocate, models, ranking, serving, splits, training
from datelore.plans import views

FEATURES = ["n_orders", "mean_price", "last_year"]
UNITS = {"n_orders": "count", "mean_price": "usd", "last_year": "year"}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with features of their orders; the price is missing for those with few."""
    orders = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.when(F.count(F.lit(1)) > 5, F.round(F.avg("o_totalprice"), 2)).alias("mean_price"), F.max(F.year("o_orderdate")).cast("double").alias("last_year"))
    customers = views.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("label"))
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


def _long(rows: DataFrame) -> DataFrame:
    return rows.unpivot("c_custkey", FEATURES, "feature_name", "value")


def additive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    terms, intercept = models.fit_additive(rows, FEATURES, "label")
    scores = models.score_additive(_long(rows), ["c_custkey"], terms, intercept)
    return ranking.ranked(scores.withColumn("score", F.round("score", 6)), "score", "c_custkey")


def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return models.score_trees(rows, FEATURES, models.fit_trees(rows, FEATURES, "label")).select("c_custkey", F.round("prediction", 6).alias("prediction"))


def warnings_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(_rows(spark, sf_dir))
    return models.range_warnings(long, models.training_ranges(long.where("c_custkey % 2 = 0")), ["c_custkey"])


def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    terms, intercept = models.fit_additive(rows, FEATURES, "label")
    long = _long(rows)
    ranges = ranking.observed_points(long, models.training_ranges(long))
    unit = F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), F.col("feature_name"))
    values = ranking.value_grid(F.col("value"), F.col("low"), F.col("high"), F.col("observed"), F.col("least_positive"), unit)
    found = models.search_one_field(long, ranges, values, ["c_custkey"], terms, intercept, 5000.0)
    return found.select("c_custkey", "feature_name", F.round("candidate", 4).alias("candidate"), F.round("gap", 4).alias("gap"))


def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the chosen model on the test companies, by how many of their features are there."""
    rows = splits.group_folds(_rows(spark, sf_dir), "c_custkey", 2, 0.2, 11)
    run = training.train(rows, "c_custkey", {"n_orders": "core", "mean_price": "core", "last_year": "climate"}, "label", "fold", {"bins": [4, 8], "ridge": [0.1, 1.0]})
    if run.test is None:
        return spark.createDataFrame([], "coverage_bin int, mae double, rmse double, n long, feature_set string, configuration string")
    share = sum((F.col(f).isNotNull().cast("int") for f in FEATURES), F.lit(0)) / len(FEATURES)
    told = run.test.join(_rows(spark, sf_dir).select("c_custkey", training.coverage_bin(share).alias("coverage_bin")), "c_custkey")
    found = splits.errors(told, ["coverage_bin"], "label", "predicted")
    return found.select("coverage_bin", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), "n").withColumns({"feature_set": F.lit(run.feature_set), "configuration": F.lit(run.configuration)})


def scenario_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers before and after a capped scenario: scores, ranks and their change."""
    rows = views.financials(spark, sf_dir).select("company_cik", "sector", F.coalesce("units", F.lit(0.0)).alias("units"), "balance")
    both = rows.select("company_cik", "sector", (F.col("units") + F.col("balance")).alias("before"), (F.least(F.lit(20000.0), F.col("units") * 1.5) + F.col("balance")).alias("after"))
    return ranking.rank_change(both, "before", "after", "company_cik").select("company_cik", "rank_before", "rank_after", "rank_change")


def scenario_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fund split before and after a scenario, under the same caps."""
    rows = views.financials(spark, sf_dir).select("company_cik", "industry", F.col("balance").alias("before"), (F.col("balance") * F.when(F.col("sector") == "ASIA", 1.5).otherwise(1.0)).alias("after"))
    parts = [allocate.greedy(rows, v, "company_cik", "industry", 1_000_003, 12, 0.1, 0.2).select("company_cik", "amount_cents", F.lit(v).alias("variant")) for v in ("before", "after")]
    return parts[0].unionByName(parts[1])


_INF = float("inf")
#: Terms of two models by range, an unknown value's first, and their intercepts.
SERVED = [
    ("esg", None, 0, None, None, 50.0), ("esg", "units", 0, None, None, -1.0), ("esg", "units", 1, -_INF, 20000.0, 0.5), ("esg", "units", 2, 20000.0, _INF, 2.0), ("esg", "balance", 0, None, None, 0.0),
    ("esg", "balance", 1, -_INF, 4000.0, -3.0), ("esg", "balance", 2, 4000.0, _INF, 3.25), ("csa", None, 0, None, None, 40.0), ("csa", "balance", 0, None, None, -1.0), ("csa", "balance", 1, -_INF, 1000.0, 1.0), ("csa", "balance", 2, 1000.0, _INF, -1.5),
    ("csa", "revenue", 0, None, None, 0.0), ("csa", "revenue", 1, -_INF, 1.5e7, 2.0), ("csa", "revenue", 2, 1.5e7, _INF, 4.0),
]


def _served(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.financials(spark, sf_dir)
    return rows.unpivot(["company_cik", "sector"], ["revenue", "units", "balance"], "feature_name", "value"), spark.createDataFrame(SERVED, serving.TERMS)


def all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company by two models at once."""
    long, terms = _served(spark, sf_dir)
    return serving.scores_by_target(long, ["company_cik"], terms)


def cohort_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies of two regions, ranked by both models before and after categories are weighed."""
    long, terms = _served(spark, sf_dir)
    found = serving.cohort_ranking(long, "company_cik", terms, {"units": "operations", "balance": "finance"}, {"finance": 2.0, "operations": 0.5}, F.col("sector").isin("ASIA", "EUROPE"))
    return found.withColumns({"raw": F.round("raw", 6), "personalized": F.round("personalized", 6)})


def scenario_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' scores of every company before and after its balance rises by half and its revenue falls, and whether the models agree."""
    long, terms = _served(spark, sf_dir)
    changed = F.when(F.col("feature_name") == "balance", F.col("value") * 1.5).when(F.col("feature_name") == "revenue", F.col("value") * 0.9).otherwise(F.col("value"))
    found = serving.agreement(serving.scenario_scores(long, ["company_cik"], terms, changed), ["company_cik"], "target")
    return found.withColumn("ensemble", F.round("ensemble", 6))


QUERIES = {"k08_all_targets": all_targets, "k10_cohort_ranks": cohort_ranks, "k11_models_agree": scenario_of_models, "k07_training_run": training_run, "k12_scenario_ranks": scenario_ranks, "k14_scenario_portfolios": scenario_portfolios, "k09_additive_scores": additive_scores, "k08_tree_scores": tree_scores, "b29_range_warnings": warnings_of_range, "k11_field_search": field_search}

_GREEDY = """SELECT company_cik, CAST(least(want, 1000003 - coalesce(sum(want) OVER (ORDER BY s DESC, company_cik ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS amount_cents, '{v}' AS variant
        FROM (SELECT *, least(100000, 200000 - (k - 1) * 100000) AS want FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY s DESC, company_cik) AS k FROM {v}) WHERE k <= 2 ORDER BY s DESC, company_cik LIMIT 12)"""

_ESG = "CASE WHEN {u} IS NULL THEN -1.0 WHEN {u} < 20000 THEN 0.5 ELSE 2.0 END"
_ESG_B = "CASE WHEN {b} IS NULL THEN 0.0 WHEN {b} < 4000 THEN -3.0 ELSE 3.25 END"
_CSA_B = "CASE WHEN {b} IS NULL THEN -1.0 WHEN {b} < 1000 THEN 1.0 ELSE -1.5 END"
_CSA_R = "CASE WHEN {r} IS NULL THEN 0.0 WHEN {r} < 15000000 THEN 2.0 ELSE 4.0 END"


def _of(term: str, after: bool = False) -> str:
    return term.format(u="units", b="balance * 1.5" if after else "balance", r="revenue * 0.9" if after else "revenue")


ORACLE_SQL = {
    "k08_all_targets": views.with_views("v_financials") + f""" SELECT company_cik, 'esg' AS target, CAST(50 + {_of(_ESG)} + {_of(_ESG_B)} AS DOUBLE) AS score, 2 AS n_features, (units IS NULL)::INT + (balance IS NULL)::INT AS n_missing FROM v_financials
        UNION ALL SELECT company_cik, 'csa', CAST(40 + {_of(_CSA_B)} + {_of(_CSA_R)} AS DOUBLE), 2, (balance IS NULL)::INT + (revenue IS NULL)::INT FROM v_financials""",
    "k10_cohort_ranks": views.with_views("v_financials") + f""", s AS (SELECT company_cik, 'esg' AS target, CAST(50 + {_of(_ESG)} + {_of(_ESG_B)} AS DOUBLE) AS raw, CAST(50 + 0.5 * {_of(_ESG)} + 2 * {_of(_ESG_B)} AS DOUBLE) AS personalized FROM v_financials WHERE sector IN ('ASIA', 'EUROPE')
        UNION ALL SELECT company_cik, 'csa', CAST(40 + {_of(_CSA_B)} + {_of(_CSA_R)} AS DOUBLE), CAST(40 + 2 * {_of(_CSA_B)} + {_of(_CSA_R)} AS DOUBLE) FROM v_financials WHERE sector IN ('ASIA', 'EUROPE')),
        r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY raw DESC, company_cik) AS rank_before, row_number() OVER (PARTITION BY target ORDER BY personalized DESC, company_cik) AS rank_after FROM s)
        SELECT *, rank_before - rank_after AS rank_change FROM r""",
    "k11_models_agree": views.with_views("v_financials") + f""", d AS (SELECT company_cik, CAST({_of(_ESG_B, True)} - {_of(_ESG_B)} AS DOUBLE) AS e, CAST({_of(_CSA_B, True)} - {_of(_CSA_B)} + {_of(_CSA_R, True)} - {_of(_CSA_R)} AS DOUBLE) AS c FROM v_financials)
        SELECT company_cik, round((e + c) / 2, 6) AS ensemble, CASE WHEN sign(e) <> sign(c) THEN 'disagree' WHEN e > 0 THEN 'up' WHEN e < 0 THEN 'down' ELSE 'unchanged' END AS direction, 2 AS n_families FROM d""",
    "k12_scenario_ranks": views.with_views("v_financials") + """ SELECT company_cik, a AS rank_before, b AS rank_after, a - b AS rank_change FROM (SELECT company_cik, row_number() OVER (ORDER BY coalesce(units, 0) + balance DESC, company_cik) AS a,
        row_number() OVER (ORDER BY least(20000.0, coalesce(units, 0) * 1.5) + balance DESC, company_cik) AS b FROM v_financials)""",
    "k14_scenario_portfolios": views.with_views("v_financials") + ", before AS (SELECT company_cik, industry, balance AS s FROM v_financials), after AS (SELECT company_cik, industry, balance * CASE WHEN sector = 'ASIA' THEN 1.5 ELSE 1.0 END AS s FROM v_financials) "
        + "SELECT * FROM (" + _GREEDY.format(v="before") + " UNION ALL " + _GREEDY.format(v="after") + ") WHERE amount_cents > 0",
    "b29_range_warnings": """WITH r AS (SELECT c_custkey, CAST(count(o_orderkey) AS DOUBLE) AS n, CASE WHEN count(o_orderkey) > 5 THEN round(avg(o_totalprice), 2) END AS p, CAST(max(year(o_orderdate)) AS DOUBLE) AS y, count(o_orderkey) AS k
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
        l AS (SELECT c_custkey, 'n_orders' AS feature_name, CASE WHEN k > 0 THEN n END AS value FROM r UNION ALL SELECT c_custkey, 'mean_price', p FROM r UNION ALL SELECT c_custkey, 'last_year', y FROM r),
        g AS (SELECT feature_name, min(value) AS low, max(value) AS high FROM l WHERE c_custkey % 2 = 0 GROUP BY 1)
        SELECT c_custkey, feature_name, value, CASE WHEN value < low THEN 'below' ELSE 'above' END AS warning FROM l JOIN g USING (feature_name) WHERE value < low OR value > high""",
}
