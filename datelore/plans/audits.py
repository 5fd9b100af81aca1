"""Queries: typed observations, audits of what is missing, labels, usage reports, links, catalog pages and scenario rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import asof, audits
from datelore.plans import views

_KEYS = ["company_cik", "as_of"]
#: A small registry over the test tables: (feature, data type, unit, category).
REGISTRY = (("1-URGENT", "number", "usd", "financial"), ("2-HIGH", "integer", "count", "social"), ("3-MEDIUM", "boolean", None, "social"), ("4-NOT SPECIFIED", "text", None, "context"), ("5-LOW", "number", "usd", "financial"))
_RATIOS = (("urgent_low", 0, "1-URGENT"), ("urgent_low", 1, "5-LOW"), ("high_low", 0, "2-HIGH"), ("high_low", 1, "5-LOW"))


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "feature_name string, data_type string, unit string, category string")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as typed observations: the priority decides the type, and one order in 53 has a value of the wrong one (for an integer one that is never whole)."""
    day, f, k = F.col("o_orderdate").cast("date"), F.col("o_orderpriority"), F.col("o_orderkey")
    odd = k % 53 == 0
    return views.table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("company_cik"), f.alias("feature_name"),
        F.when(f.isin("1-URGENT", "5-LOW") & ~odd, F.col("o_totalprice")).when((f == "2-HIGH") & ~odd, (k % 40).cast("double")).when(odd & (f == "2-HIGH"), F.floor("o_totalprice") + 0.5).when(odd & (f != "1-URGENT"), F.col("o_totalprice") + 0.5).alias("value"),
        F.when((f == "3-MEDIUM") & ~odd, k % 2 == 0).when(odd & (f == "1-URGENT"), F.lit(True)).alias("flag"), F.when((f == "4-NOT SPECIFIED") & ~odd, F.when(k % 31 == 0, " ").otherwise(F.col("o_orderstatus"))).alias("said"),
        F.when(f.isin("1-URGENT", "5-LOW"), F.when(k % 97 == 0, "eur").otherwise("usd")).when(f == "2-HIGH", "count").alias("unit"), (F.year(day) - 1).alias("reporting_year"),
        F.when(F.col("o_orderstatus") != "P", F.trunc(day, "year")).alias("publication_date"), F.lit(None).cast("date").alias("acquired_date"), k.alias("document_id"),
    )


def typed_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = asof.known_as_of(views.label_rows(spark, sf_dir), asof.typed_judged(_typed(spark, sf_dir), _registry(spark)), tuple(asof.TYPED))
    return selected.select(*_KEYS, "feature_name", "value", "flag", "said", "status", "available", "document_id")


def typed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = asof.typed_candidates(views.label_rows(spark, sf_dir).select(*_KEYS), _typed(spark, sf_dir), _registry(spark))
    _, rejected = asof.select_as_of(judged, _KEYS, tuple(asof.TYPED))
    return rejected.groupBy("as_of", "feature_name", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first_document"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a cell: dear ones have no value, and their status has one of several names; the order's status is its category's."""
    k = F.col("o_orderkey") % 8
    names = F.element_at(F.array(*[F.lit(x) for x in ("Processing", "not disclosed", "needs_review", "conflicting", "n/a", "Not Applicable ", "unknown", "missing")]), (k + 1).cast("int"))
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("feature_name"), F.when(F.col("o_orderpriority") < "3", "urgent").otherwise("normal").alias("category"),
        F.when(F.col("o_totalprice") < 250000, F.col("o_totalprice")).alias("value"), names.alias("status"), F.element_at(F.create_map(*[F.lit(x) for x in ("F", "completed", "O", "processing", "P", "not_started")]), F.col("o_orderstatus")).alias("category_status"),
    )


def missing_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    status = audits.missing_status(F.col("value"), F.col("status"))
    return cells.groupBy("feature_name", status.alias("missing_status")).agg(F.count(F.lit(1)).alias("n"))


def null_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).where("value is null")
    reason = audits.null_reason(F.col("category_status"), audits.missing_status(F.lit(None), F.col("status")))
    return cells.groupBy("category_status", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.dataset_coverage(_cells(spark, sf_dir), "company")


def completed_null_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.null_reasons(_cells(spark, sf_dir), audits.null_reason(F.col("category_status"), audits.missing_status(F.lit(None), F.col("status"))))


def derived_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).groupBy("company", "feature_name").agg(F.max("value").alias("value"), F.max("status").alias("status"))
    told = cells.withColumn("status", audits.missing_status(F.col("value"), F.col("status")))
    found = audits.derived_status(told, ["company"], spark.createDataFrame(list(_RATIOS), "ratio string, position int, feature_name string"))
    return found.groupBy("ratio", "status").agg(F.count(F.lit(1)).alias("n"), F.min("company").alias("first_company"))


def active_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _registry(spark).select("feature_name", "category").where("category <> 'context'")
    return audits.active_coverage(_cells(spark, sf_dir).select("company", "feature_name", "value"), "company", active).withColumn("missing", F.array_join("missing", ","))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    cik = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    return orders.select(F.when(F.col("o_orderkey") % 17 == 0, F.concat(F.lit("X"), cik)).otherwise(cik).alias("company_cik"), F.when(F.col("o_orderkey") % 2 == 0, "esg").otherwise("csa").alias("target"), "o_orderkey")


def labels_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeric = views.observations(spark, sf_dir).withColumn("company_cik", F.when(F.col("publication_date") < "1996-01-01", F.col("company_cik")).otherwise(F.concat(F.lit("?"), "company_cik")))
    return audits.usable_labels(_labels(spark, sf_dir), views.companies(spark, sf_dir), numeric)[0]


def labels_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.usable_labels(_labels(spark, sf_dir), views.companies(spark, sf_dir), views.observations(spark, sf_dir))[1]


def usage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, k = views.table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("bigint")
    out = F.floor("value").cast("bigint")
    told = audits.usage_statuses(k, out, k + out + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 60), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 40))
    return events.select(told.alias("u")).groupBy("u.total_status", "u.cached_status", "u.reasoning_status").agg(F.count(F.lit(1)).alias("n"), F.sum("u.answer_tokens").alias("answer_tokens"))


def usage_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens"), F.count(F.lit(1)).alias("calls"))


def links_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    documents = orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("company_cik"), F.md5(F.col("o_clerk" if "o_clerk" in orders.columns else "o_orderpriority").cast("binary")).alias("sha256"))
    k = F.col("document_id")
    rows = documents.select(
        k.alias("row_id"), F.when(k % 5 == 0, F.col("company_cik") + 1).otherwise(F.col("company_cik")).alias("company_cik"), F.when(k % 7 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(k % 11 == 0, F.lit(None).cast("bigint")).when(k % 13 == 0, -k).otherwise(k).alias("document_id"),
    )
    return audits.evidence_links(rows, documents).select("row_id", "document_id", "warning")


def contribution_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.financials(spark, sf_dir).unpivot("company_cik", ["revenue", "cost", "units", "balance"], "feature_name", "value").where("value is not null")
    before = long.select("company_cik", "feature_name", F.round(F.col("value") / 1000, 3).alias("contribution")).where("feature_name <> 'units'")
    factor = F.when(F.col("feature_name") == "cost", 1.0).when(F.col("feature_name") == "revenue", 0.9).otherwise(1.5)
    after = long.select("company_cik", "feature_name", (F.round(F.col("value") / 1000, 3) * factor).alias("contribution"))
    return audits.largest_changes(before, after, "company_cik").withColumn("delta", F.round("delta", 4))


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.financials(spark, sf_dir).join(views.companies(spark, sf_dir).select("company_cik", "ticker"), "company_cik").select("company_cik", "company_name", "ticker", "industry", "balance")
    return audits.company_page(rows, "SUPPLIER#", None, "balance", True, 20)


def ids_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for its customer, one in 19 for one that is not there; the order of the requests is kept as a column.

    Ids are asked for as they are written: "-0" is no customer's, while the number -0 would be that of customer 0.
    """
    key = F.col("o_custkey").cast("string")
    asked = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 19 == 0, F.concat(F.lit("-"), key)).otherwise(key).alias("c_custkey"))
    customers = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")
    return audits.requested_rows(asked, customers, "c_custkey").withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


def scenario_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("number", "integer", "text", "number")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    unit = F.element_at(F.array(*[F.lit(x) for x in ("percent", "year", "usd", "count", "usd")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    value = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 40).when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).otherwise(-F.col("l_quantity"))
    issue = audits.scenario_issue(value, kind, unit, F.col("l_suppkey") % 2 == 0)
    return items.groupBy(kind.alias("data_type"), unit.alias("unit"), F.coalesce(issue, F.lit("ok")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = views.financials(spark, sf_dir).where("revenue > 2.3e7").select("industry")
    return audits.unseen_categories(views.financials(spark, sf_dir).select("company_cik", "industry"), trained, "industry")


def scores_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = parts.select(k.alias("provider_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("url"))
    seen = parts.select(F.when(k % 6 == 0, -k - 1).otherwise(k).alias("provider_id"), F.when(k % 7 == 0, F.lit("?")).otherwise(F.col("p_name")).alias("name"), F.when(k % 5 == 0, F.lit("?")).otherwise(F.col("p_brand")).alias("url"), F.col("p_size").alias("score"))
    return audits.observations_applied(rows, seen)[0].select("provider_id", "score", "outcome")


QUERIES = {
    "c01_typed_by_date": typed_by_date, "b08_typed_rejects": typed_rejects, "b09_missing_statuses": missing_statuses, "b10_null_statuses": null_statuses, "d03_dataset_coverage": coverage_levels,
    "d09_null_reasons": completed_null_reasons, "d11_derived_statuses": derived_statuses, "d26_active_coverage": active_cells, "d14_labels_usable": labels_usable, "c03_labels_unmatched": labels_unmatched,
    "d39_usage_statuses": usage_reports, "d37_usage_by_user": usage_by_user, "c14_links_verified": links_verified, "d41_largest_changes": contribution_changes, "f01_company_page": first_page,
    "c28_ids_resolved": ids_resolved, "b27_scenario_values": scenario_values, "b30_unseen_categories": unseen, "c08_scores_applied": scores_applied,
}

_TYPED_SQL = """WITH v_label AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS company_cik, unnest([DATE '1997-06-30', DATE '1999-06-30', DATE '2001-06-30']) AS as_of FROM customer),
o AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS company_cik, o_orderpriority AS feature_name, o_orderkey AS k, o_orderkey % 53 = 0 AS odd, o_totalprice AS p, o_orderstatus AS st,
      CASE WHEN o_orderstatus <> 'P' THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS available, CAST(year(o_orderdate) - 1 AS INTEGER) AS y FROM orders),
t AS (SELECT *, CASE WHEN NOT odd AND feature_name IN ('1-URGENT', '5-LOW') THEN p WHEN NOT odd AND feature_name = '2-HIGH' THEN CAST(k % 40 AS DOUBLE) END AS value,
      CASE WHEN NOT odd AND feature_name = '3-MEDIUM' THEN k % 2 = 0 END AS flag, CASE WHEN NOT odd AND feature_name = '4-NOT SPECIFIED' THEN st END AS said FROM o),
j AS (SELECT l.as_of, t.*, CASE WHEN available IS NULL THEN 'undated' WHEN available > as_of THEN 'after_cutoff' WHEN feature_name IN ('1-URGENT', '5-LOW') AND k % 97 = 0 THEN 'unit_mismatch'
      WHEN feature_name = '2-HIGH' AND odd OR feature_name <> '2-HIGH' AND odd AND feature_name <> '5-LOW' OR feature_name = '4-NOT SPECIFIED' AND k % 31 = 0 THEN 'type_mismatch' END AS reason
      FROM v_label l JOIN t USING (company_cik)),
e AS (SELECT * REPLACE (CASE WHEN odd AND feature_name = '5-LOW' THEN p + 0.5 ELSE value END AS value) FROM (SELECT *, rank() OVER (PARTITION BY company_cik, as_of, feature_name ORDER BY available DESC, y DESC) AS r FROM j WHERE reason IS NULL) WHERE r = 1),
c AS (SELECT *, count(DISTINCT value) OVER g > 1 OR count(DISTINCT flag) OVER g > 1 OR count(DISTINCT said) OVER g > 1 AS torn FROM e WINDOW g AS (PARTITION BY company_cik, as_of, feature_name))"""
_CELLS_SQL = """WITH c0 AS (SELECT o_custkey AS company, o_orderpriority AS feature_name, CASE WHEN o_orderpriority < '3' THEN 'urgent' ELSE 'normal' END AS category, CASE WHEN o_totalprice < 250000 THEN o_totalprice END AS value,
    ['Processing', 'not disclosed', 'needs_review', 'conflicting', 'n/a', 'Not Applicable ', 'unknown', 'missing'][o_orderkey % 8 + 1] AS raw,
    ['processing', 'not_disclosed', 'not_extracted', 'conflicting', 'unspecified_null', 'not_applicable', 'unknown', 'not_extracted'][o_orderkey % 8 + 1] AS st,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'not_started' END AS category_status FROM orders),
    c AS (SELECT *, CASE WHEN category_status = 'processing' THEN 'processing' WHEN st <> 'unspecified_null' THEN st WHEN category_status = 'completed' THEN 'unspecified_null' ELSE 'not_extracted' END AS reason FROM c0)"""
_LABELS_SQL = """WITH l AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE '' END || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS company_cik, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'esg' ELSE 'csa' END AS target, o_orderkey FROM orders)"""
_MISSING_OF = "CASE {s} WHEN 'Processing' THEN 'processing' WHEN 'not disclosed' THEN 'not_disclosed' WHEN 'conflicting' THEN 'conflicting' WHEN 'n/a' THEN 'unspecified_null' WHEN 'Not Applicable ' THEN 'not_applicable' WHEN 'unknown' THEN 'unknown' ELSE 'not_extracted' END"

ORACLE_SQL = {
    "c01_typed_by_date": views.dated(_TYPED_SQL + """ SELECT company_cik, as_of, feature_name, CASE WHEN NOT torn THEN value END AS value, CASE WHEN NOT torn THEN flag END AS flag, CASE WHEN NOT torn THEN said END AS said,
        CASE WHEN torn THEN 'conflicting' WHEN value IS NULL AND flag IS NULL AND said IS NULL THEN 'missing' ELSE 'observed' END AS status, available, k AS document_id
        FROM c QUALIFY row_number() OVER (PARTITION BY company_cik, as_of, feature_name ORDER BY k DESC) = 1""", "as_of", "available"),
    "b08_typed_rejects": views.dated(_TYPED_SQL + """, q AS (SELECT as_of, feature_name, reason, k FROM j WHERE reason IS NOT NULL UNION ALL SELECT as_of, feature_name, 'conflict', k FROM c WHERE torn)
        SELECT as_of, feature_name, reason, count(*) AS n, min(k) AS first_document FROM q GROUP BY ALL""", "as_of"),
    "b09_missing_statuses": _CELLS_SQL + " SELECT feature_name, CASE WHEN value IS NOT NULL THEN 'observed' ELSE st END AS missing_status, count(*) AS n FROM c GROUP BY ALL",
    "b10_null_statuses": _CELLS_SQL + " SELECT category_status, reason, count(*) AS n FROM c WHERE value IS NULL GROUP BY ALL",
    "d03_dataset_coverage": _CELLS_SQL + """ SELECT 'feature' AS level, feature_name AS name, count(*) AS n_cells, count(value) AS n_values, count(DISTINCT company) FILTER (value IS NOT NULL) AS n_rows FROM c GROUP BY feature_name
        UNION ALL SELECT 'category', category, count(*), count(value), count(DISTINCT company) FILTER (value IS NOT NULL) FROM c GROUP BY category
        UNION ALL SELECT 'all', 'all', count(*), count(value), count(DISTINCT company) FILTER (value IS NOT NULL) FROM c""",
    "d09_null_reasons": _CELLS_SQL + """, n AS (SELECT * FROM c WHERE value IS NULL AND category_status = 'completed')
        SELECT 'category' AS level, category AS name, reason, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'feature', feature_name, reason, count(*) FROM n GROUP BY ALL""",
    "d11_derived_statuses": _CELLS_SQL + f""", m AS (SELECT company, feature_name, max(value) AS value, {_MISSING_OF.format(s='max(raw)')} AS st FROM c GROUP BY ALL),
        r(ratio, pos, feature_name) AS (VALUES ('urgent_low', 0, '1-URGENT'), ('urgent_low', 1, '5-LOW'), ('high_low', 0, '2-HIGH'), ('high_low', 1, '5-LOW')),
        w AS (SELECT company, ratio, arg_min(st, pos + CASE WHEN st IN ('processing', 'not_extracted', 'unknown', 'unspecified_null') THEN 0 ELSE 10 END) FILTER (value IS NULL) AS st FROM m JOIN r USING (feature_name) GROUP BY ALL)
        SELECT ratio, coalesce(st, 'observed') AS status, count(*) AS n, min(company) AS first_company FROM w GROUP BY ALL""",
    "d26_active_coverage": _CELLS_SQL + """, a(feature_name, category) AS (VALUES ('1-URGENT', 'financial'), ('2-HIGH', 'social'), ('3-MEDIUM', 'social'), ('5-LOW', 'financial')),
        e AS (SELECT company, a.* FROM (SELECT DISTINCT company FROM c), a), h AS (SELECT DISTINCT company, feature_name FROM c WHERE value IS NOT NULL)
        SELECT company, category, count(*) AS n_active, count(h.company) AS n_available, coalesce(string_agg(e.feature_name, ',' ORDER BY e.feature_name) FILTER (h.company IS NULL), '') AS missing
        FROM e LEFT JOIN h USING (company, feature_name) GROUP BY ALL""",
    "d14_labels_usable": _LABELS_SQL + """ SELECT target, count(*) AS n_labels, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate < DATE '1996-01-01' AND o_totalprice IS NOT NULL)) AS n_usable,
        count(DISTINCT o_custkey) AS n_companies FROM l WHERE company_cik NOT LIKE 'X%' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1""",
    "c03_labels_unmatched": _LABELS_SQL + " SELECT company_cik, target, o_orderkey FROM l WHERE company_cik LIKE 'X%' OR o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "d39_usage_statuses": """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS o, CASE WHEN event_id % 3 <> 0 THEN event_id % 60 END AS c, CASE WHEN event_id % 4 <> 0 THEN event_id % 40 END AS r FROM events)
        SELECT CASE WHEN event_id % 10 = 0 THEN 'reported_inconsistent' ELSE 'reported_consistent' END AS total_status, CASE WHEN c IS NULL THEN 'unreported' WHEN c <= k THEN 'reported' ELSE 'reported_inconsistent' END AS cached_status,
        CASE WHEN r IS NULL THEN 'unreported' WHEN r <= o THEN 'reported' ELSE 'reported_inconsistent' END AS reasoning_status, count(*) AS n, CAST(sum(CASE WHEN r <= o THEN o - r END) AS BIGINT) AS answer_tokens FROM e GROUP BY ALL""",
    "d37_usage_by_user": "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY 1",
    "c14_links_verified": """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderkey END AS document_id,
        CASE WHEN o_orderkey % 11 <> 0 AND (o_orderkey % 13 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) THEN 'unverified_document' END AS warning FROM orders""",
    "d41_largest_changes": views.with_views("v_financials") + """, d AS (SELECT company_cik, 'revenue' AS feature_name, round(revenue / 1000, 3) * 0.9 - round(revenue / 1000, 3) AS delta FROM v_financials WHERE revenue IS NOT NULL
        UNION ALL SELECT company_cik, 'cost', 0.0 FROM v_financials WHERE cost IS NOT NULL UNION ALL SELECT company_cik, 'units', round(units / 1000, 3) * 1.5 FROM v_financials WHERE units IS NOT NULL
        UNION ALL SELECT company_cik, 'balance', round(balance / 1000, 3) * 1.5 - round(balance / 1000, 3) FROM v_financials WHERE balance IS NOT NULL)
        SELECT company_cik, feature_name, round(delta, 4) AS delta, row_number() OVER (PARTITION BY company_cik ORDER BY abs(delta) DESC, feature_name) AS place FROM d WHERE true QUALIFY place <= 3 AND abs(delta) > 1e-8""",
    "f01_company_page": views.with_views("v_financials", "v_company") + """, f AS (SELECT company_cik, f.company_name, ticker, f.industry, balance FROM v_financials f JOIN v_company c USING (company_cik) WHERE contains(lower(f.company_name), 'supplier#'))
        SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY balance DESC NULLS LAST, company_cik LIMIT 20""",
    "c28_ids_resolved": """SELECT CASE WHEN o_orderkey % 19 = 0 THEN -o_custkey ELSE o_custkey END AS c_custkey, o_orderkey AS position, CASE WHEN o_orderkey % 19 <> 0 THEN c_name END AS c_name, o_orderkey % 19 <> 0 AND c_name IS NOT NULL AS is_known
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "b27_scenario_values": """WITH v AS (SELECT ['number', 'integer', 'text', 'number'][l_linenumber % 4 + 1] AS data_type, ['percent', 'year', 'usd', 'count', 'usd'][l_partkey % 5 + 1] AS unit, l_suppkey % 2 = 0 AS may,
        CASE l_returnflag WHEN 'R' THEN l_quantity * 40 WHEN 'A' THEN l_extendedprice ELSE -l_quantity END AS x FROM lineitem)
        SELECT data_type, unit, CASE WHEN (data_type = 'integer' OR unit = 'count') AND x <> floor(x) THEN 'not_whole' WHEN data_type = 'text' AND unit <> 'count' THEN 'not_editable' WHEN unit = 'year' AND x NOT BETWEEN 1900 AND 2100 THEN 'year_out_of_range'
        WHEN unit = 'percent' AND x NOT BETWEEN 0 AND 100 THEN 'percent_out_of_range' WHEN NOT may AND x < 0 THEN 'negative' ELSE 'ok' END AS issue, count(*) AS n FROM v GROUP BY ALL""",
    "b30_unseen_categories": views.with_views("v_financials") + " SELECT company_cik, industry, CASE WHEN industry NOT IN (SELECT industry FROM v_financials WHERE revenue > 2.3e7) THEN 'unseen_category' END AS warning FROM v_financials",
    "c08_scores_applied": """SELECT p_partkey AS provider_id, CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_size END AS score,
        CASE WHEN p_partkey % 6 = 0 THEN 'not_observed' WHEN p_partkey % 7 = 0 THEN 'name_differs' WHEN p_partkey % 5 = 0 THEN 'url_differs' ELSE 'applied' END AS outcome FROM part""",
}
