"""Queries: reviews, receipts, statuses, links of pages, cohorts, reference rows, catalogs, model inputs and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import reviews
from datelore.plans import views
from datelore.plans.wordings import _one_of

TOPICS = {"license_report": ("en", ("licensed", "version")), "permission_report": ("en|fr|de", ("[Pp]ermission", "software"))}
FIELDS = ["URGENT", "HIGH", "MEDIUM"]
AMBIGUOUS = ("not_disclosed", "unknown", "unspecified_null")
RATIOS = [("urgent_to_high", "1-URGENT", "2-HIGH"), ("medium_to_low", "3-MEDIUM", "5-LOW")]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").where("o_custkey is not null")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    rows = _orders(spark, sf_dir).select(
        "o_orderkey", _one_of(F.col("o_orderkey"), ["latest_verified", "newer_available", "unknown", "other", None]).alias("status"), F.when(F.col("o_orderkey") % 7 != 0, digest).otherwise(F.upper(digest)).alias("sha256"),
        F.col("o_orderdate").alias("checked_at"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 33).cast("int"))).alias("valid_until"), F.when(F.col("o_orderkey") % 2 == 0, "https://example.org/new").alias("candidate_url"),
    )
    return rows.select("o_orderkey", F.array_join(reviews.review_issues(), ",").alias("issues"))


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.concat(F.lit(reviews.LISTING_NOTE), F.lit("old")), F.when(F.col("o_orderkey") % 2 == 0, F.lit("read by hand")), F.col("o_orderpriority")))
    old = F.when(F.col("o_orderkey") % 5 != 0, F.create_map(F.lit("financial_report"), F.lit("old"), F.lit("environment_report"), F.col("o_orderstatus")))
    proven = F.when(F.col("o_orderkey") % 4 == 0, F.create_map(F.lit("financial_report"), F.lit("new")))
    r = reviews.review_refreshed(F.sha2(F.col("o_orderkey").cast("string"), 256), F.col("o_orderdate"), notes, old, proven)
    rows = _orders(spark, sf_dir).select("o_orderkey", r.alias("r"))
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("r.assessments"), lambda e: F.concat_ws("=", e.key, e.value))), ",")
    return rows.select("o_orderkey", "r.status", F.col("r.valid_until").cast("date").alias("valid_until"), F.array_join("r.notes", "|").alias("notes"), entries.alias("assessments"))


def processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _orders(spark, sf_dir).select(
        "o_custkey", "o_orderpriority", F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("started_at"), _one_of(F.col("o_orderkey"), ["succeeded", "running", "failed"]).alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 50).alias("fields"),
    )
    return reviews.processing_status(attempts, ["o_custkey", "o_orderpriority"])


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    told = rows.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 20 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("company"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("sha256"))
    return reviews.receipts_matched(told, rows.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("sha256")))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda n, yes, no: F.when(F.col("o_orderkey") % n < yes, True).when(F.col("o_orderkey") % n < no, False)
    judged = F.when(F.col("o_orderkey") % 2 == 0, F.array().cast("array<boolean>")).otherwise(F.array(F.lit(True), F.col("o_orderkey") % 13 != 0, F.lit(True)))
    passed = reviews.checks_passed(_one_of(F.col("o_orderkey"), ["passed", "passed", "passed", "failed"]), F.col("o_orderkey") % 5 != 0, flag(7, 3, 5), flag(11, 6, 9), judged, 3)
    return _orders(spark, sf_dir).select("o_orderkey", passed.alias("passed"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.create_map(F.lit("quote"), F.col("o_orderpriority"), F.lit("path"), F.concat(F.lit("/store/"), F.col("o_orderkey").cast("string")), F.lit("formula"), F.col("o_orderstatus"), F.lit("request"), F.lit("r"))
    part = reviews.public_part(evidence, ("quote", "formula", "basis"))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.array_sort(F.transform(F.map_entries(part), lambda e: F.concat(e.key, F.lit("="), e.value))), ",").alias("evidence"))


def fields_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated, category = _one_of(F.col("o_orderkey"), [None, "available", "unclear", None, None]), _one_of(F.col("o_orderkey"), ["completed", "processing", None, "completed", "needs_review", "unknown", None])
    status, reason = reviews.field_status(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")), F.col("o_orderkey") % 4 != 0, stated, category)
    return _orders(spark, sf_dir).groupBy(status.alias("status"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("feature_name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("value"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("reporting_year"))
    return reviews.bundle_coverage(cells).withColumns({c: F.array_join(c, ",") for c in ("statuses", "years")})


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, n = F.col("event_id") % 3, F.floor("value")
    rows = views.table(spark, sf_dir, "events").select("event_type", F.when(turn == 0, n > 10).alias("flag"), F.when(turn == 1, n).alias("number"), F.when(turn == 2, n.cast("string")).alias("words"))
    return reviews.typed_distinct(rows, ["event_type"], ["flag", "number", "words"])


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("o_orderpriority") == "1-URGENT", "financial").when(F.col("o_orderpriority") == "2-HIGH", "social").when(F.col("o_orderpriority") == "3-MEDIUM", "environmental").otherwise("other")
    given = _orders(spark, sf_dir).groupBy("o_custkey", category.alias("category")).agg((F.max("o_totalprice") / 150000).alias("weight"))
    return reviews.weights_checked(given, "o_custkey")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _orders(spark, sf_dir).where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    companies = views.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("industry"))
    return reviews.cohort(companies, "c_custkey", ids, "MACHINERY")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.col("lang").alias("title"), "text")
    return reviews.report_categories(pages, "source", "title", TOPICS)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.anchors(views.table(spark, sf_dir, "pages"), "page_id", "url", "html")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.link_scope(_links(spark, sf_dir), "page_id", 4).drop("words")


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.relevant_links(_links(spark, sf_dir), "th|en", "tion").drop("words")


def source_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("sha256"), "o_orderdate")
    told = rows.where("document_id % 2 = 0").select("company", "sha256", F.col("o_orderdate").alias("checked_at"), F.when(F.col("document_id") % 3 != 0, F.col("o_orderdate").cast("date")).alias("publication_date"))
    return reviews.with_source_dates(rows.drop("o_orderdate"), told)


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = views.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).alias("c_nationkey"), "n_name")
    joined, left = reviews.with_reference(views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey")
    return joined.groupBy("c_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n")).unionByName(left.select("c_nationkey", "n_name", F.lit(0).cast("long").alias("n")))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("wording"))
    found = reviews.targets_grouped(views.table(spark, sf_dir, "customer").withColumn("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))), rows, "c_custkey")
    return found.withColumn("targets", F.array_join(F.transform("targets", lambda t: F.concat_ws("/", t.target_id.cast("string"), t.status, t.wording)), ","))


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda p: F.max(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    years = _orders(spark, sf_dir).groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(top("1-URGENT").alias("whole"), top("2-HIGH").alias("part_1"), top("3-MEDIUM").alias("part_2"))
    return reviews.baseline_years(years, "o_custkey", 1996)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(
        "o_custkey", "o_orderpriority", _one_of(F.col("o_orderkey"), ["latest_verified", "unknown", "newer_available", None]).alias("freshness"), F.when(F.col("o_orderkey") % 5 != 0, F.year("o_orderdate").cast("string")).alias("dated"),
        _one_of(F.col("o_orderkey"), ["application/pdf", "text/html", None]).alias("content_type"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("document_id"),
    )
    return reviews.best_sources(rows, ["o_custkey", "o_orderpriority"])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = views.table(spark, sf_dir, "part").select("p_size", F.when(k % 6 != 0, F.col("p_type")).alias("family"), F.when(k % 5 != 0, k % 40).alias("dated"), (k % 7).alias("year"), F.col("p_name").alias("title"), k.alias("asset_id"))
    return reviews.candidates_ranked(rows, "p_size", ("STANDARD", "ECONOMY"))


def ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _one_of(F.col("o_orderkey"), ["Unknown", "not disclosed", None, "", "conflicting"])
    reason = _one_of(F.col("o_orderkey"), [None, "Status is Not Disclosed by the issuer", "", "unknown cause", "other", "unspecified null", " "])
    return _orders(spark, sf_dir).groupBy(F.array_join(reviews.ambiguous_statuses(status, reason, AMBIGUOUS), ",").alias("statuses")).agg(F.count(F.lit(1)).alias("n"))


def together(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.year("o_orderdate").alias("year"))
    return reviews.united({"orders": orders, "suppliers": views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"), F.col("s_name").alias("name"))})


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.observations(spark, sf_dir).select("company_cik", F.substring("feature_name", 3, 20).alias("feature_name"), "value", "unit", "document_id")
    newest = rows.groupBy("company_cik", "feature_name").agg(F.max_by(F.struct("value", "unit"), "document_id").alias("n")).select("company_cik", "feature_name", "n.value", "n.unit")
    return reviews.feature_catalog(views.companies(spark, sf_dir).select("company_cik", "ticker"), newest.where(F.col("feature_name").isin(*FIELDS)), "company_cik", FIELDS)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).withColumn("other_unit", F.array_join("other_unit", ","))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.catalog_cells(_catalog(spark, sf_dir), "company_cik", FIELDS)


def json_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return views.table(spark, sf_dir, "events").select("event_id", reviews.json_number(props, "$.k", "bigint").alias("k"), reviews.json_number(props, "$.absent").alias("absent"))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.children_json(_orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")), ["o_custkey"], ["id", "priority"])


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("string")).when(F.col("o_orderkey") % 10 == 0, "n/a")
    rows = _orders(spark, sf_dir).select("o_orderkey", price.alias("price"), _one_of(F.col("o_orderkey"), ["  A ", "", None, "b"]).alias("sector"))
    return reviews.model_inputs(rows, ["price"], ["sector"]).withColumn("issues", F.array_join("issues", ","))


def scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _orders(spark, sf_dir).groupBy("o_custkey", F.col("o_orderpriority").alias("feature_name")).agg(F.max("o_totalprice").alias("value")).withColumn("reporting_year", F.lit(2000))
    new = F.when(F.col("o_custkey") % 3 != 0, F.col("value") * 1.5)
    changes = long.where("o_custkey % 2 = 0 and feature_name in ('1-URGENT', '5-LOW')").select("o_custkey", "feature_name", new.alias("new_value"))
    return reviews.scenario_differences(long, changes, ["o_custkey"], RATIOS)


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("c_acctbal")
    rows = views.table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("cohort"), score.alias("a"), F.when(F.col("c_custkey") % 4 == 0, score * 2).otherwise(score).alias("b"), (score - F.col("c_custkey") * 10).alias("c"))
    return reviews.three_ranks(rows, "cohort", "c_custkey", {"original_rank": "a", "scenario_rank": "b", "personal_rank": "c"}).drop("a", "b", "c")


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.preview_lines(views.table(spark, sf_dir, "documents"), "doc_id", "text", 20, 1500)


QUERIES = {
    "b15_review_issues": issues, "b46_reviews_refreshed": refreshed, "b19_processing_status": processing, "c11_receipts_matched": receipts, "b54_checks_passed": gate, "b55_public_evidence": shown,
    "b56_field_status": fields_told, "d36_bundle_coverage": bundle, "d12_typed_distinct": distinct_values, "b31_weights_checked": weights, "b32_cohort": cohort, "b40_report_categories": categories,
    "b43_link_scope": scopes, "b41_relevant_links": relevant, "c02_source_dates": source_dates, "c24_reference_joined": reference, "c25_targets_grouped": targets, "c26_baseline_years": baselines,
    "e08_best_sources": best, "e09_candidates_ranked": candidates, "g06_ambiguous_statuses": ambiguous, "g01_sources_united": together, "a29_feature_catalog": catalog, "a30_catalog_cells": cells,
    "h30_json_reads": json_reads, "h31_children_json": children, "k01_model_inputs": inputs, "h34_scenario_differences": scenario, "k13_three_ranks": ranks, "a11_preview_lines": preview,
}

_O = "o AS (SELECT *, o_orderkey AS k FROM orders WHERE o_custkey IS NOT NULL)"
_LINKS = """WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*', 0) AS root, regexp_extract_all(html, '<a[^>]*?href="([^"#]*)[^"]*"[^>]*>([^<]*)</a>', 1) AS h,
        regexp_extract_all(html, '<a[^>]*?href="([^"#]*)[^"]*"[^>]*>([^<]*)</a>', 2) AS w FROM pages),
    l AS (SELECT page_id, root, unnest(range(0, len(h))) AS place, unnest(h) AS href, unnest(w) AS words FROM a),
    t AS (SELECT page_id, regexp_replace(root, '^https?://', '') AS host, CAST(place AS INTEGER) AS place, words,
        CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN regexp_matches(href, '^/([^/]|$)') THEN root || href END AS url FROM l),
    v AS (SELECT *, regexp_extract(url, '^https?://([^/?#]*)', 1) AS own_host, ends_with(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '.pdf') AS pdf
        FROM t WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY place) = 1)"""
_CATALOG = views.with_views("v_observation", "v_company") + """, n AS (SELECT company_cik, substr(feature_name, 3) AS f, value, unit FROM v_observation
        QUALIFY row_number() OVER (PARTITION BY company_cik, feature_name ORDER BY document_id DESC) = 1),
    w AS (SELECT company_cik, max(CASE WHEN f = 'URGENT' AND unit = 'usd' THEN value END) AS URGENT, max(CASE WHEN f = 'HIGH' AND unit = 'usd' THEN value END) AS HIGH, max(CASE WHEN f = 'MEDIUM' AND unit = 'usd' THEN value END) AS MEDIUM,
        string_agg(CASE WHEN unit <> 'usd' AND f IN ('URGENT', 'HIGH', 'MEDIUM') THEN f END, ',' ORDER BY f) AS other_unit FROM n GROUP BY 1),
    c AS (SELECT company_cik, ticker, URGENT, HIGH, MEDIUM, coalesce(other_unit, '') AS other_unit FROM v_company LEFT JOIN w USING (company_cik))"""

ORACLE_SQL = {
    "b15_review_issues": f"""WITH {_O} SELECT o_orderkey, concat_ws(',', CASE WHEN k % 5 > 2 THEN 'status' END, CASE WHEN k % 7 = 0 THEN 'sha256' END, CASE WHEN k % 33 NOT BETWEEN 1 AND 30 THEN 'window' END,
        CASE WHEN (k % 2 = 0) <> (k % 5 = 1) THEN 'candidate' END) AS issues FROM o""",
    "b46_reviews_refreshed": f"""WITH {_O} SELECT o_orderkey, 'latest_verified' AS status, CAST(CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS valid_until,
        concat_ws('|', CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN 'read by hand' END, CASE WHEN k % 3 <> 0 THEN o_orderpriority END, 'listing sha256: ' || sha256(CAST(k AS VARCHAR))) AS notes,
        concat_ws(',', CASE WHEN k % 5 <> 0 THEN 'environment_report=' || o_orderstatus END, CASE WHEN k % 4 = 0 THEN 'financial_report=new' WHEN k % 5 <> 0 THEN 'financial_report=old' END) AS assessments FROM o""",
    "b19_processing_status": f"""WITH {_O}, l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, k DESC) = 1),
        s AS (SELECT * FROM o WHERE k % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, k DESC) = 1)
        SELECT l.o_custkey, l.o_orderpriority, CASE l.k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' ELSE CASE WHEN s.k IS NULL THEN 'needs_review' ELSE 'completed' END END AS status,
        s.k IS NOT NULL AS has_result, l.k AS last_id, s.k AS saved_id, s.k % 50 AS saved_fields FROM l LEFT JOIN s ON l.o_custkey = s.o_custkey AND l.o_orderpriority = s.o_orderpriority""",
    "c11_receipts_matched": f"""WITH {_O}, r AS (SELECT k, CASE WHEN k % 20 = 0 THEN o_custkey + 1 ELSE o_custkey END AS c, CASE WHEN k % 9 <> 0 THEN o_orderpriority END AS h FROM o)
        SELECT r.k AS document_id, r.c AS company, r.h AS sha256 FROM r JOIN o ON r.k = o.k AND r.c = o.o_custkey AND r.h = o.o_orderpriority""",
    "b54_checks_passed": f"""WITH {_O}, f AS (SELECT *, CASE WHEN k % 7 < 3 THEN true WHEN k % 7 < 5 THEN false END AS asked, CASE WHEN k % 11 < 6 THEN true WHEN k % 11 < 9 THEN false END AS reviewed FROM o)
        SELECT o_orderkey, k % 4 <> 3 AND k % 5 <> 0 AND CASE WHEN asked IS NOT DISTINCT FROM false THEN reviewed IS NOT DISTINCT FROM false AND k % 2 = 0
        ELSE k % 2 = 1 AND k % 13 <> 0 AND reviewed IS DISTINCT FROM false END AS passed FROM f""",
    "b55_public_evidence": f"WITH {_O} SELECT o_orderkey, concat_ws(',', 'formula=' || o_orderstatus, 'quote=' || o_orderpriority) AS evidence FROM o",
    "b56_field_status": f"""WITH {_O}, t AS (SELECT k, ['completed', 'processing', NULL, 'completed', 'needs_review', 'unknown', NULL][k % 7 + 1] AS c, [NULL, 'available', 'unclear', NULL, NULL][k % 5 + 1] AS s FROM o)
        SELECT CASE WHEN k % 4 <> 0 THEN coalesce(s, CASE WHEN k % 3 = 0 THEN 'available' ELSE 'not_disclosed' END) ELSE coalesce(c, 'not_started') END AS status,
        CASE WHEN k % 4 = 0 THEN CASE WHEN c <> 'completed' THEN 'category_not_extracted' ELSE 'not_in_result' END END AS reason, count(*) AS n FROM t GROUP BY ALL""",
    "d36_bundle_coverage": f"""WITH {_O}, s AS (SELECT o_orderpriority AS p, o_orderstatus || ':' || count(*) AS e FROM o WHERE o_orderstatus IS NOT NULL GROUP BY o_orderpriority, o_orderstatus),
        y AS (SELECT o_orderpriority AS p, year(o_orderdate) || ':' || count(*) AS e FROM o WHERE o_orderdate IS NOT NULL GROUP BY o_orderpriority, year(o_orderdate)),
        c AS (SELECT o_orderpriority AS p, count(*) FILTER (k % 3 = 0 AND o_totalprice IS NOT NULL) AS a, count(*) AS n FROM o GROUP BY 1)
        SELECT p AS feature_name, a AS n_available, n - a AS n_missing, a / n AS share, (SELECT string_agg(e, ',' ORDER BY e) FROM s WHERE s.p = c.p) AS statuses, (SELECT string_agg(e, ',' ORDER BY e) FROM y WHERE y.p = c.p) AS years FROM c""",
    "d12_typed_distinct": """SELECT event_type, count(DISTINCT CASE event_id % 3 WHEN 0 THEN 'flag ' || (floor(value) > 10) WHEN 1 THEN 'number ' || CAST(floor(value) AS BIGINT) ELSE 'words ' || CAST(floor(value) AS BIGINT) END) AS n_distinct
        FROM events GROUP BY 1""",
    "b31_weights_checked": f"""WITH {_O}, g AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'financial' WHEN '2-HIGH' THEN 'social' WHEN '3-MEDIUM' THEN 'environmental' ELSE 'other' END AS category, max(o_totalprice) / 150000 AS w FROM o GROUP BY ALL),
        e AS (SELECT DISTINCT o_custkey, unnest(['financial', 'social', 'environmental', 'climate_target', 'financial_target']) AS category FROM o),
        b AS (SELECT coalesce(e.o_custkey, g.o_custkey) AS o_custkey, coalesce(e.category, g.category) AS category, CASE WHEN g.category IS NULL THEN 1.0 ELSE w END AS weight, e.category IS NULL AS odd
              FROM e FULL JOIN g ON e.o_custkey = g.o_custkey AND e.category = g.category)
        SELECT o_custkey, category, weight, CASE WHEN odd THEN 'unknown_category' WHEN weight IS NULL OR weight NOT BETWEEN 0 AND 3 THEN 'out_of_range' END AS issue FROM b""",
    "b32_cohort": "SELECT c_custkey, c_name, c_mktsegment AS industry FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "b40_report_categories": r"""WITH p AS (SELECT source, doc_id AS page, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), f AS (
        SELECT source, 'license_report' AS category, page, regexp_extract(t, '(?:licensed).{0,180}', 0) AS quote FROM p WHERE lang LIKE '%en%' AND contains(t, 'licensed') AND contains(t, 'version') UNION ALL
        SELECT source, 'permission_report', page, regexp_extract(t, '(?:[Pp]ermission).{0,180}', 0) FROM p WHERE regexp_matches(lang, 'en|fr|de') AND regexp_matches(t, '[Pp]ermission') AND contains(t, 'software'))
        SELECT source, category, page, quote FROM f QUALIFY row_number() OVER (PARTITION BY source, category ORDER BY page) = 1""",
    "b43_link_scope": _LINKS + """ SELECT page_id, host, url, place, CASE WHEN NOT (pdf OR own_host = host) THEN 'outside' WHEN row_number() OVER (PARTITION BY page_id, pdf OR own_host = host ORDER BY place, url) <= 4 THEN 'read' ELSE 'unread' END AS scope FROM v""",
    "b41_relevant_links": _LINKS + """, r AS (SELECT *, lower(words || ' ' || url) AS said, own_host = host OR ends_with(own_host, '.' || host) AS own FROM v),
        q AS (SELECT page_id, host, url, place, CASE WHEN (pdf OR NOT own) AND regexp_matches(said, 'th|en') AND contains(said, 'tion') THEN 'report' WHEN own AND NOT pdf AND regexp_matches(said, 'th|en') THEN 'page' END AS kind,
            CAST(list_max([CAST(x AS INTEGER) FOR x IN regexp_extract_all(said, '[0-9]+') IF len(x) = 4 AND x BETWEEN '1900' AND '2099']) AS INTEGER) AS year FROM r)
        SELECT * FROM q WHERE kind IS NOT NULL""",
    "c02_source_dates": f"""WITH {_O}, d AS (SELECT o_custkey, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM o WHERE k % 2 = 0 AND k % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC) = 1)
        SELECT k AS document_id, o.o_custkey AS company, o.o_orderpriority AS sha256, day AS publication_date FROM o LEFT JOIN d ON o.o_custkey = d.o_custkey AND o.o_orderpriority = d.o_orderpriority""",
    "c24_reference_joined": """WITH r AS (SELECT n_nationkey * 2 AS c_nationkey, n_name FROM nation)
        SELECT c.c_nationkey, n_name, count(*) AS n FROM customer c LEFT JOIN r ON c.c_nationkey = r.c_nationkey GROUP BY ALL UNION ALL
        SELECT c_nationkey, n_name, 0 FROM r WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = r.c_nationkey)""",
    "c25_targets_grouped": f"""WITH {_O} SELECT o_custkey AS c_custkey, count(*) AS n_targets, string_agg(concat_ws('/', k, o_orderstatus, o_orderpriority), ',' ORDER BY k) AS targets
        FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""",
    "c26_baseline_years": f"""WITH {_O}, y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS whole, max(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS part_1,
            max(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS part_2 FROM o GROUP BY 1, 2),
        u AS (SELECT *, CASE WHEN year >= 1996 THEN coalesce(whole, part_1 + part_2) END AS v FROM y)
        SELECT a.* EXCLUDE (v), b.year AS baseline_year, b.v AS baseline FROM u a LEFT JOIN u b ON a.o_custkey = b.o_custkey AND b.year = (SELECT max(c.year) FROM u c WHERE c.o_custkey = a.o_custkey AND c.year < a.year AND c.v IS NOT NULL)""",
    "e08_best_sources": f"""WITH {_O}, s AS (SELECT o_custkey, o_orderpriority, ['latest_verified', 'unknown', 'newer_available', NULL][k % 4 + 1] AS freshness, CASE WHEN k % 5 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS dated,
            ['application/pdf', 'text/html', NULL][k % 3 + 1] AS content_type, k AS document_id FROM o WHERE k % 7 <> 0)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE freshness WHEN 'latest_verified' THEN 3 WHEN 'unknown' THEN 2 WHEN 'newer_available' THEN 1 ELSE 0 END DESC,
            coalesce(dated, '') DESC, CASE WHEN content_type LIKE '%pdf%' THEN 1 ELSE 0 END DESC, document_id DESC) = 1""",
    "e09_candidates_ranked": """WITH c AS (SELECT p_size, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS family, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 40 END AS dated, p_partkey % 7 AS year, p_name AS title, p_partkey AS asset_id FROM part)
        SELECT *, CAST(row_number() OVER (PARTITION BY p_size ORDER BY CASE family WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 3 END, dated DESC NULLS LAST, year DESC NULLS LAST, lower(title), asset_id) AS INTEGER) AS place FROM c""",
    "g06_ambiguous_statuses": f"""WITH {_O}, t AS (SELECT k % 5 AS s, k % 7 AS r FROM o)
        SELECT concat_ws(',', CASE WHEN s = 1 OR r = 1 THEN 'not_disclosed' END, CASE WHEN s = 0 OR r = 3 THEN 'unknown' END, CASE WHEN s IN (2, 3) AND r IN (0, 2, 6) THEN 'unspecified_null' END) AS statuses, count(*) AS n FROM t GROUP BY 1""",
    "g01_sources_united": f"""WITH {_O} SELECT k AS id, o_totalprice AS value, CAST(year(o_orderdate) AS INTEGER) AS year, 'orders' AS origin, NULL::VARCHAR AS name FROM o UNION ALL
        SELECT s_suppkey, s_acctbal, NULL, 'suppliers', s_name FROM supplier""",
    "a29_feature_catalog": _CATALOG + " SELECT * FROM c",
    "a30_catalog_cells": _CATALOG + """, m AS (SELECT company_cik, other_unit, unnest(['URGENT', 'HIGH', 'MEDIUM']) AS feature_name, unnest([URGENT, HIGH, MEDIUM]) AS value FROM c)
        SELECT company_cik, feature_name, value, CASE WHEN value IS NULL THEN CASE WHEN list_contains(string_split(other_unit, ','), feature_name) THEN 'other_unit' ELSE 'not_extracted' END END AS missing_reason FROM m""",
    "h30_json_reads": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.absent') AS DOUBLE) AS absent FROM events",
    "h31_children_json": f"""WITH {_O} SELECT o_custkey, '[' || string_agg('{{"id":' || k || ',"priority":"' || o_orderpriority || '"}}', ',' ORDER BY k) || ']' AS children FROM o GROUP BY 1""",
    "k01_model_inputs": f"""WITH {_O} SELECT o_orderkey, CASE WHEN k % 5 <> 0 THEN o_totalprice END AS price, ['A', 'Unknown', 'Unknown', 'b'][k % 4 + 1] AS sector, CASE WHEN k % 10 = 0 THEN 'price' ELSE '' END AS issues FROM o""",
    "h34_scenario_differences": f"""WITH {_O}, l AS (SELECT o_custkey AS c, o_orderpriority AS f, max(o_totalprice) AS v FROM o GROUP BY 1, 2),
        s AS (SELECT c, f, v, CASE WHEN c % 2 = 0 AND f IN ('1-URGENT', '5-LOW') THEN CASE WHEN c % 3 <> 0 THEN v * 1.5 END ELSE v END AS w FROM l),
        r AS (SELECT c, CASE WHEN f IN ('1-URGENT', '2-HIGH') THEN 'urgent_to_high' ELSE 'medium_to_low' END AS name, max(v) FILTER (f IN ('1-URGENT', '3-MEDIUM')) AS nv, max(w) FILTER (f IN ('1-URGENT', '3-MEDIUM')) AS nw,
            max(v) FILTER (f IN ('2-HIGH', '5-LOW')) AS dv, max(w) FILTER (f IN ('2-HIGH', '5-LOW')) AS dw FROM s WHERE f <> '4-NOT SPECIFIED' GROUP BY ALL),
        q AS (SELECT c, name, CASE WHEN dv > 0 THEN nv / dv END AS original, CASE WHEN dw > 0 THEN nw / dw END AS scenario FROM r)
        SELECT c AS o_custkey, name AS feature_name, original, scenario, scenario - original AS difference FROM q""",
    "k13_three_ranks": """WITH c AS (SELECT c_custkey, concat_ws('/', c_mktsegment, c_nationkey) AS cohort, c_acctbal AS a, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS b, c_acctbal - c_custkey * 10 AS p FROM customer)
        SELECT c_custkey, cohort, CAST(rank() OVER (PARTITION BY cohort ORDER BY a DESC NULLS LAST, c_custkey) AS INTEGER) AS original_rank, CAST(rank() OVER (PARTITION BY cohort ORDER BY b DESC NULLS LAST, c_custkey) AS INTEGER) AS scenario_rank,
        CAST(rank() OVER (PARTITION BY cohort ORDER BY p DESC NULLS LAST, c_custkey) AS INTEGER) AS personal_rank FROM c""",
    "a11_preview_lines": views.with_views("v_lines") + """, b AS (SELECT doc_id, line_no, line, 1500 - coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM v_lines WHERE line_no <= 20)
        SELECT doc_id, line_no, left(line, CAST(room AS BIGINT)) AS line, length(line) > room AS is_cut FROM b WHERE room > 0""",
}
