"""Queries: latest filings, sources and pages in order, merged chunks, groups, links, pairs of lines, masks by fold, score states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import choices
from datelore.plans import views
from datelore.plans.wordings import _one_of

FAMILIES = {"license": ("license", "copyright"), "contact": ("@", "http"), "figures": ("%", "0")}
AMBIGUOUS = ("unknown", "unspecified_null")
KINDS = (("1-URGENT", "number"), ("2-HIGH", "integer"), ("3-MEDIUM", "boolean"), ("4-NOT SPECIFIED", "number"), ("5-LOW", "boolean"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.latest_filings(views.facts(spark, sf_dir).select("company", "form", "filed", "accession"), "company")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = _one_of(F.col("o_orderkey"), ["sec_annual_filing", "sec_proxy_statement", "sec_other", "issuer_report", None])
    category = _one_of(F.col("o_custkey"), ["financial_report", "social_employee", "climate_targets"])
    assessed = F.when(F.col("o_orderkey") % 7 < 3, F.array(category)).when(F.col("o_orderkey") % 7 < 5, F.array(F.lit("elsewhere")))
    told = choices.category_freshness(F.when(F.col("o_orderkey") % 11 != 0, "latest_verified"), family, category, assessed, F.when(F.col("o_orderkey") % 2 == 0, "current"))
    return _orders(spark, sf_dir).groupBy(family.alias("family"), category.alias("category"), told.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = views.table(spark, sf_dir, "part").select(
        F.col("p_size").alias("company"), F.concat_ws("/", "p_brand", "p_type").alias("url"), F.when(k % 3 != 0, k).alias("document_id"), F.lpad(k.cast("string"), 9, "0").alias("title"),
        _one_of(k, ["latest_verified", "newer_available", None, "unknown"]).alias("freshness"), F.when(k % 5 != 0, F.concat(F.lit("20"), F.lpad((k % 30).cast("string"), 2, "0"))).alias("dated"),
    )
    return choices.sources_in_order(rows, "company", "url")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.family_pages(views.table(spark, sf_dir, "documents"), "source", "doc_id", "text", FAMILIES)


def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return choices.first_rows(rows, ["l_suppkey", "l_returnflag"], [F.col("l_extendedprice").desc(), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey"))], 5)


def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return choices.first_rows(rows, ["o_custkey"], [F.col("day").desc(), F.col("o_orderkey").desc()], 3)


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("source", F.coalesce("lang", F.lit("none")).alias("field"), "text", "doc_id", F.when(F.col("text").contains("%"), 1).otherwise(0).alias("score"))
    return choices.excerpts_in_budget(docs, "source", "field", "text", "score", "doc_id", 4000).drop("text")


def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(
        "o_custkey", (F.col("o_orderkey") % 3 == 0).alias("models_agree"), (F.col("o_orderkey") % 4 == 0).alias("reaches_target"), (F.col("o_totalprice") - 250000).alias("remaining_gap"),
        F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 41 - 20).cast("double")).alias("relative_change"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"),
    )
    return choices.suggestions(rows, ["o_custkey"], 3).select("o_custkey", "label", "place")


def chunks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("name"), F.floor(F.col("l_quantity") / 25).alias("value"), F.lit("t").alias("unit"), F.year("l_shipdate").alias("reporting_year"),
        F.when(F.col("l_linestatus") == "F", "reported").otherwise("estimated").alias("status"),
    )
    return choices.merged_chunks(rows, ["l_orderkey"], "name", F.lit(1998)).drop("candidates")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).where("o_custkey is not null").select("o_custkey", F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("sector"))
    return choices.memberships(rows, "o_custkey").withColumn("symbols", F.array_join("symbols", ","))


def names_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part")
    named = lambda other: F.concat_ws(" ", "p_name", other)
    marked = F.when(F.col("p_partkey") % 7 == 0, F.concat(named("p_brand"), F.lit("?"))).otherwise(named("p_brand"))
    names = parts.select("p_partkey", F.explode(F.array(marked, F.concat(named("p_type"), F.lit(" Brand#1")))).alias("name"))
    return choices.any_name_matched(names, parts.select(named("p_brand").alias("name"), F.col("p_size").alias("provider_id")), "p_partkey", "name", "provider_id")


def rows_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"))
    features = _orders(spark, sf_dir).select(F.col("o_custkey").alias("row_id"))
    return choices.aligned({"labels": label, "features": features, "metadata": views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"))}, "row_id")


def documents_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return choices.visible(docs, views.table(spark, sf_dir, "labels").where("quality = 1"), views.table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("doc_id")), "doc_id")


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    docs = rows.select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 50).alias("company"), F.col("o_orderpriority").alias("accession"), (F.col("o_orderkey") % 40).alias("url"))
    links = rows.select((-F.col("o_orderkey")).alias("wrapper_id"), (F.col("o_custkey") % 50).alias("company"), F.col("o_orderpriority").alias("accession"), (F.col("o_orderkey") * 7 % 90).alias("url"), F.concat(F.lit("Report "), F.col("o_orderkey").cast("string")).alias("link_text"))
    return choices.attached(docs, links)


def pairs_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return choices.label_value_pairs(views.lines(spark, sf_dir), "doc_id", line.startswith("And"), F.length(line) < 12, 40)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature, price = F.col("o_orderpriority"), F.col("o_totalprice")
    value = F.when(feature.isin("3-MEDIUM", "5-LOW"), F.when(F.col("o_orderkey") % 9 == 0, 1.0).otherwise(0.0)).when(feature == "2-HIGH", (F.col("o_orderkey") % 3).cast("double")).otherwise(price)
    status = F.when(price >= 300000, _one_of(F.col("o_orderkey"), ["unknown", "not_disclosed", None, "not_applicable"]))
    return _orders(spark, sf_dir).select(
        F.year("o_orderdate").alias("fold"), F.col("o_custkey").alias("company"), feature.alias("feature_name"), F.when(feature < "3", "urgent").otherwise("normal").alias("category"),
        F.when(price < 300000, value).alias("value"), status.alias("status"), F.year("o_orderdate").alias("reporting_year"),
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame(list(KINDS), "feature_name string, data_type string")
    return choices.fold_masks(_cells(spark, sf_dir), registry, "fold", 20, 0.6, 5, 10, AMBIGUOUS, 0.2)


def audit_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.current_audit(_cells(spark, sf_dir), "company")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("c_acctbal") > 0, F.least(F.lit(100.0), F.col("c_acctbal") / 80))
    rows = views.table(spark, sf_dir, "customer").select("c_mktsegment", share.alias("before"), F.least(F.lit(100.0), share * 1.5).alias("after"))
    return choices.step_summary(rows.withColumn("after", F.when(F.col("before").isNotNull(), F.col("after"))), ["c_mktsegment"], "before", "after", 100.0)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.col("o_custkey").cast("string")
    outcome = _one_of(F.col("o_orderkey"), ["matched", "matched", "ambiguous", "unmatched", "access_blocked", "not_checked", "blocked"])
    score = F.when(outcome == "blocked", F.when(F.col("o_orderkey") % 2 == 0, 5.0)).otherwise(F.round(F.col("o_totalprice") / 4000, 1))
    url = F.concat(F.lit("https://scores.example.org/results?cid="), F.when(F.col("o_orderkey") % 13 != 0, provider).otherwise(F.lit("0")))
    dated = F.when(F.col("o_orderkey") % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("1.5.1998"))
    state = choices.score_state(F.lit("matched"), F.lit("succeeded"), outcome, F.when(outcome == "blocked", "premium_only").otherwise("available"), score, dated, url, provider)
    return _orders(spark, sf_dir).select("o_orderkey", state.alias("state"), score.alias("score"), dated.alias("dated"))


def score_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("o_orderkey", "state")


def scores_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.score_audit(_scores(spark, sf_dir), "state")


QUERIES = {
    "e07_latest_filings": filings, "b17_category_freshness": freshness, "e25_sources_ordered": sources, "e24_family_pages": pages, "f02_top_candidates": top_lines, "f04_last_rows": last_orders,
    "f03_excerpts_in_budget": excerpts, "f05_suggestions": suggested, "d31_chunks_merged": chunks_merged, "d40_memberships": members, "c06_any_name_matched": names_met, "c16_rows_aligned": rows_aligned,
    "c23_documents_visible": documents_visible, "c21_attachments": attachments, "c19_label_value_pairs": pairs_of_lines, "d15_fold_masks": masks, "d05_current_audit": audit_now, "d28_step_summary": steps,
    "b14_score_states": score_states, "d13_scores_audited": scores_audited,
}

_CELLS_SQL = """WITH c0 AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS fold, o_custkey AS company, o_orderpriority AS feature_name, CASE WHEN o_orderpriority < '3' THEN 'urgent' ELSE 'normal' END AS category, o_totalprice < 300000 AS has,
    CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN CASE WHEN o_orderkey % 9 = 0 THEN 1.0 ELSE 0.0 END WHEN o_orderpriority = '2-HIGH' THEN o_orderkey % 3 ELSE o_totalprice END AS v,
    CASE WHEN o_totalprice >= 300000 THEN ['unknown', 'not_disclosed', NULL, 'not_applicable'][o_orderkey % 4 + 1] END AS status FROM orders), c AS (SELECT *, CASE WHEN has THEN v END AS value FROM c0)"""
_SCORES_SQL = """WITH o AS (SELECT o_orderkey, o_custkey, ['matched', 'matched', 'ambiguous', 'unmatched', 'access_blocked', 'not_checked', 'blocked'][o_orderkey % 7 + 1] AS outcome, o_orderkey % 13 <> 0 AND o_custkey > 0 AS own, o_orderkey % 17 <> 0 AS good,
    CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '1.5.1998' END AS dated, CASE WHEN o_orderkey % 7 = 6 THEN CASE WHEN o_orderkey % 2 = 0 THEN 5.0 END ELSE round(o_totalprice / 4000, 1) END AS score FROM orders),
    s AS (SELECT *, CASE WHEN outcome IN ('ambiguous', 'unmatched', 'access_blocked', 'not_checked') THEN outcome WHEN NOT own THEN 'invalid' WHEN outcome = 'blocked' THEN CASE WHEN score IS NULL THEN 'premium_only' ELSE 'invalid' END
          WHEN good AND score BETWEEN 0 AND 100 THEN 'available' ELSE 'invalid' END AS state FROM o)"""

ORACLE_SQL = {
    "e07_latest_filings": views.dated(views.with_views("v_fact") + """, g AS (SELECT company, CASE form WHEN '10-K' THEN 'annual' WHEN '10-Q' THEN 'quarterly' END AS form_group, form, filed, accession FROM v_fact)
        SELECT DISTINCT * FROM g WHERE form_group IS NOT NULL QUALIFY rank() OVER (PARTITION BY company, form_group ORDER BY filed DESC, accession DESC) = 1""", "filed"),
    "b17_category_freshness": """WITH w AS (SELECT o_orderkey AS k, ['sec_annual_filing', 'sec_proxy_statement', 'sec_other', 'issuer_report', NULL][o_orderkey % 5 + 1] AS family, ['financial_report', 'social_employee', 'climate_targets'][o_custkey % 3 + 1] AS category FROM orders),
        t AS (SELECT *, k % 7 < 3 AS own, k % 7 < 5 AS named FROM w)
        SELECT family, category, CASE WHEN k % 11 = 0 THEN 'unknown' WHEN category = 'climate_targets' AND k % 2 = 1 THEN 'unknown' WHEN starts_with(family, 'sec_') THEN CASE WHEN own AND (family = 'sec_annual_filing' AND category = 'financial_report'
        OR family = 'sec_proxy_statement' AND category = 'social_employee') THEN 'latest_verified' ELSE 'unknown' END WHEN named AND NOT own THEN 'unknown' ELSE 'latest_verified' END AS status, count(*) AS n FROM t GROUP BY ALL""",
    "e25_sources_ordered": """WITH r AS (SELECT p_size AS company, p_brand || '/' || p_type AS url, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS document_id, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS title,
        ['latest_verified', 'newer_available', NULL, 'unknown'][p_partkey % 4 + 1] AS freshness, CASE WHEN p_partkey % 5 <> 0 THEN '20' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') END AS dated FROM part),
        n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY company, url ORDER BY document_id DESC NULLS LAST, title DESC) = 1)
        SELECT *, row_number() OVER (PARTITION BY company ORDER BY document_id IS NULL, CASE freshness WHEN 'latest_verified' THEN 0 WHEN 'newer_available' THEN 2 ELSE 1 END, coalesce(dated, '') DESC, title) AS place FROM n""",
    "e24_family_pages": """WITH d AS (SELECT source, doc_id, lower(text) AS t FROM documents), f(family, term) AS (VALUES ('license', 'license'), ('license', 'copyright'), ('contact', '@'), ('contact', 'http'), ('figures', '%'), ('figures', '0')),
        h AS (SELECT source, family, doc_id, CAST(sum(len(string_split(t, term)) - 1) AS BIGINT) AS n_hits FROM d, f GROUP BY ALL)
        SELECT source, family, doc_id, n_hits FROM h WHERE n_hits > 0 QUALIFY row_number() OVER (PARTITION BY source, family ORDER BY n_hits DESC, doc_id) = 1""",
    "f02_top_candidates": """SELECT l_suppkey, l_returnflag, l_extendedprice, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem QUALIFY place <= 5""",
    "f04_last_rows": views.dated("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 3", "day"),
    "f03_excerpts_in_budget": """WITH d AS (SELECT source, coalesce(lang, 'none') AS field, length(text) AS n, doc_id, CASE WHEN contains(text, '%') THEN 1 ELSE 0 END AS score FROM documents),
        b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source, field ORDER BY score DESC, doc_id) = 1), u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY field ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM b)
        SELECT source, field, doc_id, score, used FROM u WHERE used <= 4000""",
    "f05_suggestions": """SELECT o_custkey, 'order ' || o_orderkey AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 <> 0, o_orderkey % 4 <> 0, abs(o_totalprice - 250000), o_orderkey % 5 = 0,
        CASE WHEN o_orderkey % 5 <> 0 THEN abs(o_orderkey % 41 - 20) END, 'order ' || o_orderkey) AS place FROM orders QUALIFY place <= 3""",
    "d31_chunks_merged": """WITH r AS (SELECT l_orderkey, l_returnflag || CASE WHEN year(l_shipdate) = 1998 THEN '' ELSE '_' || year(l_shipdate) END AS name, CAST(floor(l_quantity / 25) AS BIGINT) AS value, CASE WHEN l_linestatus = 'F' THEN 'extracted' ELSE 'estimated' END AS status FROM lineitem),
        c AS (SELECT l_orderkey, name, list(DISTINCT {'v': value, 's': status}) AS l FROM r GROUP BY ALL)
        SELECT l_orderkey, name, CASE WHEN len(l) = 1 THEN l[1].v END AS value, CASE WHEN len(l) = 1 THEN l[1].s ELSE 'conflicting' END AS status, len(l) AS n_candidates FROM c""",
    "d40_memberships": """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS symbols, CASE WHEN count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) = 1 THEN min(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) END AS sector,
        CASE WHEN count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) > 1 THEN 'several_sectors' ELSE 'ok' END AS status FROM orders GROUP BY 1""",
    "c06_any_name_matched": """WITH n AS (SELECT p_partkey, p_name || ' ' || p_brand || CASE WHEN p_partkey % 7 = 0 THEN '?' ELSE '' END AS name FROM part UNION ALL SELECT p_partkey, p_name || ' ' || p_type || ' Brand#1' FROM part),
        c AS (SELECT DISTINCT p_name || ' ' || p_brand AS name, p_size FROM part), m AS (SELECT p_partkey, list(DISTINCT p_size) FILTER (p_size IS NOT NULL) AS ids FROM n LEFT JOIN c USING (name) GROUP BY 1)
        SELECT p_partkey, CASE WHEN len(ids) = 1 THEN ids[1] END AS provider_id, CASE WHEN len(ids) = 1 THEN 'matched' WHEN len(ids) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM m""",
    "c16_rows_aligned": """WITH l AS (SELECT c_custkey AS row_id, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT o_custkey AS row_id, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT s_suppkey AS row_id, count(*) AS n FROM supplier GROUP BY 1)
        SELECT row_id, coalesce(l.n, 0) AS n_labels, coalesce(f.n, 0) AS n_features, coalesce(m.n, 0) AS n_metadata, coalesce(l.n = 1 AND f.n = 1 AND m.n = 1, false) AS is_aligned FROM l FULL JOIN f USING (row_id) FULL JOIN m USING (row_id)""",
    "c23_documents_visible": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR doc_id IN (SELECT p_partkey * 3 FROM part)",
    "c21_attachments": """WITH d AS (SELECT o_orderkey AS document_id, o_custkey % 50 AS c, o_orderpriority AS a, o_orderkey % 40 AS u FROM orders), l AS (SELECT o_orderkey AS w, o_custkey % 50 AS c, o_orderpriority AS a, o_orderkey * 7 % 90 AS u FROM orders)
        SELECT document_id, -min(w) AS wrapper_id, 'Report ' || min(w) AS link_text FROM d JOIN l USING (c, a, u) GROUP BY document_id HAVING count(*) = 1""",
    "c19_label_value_pairs": views.with_views("v_lines") + """, p AS (SELECT doc_id, line_no AS label_line, starts_with(line, 'And') AS is_label, min(CASE WHEN length(line) < 12 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no RANGE BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS value_line FROM v_lines)
        SELECT doc_id, label_line, value_line FROM p WHERE is_label AND value_line IS NOT NULL""",
    "d15_fold_masks": _CELLS_SQL + """, k(feature_name, data_type) AS (VALUES ('1-URGENT', 'number'), ('2-HIGH', 'integer'), ('3-MEDIUM', 'boolean'), ('4-NOT SPECIFIED', 'number'), ('5-LOW', 'boolean')),
        a AS (SELECT fold, feature_name, data_type, count(*) AS n_rows, count(value) AS n_values, count(DISTINCT value) AS n_distinct, count(*) FILTER (value = 0) AS f, count(*) FILTER (value = 1) AS t, count(*) FILTER (NOT has AND coalesce(status, 'unknown') = 'unknown') AS n_unclear FROM c JOIN k USING (feature_name) GROUP BY ALL),
        r AS (SELECT *, concat_ws(',', CASE WHEN n_values < 20 OR n_values < ceil(0.6 * n_rows) THEN 'too_few_values' END, CASE WHEN data_type <> 'boolean' AND n_distinct < 5 THEN 'too_few_different' END, CASE WHEN data_type = 'boolean' AND (f < 10 OR t < 10) THEN 'level_too_rare' END,
              CASE WHEN n_unclear > 0.2 * n_rows THEN 'too_many_unclear' END) AS reasons FROM a) SELECT * EXCLUDE (f, t), reasons = '' AS is_active FROM r""",
    "d05_current_audit": _CELLS_SQL + """ SELECT 'feature' AS level, feature_name AS name, count(value) AS n_with, count(*) - count(value) AS n_without FROM c GROUP BY feature_name
        UNION ALL SELECT 'year', category || ':' || fold, count(DISTINCT CASE WHEN has THEN company END), count(DISTINCT company) - count(DISTINCT CASE WHEN has THEN company END) FROM c GROUP BY category, fold
        UNION ALL SELECT 'status', category || ':' || coalesce(status, 'none'), count(DISTINCT CASE WHEN has THEN company END), count(DISTINCT company) - count(DISTINCT CASE WHEN has THEN company END) FROM c GROUP BY category, status""",
    "d28_step_summary": """WITH s AS (SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN least(100.0, c_acctbal / 80) END AS b FROM customer), t AS (SELECT *, CASE WHEN b IS NOT NULL THEN least(100.0, b * 1.5) END AS a FROM s)
        SELECT c_mktsegment, count(*) AS n_rows, count(b) AS n_observed, count(*) FILTER (b IS NULL) AS n_missing, count(*) FILTER (a IS DISTINCT FROM b) AS n_changed, count(*) FILTER (a = 100) AS n_top, count(*) FILTER (a > 0 AND a < 100) AS n_can_rise FROM t GROUP BY 1""",
    "b14_score_states": _SCORES_SQL + " SELECT o_orderkey, state FROM s",
    "d13_scores_audited": _SCORES_SQL + """ SELECT state, count(*) AS n, count(score) FILTER (state = 'available') AS n_scores, min(dated) FILTER (state = 'available') AS first_date, max(dated) FILTER (state = 'available') AS last_date FROM s GROUP BY 1""",
}
