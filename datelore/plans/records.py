"""Queries: latest state, facts, upserts, matching, splits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import latest, matching, splits
from datelore.plans import views


def latest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.observations(spark, sf_dir).select("company_cik", "feature_name", "value", "publication_date", "document_id")
    return latest.first_by(rows, ["company_cik", "feature_name"], [F.col("publication_date").desc_nulls_last(), F.col("document_id").desc()])


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return latest.first_by(rows, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


def selected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.facts(spark, sf_dir).where(latest.period_kind("form", "period_start", "period_end", "fp") == "annual")
    return latest.select_facts(facts.select("company", "metric", "form", "period_start", "period_end", "priority", "filed", "accession", "value"), ["company", "metric"])


def period_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(latest.period_kind("form", "period_start", "period_end", "fp"), F.lit("other"))
    return views.facts(spark, sf_dir).groupBy("form", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest.merged_values(views.facts(spark, sf_dir), ["company", "metric"], "value", 1e-5)
    return found.select("company", "metric", "value", "status", "n", F.size(F.coalesce("candidates", F.array().cast("array<double>"))).alias("n_candidates"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seen"))
    return latest.upsert(rows.where("seen % 2 = 0"), rows.where("seen % 2 = 1"), ["user_id", "event_type"], "seen")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    return latest.current_flags(orders.where("o_orderdate < '1998-01-01'"), orders.where("o_orderdate >= '1998-01-01'"), "o_custkey")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.facts(spark, sf_dir)
    of = lambda form: facts.where(F.col("form") == form).groupBy("company").agg(F.max("metric").cast("double").alias("value"))
    return latest.disagreements(of("10-K"), of("10-Q"), ["company"], 1.0)


def names_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part")
    left = parts.select(F.col("p_partkey").alias("left_id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    right = parts.select(F.when(F.col("p_partkey") % 2 == 1, F.col("p_partkey")).otherwise(-F.col("p_partkey")).alias("right_id"), F.concat(F.when(F.col("p_partkey") % 2 == 1, "").otherwise("another "), F.concat_ws(" ", "p_name", "p_brand")).alias("name"))
    fixed = parts.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("left_id"), F.expr("p_partkey + if(p_partkey % 100 = 0, 1, 2)").alias("right_id"))
    return matching.match_unique(left, right, "left_id", "right_id", "name", fixed)


def classes_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return matching.agreed_class(lines, views.table(spark, sf_dir, "part").withColumn("p_partkey", F.when(F.col("p_size") > 10, F.col("p_partkey")).otherwise(-F.col("p_partkey"))), "l_orderkey", "p_partkey", "p_type")


def universe_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = views.companies(spark, sf_dir)
    verified = views.observations(spark, sf_dir).where("publication_date is not null").groupBy("company_cik").agg((F.min("document_id") % 300).alias("provider_id"))
    strangers = verified.withColumn("company_cik", F.when(F.col("provider_id") % 9 == 0, F.concat(F.lit("X"), "company_cik")).otherwise(F.col("company_cik")))
    return matching.coverage_of(companies, strangers, "company_cik", "provider_id")


def range_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.financials(spark, sf_dir).unpivot("company_cik", ["revenue", "units", "balance"], "feature_name", "value")
    return matching.meets_all(long, "company_cik", [("revenue", 1e7, 3e7), ("balance", 0.0, 6000.0)])


def either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part")
    sources = parts.select(F.col("p_partkey").alias("source"), F.col("p_name").alias("url"), F.concat_ws("/", "p_name", "p_brand").alias("final_url"))
    moved = F.when(F.col("p_partkey") % 3 == 0, "").otherwise("elsewhere/")
    documents = parts.select(F.col("p_partkey").alias("document_id"), F.col("p_size").alias("task"), F.concat(moved, F.concat_ws(" ", "p_name", "p_type")).alias("url"), F.concat(moved, F.concat_ws("/", "p_name", "p_brand")).alias("final_url"))
    return matching.latest_by_either_key(sources, documents, "source", ["url", "final_url"], ["task"]).select("source", "document_id")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = views.companies(spark, sf_dir)
    asked = companies.select(F.when(F.col("sub_class") % 2 == 0, F.lower("ticker")).otherwise(F.col("company_cik")).alias("given"))
    known = companies.withColumns({c: F.when(F.col("sub_class") < 22, F.col(c)).otherwise(F.concat(F.lit("?"), c)) for c in ("company_cik", "ticker")})
    return matching.resolve(asked, known, "given", "company_cik", "ticker")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies, rows = views.companies(spark, sf_dir).select("company_cik"), views.observations(spark, sf_dir)
    return matching.child_counts(companies, {"n_dated": rows.where("publication_date is not null"), "n_undated": rows.where("publication_date is null")}, "company_cik")


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.expanding_folds(views.label_rows(spark, sf_dir), 2)


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.label_rows(spark, sf_dir).select("company_cik", "cycle", "industry", F.round(F.col("score") + F.col("cycle") % 7, 6).alias("score"))
    held = splits.baselines(splits.expanding_folds(views.label_rows(spark, sf_dir), 2).join(rows, ["company_cik", "cycle"]), "industry")
    plain = splits.errors(held, ["fold", "role"], "score", "global_median").withColumn("baseline", F.lit("global"))
    own = splits.errors(held, ["fold", "role"], "score", "group_median").withColumn("baseline", F.lit("industry"))
    return plain.unionByName(own).select("fold", "role", "baseline", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "n")


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splits.rank_correlation(views.financials(spark, sf_dir), "industry", "balance", "units")
    return found.select("industry", "n", F.round("spearman", 6).alias("spearman"))


QUERIES = {
    "e01_latest_observations": latest_observations, "e02_latest_events": latest_events, "e05_selected_facts": selected_facts, "b11_period_kinds": period_kinds, "d32_merged_values": merged,
    "a20_upserted": upserted, "a23_membership": membership, "d33_compared": compared, "c04_names_matched": names_matched, "c09_classes_agreed": classes_agreed, "c07_universe_covered": universe_covered,
    "c12_range_filters": range_filters, "c10_either_key": either_key, "c27_resolved": resolved, "c13_counted": counted, "e18_folds": folds, "d18_fold_metrics": fold_metrics, "d20_correlations": correlations,
}

_FACT = views.with_views("v_fact")
_KIND = """CASE WHEN form NOT IN ('10-K', '10-Q', '8-K', '20-F/A') THEN 'other' WHEN period_start IS NULL THEN 'instant'
    WHEN form IN ('10-K', '20-F/A') AND fp = 'FY' AND period_end - period_start BETWEEN 299 AND 429 THEN 'annual' WHEN period_end - period_start BETWEEN 59 AND 119 THEN 'quarter' ELSE 'other' END"""
_FOLDS = views.with_views("v_label") + """, c AS (SELECT cycle AS fold, min(as_of) AS cutoff, row_number() OVER (ORDER BY cycle DESC) AS back FROM v_label GROUP BY cycle QUALIFY back <= 2),
    f AS (SELECT fold, CASE WHEN back = 1 THEN 'test' ELSE 'validation' END AS role, company_cik, cycle, as_of FROM v_label JOIN c ON cycle = fold
    UNION ALL SELECT fold, 'train', company_cik, cycle, as_of FROM v_label JOIN c ON cycle < fold AND published_date <= cutoff)"""

ORACLE_SQL = {
    "e01_latest_observations": views.dated(views.with_views("v_observation") + """ SELECT company_cik, feature_name, value, publication_date, document_id FROM v_observation
        QUALIFY row_number() OVER (PARTITION BY company_cik, feature_name ORDER BY publication_date DESC NULLS LAST, document_id DESC) = 1""", "publication_date"),
    "e02_latest_events": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "e05_selected_facts": views.dated(_FACT + f""", a AS (SELECT company, metric, form, period_start, period_end, priority, filed, accession, value FROM v_fact WHERE {_KIND} = 'annual'),
        t AS (SELECT company, metric, period_start, period_end, priority, count(DISTINCT value) AS n_values, count(*) AS n_published FROM a GROUP BY ALL)
        SELECT a.*, n_values, n_published, n_values > 1 AS is_disputed, ends_with(form, '/A') AS is_amendment FROM a JOIN t USING (company, metric, period_start, period_end, priority)
        QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY period_end DESC, priority, filed DESC, accession DESC, value DESC) = 1""", "period_end", "period_start", "filed"),
    "b11_period_kinds": _FACT + f" SELECT form, {_KIND} AS kind, count(*) AS n, round(sum(value), 2) AS total FROM v_fact GROUP BY ALL",
    "d32_merged_values": _FACT + """ SELECT company, metric, CASE WHEN max(value) - min(value) <= 1e-5 THEN min(value) END AS value, CASE WHEN max(value) - min(value) > 1e-5 THEN 'conflicting' ELSE 'agreed' END AS status,
        count(*) AS n, CAST(CASE WHEN max(value) - min(value) > 1e-5 THEN count(DISTINCT value) ELSE 0 END AS INTEGER) AS n_candidates FROM v_fact GROUP BY ALL""",
    "a20_upserted": "SELECT user_id, event_type, min(event_id) AS first_seen, max(event_id) AS last_seen, max_by(value, event_id) AS value FROM events GROUP BY ALL",
    "a23_membership": """SELECT coalesce(b, a) AS o_custkey, b IS NOT NULL AS is_current, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'dropped' ELSE 'kept' END AS change
        FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderdate < DATE '1998-01-01') FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_orderdate >= DATE '1998-01-01') ON a = b""",
    "d33_compared": _FACT + """, k AS (SELECT company, CAST(max(metric) AS DOUBLE) AS left_value FROM v_fact WHERE form = '10-K' GROUP BY 1), q AS (SELECT company, CAST(max(metric) AS DOUBLE) AS right_value FROM v_fact WHERE form = '10-Q' GROUP BY 1)
        SELECT company, left_value, right_value, CASE WHEN left_value IS NULL THEN 'only_right' WHEN right_value IS NULL THEN 'only_left' ELSE 'different' END AS issue FROM k FULL JOIN q USING (company)
        WHERE left_value IS NULL OR right_value IS NULL OR abs(left_value - right_value) > 1""",
    "c04_names_matched": """WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part), l AS (SELECT p_partkey AS left_id, name, count(*) OVER (PARTITION BY name) AS mine FROM p),
        r AS (SELECT name, count(*) AS theirs, min(p_partkey) AS rid FROM p WHERE p_partkey % 2 = 1 GROUP BY 1), o AS (SELECT p_partkey AS left_id, p_partkey + CASE WHEN p_partkey % 100 = 0 THEN 1 ELSE 2 END AS ov FROM part WHERE p_partkey % 50 = 0),
        j AS (SELECT left_id, rid, ov, e.p_partkey AS ex, CASE WHEN ov IS NOT NULL THEN CASE WHEN e.p_partkey IS NULL THEN 'override_missing' ELSE 'matched_by_override' END
              WHEN theirs IS NULL THEN 'unmatched' WHEN mine > 1 OR theirs > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome
              FROM l LEFT JOIN r USING (name) LEFT JOIN o USING (left_id) LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 1) e ON e.p_partkey = ov)
        SELECT left_id, CASE outcome WHEN 'matched_by_override' THEN ex WHEN 'matched' THEN rid END AS right_id, outcome FROM j""",
    "c09_classes_agreed": """SELECT l_orderkey, CASE WHEN min(p_type) = max(p_type) THEN min(p_type) END AS p_type, CASE WHEN min(p_type) IS NULL THEN 'missing' WHEN min(p_type) <> max(p_type) THEN 'ambiguous' ELSE 'agreed' END AS status,
        count(*) AS n_members FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1""",
    "c07_universe_covered": views.with_views("v_company", "v_observation") + """, v0 AS (SELECT company_cik, min(document_id) % 300 AS provider_id FROM v_observation WHERE publication_date IS NOT NULL GROUP BY 1),
        v AS (SELECT CASE WHEN provider_id % 9 = 0 THEN 'X' || company_cik ELSE company_cik END AS company_cik, provider_id FROM v0), u AS (SELECT *, count(*) OVER (PARTITION BY provider_id) AS uses FROM v)
        SELECT company_cik, provider_id, CASE WHEN c.company_name IS NULL THEN 'outside_universe' WHEN provider_id IS NULL THEN 'missing' WHEN uses > 1 THEN 'reused_id' ELSE 'covered' END AS status
        FROM v_company c FULL JOIN u USING (company_cik)""",
    "c12_range_filters": views.with_views("v_financials") + " SELECT company_cik FROM v_financials WHERE revenue BETWEEN 1e7 AND 3e7 AND balance BETWEEN 0 AND 6000",
    "c10_either_key": """WITH s AS (SELECT p_partkey AS source, p_name || '/' || p_brand AS u FROM part), d AS (SELECT p_partkey, p_size, p_name || '/' || p_brand AS u FROM part WHERE p_partkey % 3 = 0)
        SELECT source, max(struct_pack(a := p_size, b := p_partkey)).b AS document_id FROM s LEFT JOIN d USING (u) GROUP BY source""",
    "c27_resolved": views.with_views("v_company") + """, a AS (SELECT DISTINCT CASE WHEN sub_class % 2 = 0 THEN lower(ticker) ELSE company_cik END AS given FROM v_company)
        SELECT given, CASE WHEN count(company_cik) = 1 THEN min(company_cik) END AS company_cik, count(company_cik) AS n_matches FROM a LEFT JOIN (SELECT * FROM v_company WHERE sub_class < 22) c ON given = c.company_cik OR upper(given) = upper(ticker) GROUP BY 1""",
    "c13_counted": views.with_views("v_company", "v_observation") + " SELECT company_cik, count(o.publication_date) AS n_dated, count(o.document_id) - count(o.publication_date) AS n_undated FROM v_company LEFT JOIN v_observation o USING (company_cik) GROUP BY 1",
    "e18_folds": views.dated(_FOLDS + " SELECT * FROM f", "as_of"),
    "d18_fold_metrics": _FOLDS + """, s AS (SELECT f.fold, f.role, industry, round(score + cycle % 7, 6) AS score FROM f JOIN v_label USING (company_cik, cycle)),
        g AS (SELECT fold, median(score) AS gm FROM s WHERE role = 'train' GROUP BY 1), i AS (SELECT fold, industry, median(score) AS im FROM s WHERE role = 'train' GROUP BY ALL),
        h AS (SELECT fold, role, score, gm, coalesce(im, gm) AS im FROM s LEFT JOIN g USING (fold) LEFT JOIN i USING (fold, industry) WHERE role <> 'train')
        SELECT fold, role, 'global' AS baseline, round(avg(abs(gm - score)), 6) AS mae, round(sqrt(avg((gm - score) ** 2)), 6) AS rmse, count(gm - score) AS n FROM h GROUP BY ALL
        UNION ALL SELECT fold, role, 'industry', round(avg(abs(im - score)), 6), round(sqrt(avg((im - score) ** 2)), 6), count(im - score) FROM h GROUP BY ALL""",
    "d20_correlations": views.with_views("v_financials") + """, r AS (SELECT industry, rank() OVER (PARTITION BY industry ORDER BY balance) + (count(*) OVER (PARTITION BY industry, balance) - 1) / 2 AS a,
        rank() OVER (PARTITION BY industry ORDER BY units) + (count(*) OVER (PARTITION BY industry, units) - 1) / 2 AS b FROM v_financials WHERE balance IS NOT NULL AND units IS NOT NULL)
        SELECT industry, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS spearman FROM r GROUP BY 1""",
}
