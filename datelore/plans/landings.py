"""Queries: listings, profiles, widgets, exports and receipts as they land, label eligibility, evidence of values, orders of years and warnings."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import eligibility
from datelore.plans import views
from datelore.plans.lineage import shared_folder
from datelore.plans.wordings import _one_of
from datelore.sources import exports, scans


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of three assets for each page: its own address as a report, one of a broken date, and one of another type; one page in nine answers with a web page."""
    k = F.col("page_id")
    asset = lambda kind, path, day: F.struct(F.lit(kind).alias("Type"), path.alias("FilePath"), F.concat(F.lit(" Report "), k.cast("string")).alias("Title"), _one_of(k, ["PDF", "pdf", "html"]).alias("FileType"), F.lit(day).alias("ContentAssetDate"))
    own = F.concat(F.lit("https://a.example.org/"), k.cast("string"), _one_of(k, [".pdf", ".PDF?x=1", ".pdf", ".doc"]))
    body = F.to_json(F.struct(F.array(asset("esg", own, "03/05/2024 10:00:00"), asset("ESG", own, "2024-03-05"), asset("Other", own, "03/05/2024 10:00:00")).alias("GetContentAssetListResult")))
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.when(k % 9 == 0, F.col("html")).otherwise(body).alias("body"), F.lit("ESG").alias("type"))
    return scans.asset_listing(pages, ["page_id"], "body", "type").withColumn("published", F.col("published").cast("string"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles embedded behind the html of every page, some without a part of theirs."""
    k = F.col("page_id")
    ld = lambda kind: F.concat(F.lit("<script type='application/ld+json'>"), F.to_json(F.struct(F.lit(kind).alias("@type"), F.concat(F.lit("Firm "), k.cast("string")).alias("name"), _one_of(k, ["https://a.example.org/", "http://10.0.0.1/", None]).alias("url"))), F.lit("</script>"))
    ticker = F.when(k % 5 != 0, F.concat(F.lit("<span class=\"x ticker_name\"> T"), k.cast("string"), F.lit(" </span>"))).otherwise("")
    page = F.concat(F.coalesce("html", F.lit("")), F.lit("<script type='application/ld+json'>{broken</script>"), ld("Person"), F.when(k % 7 != 0, ld("Corporation")).otherwise(""), ticker)
    return scans.company_profiles(views.table(spark, sf_dir, "pages").select("page_id", page.alias("html")), ["page_id"], "html")


def widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download widgets in the scripts of every page: one that matters, the same type again, one that does not matter, and on some pages none that works."""
    k = F.col("page_id")
    call = lambda kind, more: F.concat(F.lit("<script>$('#x').downloads({ downloadType: '"), F.lit(kind), F.lit("', "), more, F.lit(" }); </script>"))
    year = F.concat(F.lit("minYear: "), (2012 + k % 20).cast("string"), F.when(k % 2 == 0, ", fetchAllYears: true").otherwise(""))
    script = F.when(k % 4 != 0, "<script src='//widgets.q4app.com/a.js'></script>").otherwise("")
    page = F.concat(F.coalesce("html", F.lit("")), script, call("Human_Rights reports", year), call("human_rights REPORTS", F.lit("a: 1")), call("ESG", F.lit("b: {c: 1}")), call("Earnings", F.lit("d: 2")))
    pages = views.table(spark, sf_dir, "pages").select("page_id", page.alias("html"), F.concat(F.lit("https://p.example.org/"), k.cast("string")).alias("page_url"))
    return scans.download_widgets(pages, ["page_id"], "html", "page_url")


def score_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export for each customer, of a row for each of its orders, some with a fault in the file or in a row; how many rows each gives."""
    c = F.col("c_custkey")
    cik = F.lpad(c.cast("string"), 10, "0")
    verified = views.table(spark, sf_dir, "customer").select(cik.alias("company_cik"), c.cast("string").alias("provider_cid"), F.col("c_name").alias("company_name"))
    row = lambda of, k: F.struct(
        cik.alias("company_cik"), c.cast("string").alias("provider_cid"), F.when(c % 11 == 1, "other").otherwise(of["c_name"]).alias("provider_company_name"), of["c_mktsegment"].alias("industry"), F.lit("esg_score").alias("score_type"),
        F.when(c % 11 == 2, 100.5).otherwise((k % 101).cast("double")).alias("score_value"), (k % 2 == 0).alias("score_under_review"), F.when(c % 11 == 3, "soon").otherwise(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.when(c % 11 == 4, 0).otherwise((k % 100_000).cast("int"))), "yyyy-MM-dd")).alias("last_updated"),
        (2000 + k % 20).alias("assessment_year"),
    )
    orders = views.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    of = views.table(spark, sf_dir, "customer").join(orders, "c_custkey").groupBy("c_custkey").agg(F.collect_list(F.struct("c_name", "c_mktsegment", "o_orderkey")).alias("_of"))
    rows = of.select("c_custkey", F.transform("_of", lambda o: row(o, o["o_orderkey"])).alias("rows"))
    body = F.to_json(F.struct(F.lit("p").alias("provider"), F.when(c % 11 == 5, " ").otherwise("right").alias("license_reference"), F.when(c % 11 == 6, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+00:00").alias("fetched_at"), "rows"))
    judged = scans.judged_exports(rows.select("c_custkey", body.alias("body")), ["c_custkey"], "body", verified)
    total = F.aggregate("rows", F.lit(0.0), lambda so_far, r: so_far + r["score_value"])
    return judged.select("c_custkey", F.array_join("issues", ",").alias("issues"), F.when(F.col("rows").isNotNull(), F.size("rows")).cast("long").alias("n_rows"), total.alias("total"))


def receipt_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of receipt, data, checks and evidence for each document, with its text as data, some with a fault."""
    k = F.col("doc_id")
    data = F.to_json(F.struct(F.struct(F.when(k % 10 == 1, "other").otherwise(k.cast("string")).alias("ticker")).alias("company"), F.col("text")))
    digest = F.when(k % 10 == 2, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(data.cast("binary"), 256))
    receipt = F.to_json(F.struct(
        _one_of(k, ["climate", "social"]).alias("category"), F.when(k % 10 == 3, "old").otherwise("v2").alias("version"), F.lit(True).alias("fresh_original_extraction"), k.alias("document_id"), F.lpad(k.cast("string"), 10, "0").alias("company_cik"), k.cast("string").alias("company_id"),
        F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), F.when(k % 10 == 4, "running").otherwise("succeeded").alias("status"), digest.alias("output_sha256"),
    ))
    checks = F.to_json(F.struct(F.when(k % 10 == 5, "failed").otherwise("passed").alias("status"), *[F.lit(True).alias(c) for c in ("schema_checks", "source_identity_checks", "source_quote_checks")]))
    file = lambda name, content: F.struct(F.concat(F.lit("f/"), k.cast("string"), F.lit(f"/{name}.json")).alias("path"), content.cast("binary").alias("content"))
    every = F.array(file("receipt", F.when(k % 10 == 6, "{broken").otherwise(receipt)), file("data", data), file("validation", checks), file("evidence", F.lit("{}")))
    files = views.table(spark, sf_dir, "documents").where("text is not null").select(F.inline(F.filter(every, lambda f: ~((k % 10 == 7) & F.endswith(f.path, F.lit("/data.json"))))))
    return scans.receipts(files, ("climate", "social"), "v2").select("folder", "category", "document_id", "status", "reason", F.length("data").alias("n_data"))


def label_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all orders as labels: too large ones, missing provenance, and ids that stand twice, counted by reason."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = views.table(spark, sf_dir, "orders").select(
        F.when(k % 17 == 0, "twice").otherwise(k.cast("string")).alias("row_id"), F.col("o_custkey").cast("string").alias("company_cik"), F.year("o_orderdate").cast("string").alias("assessment_cycle"), day.alias("prediction_as_of"),
        (F.col("o_totalprice") / 3000).alias("score"), F.when(k % 5 != 0, day).otherwise("2024-1-1").alias("published"), F.when(k % 7 != 0, "ref").otherwise(" ").alias("reference"),
    )
    return eligibility.exclusion_counts(eligibility.label_exclusions(rows, "score", "published", "reference"), "price")


def present_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as values with evidence that lacks something, and why they may not stand."""
    k, q = F.col("l_partkey"), F.col("l_quantity")
    issue = eligibility.evidence_issue(
        _one_of(F.col("l_suppkey"), ["total", "target_reduction_pct"]), F.col("l_linenumber") == 7, F.when(k % 9 != 0, q), _one_of(k, ["reported", "company_target", "company_estimate", "reported", "not_disclosed"]), k % 7 != 0,
        F.when(k % 8 != 0, q), F.when(k % 4 != 3, "t"), _one_of(k, [1.0, -1.0, 1000.0]),
    )
    return views.table(spark, sf_dir, "lineitem").groupBy(issue.alias("issue")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def year_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last years of each customer's orders as baseline and target of two families, one of them the wrong way round where they differ."""
    years = views.table(spark, sf_dir, "orders").where("o_custkey is not null").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    row = lambda name, value: F.struct(F.lit(name).alias("name"), F.col(value).alias("value"))
    long = years.select("o_custkey", F.inline(F.array(row("x_baseline_year", "a"), row("x_target_year", "b"), row("y_baseline_year", "b"), row("y_target_year", "a"), row("z_target_year", "a"))))
    return eligibility.years_out_of_order(long, ["o_custkey"], "name", "value")


def first_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of each order's lines as its warnings, each once, in the order of lines."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("warning"))
    return eligibility.warnings_once(lines, ["l_orderkey"], "l_linenumber", "warning")


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of suppliers, flat: written as CSV and read back as text."""
    path = f"{shared_folder(spark)}/features_{uuid4().hex}"
    rows = views.table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 2 == 0).alias("even"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).when(F.col("s_acctbal") < -500, F.lit(float("nan"))).alias("balance"))
    exports.write_flat_features(rows, ["s_suppkey"], ["even", "balance"], path)
    read = spark.read.option("header", True).csv(path)
    return read.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("even"), F.col("balance").cast("double").alias("balance"))


def repair_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated and late observations as a list of repairs, written, and the summary beside it."""
    path = f"{shared_folder(spark)}/repairs_{uuid4().hex}"
    found = views.observations(spark, sf_dir)
    issue = F.when(F.col("publication_date").isNull(), "undated_value").when(F.col("publication_date") > "1999-06-30", "after_cutoff")
    exports.write_repairs(found.withColumn("issue", issue).where("issue is not null").select("company_cik", "feature_name", "document_id", "issue"), "1999-06-30", path)
    told = spark.read.schema("audit_cutoff string, row_count long, issue_counts map<string,long>").json(f"{path}/summary")
    return told.select("audit_cutoff", "row_count", F.explode("issue_counts").alias("issue", "n"))


def results_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer with the sums of its orders where it has any; its parts read back."""
    reference = views.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))
    of = views.table(spark, sf_dir, "orders").join(reference.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("last_order"))
    results = of.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("n_orders") % 2 == 0, F.lit("renamed")).alias("name"), "n_orders", "last_order")
    found = exports.company_results(reference, results, "c_custkey", "name")
    read = lambda path: F.get_json_object("document", path)
    return found.select("c_custkey", read("$.company.name").alias("name"), read("$.company.sector").alias("sector"), read("$.result.status").alias("status"), read("$.result.n_orders").cast("long").alias("n_orders"), read("$.result.last_order").cast("long").alias("last_order"))


QUERIES = {
    "a06_asset_listings": listings, "a33_company_profiles": profiles, "a34_download_widgets": widgets, "a35_score_exports": score_exports, "a14_receipt_folders": receipt_folders, "b33_label_eligibility": label_eligibility,
    "b23_present_values": present_values, "b28_year_order": year_order, "f06_first_warnings": first_warnings, "a19_flat_features": flat_rows, "a27_repair_lists": repair_lists, "a28_company_results": results_by_company,
}

ORACLE_SQL = {
    "a06_asset_listings": """WITH p AS (SELECT page_id, page_id AS k, 'https://a.example.org/' || page_id || ['.pdf', '.PDF?x=1', '.pdf', '.doc'][page_id % 4 + 1] AS url FROM pages)
        SELECT page_id, 0 AS "row", url, 'Report ' || page_id AS title, '2024-03-05' AS published, CASE WHEN k % 3 = 2 OR k % 4 = 3 THEN 'invalid_pdf' END AS issue FROM p WHERE k % 9 <> 0 UNION ALL
        SELECT page_id, 1, url, 'Report ' || page_id, NULL, 'invalid_date' FROM p WHERE k % 9 <> 0 UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, 'invalid_listing' FROM p WHERE k % 9 = 0""",
    "a33_company_profiles": """WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'no_profile' WHEN page_id % 5 = 0 THEN 'no_ticker' WHEN page_id % 3 = 2 THEN 'no_url' WHEN page_id % 3 = 1 THEN 'private_url' END AS issue FROM pages)
        SELECT page_id, CASE WHEN issue IS NULL THEN 'T' || page_id END AS ticker, CASE WHEN issue IS NULL THEN 'Firm ' || page_id END AS name, CASE WHEN issue IS NULL THEN 'https://a.example.org/' END AS official_url, issue FROM p""",
    "a34_download_widgets": """SELECT page_id, t AS asset_type, t <> 'ESG' AND page_id % 2 = 0 AS all_years, CASE WHEN t <> 'ESG' THEN CAST(2012 + page_id % 20 AS INTEGER) END AS min_year, 'https://p.example.org' AS origin
        FROM pages, (VALUES ('Human_Rights reports'), ('ESG')) AS v(t) WHERE page_id % 4 <> 0""",
    "a35_score_exports": """WITH r AS (SELECT c_custkey, c_custkey % 11 AS m, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey),
        d AS (SELECT c_custkey, m, CASE WHEN m = 3 THEN 0 WHEN m = 4 THEN 0 ELSE k % 100000 END AS day, k % 20 AS y, count(*) AS n FROM r GROUP BY ALL), i AS (SELECT c_custkey, m, max(n) AS n FROM d GROUP BY ALL),
        t AS (SELECT c_custkey, count(*) AS n, CAST(sum(k % 101) AS DOUBLE) AS s FROM r GROUP BY 1),
        w AS (SELECT c_custkey, concat_ws(',', CASE WHEN m = 6 THEN 'fetched_at' END, CASE WHEN m = 1 THEN 'identity' END, CASE WHEN m = 3 THEN 'last_updated' END, CASE WHEN m = 5 THEN 'license' END, CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN m = 2 THEN 'score_value' END) AS issues FROM i)
        SELECT c_custkey, issues, CASE WHEN issues = '' THEN t.n END AS n_rows, CASE WHEN issues = '' THEN t.s END AS total FROM w JOIN t USING (c_custkey)""",
    "a14_receipt_folders": """WITH d AS (SELECT doc_id, doc_id % 10 AS m, text FROM documents WHERE text IS NOT NULL AND doc_id % 10 NOT IN (3, 6)), r AS (SELECT *, CASE m WHEN 7 THEN 'no_data' WHEN 2 THEN 'data_changed' WHEN 1 THEN 'other_company' WHEN 5 THEN 'checks_not_passed' END AS reason FROM d)
        SELECT 'f/' || doc_id AS folder, ['climate', 'social'][doc_id % 2 + 1] AS category, doc_id AS document_id, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN m = 4 THEN 'running' ELSE 'succeeded' END AS status, reason,
        CASE WHEN reason IS NULL AND m <> 4 THEN CAST(length(CAST(to_json({'company': {'ticker': CAST(doc_id AS VARCHAR)}, 'text': text}) AS VARCHAR)) AS INTEGER) END AS n_data FROM r""",
    "b33_label_eligibility": """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice / 3000 AS s, count(*) OVER (PARTITION BY CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE o_orderkey END) AS times FROM orders)
        SELECT 'price' AS target, CASE WHEN times > 1 THEN 'repeated_row' WHEN s IS NULL OR s > 100 OR s < 0 THEN 'missing_or_invalid_label' WHEN k % 5 = 0 OR k % 7 = 0 OR c IS NULL THEN 'missing_label_provenance' ELSE 'used' END AS reason, count(*) AS n FROM r GROUP BY ALL""",
    "b23_present_values": """WITH r AS (SELECT l_partkey AS k, l_suppkey % 2 = 1 AS pct, l_linenumber = 7 AS b, l_quantity AS q FROM lineitem)
        SELECT CASE WHEN k % 9 = 0 OR q IS NULL THEN NULL WHEN k % 7 = 0 THEN 'no_evidence' WHEN k % 5 = 4 THEN 'status_without_value' WHEN NOT b AND (k % 8 = 0 OR k % 4 = 3) THEN 'incomplete_evidence' WHEN NOT b AND k % 3 = 1 AND NOT pct THEN 'scale_sign' END AS issue,
        count(*) AS n, sum(q) AS quantity FROM r GROUP BY 1""",
    "b28_year_order": """WITH y AS (SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
        SELECT o_custkey, 'y' AS family FROM y UNION ALL SELECT o_custkey, 'x' FROM y WHERE a = b""",
    "f06_first_warnings": """WITH f AS (SELECT l_orderkey, l_returnflag || l_linestatus AS warning, min(l_linenumber) AS first_at FROM lineitem GROUP BY ALL HAVING warning IS NOT NULL)
        SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first_at, warning) AS INTEGER) AS place, warning FROM f""",
    "a19_flat_features": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '0' END END AS even, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier",
    "a27_repair_lists": views.with_views("v_observation") + """, i AS (SELECT CASE WHEN publication_date IS NULL THEN 'undated_value' WHEN publication_date > DATE '1999-06-30' THEN 'after_cutoff' END AS issue FROM v_observation)
        SELECT '1999-06-30' AS audit_cutoff, CAST(sum(count(*)) OVER () AS BIGINT) AS row_count, issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue""",
    "a28_company_results": """WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS k FROM orders GROUP BY 1)
        SELECT c_custkey, CASE WHEN n % 2 = 0 THEN 'renamed' ELSE c_name END AS name, c_mktsegment AS sector, CASE WHEN n IS NULL THEN 'not_extracted' ELSE 'extracted' END AS status, n AS n_orders, k AS last_order FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
}
