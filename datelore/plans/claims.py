"""Queries: values against the lines that they were read from, records, seeds, stored documents and score rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import claims
from datelore.plans import views
from datelore.plans.wordings import _one_of

SCOPE_LINES = [
    "Scope 1 emissions | 12", "Scope 2 (market-based) | 12", "Scope 2 location-based | 12", "Scope 1 and 2 market-based | 12", "Total Scope 3 | 12", "Scope 3 category 4 | 12",
    "Scope 1 | 9\nScope 2 market-based | 12",
]
ENERGY_LINES = [
    "Office energy use", "Total energy, office energy included", "Renewable electricity", "Renewable energy", "Purchased renewable electricity", "Renewable electricity consumption, on-site",
    "Total energy > 12", "RECs and renewable electricity",
]
TOPICS = {"license": "licen[sc]e", "pair": "the.{0,40}tion", "mark": "%%%"}
PROVIDERS = ("filing", "hub")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "lineitem")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    field, line = _one_of(F.col("l_suppkey"), [*claims.SCOPES, "other"]), _one_of(F.col("l_partkey"), SCOPE_LINES)
    return _lines(spark, sf_dir).groupBy(field.alias("field"), line.alias("line"), claims.scope_issue(field, line, F.lit("12")).isNull().alias("is_established")).agg(F.count(F.lit(1)).alias("n"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    field, line = _one_of(F.col("l_suppkey"), [*claims.RIVALS, "other"]), _one_of(F.col("l_partkey"), ENERGY_LINES)
    issue = claims.boundary_issue(field, line, F.lit(None).cast("string"), F.lit("12"))
    return _lines(spark, sf_dir).groupBy(field.alias("field"), line.alias("line"), issue.alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, year = F.col("l_quantity"), F.year("l_shipdate")
    value = _one_of(F.col("l_partkey"), [q, -q, q * 10, F.lit(None).cast("double")])
    rows = _lines(spark, sf_dir).select(value.alias("value"), claims.physical_issue(value, _one_of(F.col("l_suppkey"), ["percent", "t"]), year, F.lit(1998), F.when(F.col("l_linenumber") == 2, "company_target")).alias("i"))
    return rows.groupBy("i.status", "i.reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("i").isNull(), F.col("value"))).alias("n_values"))


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, factor = F.col("l_quantity"), _one_of(F.col("l_suppkey"), [1.0, 1000.0, 0.001])
    value = _one_of(F.col("l_partkey"), [q * factor, q * factor * (1 + 1e-12), q, F.lit(None).cast("double"), q * factor + 1])
    ok = claims.agrees(value, q * factor, whole=F.col("l_linenumber") == 1)
    return _lines(spark, sf_dir).groupBy((F.col("l_partkey") % 5).alias("told_as"), (F.col("l_suppkey") % 3).alias("factor_no"), ok.alias("agrees")).agg(F.count(F.lit(1)).alias("n"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    said = F.concat(F.lit("Total "), F.format_number(price, 2), F.lit(" in "), F.year("o_orderdate").cast("string"))
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 11 != 0, price).alias("value"), said.alias("said"), _one_of(k, [said, F.lit("Total"), F.lit(None).cast("string")]).alias("quote"), F.year("o_orderdate").alias("year"))
    rules = {"quoted": F.col("quote").isNotNull(), "grounded": F.contains("said", F.col("quote")), "printed": F.contains("quote", F.format_number("value", 2)), "range": F.col("value") <= 400000, "year": F.col("year") >= 1996}
    return claims.validated(rows, "value", rules).select("o_orderkey", "value", "issue")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", F.array_join(claims.content_topics(F.col("html"), TOPICS), ",").alias("topics"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    metric = lambda name, value, unit, y, status: F.struct(F.lit(name).alias("name"), value.alias("value"), unit.alias("unit"), y.alias("fiscal_year"), status.alias("status"))
    sums = metric("revenue", F.when(k % 3 != 0, F.col("o_totalprice")), _one_of(k, ["USD", "EUR", None]), F.when(k % 5 != 0, year).otherwise(year - 1), F.when(k % 2 == 0, "reported").otherwise("not_disclosed"))
    staff = metric("employees", F.lit(None).cast("double"), F.when(k % 7 == 0, "people"), year, F.lit("not_disclosed"))
    found = claims.record_issues(year, F.when(k % 4 != 0, "USD").otherwise("US$"), F.array(sums, staff))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("issues"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = views.table(spark, sf_dir, "orders").where("o_custkey is not null").select(
        k.alias("seed_id"), F.when(k % 6 == 0, -k).otherwise(k).alias("c_custkey"), _one_of(k, ["https://a.example.org", "http://a.example.org:443/x", "http://u:p@a.example.org/", "http://a.example.org:9999/", "ftp://a.example.org", "http://127.0.0.1/", "http://10.0.0.1:80/", "http://a.example.org:80/"]).alias("url"),
        _one_of(k, ["filing", "hub", "other", None]).alias("provider"), F.when(k % 7 != 0, k + 1).alias("document_id"), F.when(k % 9 != 0, "seen").otherwise(" ").alias("context"),
    )
    twice = rows.unionByName(rows.where("seed_id % 10 = 1").withColumn("seed_id", -F.col("seed_id")))
    return claims.seeds_checked(twice, views.table(spark, sf_dir, "customer"), "c_custkey", PROVIDERS).select("seed_id", F.array_join("issues", ",").alias("issues"))


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, digest, size = F.col("doc_id"), F.sha2("text", 256), F.octet_length("text")
    docs = views.table(spark, sf_dir, "documents")
    told = docs.select("source", "lang", k.alias("document_id"), F.when(k % 3 != 0, digest).otherwise(F.reverse(digest)).alias("sha256"), F.when(k % 5 != 0, size).otherwise(size + 1).alias("n_bytes"))
    return claims.newest_verified(told, docs.select(digest.alias("sha256"), size.alias("n_bytes")), ["source", "lang"])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = (k + F.when(k % 3 == 0, 1).otherwise(0)).cast("string")
    cik = F.when(k % 8 != 0, F.lpad(own, 10, "0")).otherwise(own)
    return claims.scores_by_company(views.table(spark, sf_dir, "orders").select(cik.alias("company_cik"), _one_of((k / 5).cast("long"), ["available", "ambiguous"]).alias("state"), F.col("o_totalprice").alias("score")), "company_cik")


QUERIES = {
    "b35_scope_lines": scopes, "b38_energy_boundaries": boundaries, "b20_physical_values": physical, "b21_values_converted": converted, "b47_fields_validated": fields, "b42_content_topics": topics,
    "b52_record_issues": records, "b58_seeds_checked": seeds, "c29_newest_verified": verified, "a15_scores_by_company": scores,
}

_SCOPE_LIST = "[" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in SCOPE_LINES) + "]"
_ENERGY_LIST = "[" + ", ".join(f"'{s}'" for s in ENERGY_LINES) + "]"

ORACLE_SQL = {
    # which line (from 0) establishes which field is listed, not computed
    "b35_scope_lines": f"""WITH t AS (SELECT ['scope_1', 'scope_2_market', 'scope_2_location', 'scope_1_2_market', 'scope_3_total', 'other'][l_suppkey % 6 + 1] AS field, l_partkey % 7 AS i, {_SCOPE_LIST}[l_partkey % 7 + 1] AS line FROM lineitem)
        SELECT field, line, CASE field WHEN 'scope_1' THEN i = 0 WHEN 'scope_2_market' THEN i IN (1, 6) WHEN 'scope_2_location' THEN i = 2 WHEN 'scope_1_2_market' THEN i = 3 WHEN 'scope_3_total' THEN i = 4 ELSE true END AS is_established,
        count(*) AS n FROM t GROUP BY ALL""",
    "b38_energy_boundaries": f"""WITH t AS (SELECT ['total_energy', 'renewable_energy', 'renewable_electricity', 'other'][l_suppkey % 4 + 1] AS field, l_partkey % 8 AS i, {_ENERGY_LIST}[l_partkey % 8 + 1] AS line FROM lineitem)
        SELECT field, line, CASE WHEN i = 6 THEN 'bound_is_not_a_point' WHEN field = 'total_energy' AND i = 0 THEN 'office_is_not_total' WHEN field = 'renewable_energy' AND i IN (2, 4, 5, 7) THEN 'electricity_is_not_energy'
        WHEN field = 'renewable_electricity' AND i = 3 THEN 'energy_is_not_electricity' WHEN field = 'renewable_electricity' AND i IN (4, 7) THEN 'part_is_not_total' END AS issue, count(*) AS n FROM t GROUP BY ALL""",
    "b20_physical_values": """WITH t AS (SELECT l_partkey % 4 AS p, l_suppkey % 2 = 0 AS share, l_linenumber = 2 AS target, year(l_shipdate) AS y, CASE l_partkey % 4 WHEN 0 THEN l_quantity WHEN 1 THEN -l_quantity WHEN 2 THEN l_quantity * 10 END AS v FROM lineitem),
        r AS (SELECT v, CASE WHEN v IS NULL THEN NULL WHEN target THEN 'target' WHEN y IS DISTINCT FROM 1998 THEN 'other_year' WHEN v < 0 THEN 'negative' WHEN share AND v > 100 THEN 'above_100' END AS reason FROM t)
        SELECT CASE WHEN reason = 'target' THEN 'not_applicable' WHEN reason IS NOT NULL THEN 'conflicting' END AS status, reason, count(*) AS n, count(v) FILTER (reason IS NULL) AS n_values FROM r GROUP BY ALL""",
    "b21_values_converted": """WITH t AS (SELECT l_partkey % 5 AS p, l_suppkey % 3 AS s, l_linenumber = 1 AS whole, l_quantity AS q, CASE l_suppkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 1e3 ELSE 1e-3 END AS f FROM lineitem),
        u AS (SELECT *, CASE p WHEN 0 THEN q * f WHEN 1 THEN q * f * (1 + 1e-12) WHEN 2 THEN q WHEN 4 THEN q * f + 1 END AS v FROM t)
        SELECT p AS told_as, s AS factor_no, coalesce(abs(v - q * f) <= greatest(1e-9, greatest(abs(v), abs(q * f)) * 1e-9) AND (NOT whole OR v = floor(v)), false) AS agrees, count(*) AS n FROM u GROUP BY ALL""",
    "b47_fields_validated": """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS v, o_orderkey % 3 AS m, year(o_orderdate) AS y FROM orders),
        r AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN m = 2 THEN 'quoted' WHEN m = 1 THEN 'printed' WHEN v > 400000 THEN 'range' WHEN y < 1996 THEN 'year' END AS issue FROM t)
        SELECT o_orderkey, CASE WHEN issue IS NULL THEN v END AS value, issue FROM r""",
    "b42_content_topics": r"""WITH p AS (SELECT page_id, trim(regexp_replace(lower(regexp_replace(html, '<[^>]+>', ' ', 'g')), '\s+', ' ', 'g')) AS t FROM pages)
        SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(t, 'licen[sc]e') THEN 'license' END, CASE WHEN regexp_matches(t, 'the.{0,40}tion') THEN 'pair' END, CASE WHEN contains(t, '%%%') THEN 'mark' END) AS topics FROM p""",
    "b52_record_issues": """WITH o AS (SELECT o_orderkey, o_orderkey AS k, ['USD', 'EUR', NULL][o_orderkey % 3 + 1] AS unit, o_orderkey % 4 <> 0 AS usd FROM orders)
        SELECT o_orderkey, concat_ws(',', CASE WHEN NOT usd THEN 'currency' END, CASE WHEN k % 5 = 0 THEN 'fiscal_year' END, CASE WHEN k % 7 = 0 OR unit IS NOT NULL AND NOT (usd AND unit = 'USD') THEN 'unit' END,
        CASE WHEN k % 2 = 0 AND k % 3 <> 1 OR k % 2 = 1 AND k % 3 <> 0 THEN 'value' END) AS issues FROM o""",
    "b58_seeds_checked": """WITH s AS (SELECT o_orderkey AS seed_id, o_orderkey AS k FROM orders WHERE o_custkey IS NOT NULL UNION ALL SELECT -o_orderkey, o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 10 = 1)
        SELECT seed_id, concat_ws(',', CASE WHEN CASE WHEN k % 6 = 0 THEN -k ELSE k END NOT IN (SELECT c_custkey FROM customer) THEN 'company' END, CASE WHEN k % 10 = 1 THEN 'repeated' END, CASE WHEN k % 8 BETWEEN 1 AND 6 THEN 'url' END,
        CASE WHEN k % 4 >= 2 THEN 'provider' END, CASE WHEN k % 7 = 0 OR k % 9 = 0 THEN 'evidence' END) AS issues FROM s""",
    "c29_newest_verified": """SELECT source, lang, doc_id AS document_id, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 AND doc_id % 5 <> 0
        QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1""",
    "a15_scores_by_company": """WITH r AS (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS own, count(*) AS n, min(o_orderkey) AS k, min(o_totalprice) AS v FROM orders WHERE o_orderkey % 8 <> 0 GROUP BY 1)
        SELECT lpad(CAST(own AS VARCHAR), 10, '0') AS company_cik, CASE WHEN n > 1 THEN 'invalid' WHEN k // 5 % 2 = 0 THEN 'available' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 AND k // 5 % 2 = 0 THEN v END AS score FROM r""",
}
