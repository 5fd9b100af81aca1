"""Queries: text and number expressions, units, contracts, lines, evidence and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.functions import text, units
from datelore.operators import documents
from datelore.plans import views


def names_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" & "), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, " Co., Inc.").otherwise(" (Class A)"))
    return parts.select("p_partkey", text.company_name(raw).alias("company"), text.issuer_name(raw).alias("issuer"), text.ticker(raw).alias("ticker"))


def names_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length(text.company_name(text.nfkc(F.col("text")))).alias("n"))


def numbers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"), "l_partkey").distinct()
    raw = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("$ "), F.format_number("v", 2))).when(F.col("l_partkey") % 3 == 1, F.concat(F.format_number("v", 1), F.lit(" million"))).otherwise(F.concat(F.format_number("v", 0), F.lit(" + 1")))
    items = parts.select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", text.reported_number(F.col("raw")).alias("number"))


def units_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("GWh", "kWh", "gigajoules", "Mt", "barrels")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = items.select("l_returnflag", F.col("l_quantity").alias("v"), unit.alias("unit"), F.lit("MWh").alias("target"))
    return units.converted(rows, "v", "unit", "target").groupBy("l_returnflag", "unit").agg(F.count("converted").alias("n"), F.round(F.sum("converted"), 4).alias("total"))


def contracts_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.observations(spark, sf_dir)
    rules = {
        "company_id": text.cik(F.col("company_cik")).isNotNull(), "unit": F.col("unit") == "usd", "dated": F.col("publication_date").isNotNull(),
        "year": F.col("reporting_year").between(1995, 2000), "finite": ~F.isnan("value") & (F.col("value") >= 1000),
    }
    return rows.groupBy(F.array_join(text.broken_rules(rules), ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


def ledger_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    cost = text.token_cost(k * 1000, (F.col("value") * 10).cast("bigint"), k * 100, ("2.5", "10.0", "0.25"))
    return events.groupBy("event_type").agg(F.sum(cost).cast("double").alias("cost"), F.sum(k).alias("tokens"), F.count(F.lit(1)).alias("calls"))


def dates_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_partkey") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "yyyy-M-d"))
    day = text.iso_date(raw)
    return items.groupBy(F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"))


def urls_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.public_url(F.col("url")).alias("is_public"), F.array_max(text.years_in(F.col("url"))).alias("last_year"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.html_to_lines(views.table(spark, sf_dir, "pages"), "page_id", "html")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max(F.col("line").contains("track(")).alias("has_script"))


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.json_leaves(views.table(spark, sf_dir, "events"), "event_id", "props").select("event_id", "pointer", "value")


def lines_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.search_lines(views.lines(spark, sf_dir), "doc_id", ["license"], 1)
    return found.select("doc_id", "line_no", "is_hit", F.length("line").alias("n_chars"))


def quotes_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return documents.ground_quotes(views.table(spark, sf_dir, "documents").select("doc_id", "text"), quotes, "doc_id")


def headers_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.lines(spark, sf_dir)
    return documents.nearest_before(rows.where(F.lower("line").contains("license")), rows.where(F.length("line") < 40), "doc_id", 20)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.packed(views.lines(spark, sf_dir), "doc_id", 500)
    return found.groupBy("doc_id").agg(F.max("chunk").alias("last_chunk"), F.count(F.lit(1)).alias("n_lines"))


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.greedy_cover(views.lines(spark, sf_dir), "doc_id", {"rights": ["license", "copyright"], "contact": ["@", "http"], "number": ["1", "2", "3"]}, 400)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


QUERIES = {
    "h01_names_normalised": names_normalised, "j03_names_nfkc": names_nfkc, "h08_numbers_parsed": numbers_parsed, "h06_units_converted": units_converted, "b03_contracts_checked": contracts_checked,
    "d38_ledger_costs": ledger_costs, "h22_dates_strict": dates_strict, "h21_urls_public": urls_public, "a08_page_lines": page_lines, "a10_json_leaves": json_leaves, "b45_lines_searched": lines_searched,
    "h14_quotes_grounded": quotes_grounded, "c18_headers_near": headers_near, "e22_chunks": chunks, "e23_covered": covered,
}

_L = views.with_views("v_lines")
ORACLE_SQL = {
    "h08_numbers_parsed": """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 0 THEN l_extendedprice WHEN 1 THEN CAST(format('{:.1f}', l_extendedprice) AS DOUBLE) END AS number
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem)""",
    "h21_urls_public": r"""WITH p AS (SELECT page_id, url, lower(split_part(url, '://', 1)) AS s, regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#\\]*') AS a FROM pages),
        h AS (SELECT *, lower(split_part(a, ':', 1)) AS h, substr(a, length(split_part(a, ':', 1)) + 1) AS port FROM p), o AS (SELECT *, CASE WHEN regexp_full_match(h, '([0-9]{1,3}\.){3}[0-9]{1,3}') THEN list_transform(string_split(h, '.'), lambda x: CAST(x AS INTEGER)) END AS o FROM h)
        SELECT page_id, coalesce(contains(url, '://') AND s IN ('http', 'https') AND length(url) <= 2048 AND NOT contains(a, '@') AND (port IN ('', ':') OR s = 'http' AND port = ':80' OR s = 'https' AND port = ':443')
            AND CASE WHEN o IS NOT NULL AND list_max(o) <= 255 THEN NOT (o[1] IN (0, 10, 127) OR o[1] >= 224 OR o[1] = 169 AND o[2] = 254 OR o[1] = 172 AND o[2] BETWEEN 16 AND 31 OR o[1] = 192 AND o[2] = 168 OR o[1] = 100 AND o[2] BETWEEN 64 AND 127)
            ELSE contains(h, '.') AND NOT ends_with(h, '.local') AND NOT ends_with(h, '.localhost') END, false) AS is_public,
            CAST(list_max(list_filter(list_transform(regexp_extract_all(url, '[0-9]+'), lambda x: CASE WHEN length(x) = 4 THEN CAST(x AS INTEGER) END), lambda y: y BETWEEN 1990 AND 2049)) AS INTEGER) AS last_year FROM o""",
    "h06_units_converted": """WITH r AS (SELECT l_returnflag, l_quantity AS v, l_partkey % 5 AS u FROM lineitem)
        SELECT l_returnflag, ['GWh', 'kWh', 'gigajoules', 'Mt', 'barrels'][u + 1] AS unit, count(CASE WHEN u < 3 THEN v END) AS n,
        round(sum(CASE u WHEN 0 THEN v * 1e3 WHEN 1 THEN v * 1e-3 WHEN 2 THEN v / 3.6 END), 4) AS total FROM r GROUP BY ALL""",
    "b03_contracts_checked": views.with_views("v_observation") + """ SELECT concat_ws(',', CASE WHEN unit <> 'usd' THEN 'unit' END, CASE WHEN publication_date IS NULL THEN 'dated' END, CASE WHEN reporting_year NOT BETWEEN 1995 AND 2000 THEN 'year' END,
        CASE WHEN value < 1000 THEN 'finite' END) AS broken, count(*) AS n FROM v_observation GROUP BY 1""",
    "d38_ledger_costs": """WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(trunc(value * 10) AS BIGINT) AS o FROM events)
        SELECT event_type, CAST(sum((900 * k * 2.5::DECIMAL(18,6) + o * 10.0::DECIMAL(18,6) + 100 * k * 0.25::DECIMAL(18,6))) / 1000000 AS DOUBLE) AS cost, CAST(sum(k) AS BIGINT) AS tokens, count(*) AS calls FROM e GROUP BY 1""",
    "h22_dates_strict": views.dated("""SELECT year(d) AS year, count(*) AS n, min(d) AS first_day FROM (SELECT CASE WHEN l_partkey % 2 = 0 OR (month(l_shipdate) > 9 AND day(l_shipdate) > 9) THEN CAST(l_shipdate AS DATE) END AS d FROM lineitem) GROUP BY 1""", "first_day"),
    "a10_json_leaves": "SELECT event_id, '/k' AS pointer, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events",
    "b45_lines_searched": _L + """ SELECT doc_id, line_no, h AS is_hit, length(line) AS n_chars FROM (SELECT *, contains(lower(line), 'license') AS h FROM v_lines)
        QUALIFY bool_or(h) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "h14_quotes_grounded": """SELECT item_id AS quote_id, doc_id, length(split_part(d.text, b.text, 1)) AS start, CAST((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) AS INTEGER) AS n_places
        FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''""",
    "c18_headers_near": _L + """, h AS (SELECT doc_id, line_no FROM v_lines WHERE contains(lower(line), 'license')), s AS (SELECT doc_id, line_no FROM v_lines WHERE length(line) < 40)
        SELECT h.doc_id, h.line_no, max(s.line_no) AS header_no FROM h LEFT JOIN s ON s.doc_id = h.doc_id AND s.line_no <= h.line_no AND h.line_no - s.line_no <= 20 GROUP BY ALL""",
}
