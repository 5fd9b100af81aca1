"""Queries: tables of pages as grids and records, headline blocks in lines, climate targets by families, numbers grounded by an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datelore.operators import grids, grounding, sequences, targets
from datelore.plans import views
from datelore.plans.wordings import _one_of

_TABLE = "<table><tr><th>Sym&amp;bol<th>Name<th colspan=2>Other<tr><td rowspan=2>S%s<td> n <b>m</b><td>a<td>b<tr><td>x<td colspan='2'>c<script>d</script></table><p>after"


def page_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of all pages, each with one more behind its own."""
    page = F.concat(F.coalesce("html", F.lit("")), F.format_string(_TABLE, F.col("page_id").cast("string")))
    cells = grids.html_grids(views.table(spark, sf_dir, "pages").select("page_id", page.alias("html")), "page_id", "html")
    return cells.withColumn("last", F.max("table").over(Window.partitionBy("page_id"))).where("table = last").drop("table", "last")


_HEADERS = {"symbol": "Symbol", "name": "Security", "cik": "CIK"}


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation that lists its suppliers in a table, some with a fault."""
    k, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    td = lambda x: F.concat(F.lit("<td>"), x)
    fault = nation % 6
    row = F.concat(F.lit("<tr>"), td(F.when(fault == 1, F.lit("same")).otherwise(k)), td(F.when((fault == 2) & (F.col("s_suppkey") % 2 == 0), F.lit(" ")).otherwise(F.col("s_name"))), F.when(fault == 3, "<td>").otherwise(""), td(F.when(fault == 4, F.concat(F.lit("x"), k)).otherwise(k)))
    rows = views.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x.r), "\n").alias("rows"))
    head = F.concat(F.lit("<table><tr><th>Symbol<th>Security<th>"), F.when(nation % 6 == 5, "Symbol").otherwise("CIK"))
    return rows.select("s_nationkey", F.concat(head, "rows").alias("html"))


def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grids.html_grids(_listings(spark, sf_dir), "s_nationkey", "html")
    records, issues = grids.read_records(cells, ["s_nationkey", "table"], _HEADERS, "symbol", "[0-9]{1,10}|same")
    counts = records.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_records"), F.min("name").alias("first_name"), F.sum(F.col("cik").try_cast("long")).alias("sum_cik"))
    return issues.join(counts, "s_nationkey", "left").select("s_nationkey", F.array_join("issues", ",").alias("issues"), "n_records", "first_name", "sum_cik")


def headline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with lines of scores set behind their text: one block, the same twice, two that differ, one cut off on a page without public scores, one out of range, none."""
    head = "\n".join(sequences.HEADERS)
    k = F.col("doc_id")
    block = lambda score: F.concat(F.lit(f"{head}\nFirm "), k.cast("string"), F.lit("\nMetals\n"), score.cast("string"), F.lit("\n 7\nNo\nMarch 5, 2024\n"))
    good = k % 101
    cut = F.concat(F.lit(f"{head}\nFirm\nMetals\nAvailable  via our premium channels"))
    added = _one_of(k, [block(good), F.concat(block(good), F.lit("This company is a Corporate Sustainability Assessment (CSA) survey respondent. Yes\n"), block(good)), F.concat(block(good), block(good + 1 - 2 * (good == 100).cast("int"))), cut, block(good + 101), F.lit("Company\nIndustry")])
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), added).alias("text"))
    return sequences.headline_scores(docs, "text").select("doc_id", "scores.*")


SAID = [
    "reduce absolute scope 1 and 2 emissions from a 2019 base year", "reduce absolute Scope 1 & Scope 2 emissions", "reduce scope 3 emissions from 2020", "reduce Scope 3 emissions of selected categories", "reduce scope 1 + 2 and scope 3 emissions",
    "reduce scope 1 and 2 emissions intensity", "reduce scope 1 and 2 emissions, goal achieved", "reduce scope 1 and 2 emissions, a site-specific goal", "reduce scope 1 and 2 emissions, a site specific and global goal, baseline", "nothing of it",
]
FAMILIES = ["scope_1_2_absolute_reduction", "scope_3_absolute_reduction", "scope_1_2_3_absolute_reduction", "net_zero"]


def climate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fields of a target for every document, quoted from its first line with some words behind it."""
    k = F.col("doc_id")
    docs = views.table(spark, sf_dir, "documents").select(k, F.coalesce(F.substring_index("text", "\n", 1), F.lit("")).alias("first"), _one_of(k, FAMILIES).alias("family"))
    quote = lambda n: F.concat("first", F.lit(" "), _one_of((k / 4).cast("long") * 3 + n, SAID))
    field = lambda name, value, n: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), quote(n).alias("quote"))
    rows = docs.select("doc_id", "family", F.lit(2024).alias("reporting_year"), F.lit(None).cast("string").alias("context"), F.inline(F.array(
        field("target_year", 2023 + k % 9, 0), field("reduction_pct", k % 50, k % 2), field("baseline_year", F.lit(2019), k % 3), field("progress_pct", F.when(k % 5 != 0, 10), F.lit(1)))))
    return targets.targets_checked(rows, ["doc_id"]).select("doc_id", "name", "value", "issue")


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure for every document: the first number that its text prints, some with a fault, looked up in the index of all numbers of all texts."""
    docs, k = views.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    index = grounding.number_index(docs, ["doc_id"], "text")
    first = index.groupBy("doc_id").agg(F.min_by(F.struct("token", "size"), F.struct("line_no", "offset")).alias("f"))
    size = F.col("f.size").cast("double")
    metrics = docs.select("doc_id").join(first, "doc_id", "left").select(
        "doc_id", F.lit("figure").alias("name"), F.when(k % 6 == 3, " Year").otherwise("t").alias("unit"), F.when(k % 6 == 1, size * 1000 + 1).otherwise(size * 1000).alias("value"),
        F.when(k % 6 == 2, "987654321.5").when(k % 6 == 4, "n/a").otherwise(F.col("f.token")).alias("raw_value"), F.when(k % 6 == 5, 0.0).otherwise(1000.0).alias("scale"), (k % 6).isin(3, 5).alias("is_target"),
    )
    return grounding.metrics_grounded(metrics, index, ["doc_id"]).select("doc_id", "value", "reason", F.md5("line").alias("line"), "offset")


def financial_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of nine figures for every order, cited from three lines of its own."""
    k = F.col("o_orderkey")
    orders = views.table(spark, sf_dir, "orders").where("o_custkey is not null")
    block = lambda name, text: F.struct(F.lit(name).alias("block_id"), text.alias("text"))
    blocks = orders.select("o_orderkey", F.inline(F.array(block("a", F.concat(F.lit("Total | "), F.format_number("o_totalprice", 2))), block("b", F.concat(F.lit("Part | "), F.col("o_custkey").cast("string"))), block("c", F.concat(F.lit("Rest | "), k.cast("string"))))))
    index = grounding.number_index(blocks, ["o_orderkey", "block_id"], "text")
    none = F.array().cast("array<string>")
    figure = lambda name, status, value, cited: F.struct(F.lit(name).alias("name"), F.lit(status).alias("status"), value.cast("double").alias("value"), F.lit(1.0).alias("scale"), cited.alias("citations"))
    revenue = figure("revenue", "reported", F.col("o_totalprice"), F.array(F.when(k % 7 == 0, "b").otherwise("a")))
    debt = figure("total_debt", "calculated", F.col("o_custkey") + k + F.when(k % 5 == 0, 1).otherwise(0), F.array(F.lit("b"), F.lit("c")))
    cash = figure("cash_and_equivalents", "calculated", F.round(F.col("o_totalprice") + F.col("o_custkey") + k, 2), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    staff = figure("employees", "reported", F.col("o_custkey"), F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"))))
    rest = [figure(n, "not_disclosed", F.lit(None), none) for n in grounding.METRICS if n not in ("revenue", "total_debt", "cash_and_equivalents", "employees", "net_income")]
    income = figure("net_income", "not_disclosed", F.when(k % 4 == 0, 1.0), none)
    every = F.array(revenue, debt, cash, staff, *rest)
    told = F.when(k % 11 == 0, every).when(k % 13 == 0, F.concat(every, F.array(income, revenue))).otherwise(F.concat(every, F.array(income)))
    metrics = orders.select("o_orderkey", F.inline(told))
    return grounding.records_checked(metrics, index, ["o_orderkey"]).select("o_orderkey", F.array_join("issues", ",").alias("issues"))


QUERIES = {
    "a07_page_grids": page_grids, "a07_listing_records": listing_records, "a32_headline_blocks": headline_blocks, "b36_climate_targets": climate_targets, "b50_metrics_grounded": grounded,
    "b48_financial_records": financial_records,
}

_SAID = "[" + ", ".join(f"'{s}'" for s in SAID) + "]"
_FAMILY = """CASE WHEN family LIKE 'scope%' AND {q}j AND {q}s3 THEN 'several_scopes' WHEN family = 'scope_1_2_3_absolute_reduction' AND NOT ({q}j AND {q}s3) THEN 'not_scope_1_2_3'
    WHEN family = 'scope_1_2_absolute_reduction' AND (NOT {q}j OR {q}s3) THEN 'not_scope_1_2' WHEN family = 'scope_3_absolute_reduction' AND NOT {q}s3 THEN 'not_scope_3' WHEN family = 'scope_3_absolute_reduction' AND {q}sub THEN 'part_of_scope_3'
    WHEN family LIKE '%absolute%' AND NOT ({q}ab AND NOT {q}i) THEN 'not_absolute' WHEN family = 'net_zero' AND NOT {q}nz THEN 'not_net_zero' END"""
_FLAGS = r"""regexp_matches({q}, '(^|[^a-z])scope\s*1\s*(&|\+|and)\s*(scope\s*)?2($|[^a-z0-9])') AS j, regexp_matches({q}, '(^|[^a-z])scope\s*3($|[^a-z0-9])') AS s3, regexp_matches({q}, '(^|[^a-z])(category|categories|selected|partial|subset)($|[^a-z])') AS sub,
    contains({q}, 'intensity') AS i, contains({q}, 'absolute') OR NOT contains({q}, 'intensity') AND contains({q}, 'reduc') AND (contains({q}, 'emission') OR contains({q}, 'ghg')) AS ab, regexp_matches({q}, 'net[ -]?zero') AS nz,
    regexp_matches({q}, '(^|[^a-z])(goal achieved|target achieved|expired|withdrawn|superseded|cancell?ed)($|[^a-z])') AS ov, regexp_matches({q}, '(^|[^a-z])site[ -]specific($|[^a-z])') AND NOT regexp_matches({q}, '(^|[^a-z])global($|[^a-z])') AS lo"""

ORACLE_SQL = {
    "a07_page_grids": """SELECT page_id, "row", "column", replace(text, 'S%', 'S' || page_id) AS text, "row" = 0 AS is_header, is_first FROM pages,
        (VALUES (0, 0, 'Sym&bol', true), (0, 1, 'Name', true), (0, 2, 'Other', true), (0, 3, 'Other', false), (1, 0, 'S%', true), (1, 1, 'n m', true), (1, 2, 'a', true), (1, 3, 'b', true),
        (2, 0, 'S%', false), (2, 1, 'x', true), (2, 2, 'c', true), (2, 3, 'c', false)) AS c("row", "column", text, is_first)""",
    "a07_listing_records": """WITH s AS (SELECT *, s_nationkey % 6 AS f FROM supplier), g AS (SELECT s_nationkey, f, count(*) AS n, min(s_name) AS m, sum(s_suppkey) AS t, count(*) FILTER (s_suppkey % 2 = 0) AS e FROM s GROUP BY ALL),
        i AS (SELECT *, concat_ws(',', CASE WHEN f = 5 THEN 'missing_header' END, CASE WHEN f = 5 THEN 'repeated_header' END, CASE WHEN f = 3 THEN 'ragged_rows' END, CASE WHEN f = 2 AND e > 0 OR f IN (3, 5) THEN 'missing_value' END, CASE WHEN f = 1 AND n > 1 THEN 'repeated_identifier' END) AS issues FROM g)
        SELECT s_nationkey, issues, CASE WHEN issues = '' THEN n END AS n_records, CASE WHEN issues = '' THEN m END AS first_name, CASE WHEN issues = '' AND f <> 4 THEN CAST(t AS BIGINT) END AS sum_cik FROM i""",
    "a32_headline_blocks": """WITH d AS (SELECT doc_id, doc_id % 6 AS m, doc_id % 101 AS g FROM documents)
        SELECT doc_id, ['available', 'available', 'conflicting', 'not_public', 'out_of_range', 'no_block'][m + 1] AS status, CASE WHEN m < 2 THEN 'Firm ' || doc_id WHEN m = 3 THEN 'Firm' END AS company, CASE WHEN m < 2 OR m = 3 THEN 'Metals' END AS industry,
        CASE WHEN m < 2 THEN CAST(g AS INTEGER) END AS csa_score, CASE WHEN m < 2 THEN 7 END AS esg_score, CASE WHEN m < 2 THEN false END AS under_review, CASE WHEN m < 2 THEN '2024-03-05' END AS updated, CASE WHEN m = 1 THEN true END AS takes_part FROM d""",
    "b36_climate_targets": f"""WITH d AS (SELECT doc_id, doc_id AS k, coalesce(string_split(text, chr(10))[1], '') AS f, ['{"', '".join(FAMILIES)}'][doc_id % 4 + 1] AS family, (doc_id // 4) * 3 AS s FROM documents),
        n AS (SELECT k, family, 'target_year' AS name, 2023 + k % 9 AS v, f || ' ' || {_SAID}[s % 10 + 1] AS quote FROM d UNION ALL SELECT k, family, 'reduction_pct', k % 50, f || ' ' || {_SAID}[(s + k % 2) % 10 + 1] FROM d
              UNION ALL SELECT k, family, 'baseline_year', 2019, f || ' ' || {_SAID}[(s + k % 3) % 10 + 1] FROM d UNION ALL SELECT k, family, 'progress_pct', CASE WHEN k % 5 <> 0 THEN 10 END, f || ' ' || {_SAID}[(s + 1) % 10 + 1] FROM d),
        q AS (SELECT *, {_FLAGS.format(q="lower(quote)")} FROM n), r AS (SELECT *, {_FAMILY.format(q="")} AS bad FROM q),
        w AS (SELECT k, max(v) FILTER (name = 'target_year') <= 2024 AS late, bool_or(ov) AS over FROM r GROUP BY 1),
        a AS (SELECT r.*, w.late, w.over, list({{'j': o.j, 's3': o.s3, 'sub': o.sub, 'i': o.i, 'ab': o.ab, 'nz': o.nz, 'ov': o.ov, 'lo': o.lo, 'bad': o.bad}} ORDER BY CASE WHEN o.name = r.name THEN 0 WHEN o.name = 'reduction_pct' THEN 1 WHEN o.name = 'progress_pct' THEN 2 ELSE 3 END)
                FILTER (o.bad IS NULL AND (o.name = r.name OR o.name <> 'baseline_year')) AS c FROM r JOIN w USING (k) JOIN r o USING (k) GROUP BY ALL),
        z AS (SELECT *, CASE WHEN c IS NULL THEN ov ELSE c[1].ov END AS aov, CASE WHEN c IS NULL THEN lo ELSE c[1].lo END AS alo, CASE WHEN c IS NULL THEN bad END AS abad FROM a),
        i AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN late THEN 'target_year_not_after_report' WHEN over OR aov THEN 'target_is_over' WHEN alo THEN 'local_target' WHEN abad IS NOT NULL THEN abad
            WHEN name = 'baseline_year' AND NOT regexp_matches(lower(quote), '(^|[^a-z])(baseline|base year|from 20[0-9][0-9])($|[^a-z0-9])') THEN 'no_baseline' WHEN name = 'reduction_pct' AND NOT contains(lower(quote), 'reduc') THEN 'no_reduction'
            WHEN name = 'progress_pct' AND NOT regexp_matches(lower(quote), '(^|[^a-z])(progress|achieved|to date|reduced by)($|[^a-z])') THEN 'no_progress' END AS issue FROM z)
        SELECT k AS doc_id, name, CAST(CASE WHEN issue IS NULL THEN v END AS DOUBLE) AS value, issue FROM i""",
    "b50_metrics_grounded": r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        u AS (SELECT doc_id, n, line, unnest(regexp_extract_all(line, '[0-9A-Za-z.,]+')) AS r, generate_subscripts(regexp_extract_all(line, '[0-9A-Za-z.,]+'), 1) AS p FROM x WHERE regexp_matches(line, '[0-9]')),
        t AS (SELECT *, regexp_extract(r, '^[0-9][0-9,]*(\.[0-9]+)?') AS token FROM u), g AS (SELECT *, CAST(replace(token, ',', '') AS DECIMAL(38, 6)) AS size FROM t WHERE token <> '' AND NOT regexp_matches(substr(r, length(token) + 1), '^[.,]?[0-9]')),
        f AS (SELECT doc_id, arg_min(token, (n, p)) AS token, arg_min(size, (n, p)) AS size, arg_min(line, (n, p)) AS line FROM g GROUP BY 1), c AS (SELECT doc_id, size, count(*) AS times FROM g GROUP BY ALL),
        m AS (SELECT d.doc_id, d.doc_id % 6 AS k, f.token, f.size, f.line, c.times FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN c ON c.doc_id = d.doc_id AND c.size = f.size),
        r AS (SELECT *, CASE WHEN k = 3 THEN 'target_is_a_year' WHEN k = 5 OR k = 3 AND size IS NULL THEN 'target_without_quantity' WHEN size IS NULL THEN NULL WHEN k = 4 THEN 'raw_value_is_no_number' WHEN k = 2 OR k = 1 AND CAST(size AS DOUBLE) * 1000 + 1 < 1e8 THEN 'raw_value_and_scale_disagree' WHEN times > 1 THEN 'number_stands_twice' END AS reason FROM m)
        SELECT doc_id, CASE WHEN reason IS NULL THEN CAST(size AS DOUBLE) * 1000 + CASE WHEN k = 1 THEN 1 ELSE 0 END END AS value, reason, CASE WHEN reason IS NULL AND size IS NOT NULL THEN md5(trim(line)) END AS line, CASE WHEN reason IS NULL AND size IS NOT NULL THEN CAST(strpos(line, token) - 1 AS INTEGER) END AS "offset" FROM r""",
    "b48_financial_records": """WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders WHERE o_custkey IS NOT NULL)
        SELECT o_orderkey, concat_ws(',', 'cash_and_equivalents: calculated', CASE WHEN k % 3 = 0 THEN 'employees: citation' END, CASE WHEN k % 11 <> 0 AND k % 4 = 0 THEN 'net_income: citation' END, CASE WHEN k % 11 = 0 THEN 'net_income: missing' END,
        CASE WHEN k % 7 = 0 AND CAST(p AS DECIMAL(38, 2)) <> c THEN 'revenue: printed' END, CASE WHEN k % 13 = 0 AND k % 11 <> 0 THEN 'revenue: repeated' END, CASE WHEN k % 5 = 0 THEN 'total_debt: sum' END) AS issues FROM o""",
}
ORACLE_SQL["a32_headline_blocks"] = views.dated(ORACLE_SQL["a32_headline_blocks"], "updated")
