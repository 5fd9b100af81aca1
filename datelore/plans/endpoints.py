"""Queries: target ranges by endpoints, single facts against blocks, citations by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datelore.operators import endpoints
from datelore.plans import views
from datelore.plans.wordings import _one_of

TARGETS = ["revenue", "operating_margin", "eps"]
QUOTES = ["USD 5 at least", "up to USD 5", "USD 5", "about 5", "50 bps, USD"]
FORMS = [*(f"USD 5: {w} 5" for w in ("≥", ">=", ">", "at least", "more than", "greater than", "minimum of", "≤", "<=", "<", "at most", "up to", "no more than", "less than", "maximum of")), "5% + US $", "$ US 5", "United States dollars 5", "U.S. dollars 5", "tusd 5", "USD/share 5", "between at least USD 4 and at most USD 6"]
PATHS = ["income.revenue", "income.tax", "balance.assets", "balance.tax", "staff"]
CITED = ["income.revenue", "data.revenue", "tax", "assets", "other", "data.balance.assets", "staff"]


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price, target = F.col("o_orderkey"), F.col("o_totalprice"), _one_of(F.col("o_orderkey"), TARGETS)
    low = F.struct(F.lit("min").alias("endpoint"), F.when(k % 7 != 0, price).alias("value"), _one_of(k, QUOTES).alias("quote"))
    high = F.struct(F.lit("max").alias("endpoint"), F.when(k % 4 != 1, price + 1).alias("value"), _one_of(k + 1, QUOTES).alias("quote"))
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", target.alias("target"), F.when(target == "operating_margin", "percent").otherwise("USD").alias("unit"), F.inline(F.array(low, high)))
    return endpoints.endpoints_normalised(rows, ["o_orderkey"])


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endpoints(spark, sf_dir)


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.endpoint_columns(_endpoints(spark, sf_dir), ["o_orderkey"], TARGETS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    shown = F.format_number(price, 2)
    rows = views.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 9 != 0, k % 3).otherwise(F.lit(7)).alias("block_id"), F.concat(F.lit("Total  "), shown, _one_of(k, [F.lit(""), F.lit(" net"), F.lit(" gross"), F.lit(" ")])).alias("quote"),
        F.when(k % 5 != 0, shown).otherwise("12,345,678.5").alias("raw_value"), F.lit(1000.0).alias("scale"), F.when(k % 11 != 0, price * 1000).otherwise(price).alias("value"), (k % 3).alias("at"), shown.alias("shown"),
    )
    blocks = rows.select("o_orderkey", F.col("at").alias("block_id"), F.concat(F.lit("Orders\nTotal "), "shown", F.lit(" net of tax")).alias("text"))
    return endpoints.direct_facts(rows.drop("at", "shown"), blocks, ["o_orderkey"]).select("o_orderkey", "value", "issue")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.createDataFrame([(p,) for p in PATHS], "path string")
    cited = views.table(spark, sf_dir, "lineitem").select("l_orderkey", _one_of(F.col("l_partkey"), CITED).alias("path"))
    found, equal = endpoints.canonical_paths(cited, schema, "l_orderkey"), Window.partitionBy("l_orderkey", "canonical", "path")
    counted = found.withColumns({"n": F.count(F.lit(1)).over(equal), "_place": F.row_number().over(equal.orderBy("path"))})  # in the order that the rows come in
    return counted.where("_place = 1").drop("_place")


CLAIM_WORDS = [
    "guidance was raised, eps growth", "unchanged eps growth", "withdrawn sales growth", "still active", "revenue growth from 2019", "operating margin, baseline of 2020", "operating margin baseline, 50 bps",
    "base fee cagr compared to plan", "nothing", "EPS  CAGR", "no-change", "in effect",
]
ATTRIBUTES = ["is_revised", "is_withdrawn", "target_year", "baseline_year", "value"]


def flags_and_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about targets, quoted from real lines with some words set behind them, against the whole texts that these stand in."""
    k = F.col("doc_id")
    docs = views.table(spark, sf_dir, "documents").where("text is not null")
    quote = F.concat(F.substring_index("text", "\n", 1), F.lit(" "), _one_of(k, CLAIM_WORDS))
    value = F.when(k % 13 != 0, _one_of(k + 1, [1, 0])).cast("int")
    rows = docs.select("doc_id", _one_of((k / 3).cast("long"), [*endpoints.LABELS]).alias("target"), _one_of((k / 7).cast("long"), ATTRIBUTES).alias("attribute"), value.alias("value"),
                       quote.alias("quote"), F.concat(F.lit("About it: "), quote, F.lit("\n"), F.col("text")).alias("block"), F.lit(None).cast("string").alias("raw_value"))
    return endpoints.target_claims(rows).select("doc_id", "target", "attribute", "value", "issue")


def bound_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each form of words says, behind the flag of a line and before a year."""
    form = _one_of(F.col("l_partkey"), FORMS)
    quote = F.concat("l_returnflag", F.lit(" "), form, F.lit(" in "), F.year("l_shipdate").cast("string"))
    said = views.table(spark, sf_dir, "lineitem").select(form.alias("form"), endpoints.bounds_said(quote).alias("b"), endpoints.names_dollars(quote).alias("names_dollars"))
    return said.groupBy("form", F.col("b.low").alias("low"), F.col("b.high").alias("high"), "names_dollars").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"b39_bound_forms": bound_forms, "b39_flags_and_years": flags_and_years, "b39_endpoints_normalised": normalised, "b22_endpoint_columns": columns, "b44_direct_facts": facts, "b49_canonical_paths": paths}

_ENDS = """WITH r AS (SELECT o_orderkey AS k, 'min' AS e, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v, o_orderkey % 5 AS i FROM orders UNION ALL
        SELECT o_orderkey, 'max', CASE WHEN o_orderkey % 4 <> 1 THEN o_totalprice + 1 END, (o_orderkey + 1) % 5 FROM orders),
    t AS (SELECT *, CASE i WHEN 0 THEN 'min' WHEN 1 THEN 'max' ELSE e END AS d FROM r WHERE v IS NOT NULL),
    p AS (SELECT k, d, v, i, CASE WHEN d <> e THEN 'moved' END AS action FROM t QUALIFY row_number() OVER (PARTITION BY k, d ORDER BY d <> e, v) = 1),
    x AS (SELECT * FROM p UNION ALL SELECT k, CASE d WHEN 'min' THEN 'max' ELSE 'min' END, v, i, 'duplicated' FROM p WHERE i > 1 AND (SELECT count(*) FROM p AS o WHERE o.k = p.k) = 1),
    y AS (SELECT *, ['revenue', 'operating_margin', 'eps'][k % 3 + 1] AS target, CASE WHEN k % 3 <> 1 AND i = 3 THEN 'currency_not_named' WHEN k % 3 = 1 AND i = 4 THEN 'change_is_no_level' END AS issue FROM x),
    z AS (SELECT k AS o_orderkey, target, d AS endpoint, CASE WHEN issue IS NULL THEN v END AS value, action, issue FROM y)"""

_WORDS = "[" + ", ".join("'" + w + "'" for w in CLAIM_WORDS) + "]"

ORACLE_SQL = {
    "b39_bound_forms": f"""WITH f AS (SELECT l_partkey % 22 AS i, [{", ".join("'" + f + "'" for f in FORMS)}][l_partkey % 22 + 1] AS form FROM lineitem WHERE l_shipdate IS NOT NULL AND l_returnflag IS NOT NULL)
        SELECT form, i < 7 OR i IN (15, 21) AS low, i BETWEEN 7 AND 14 OR i = 21 AS high, i NOT IN (19, 20) AS names_dollars, count(*) AS n FROM f GROUP BY ALL""",
    "b39_flags_and_years": rf"""WITH d AS (SELECT doc_id, doc_id AS k, text, string_split(text, chr(10))[1] || ' ' || {_WORDS}[doc_id % 12 + 1] AS quote FROM documents WHERE text IS NOT NULL),
        f AS (SELECT *, trim(regexp_replace(quote, '\s+', ' ', 'g')) AS q, trim(regexp_replace('About it: ' || quote || chr(10) || text, '\s+', ' ', 'g')) AS b FROM d),
        n AS (SELECT *, ['revenue_growth', 'operating_margin', 'eps_growth'][(k // 3) % 3 + 1] AS target, ['is_revised', 'is_withdrawn', 'target_year', 'baseline_year', 'value'][(k // 7) % 5 + 1] AS attribute, CASE WHEN k % 13 <> 0 THEN 1 - (k + 1) % 2 END AS v,
            lower(q || ' ' || substr(b, greatest(strpos(b, q) - 250, 1), least(strpos(b, q), 251) - 1 + length(q) + 250)) AS near, lower(q || ' ' || substr(b, greatest(strpos(b, q) - 800, 1), least(strpos(b, q), 801) - 1 + length(q) + 800)) AS far FROM f),
        i AS (SELECT *, CASE WHEN v IS NULL THEN NULL
            WHEN attribute = 'is_revised' AND NOT CASE WHEN v = 1 THEN regexp_matches(near, '(^|[^a-z])(revis|updat|increas|decreas|rais|lower|narrow)') ELSE regexp_matches(near, '(^|[^a-z])(unchanged|no[\s-]+change|no[\s-]+difference|reaffirmed|nc)($|[^a-z])') END THEN 'flag_not_supported'
            WHEN attribute = 'is_withdrawn' AND NOT CASE WHEN v = 1 THEN regexp_matches(near, '(^|[^a-z])(withdraw|rescind|cancel|discontinu)') ELSE regexp_matches(near, '(^|[^a-z])(not withdrawn|remains active|still active|continues? in effect)($|[^a-z])') END THEN 'flag_not_supported'
            WHEN attribute IN ('target_year', 'baseline_year') AND (attribute = 'baseline_year' AND NOT regexp_matches(far, '(^|[^a-z])(baseline|base year|compared (with|to)|from 20\d\d)($|[^a-z0-9])')
                OR target = 'operating_margin' AND regexp_matches(far, '(^|[^a-z])(margin expansion|bps|basis points?)($|[^a-z])')
                OR NOT CASE target WHEN 'revenue_growth' THEN regexp_matches(far, '(^|[^a-z])(revenue|sales|base fee) (growth|cagr)($|[^a-z])') WHEN 'operating_margin' THEN regexp_matches(far, '(^|[^a-z])operating (income )?margin($|[^a-z])') ELSE regexp_matches(far, '(^|[^a-z])(eps|earnings per share) (growth|cagr)($|[^a-z])') END) THEN 'year_not_linked' END AS issue FROM n)
        SELECT doc_id, target, attribute, CAST(CASE WHEN issue IS NULL THEN v END AS INTEGER) AS value, issue FROM i""",
    "b39_endpoints_normalised": _ENDS + " SELECT * FROM z",
    "b22_endpoint_columns": _ENDS + " SELECT o_orderkey, " + ", ".join(f"max(value) FILTER (target = '{t}' AND endpoint = '{e}') AS {t}_{e}" for t in TARGETS for e in ("min", "max")) + " FROM z GROUP BY 1",
    "b44_direct_facts": """WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_totalprice AS v FROM orders), r AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'block' WHEN k % 4 = 2 THEN 'quote' WHEN k % 5 = 0 THEN 'raw_value' WHEN k % 11 = 0 THEN 'value' END AS issue FROM o)
        SELECT o_orderkey, CASE WHEN issue IS NULL THEN v * 1000 END AS value, issue FROM r""",
    "b49_canonical_paths": f"""WITH c AS (SELECT l_orderkey, [{", ".join(f"'{c}'" for c in CITED)}][l_partkey % 7 + 1] AS path,
            ['income.revenue', 'income.revenue', NULL, 'balance.assets', NULL, 'balance.assets', 'staff'][l_partkey % 7 + 1] AS canonical, l_partkey % 7 AS i FROM lineitem),
        w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, canonical) AS times FROM c)
        SELECT l_orderkey, path, canonical, CASE WHEN i = 2 THEN 'ambiguous' WHEN i = 4 THEN 'unknown' WHEN times > 1 THEN 'repeated' END AS issue, count(*) AS n FROM w GROUP BY ALL""",
}
