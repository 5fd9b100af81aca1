"""The library's inputs as projections of the driver's tables, and the same projections as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cik(column: str):
    return F.lpad(F.col(column).cast("string"), 10, "0")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _cik("c_custkey").alias("company_cik"), F.col("c_name").alias("company_name"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_mktsegment").alias("industry"), F.col("c_nationkey").alias("sub_class"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as feature observations: the priority is the feature; orders of status P have no publication date, a few have another unit."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        _cik("o_custkey").alias("company_cik"), F.col("o_orderpriority").alias("feature_name"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderkey") % 97 == 0, "thousand usd").otherwise("usd").alias("unit"), (F.year(day) - 1).alias("reporting_year"),
        F.when(F.col("o_orderstatus") != "P", day).alias("publication_date"), F.when(F.col("o_orderkey") % 5 < 3, day).alias("acquired_date"),
        F.col("o_orderkey").alias("document_id"),
    )


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three assessment dates for each company, with a score from 0 to 100 published 60 days later."""
    dates = F.explode(F.array(*[F.lit(d).cast("date") for d in ("1997-06-30", "1999-06-30", "2001-06-30")])).alias("as_of")
    return table(spark, sf_dir, "customer").select(
        _cik("c_custkey").alias("company_cik"), F.col("c_mktsegment").alias("industry"), dates,
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("c_acctbal") + 1000) / 110)).alias("score"),
    ).select("*", F.year("as_of").alias("cycle"), F.date_add("as_of", 60).alias("published_date"))


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with sums of their lines: revenue, cost and balance, by nation (industry) and region (sector)."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("cost"),
        F.sum("l_quantity").alias("units"),
    )
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "supplier").join(sums, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(_cik("s_suppkey").alias("company_cik"), F.col("s_name").alias("company_name"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"),
                "revenue", "cost", "units", F.col("s_acctbal").alias("balance"))
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as filing facts: part as metric, ship date as period end (every tenth part is an instant), supplier as accession, return flag as concept, line number as form."""
    end, n = F.col("l_shipdate").cast("date"), F.col("l_linenumber")
    form = F.when(F.col("l_linestatus") == "F", F.when(n % 3 == 0, "20-F/A").otherwise("10-K")).otherwise(F.when(n % 3 == 0, "8-K").when(n % 5 == 0, "S-1").otherwise("10-Q"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("company"), n.alias("metric"), end.alias("period_end"),
        F.when(F.col("l_partkey") % 10 != 0, F.date_sub(end, F.expr("cast(l_quantity as int) * 10"))).alias("period_start"), F.col("l_suppkey").alias("accession"),
        F.date_add(end, (F.col("l_suppkey") % 60).cast("int")).alias("filed"), F.when(F.col("l_partkey") % 4 == 0, "Q4").otherwise("FY").alias("fp"),
        F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("priority"),
        F.col("l_extendedprice").alias("value"), form.alias("form"), F.col("l_partkey").alias("part"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as numbered lines, from 1."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "lang", "source", (F.col("pos") + 1).alias("line_no"), "line")


#: The same projections as common table expressions of DuckDB SQL, by name.
CTE = {
    "v_company": """v_company AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS company_cik, c_name AS company_name, 'C' || c_custkey AS ticker,
        c_mktsegment AS industry, c_nationkey AS sub_class FROM customer)""",
    "v_observation": """v_observation AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS company_cik, o_orderpriority AS feature_name, o_totalprice AS value,
        CASE WHEN o_orderkey % 97 = 0 THEN 'thousand usd' ELSE 'usd' END AS unit, CAST(year(o_orderdate) - 1 AS INTEGER) AS reporting_year,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS publication_date, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS acquired_date,
        o_orderkey AS document_id FROM orders)""",
    "v_label": """v_label AS (SELECT *, CAST(year(as_of) AS INTEGER) AS cycle, CAST(as_of + INTERVAL 60 DAY AS DATE) AS published_date FROM
        (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS company_cik, c_mktsegment AS industry, unnest([DATE '1997-06-30', DATE '1999-06-30', DATE '2001-06-30']) AS as_of,
        greatest(0.0, least(100.0, (c_acctbal + 1000) / 110)) AS score FROM customer))""",
    "v_financials": """v_financials AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS company_cik, s_name AS company_name, n_name AS industry, r_name AS sector,
        revenue, cost, units, s_acctbal AS balance FROM supplier
        LEFT JOIN (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * l_discount), 2) AS cost, sum(l_quantity) AS units
                   FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "v_fact": """v_fact AS (SELECT l_orderkey AS company, l_linenumber AS metric, CAST(l_shipdate AS DATE) AS period_end,
        CASE WHEN l_partkey % 10 <> 0 THEN CAST(CAST(l_shipdate AS DATE) - CAST(l_quantity AS INTEGER) * 10 AS DATE) END AS period_start,
        l_suppkey AS accession, CAST(CAST(l_shipdate AS DATE) + CAST(l_suppkey % 60 AS INTEGER) AS DATE) AS filed, CASE WHEN l_partkey % 4 = 0 THEN 'Q4' ELSE 'FY' END AS fp,
        CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS priority, l_extendedprice AS value,
        CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber % 3 = 0 THEN '20-F/A' ELSE '10-K' END WHEN l_linenumber % 3 = 0 THEN '8-K' WHEN l_linenumber % 5 = 0 THEN 'S-1' ELSE '10-Q' END AS form,
        l_partkey AS part FROM lineitem)""",
    "v_lines": """v_lines AS (SELECT doc_id, lang, source, CAST(k AS INTEGER) AS line_no, l[k] AS line FROM (SELECT doc_id, lang, source, l, unnest(range(1, len(l) + 1)) AS k
        FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)))""",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names)


def plain(df: DataFrame) -> DataFrame:
    """df with dates as ISO text, the form in which results are compared."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def dated(sql: str, *columns: str) -> str:
    """SQL whose date columns, named, are ISO text."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({sql})"
