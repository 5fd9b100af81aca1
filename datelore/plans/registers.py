"""Queries: ids, times and numbers as they are written, formats, statuses, missing parts, counts of statuses, choices of splits and sets, and limits of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.functions import text
from datelore.operators import catalog, coverage, latest, matching, splits, training
from datelore.plans import views
from datelore.plans.wordings import _one_of
from datelore.sources import files


def written_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers as ids in several forms of writing: company ids, provider ids, tickers."""
    k = F.col("c_custkey")
    number = k.cast("string")
    raw = _one_of(k, [number, F.concat(F.lit(" 00"), number, F.lit(" ")), F.concat(F.lit("X"), number), F.concat(number, F.lit("0000000000")), F.concat(number, F.lit(".0")), F.concat(number, F.lit(".5")), F.lit(None).cast("string")])
    return views.table(spark, sf_dir, "customer").select("c_custkey", text.cik(raw).alias("cik"), text.whole_id(raw).alias("provider_id"), text.ticker(F.concat(F.lit("b-"), raw, F.lit(".a"))).alias("ticker"))


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events with an offset, in UTC; those without one are none."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.concat(plain, _one_of(F.col("event_id"), ["Z", "+02:00", "-05:30", "", " Z", ".250Z"]))
    found = views.table(spark, sf_dir, "events").select("event_id", text.zoned_time(raw).alias("at"))
    return found.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


def numbers_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed numbers of printed rows: plain, in brackets, negative, and dashes for zero."""
    shown = F.format_number("l_extendedprice", 2)
    row = F.concat(F.lit("Net | "), _one_of(F.col("l_partkey"), [shown, F.concat(F.lit("($"), shown, F.lit(")")), F.concat(F.lit("-"), shown), F.lit("—")]), F.lit(" | 7"))
    numbers = text.numbers_in(row)
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(numbers).alias("n"), F.get(numbers, F.lit(0)).cast("double").alias("first"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of several names and beginnings, by what their bytes, or else their names, say."""
    k = F.col("page_id")
    start = _one_of(k, ["%PDF-1.7 ", "<!DOCTYPE html>", "  {\"a\": ", "<?xml version='1.0'?>", "PAR1", "", "PK\x03\x04"])
    name = F.concat(F.lit("f/"), k.cast("string"), _one_of((k / 7).cast("long"), [".csv", ".JSON", ".bin", ""]))
    content = F.concat(start, F.when(start == "", "-- ").otherwise(""), F.coalesce("url", F.lit(""))).cast("binary")
    found = files.sniffed(views.table(spark, sf_dir, "pages").select("page_id", name.alias("path"), content.alias("content")))
    return found.select("page_id", "path", "format")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collection tasks, some with a document: their status, counted."""
    task = _one_of(F.col("o_custkey"), ["queued", "running", "failed", "done", None])
    rows = views.table(spark, sf_dir, "orders").where("o_custkey is not null").select(task.alias("task"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("document"), "o_orderpriority")
    return coverage.status_counts(rows.withColumn("status", catalog.collection_status("task", "document")), ["status", "o_orderpriority"])


def missing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished order of each priority: the companies and forms for which nothing is selected."""
    wanted = views.table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "5-LOW")])).alias("form"))
    found = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("form"))
    return matching.missing_from(wanted, found, ["c_custkey", "form"])


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as versions of documents on four keys, of which one may be null and then equals null; stored and new ones in one, with first and last time seen."""
    keys = ["l_orderkey", "l_returnflag", "l_linestatus", "shard"]
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey") % 3).alias("shard"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("seen"))
    return latest.upsert(rows.where("seen <= 3"), rows.where("seen > 3"), keys, "seen")


def distinct_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each value of nine columns of lines, the one of the latest order."""
    keys = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "month", "year"]
    rows = views.table(spark, sf_dir, "lineitem").withColumns({"month": F.month("l_shipdate"), "year": F.year("l_shipdate")})
    found = latest.first_by(rows, keys, [F.col("l_orderkey").desc(), F.col("l_partkey")])
    return found.groupBy("l_returnflag", "year").agg(F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("last_order"), F.sum("l_orderkey").alias("sum_orders"))


def fold_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean spend of each segment by the parity of a key, and the standard error of the means of folds."""
    orders = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    folds = orders.groupBy("c_mktsegment", (F.col("o_custkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("mae"))
    return folds.groupBy("c_mktsegment").agg(F.round(F.avg("mae"), 4).alias("mean"), F.round(splits.standard_error("mae"), 4).alias("standard_error"), F.count(F.lit(1)).alias("n_folds"))


def simplest_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as feature sets with their mean error and tolerance: the one with the fewest rows among those as good as the best within its tolerance."""
    means = fold_errors(spark, sf_dir).select(F.col("c_mktsegment").alias("name"), "mean", F.col("standard_error").alias("tolerance"), F.length("c_mktsegment").alias("size"))
    return splits.choose_simplest(means, "tolerance").select("name", "mean", "size")


def split_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split mode of each industry's label rows, and of those of its first two dates."""
    rows = views.label_rows(spark, sf_dir)
    names = sorted(r[0] for r in rows.select("industry").distinct().collect())  # a handful of segments
    found = [(n, training.split_mode(rows.where(F.col("industry") == n)), training.split_mode(rows.where((F.col("industry") == n) & (F.col("cycle") < 2001)))) for n in names]
    return spark.createDataFrame(found, "industry string, mode string, mode_of_two string")


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in five folds by customer, which is never in two of them."""
    rows = views.table(spark, sf_dir, "orders").where("o_custkey is not null").select("o_orderkey", "o_custkey")
    return splits.group_folds_by_size(rows, "o_custkey", 5).select("o_orderkey", "fold")


def run_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of a run over all observations has to know."""
    rows = views.observations(spark, sf_dir).select(F.when(F.col("publication_date").isNull(), "public_document_acquisition_date").otherwise("publisher_publication_date").alias("basis"), F.col("value").alias("label"), F.col("reporting_year").alias("cycle"))
    return training.limitations(rows)


QUERIES = {
    "b01_written_ids": written_ids, "h23_zoned_times": written_times, "h11_numbers_of_rows": numbers_of_rows, "a12_formats": formats, "b18_statuses": statuses, "c22_missing_manifest": missing_manifest, "a21_document_versions": document_versions,
    "e03_distinct_metrics": distinct_metrics, "d23_fold_errors": fold_errors, "d17_simplest_set": simplest_set, "d43_split_modes": split_modes, "k15_run_limits": run_limits, "e19_group_folds": group_folds,
}

_FOLDS = """f AS (SELECT c_mktsegment, o_custkey % 5 AS fold, avg(o_totalprice) AS mae FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        m AS (SELECT c_mktsegment, round(avg(mae), 4) AS mean, round(coalesce(stddev_samp(mae) / sqrt(count(mae)), 0), 4) AS standard_error, count(*) AS n_folds FROM f GROUP BY 1)"""

ORACLE_SQL = {
    "b01_written_ids": """WITH r AS (SELECT c_custkey, c_custkey % 7 AS m, CAST(c_custkey AS VARCHAR) AS n FROM customer)
        SELECT c_custkey, CASE WHEN m IN (0, 1) THEN lpad(CASE m WHEN 0 THEN n ELSE '00' || n END, 10, '0') END AS cik, CASE m WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 'X' || n WHEN 3 THEN n || '0000000000' WHEN 4 THEN n ELSE '' END AS provider_id,
        CASE WHEN m < 6 THEN 'B' || ['', '00', 'X', '', '', ''][m + 1] || n || ['', '', '', '0000000000', '0', '5'][m + 1] || 'A' END AS ticker FROM r""",
    "h23_zoned_times": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000' WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') || '.000' WHEN 2 THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') || '.000'
        WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.250' END AS at FROM events""",
    "h11_numbers_of_rows": "SELECT l_orderkey, l_linenumber, l_partkey, 2 AS n, CASE l_partkey % 4 WHEN 0 THEN l_extendedprice WHEN 3 THEN 0 ELSE -l_extendedprice END AS first FROM lineitem",
    "a12_formats": """WITH p AS (SELECT page_id, page_id % 7 AS m, ['.csv', '.JSON', '.bin', ''][(page_id // 7) % 4 + 1] AS e FROM pages)
        SELECT page_id, 'f/' || page_id || e AS path, CASE WHEN m < 5 THEN ['pdf', 'html', 'json', 'xml', 'parquet'][m + 1] WHEN m = 6 THEN 'zip' WHEN e = '.csv' THEN 'csv' WHEN e = '.JSON' THEN 'json' ELSE 'unknown' END AS format FROM p""",
    "b18_statuses": """WITH r AS (SELECT ['queued', 'running', 'failed', 'done', NULL][o_custkey % 5 + 1] AS t, o_orderkey % 3 <> 0 AS d, o_orderpriority FROM orders WHERE o_custkey IS NOT NULL)
        SELECT CASE WHEN t IN ('queued', 'running') THEN 'pending' WHEN t = 'failed' THEN 'failed' WHEN d THEN 'available' ELSE 'missing' END AS status, o_orderpriority, count(*) AS n FROM r GROUP BY ALL""",
    "c22_missing_manifest": """SELECT c_custkey, form FROM customer, (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) AS f(form) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = form)""",
    "a21_document_versions": """WITH r AS (SELECT l_orderkey, l_returnflag, l_linestatus, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 3 END AS shard, l_quantity AS quantity, l_linenumber AS seen FROM lineitem)
        SELECT l_orderkey, l_returnflag, l_linestatus, shard, min(seen) AS first_seen, max(seen) AS last_seen, max({'s': seen, 'q': quantity}).q AS quantity FROM r GROUP BY ALL""",
    "e03_distinct_metrics": """WITH r AS (SELECT *, month(l_shipdate) AS m, year(l_shipdate) AS y FROM lineitem), d AS (SELECT l_returnflag, y, max(l_orderkey) AS k FROM r GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_linenumber, l_suppkey, m, y)
        SELECT l_returnflag, y AS year, count(*) AS n, max(k) AS last_order, CAST(sum(k) AS BIGINT) AS sum_orders FROM d GROUP BY ALL""",
    "d23_fold_errors": f"WITH {_FOLDS} SELECT * FROM m",
    "d17_simplest_set": f"WITH {_FOLDS}, b AS (SELECT mean + standard_error AS most FROM m ORDER BY mean, length(c_mktsegment), c_mktsegment LIMIT 1) SELECT c_mktsegment AS name, mean, CAST(length(c_mktsegment) AS INTEGER) AS size FROM m, b WHERE mean <= most ORDER BY size, mean, name LIMIT 1",
    "d43_split_modes": "SELECT DISTINCT c_mktsegment AS industry, 'historical' AS mode, 'snapshot' AS mode_of_two FROM customer",
    "e19_group_folds": "SELECT o_orderkey, CAST(CAST('0x' || left(md5(CAST(o_custkey AS VARCHAR)), 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM orders WHERE o_custkey IS NOT NULL",
    "k15_run_limits": views.with_views("v_observation") + " SELECT bool_or(publication_date IS NULL) AS uses_acquisition_dates, bool_or(value IS NULL) AS has_unlabelled_rows, count(DISTINCT reporting_year) AS n_cycles FROM v_observation",
}
