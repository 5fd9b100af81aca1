"""Queries: streams run to the end of what has landed, and their batch equals."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.plans import views
from datelore.plans.lineage import shared_folder
from datelore.sources import feeds, sinks
from datelore.streaming import ingest


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: all files of its folder or file."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream source wants a folder or a pattern: this pattern names the one table
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(result: DataFrame, mode: str) -> DataFrame:
    """result's rows after all landed input: written to the shared folder, once (append) or anew with each batch (complete)."""
    spark, folder, name = result.sparkSession, shared_folder(result.sparkSession), f"flow_{uuid4().hex}"
    writer = result.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}-state")
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/{name}").start().awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{folder}/{name}")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/{name}")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(ingest.latest_state(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]), "complete")


def stream_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.touched(_events(spark, sf_dir).withColumn("seen", F.col("event_id")), ["user_id", "props"], "seen")
    return _run(found, "complete")


def stream_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.new_observations(_events(spark, sf_dir), ["user_id", "event_type", "props"], "ts", "40 days")
    return _run(found.select("user_id", "event_type", "props", "fingerprint"), "append").drop("fingerprint")


def checks_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events").withColumn("hours", F.when(F.col("user_id") % 2 == 0, 24).otherwise(168))
    found = ingest.due(events, "user_id", "ts", "hours", "2024-01-31 00:00:00")
    return found.select("user_id", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due_at"))


def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    found = ingest.enriched(_events(spark, sf_dir), context, "user_id").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return _run(found, "complete")


def delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, recorded up to three days after they happened, by the day of the event, with those marked that came more than a day late."""
    events = _events(spark, sf_dir).withColumn("recorded", F.col("ts") + F.make_interval(hours=(F.col("event_id") % 72).cast("int")))
    return _run(ingest.delays_marked(events, "ts", "recorded", "1 DAY").select("event_id", F.col("day").cast("string").alias("day"), "is_late"), "append")


def check_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log of checks batch by batch, each batch twice, as after a lost driver; read back."""
    folder, name = shared_folder(spark), f"log_{uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            sinks.append_batch(batch, f"{folder}/{name}", number)

    rows = _events(spark, sf_dir).select("event_id", "user_id", "event_type")
    rows.writeStream.foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}-state").start().awaitTermination()
    return sinks.read_log(spark, f"{folder}/{name}", like=rows).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_events"), F.sum("user_id").alias("users"))


def accepted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of all lines, accepted by extraction (an order): three batches that overlap, each extraction's rows once."""
    path = f"{shared_folder(spark)}/metrics_{uuid4().hex}"
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), "l_linenumber", "l_quantity")
    for number, part in enumerate(("extraction_id % 3 < 2", "extraction_id % 3 > 0", "true")):
        sinks.append_new(lines.where(part), path, "extraction_id", number)
    return sinks.read_log(spark, path).groupBy("extraction_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def model_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all suppliers, published with their contributions, which have to rebuild them; then anew with other scores; what is current."""
    path = f"{shared_folder(spark)}/published_{uuid4().hex}"
    parts = views.table(spark, sf_dir, "supplier").where("s_acctbal is not null").select("s_suppkey", (F.col("s_acctbal") / 100).alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    for intercept in (5.0, 7.0):
        rows = parts.withColumns({"intercept": F.lit(intercept), "score": F.lit(intercept) + F.col("balance") + F.col("nation")})
        sinks.publish({"scores": rows}, path, {"scores": {"rebuilt": sinks.reconstructs("score", "intercept", "balance", "nation"), "once": F.count(F.lit(1)) == F.countDistinct("s_suppkey")}})
    return sinks.read_current(spark, path)["scores"].select("s_suppkey", F.round("score", 6).alias("score"))


_FEED = "<?xml version='1.0'?><rss xmlns:c='urn:c'><channel><title>all</title>%s</channel></rss>"


def _feed() -> Column:
    """A page as a feed of two entries: one named by its url, whose text is marked up, and one that all pages of a group share."""
    safe = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    own = F.concat(F.lit("<item><link>"), safe, F.lit("</link><c:encoded>&lt;p&gt;page "), F.col("page_id").cast("string"), F.lit("&lt;/p&gt;&lt;p&gt;end&lt;/p&gt;</c:encoded><guid>no</guid></item>"))
    shared = F.concat(F.lit("<url><loc>shared</loc><title>"), (F.col("page_id") % 3).cast("string"), F.lit("</title></url>"))
    return F.concat(F.lit(_FEED.split("%s")[0]), own, shared, F.lit(_FEED.split("%s")[1]))


def feed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a feed for each page; of one in seven it is cut off, and unreadable."""
    feed = F.when(F.col("page_id") % 7 == 0, F.substring(_feed(), 1, 60)).otherwise(_feed())
    return feeds.feed_lines(views.table(spark, sf_dir, "pages").select("page_id", feed.alias("content")), "page_id", "content")


def feed_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as polls of ten feeds, read as a stream: each content of each entry once, with what was new and what had changed."""
    schema = spark.read.parquet(f"{sf_dir}/pages.parquet").schema
    polls = spark.readStream.schema(schema).parquet(f"{sf_dir}/page[s].parquet")
    polls = polls.select((F.col("page_id") % 10).alias("feed"), _feed().alias("content"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 3).alias("polled_at"))
    found = _run(feeds.versions(feeds.feed_entries(polls, "feed", "content"), "feed", "1 day"), "append")
    return feeds.changes(found, "feed", F.col("polled_at")).groupBy("feed", "change").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") == "shared").alias("n_shared"))


QUERIES = {"i04_delays_marked": delays, "a22_check_log": check_log, "a25_accepted_metrics": accepted_metrics, "a24_model_snapshot": model_snapshot, "a09_feed_lines": feed_texts, "i07_feed_polls": feed_polls, "i02_stream_latest": stream_latest, "i01_stream_touched": stream_touched, "i03_stream_new": stream_new, "i05_checks_due": checks_due, "i08_stream_enriched": stream_enriched}

ORACLE_SQL = {
    "i04_delays_marked": "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id % 72 > 24 AS is_late FROM events",
    "a22_check_log": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_events, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1",
    "a25_accepted_metrics": "SELECT l_orderkey AS extraction_id, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
    "a24_model_snapshot": "SELECT s_suppkey, round(7 + s_acctbal / 100 + s_nationkey, 6) AS score FROM supplier WHERE s_acctbal IS NOT NULL",
    "a09_feed_lines": """SELECT page_id, e AS entry, f AS field, 'E' || e || 'L' || l AS id, CASE l WHEN 1 THEN url WHEN 2 THEN 'page ' || page_id WHEN 3 THEN 'end' WHEN 4 THEN 'shared' ELSE CAST(page_id % 3 AS VARCHAR) END AS text
        FROM pages, (VALUES (1, 'link', 1), (1, 'encoded', 2), (1, 'encoded', 3), (2, 'loc', 4), (2, 'title', 5)) AS v(e, f, l) WHERE page_id % 7 <> 0 UNION ALL SELECT page_id, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 7 = 0""",
    "i07_feed_polls": """WITH e AS (SELECT DISTINCT page_id % 10 AS feed, url AS name, CAST(page_id AS VARCHAR) AS c FROM pages UNION SELECT DISTINCT page_id % 10, 'shared', CAST(page_id % 3 AS VARCHAR) FROM pages),
        n AS (SELECT *, row_number() OVER (PARTITION BY feed, name ORDER BY c) AS k FROM e)
        SELECT feed, CASE WHEN k = 1 THEN 'new' ELSE 'changed' END AS change, count(*) AS n, count(*) FILTER (name = 'shared') AS n_shared FROM n GROUP BY ALL""",
    "i02_stream_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "i01_stream_touched": "SELECT user_id, props, min(event_id) AS first_seen, max(event_id) AS last_checked, count(*) AS n FROM events GROUP BY ALL",
    "i03_stream_new": "SELECT DISTINCT user_id, event_type, props FROM events",
    "i05_checks_due": """SELECT user_id, strftime(due, '%Y-%m-%d %H:%M:%S') AS due_at FROM (SELECT user_id, max(ts) + CASE WHEN user_id % 2 = 0 THEN INTERVAL 24 HOUR ELSE INTERVAL 168 HOUR END AS due FROM events GROUP BY user_id)
        WHERE due <= TIMESTAMP '2024-01-31 00:00:00'""",
    "i08_stream_enriched": "SELECT c_mktsegment, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1",
}
