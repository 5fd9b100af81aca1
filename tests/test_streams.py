"""Streams fed in several micro-batches, with late and repeated rows."""

import datetime as dt

from datelore.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def landed(spark, folder, batches, schema):
    """A stream of one file for each batch, read one at a time in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def all_rows(result, folder, mode="append"):
    found = []
    query = result.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder))
    query.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).start().awaitTermination()
    return found


def test_ledger_counts_an_event_once(spark, tmp_path):
    at = lambda days, hours=0: T0 + dt.timedelta(days=days, hours=hours)
    batches = [[(at(0, 1), "a", 1, 5.0), (at(0, 2), "a", 2, 7.0), (at(0, 1), "a", 1, 5.0)], [(at(0, 1), "a", 1, 5.0), (at(1), "a", 3, 1.0)], [(at(5), "a", 4, 1.0)], [(at(9), "a", 5, 1.0)]]
    stream = landed(spark, tmp_path / "in", batches, "ts timestamp, k string, id long, v double")
    got = all_rows(ingest.daily_ledger(stream, "ts", "k", "id", "v", "1 day"), tmp_path / "cp")
    assert (T0.date(), "a", 12.0, 2) in got and len({r[0] for r in got}) == len(got)


def test_replays_are_dropped(spark, tmp_path):
    batches = [[(T0, "a", 1.0)], [(T0 + dt.timedelta(hours=1), "a", 1.0), (T0, "b", 1.0)]]
    stream = landed(spark, tmp_path / "in", batches, "ts timestamp, k string, v double")
    got = all_rows(ingest.new_observations(stream, ["k", "v"], "ts", "1 day").select("k", "v"), tmp_path / "cp")
    assert sorted(got) == [("a", 1.0), ("b", 1.0)]


def test_a_review_expires(spark, tmp_path):
    at = lambda days: T0 + dt.timedelta(days=days)
    batches = [[("x", at(0), at(2), "verified")], [("y", at(4), at(40), "verified")], [("y", at(9), at(50), "verified")]]
    stream = landed(spark, tmp_path / "in", batches, "k string, ts timestamp, until timestamp, status string")
    got = all_rows(ingest.expiring(stream, "k", "ts", "until", "status", "1 hour"), tmp_path / "cp")
    assert ("x", "expired", at(2)) in got and sum(r[1] == "verified" for r in got) == 3 and not any(r[:2] == ("y", "expired") for r in got)
