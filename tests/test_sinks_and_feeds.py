"""Sinks whose writer dies between its steps, feeds polled in any order, and reviews that end or lose their document."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from datelore.sources import feeds, sinks
from datelore.sources.files import ExpectationError
from datelore.streaming import ingest
from tests.test_streams import T0, all_rows, landed


class Killed(Exception):
    pass


def killed_at(step):
    def between(done):
        if done == step:
            raise Killed

    return between


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.append_batch(table(spark, 1, 2), path, 0)
    with pytest.raises(Killed):
        sinks.append_batch(table(spark, 3), path, 1, killed_at("data"))
    assert values(sinks.read_log(spark, path)) == [1, 2]
    assert sinks.append_batch(table(spark, 3), path, 1) and not sinks.append_batch(table(spark, 9), path, 1)
    assert values(sinks.read_log(spark, path)) == [1, 2, 3]
    assert sinks.append_batch(table(spark), path, 2) and values(sinks.read_log(spark, path)) == [1, 2, 3]
    assert sinks.read_log(spark, str(tmp_path / "none"), like=table(spark, 1)).count() == 0
    with pytest.raises(ExpectationError):
        sinks.read_log(spark, str(tmp_path / "none"))


def test_keys_are_accepted_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int")
    sinks.append_new(rows((1, 1), (1, 2)), path, "k", "a")
    sinks.append_new(rows((1, 9), (2, 3)), path, "k", "b")
    sinks.append_new(rows((3, 4)), path, "k", "b")
    assert sorted(map(tuple, sinks.read_log(spark, path).collect())) == [(1, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("step", ["data", "manifest"])
def test_readers_see_the_last_whole_version(spark, tmp_path, step):
    path = str(tmp_path / "published")
    with pytest.raises(ExpectationError):
        sinks.read_current(spark, path)
    first = sinks.publish({"t": table(spark, 1), "u": table(spark, 5)}, path)
    with pytest.raises(Killed):
        sinks.publish({"t": table(spark, 2), "u": table(spark, 6)}, path, between=killed_at(step))
    assert {n: values(df) for n, df in sinks.read_current(spark, path).items()} == {"t": [1], "u": [5]}
    second = sinks.publish({"t": table(spark, 2), "u": table(spark, 6)}, path)
    assert {n: values(df) for n, df in sinks.read_current(spark, path).items()} == {"t": [2], "u": [6]}
    assert sinks.publish({"t": table(spark, 1), "u": table(spark, 5)}, path) == first != second
    assert values(sinks.read_current(spark, path)["t"]) == [1]


def test_what_does_not_rebuild_is_not_published(spark, tmp_path):
    path = str(tmp_path / "published")
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, 3.1)], "a double, b double, score double")
    checks = {"scores": {"rebuilt": sinks.reconstructs("score", "a", "b")}}
    with pytest.raises(ExpectationError):
        sinks.publish({"scores": rows}, path, checks)
    with pytest.raises(ExpectationError):
        sinks.read_current(spark, path)
    sinks.publish({"scores": rows.limit(1)}, path, checks)
    assert sinks.read_current(spark, path)["scores"].count() == 1


FEED = "<feed xmlns='urn:a' xmlns:x='urn:x'>%s</feed>"
CASES = {
    FEED % "<entry><title>One</title><link href='u'/><summary type='xhtml'><b>two</b> three</summary></entry><entry><id>no</id></entry><entry><updated>2024</updated></entry>": [(1, "title", "E1L1", "One"), (1, "summary", "E1L2", "two  three"), (3, "updated", "E3L3", "2024")],
    "<rss><item><x:encoded xmlns:x='u'>&lt;p&gt;a&lt;/p&gt;&lt;p&gt;b</x:encoded><description><![CDATA[<i>c</i>]]></description></item></rss>": [(1, "encoded", "E1L1", "a"), (1, "encoded", "E1L2", "b"), (1, "description", "E1L3", "c")],
    "<urlset><url><loc>http://a</loc><lastmod>x</lastmod></url></urlset>": [(1, "loc", "E1L1", "http://a")], "<urlset/>": [], "<broken": [(None,) * 4], "": [(None,) * 4], None: [(None,) * 4],
}


def test_lines_of_feeds(spark):
    frame = spark.createDataFrame([(k, c) for k, c in enumerate(CASES)], "k int, c string")
    got = {}
    for r in feeds.feed_lines(frame, "k", "c").collect():
        got.setdefault(r.k, []).append(tuple(r)[1:])
    assert got == {k: v for k, v in enumerate(CASES.values()) if v}


def test_polls_in_any_order(spark, tmp_path):
    entry = lambda name, text: f"<item><link>{name}</link><title>{text}</title></item>"
    at = lambda n: T0 + dt.timedelta(hours=n)
    polls = [[("f", f"<r>{entry('a', 1)}{entry('b', 1)}</r>", at(0))], [("f", f"<r>{entry('a', 1)}{entry('b', 2)}</r>", at(1))], [("f", f"<r>{entry('a', 1)}{entry('b', 2)}{entry('c', 1)}</r>", at(2)), ("g", f"<r>{entry('a', 7)}</r>", at(0))]]
    found = set()
    for n, order in enumerate(itertools.permutations(polls)):
        stream = landed(spark, tmp_path / f"in{n}", order, "feed string, content string, polled_at timestamp")
        rows = all_rows(feeds.versions(feeds.feed_entries(stream, "feed", "content"), "feed", "1 day"), tmp_path / f"cp{n}")
        told = feeds.changes(spark.createDataFrame(rows, "feed string, polled_at timestamp, name string, content_hash string"), "feed", F.lit(0))
        found.add(tuple(sorted((r.feed, r.name, r.content_hash, r.change) for r in told.collect())))
    assert len(found) == 1
    (one,) = found
    assert sorted((f, n, c) for f, n, _, c in one) == [("f", "a", "new"), ("f", "b", "changed"), ("f", "b", "new"), ("f", "c", "new"), ("g", "a", "new")]


def test_reviews_end_or_lose_their_document(spark, tmp_path):
    at = lambda days: T0 + dt.timedelta(days=days)
    batches = [
        [("x", at(0), "verified", at(2), "h1"), ("y", at(0), "verified", at(60), "h1"), ("z", at(0), None, None, "h1")], [("y", at(1), None, None, "h2"), ("z", at(1), "newer", at(60), "h1")], [("y", at(4), "verified", at(60), "h2")], [("w", at(9), None, None, "h")],
    ]
    stream = landed(spark, tmp_path / "in", batches, "k string, ts timestamp, status string, valid_until timestamp, sha256 string")
    got = all_rows(ingest.reviewed(stream, "k", "ts", "1 hour"), tmp_path / "cp")
    assert sorted(got) == [
        ("w", "unknown", "not_reviewed", at(9)), ("x", "unknown", "verification_expired", at(2)), ("x", "verified", "valid", at(0)), ("y", "unknown", "content_changed", at(1)), ("y", "verified", "valid", at(0)), ("y", "verified", "valid", at(4)),
        ("z", "newer", "valid", at(1)), ("z", "unknown", "not_reviewed", at(0)),
    ]


def test_late_events_are_marked_and_kept(spark):
    frame = spark.createDataFrame([(1, T0, T0 + dt.timedelta(hours=1)), (2, T0, T0 + dt.timedelta(hours=25)), (3, T0, None), (4, None, T0)], "k int, ts timestamp, recorded timestamp")
    got = {r.k: (r.day, r.is_late) for r in ingest.delays_marked(frame, "ts", "recorded", "1 DAY").collect()}
    assert got == {1: (T0.date(), False), 2: (T0.date(), True), 3: (T0.date(), False), 4: (None, False)}
