"""Structured Streaming forms of ingest, latest state, ledger and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_observations(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first of each observation (by the fingerprint of keys) within the watermark's delay; replays are dropped."""
    marked = stream.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256))
    return marked.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def touched(stream: DataFrame, keys: list[str], time: str) -> DataFrame:
    """First and last time each observation was seen, for update mode: a repeated one moves last_checked without a new value."""
    return stream.groupBy(*keys).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_checked"), F.count(F.lit(1)).alias("n"))


def latest_state(stream: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The newest values of each key, for update or complete mode; late rows cannot overwrite newer ones, whatever order they come in."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def daily_ledger(stream: DataFrame, time: str, key: str, event_id: str, amount: str, delay: str) -> DataFrame:
    """Amounts and counts by key and day of event time, each event id once within the delay; a day is emitted when the watermark has passed it."""
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])
    return once.groupBy(F.window(time, "1 day"), key).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("day"), key, "total", "n")


def due(checks: DataFrame, key: str, time: str, hours: str, now: str) -> DataFrame:
    """Keys whose last check lies their interval of hours or more before now, as data for whoever schedules."""
    last = checks.groupBy(key).agg(F.max(time).alias("last_check"), F.max_by(hours, time).alias("_hours"))
    at = F.col("last_check") + F.make_interval(hours=F.col("_hours").cast("int"))
    return last.withColumn("due_at", at).where(F.col("due_at") <= F.lit(now).cast("timestamp")).select(key, "last_check", "due_at")


def expiring(stream: DataFrame, key: str, time: str, until: str, status: str, delay: str) -> DataFrame:
    """Rows (key, status, at): a key's reported status, and expired when the watermark passes its valid_until with nothing newer."""
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "status": ["expired"], "at": [pd.Timestamp(at, unit="ms")]})
            return
        rows = pd.concat(frames).sort_values(time)
        last = rows.iloc[-1]
        at = int(last[until].timestamp() * 1000)
        if not state.exists or state.get[0] < at:
            state.update((at,))
            if at > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(at)
        yield pd.DataFrame({key: [group[0]], "status": [last[status]], "at": [last[time]]})

    return (
        stream.withWatermark(time, delay).groupBy(key)
        .applyInPandasWithState(step, f"{key} {kind}, status string, at timestamp", "at long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def delays_marked(rows: DataFrame, time: str, recorded: str, delay: str) -> DataFrame:
    """Rows (of a stream or a table) with day, the day of their event, by which they are stored, and is_late: recorded more than the delay after it. None is dropped."""
    return rows.withColumns({"day": F.to_date(time), "is_late": F.coalesce(F.col(recorded) > F.col(time) + F.expr(f"INTERVAL {delay}"), F.lit(False))})


def reviewed(stream: DataFrame, key: str, recorded: str, delay: str) -> DataFrame:
    """Rows (key, status, reason, at): the standing of each document's review as reviews and stored contents arrive, and when it runs out.

    stream holds reviews (status, valid_until, sha256) and stored contents (sha256, status null) by the time that they were recorded. One state for each key keeps the review, the
    hash of what is stored, and one timer: a review holds (reason valid) while the stored content, if any is known, is the one that it was made of (else content_changed), until the
    watermark passes its end (verification_expired). A row is given for each change of standing. Rows are taken in the order of their time within a batch.
    """
    kind = stream.schema[key].dataType.simpleString()
    end_of = lambda t: int(pd.Timestamp(t).timestamp() * 1000)

    def standing(status, until, of, stored, now) -> tuple[str, str]:
        if status is None:
            return "unknown", "not_reviewed"
        if stored is not None and of != stored:
            return "unknown", "content_changed"
        return ("unknown", "verification_expired") if until <= now else (status, "valid")

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, until, of, stored, told = state.get if state.exists else (None, None, None, None, None)
        out = []
        if state.hasTimedOut:
            now = standing(status, until, of, stored, until)
            if told != now[1]:
                out.append((group[0], *now, pd.Timestamp(until, unit="ms")))
            state.update((status, until, of, stored, now[1]))
        else:
            for r in pd.concat(frames).sort_values(recorded).itertuples(index=False):
                r = r._asdict()
                if r["status"] is not None and r["status"] == r["status"]:
                    status, until, of = r["status"], end_of(r["valid_until"]), r["sha256"]
                else:
                    stored = r["sha256"]
                now = standing(status, until, of, stored, end_of(r[recorded]))
                if told != now[1] or now[1] == "valid":
                    out.append((group[0], *now, r[recorded]))
                told = now[1]
            state.update((status, until, of, stored, told))
            if until is not None and told == "valid" and until > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(until)
        if out:
            yield pd.DataFrame(out, columns=[key, "status", "reason", "at"])

    return (
        stream.withWatermark(recorded, delay).groupBy(key)
        .applyInPandasWithState(step, f"{key} {kind}, status string, reason string, at timestamp", "status string, until long, of string, stored string, told string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def enriched(stream: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """A stream with the columns of a static table; rows without a partner stay."""
    return stream.join(companies, key, "left")
