"""Feeds and sitemaps as citable lines, and polls of them as new and changed entries."""

from __future__ import annotations

import xml.etree.ElementTree as tree
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.operators.documents import page_lines

#: Elements that are entries of a feed or sitemap, and those of their children whose text is kept, by their names without a namespace.
ENTRIES = {"item", "entry", "url"}
FIELDS = {"title", "description", "content", "encoded", "summary", "pubDate", "published", "updated", "link", "loc"}


def _name(element: tree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def lines_of_feed(body: bytes | None) -> list[tuple[int, str, str, str]] | None:
    """(entry, field, id, text) of a feed: ids are E and the entry's number and L and the line's, counted over the feed; none where it is no XML.

    A field that holds markup gives a line for each of its visible texts; one without text gives none.
    """
    try:
        root = tree.fromstring(body or b"")
    except tree.ParseError:
        return None
    out: list = []
    for number, entry in enumerate((e for e in root.iter() if _name(e) in ENTRIES), 1):
        for child in entry:
            if _name(child) in FIELDS:
                text = " ".join(child.itertext()) if len(child) else child.text or ""
                for line in (page_lines(text) if "<" in text else [text] if text else []):
                    out.append((number, _name(child), f"E{number}L{len(out) + 1}", line))
    return out


def feed_lines(feeds: DataFrame, key: str, content: str) -> DataFrame:
    """(key, entry, field, id, text) of feeds (key, content: bytes or text), a row for each line. What is no XML is a row with only its key, so that it stays visible."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = lines_of_feed(batch.column(1)[k].as_py())
                rows = [(None, None, None, None)] if found is None else found
                if rows:
                    same = pa.array([batch.column(0)[k].as_py()] * len(rows), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([same, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]], [key, "entry", "field", "id", "text"])

    kind = feeds.schema[key].dataType.simpleString()
    return feeds.select(key, F.col(content).cast("binary")).mapInArrow(read, f"`{key}` {kind}, entry int, field string, id string, text string")


def feed_entries(feeds: DataFrame, key: str, content: str) -> DataFrame:
    """(key, name, content_hash): a row for each entry, named by its link, loc or title; the hash is of all its lines. Works on streams: an entry is hashed where it lies."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for k in range(batch.num_rows):
                entries: dict[int, list] = {}
                for number, field, _, text in lines_of_feed(batch.column(1)[k].as_py()) or []:
                    entries.setdefault(number, []).append((field, text))
                if entries:
                    name = lambda told: next((t for f in ("link", "loc", "title") for g, t in told if g == f), None)
                    rows = [(name(told), hashlib.sha256("\n".join(f"{f}: {t}" for f, t in told).encode()).hexdigest()) for told in entries.values()]
                    columns = [pa.array([v] * len(rows), f.type) for v, f in zip(batch.slice(k, 1).to_pylist()[0].values(), batch.schema, strict=True)]
                    del columns[1]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.string()) for c in zip(*rows, strict=True)]], [key, "polled_at", "name", "content_hash"])

    kind = feeds.schema[key].dataType.simpleString()
    return feeds.select(key, F.col(content).cast("binary"), "polled_at").mapInArrow(read, f"`{key}` {kind}, polled_at timestamp, name string, content_hash string")


def versions(entries: DataFrame, key: str, delay: str) -> DataFrame:
    """A stream of entries with each content of each entry once, the first time that it is seen; a content is forgotten when the watermark has passed it by the delay."""
    return entries.withWatermark("polled_at", delay).dropDuplicatesWithinWatermark([key, "name", "content_hash"])


def changes(found: DataFrame, key: str, order: Column) -> DataFrame:
    """Versions with change: new for an entry's first, changed for those that follow, in the given order; ties go by the hash, so the result does not depend on the order of arrival."""
    place = F.row_number().over(Window.partitionBy(key, "name").orderBy(order, "content_hash"))
    return found.withColumn("change", F.when(place == 1, "new").otherwise("changed"))
