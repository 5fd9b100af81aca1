"""Benchmark decontamination by one Aho-Corasick automaton over normalised test texts.

The patterns are the windows of the test items: runs of words, each word spelled by the digits of its number. Every
document is normalised the same way and scanned once; matches are word numbers, mapped to character offsets of the original
text. The document side is never shuffled, and a worker process builds the automaton once, for all of its tasks.
"""

from __future__ import annotations

from itertools import chain
from uuid import uuid4

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.llm.common import WORD, read_table, with_columns_from, words_of

WINDOW_WORDS = 13
#: UTF-8 bytes of test texts in one automaton, which takes about 150 times as much memory in each worker; more texts are scanned for by
#: further automata, one after another.
AUTOMATON_BYTES = 8 << 20
#: Digits that spell the number of a word; a node of the automaton has this many children at most.
BASE = 256

_SPANS = "array<struct<first_word:int,last_word:int,start:int,end:int>>"
_NAMES = ("n_words", "n_hit", "item_ids", "spans")


def windows_of(words: list[bytes], size: int) -> set[bytes]:
    """The windows of an item: every run of size words; all of a shorter item; none of one without words."""
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


class Windows:
    """An automaton over the windows of (item_id, text) rows; a window's value is (its words, ids of the items that hold it)."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        holders: dict[bytes, set[str]] = {}
        for item_id, text in items:
            for window in windows_of(words_of(text), size):
                holders.setdefault(window, set()).add(item_id)
        known = sorted({w for window in holders for w in window.split(b" ")})
        self.digits = 1
        while BASE**self.digits < len(known):
            self.digits += 1
        # Digits of different places are different letters, so no match begins within a word; 0 stands for words that no window holds.
        self.letters = {w: tuple(1 + d * BASE + k // BASE**d % BASE for d in range(self.digits)) for k, w in enumerate(known)}
        self.unknown = (0,) * self.digits
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in holders.items():
            words = window.split(b" ")
            self.automaton.add_word(self.spelled(words), (len(words), tuple(sorted(ids))))
        if holders:
            self.automaton.make_automaton()

    def spelled(self, words: list[bytes]) -> tuple[int, ...]:
        letters, unknown = self.letters, self.unknown
        return tuple(chain.from_iterable([letters.get(w, unknown) for w in words]))


def scan(text: str | None, windows: Windows) -> tuple[list[bytes], np.ndarray, set[str]]:
    """The words of text, whether each lies in an occurrence of a window, and the items that have occurring windows."""
    words = words_of(text)
    hit, items = np.zeros(len(words) + 1, np.int64), set()
    if words and windows.letters:
        for at, (n, ids) in windows.automaton.iter(windows.spelled(words)):
            last = at // windows.digits
            hit[last - n + 1] += 1
            hit[last + 1] -= 1
            items.update(ids)
    return words, np.cumsum(hit[:-1]) > 0, items


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of hit words as (first word, last word, first character, character after the last) of the original text."""
    if not hit.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    places = [m.span() for m in _WORDS.finditer(text)]
    return [(a, b - 1, places[a][0], places[b - 1][1]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


_WORDS = regex.compile(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))  # A-Z are words before they become a-z


_BUILT: dict[str, Windows] = {}  # of a worker process: the automaton that its tasks used last


def _scan_once(docs: DataFrame, items: list[tuple[str, str | None]], size: int, text_col: str, names: list[str]) -> DataFrame:
    """docs and the four columns of _NAMES, called names."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid4().hex

    def make():
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Windows(shared.value, size)
        windows = _BUILT[key]

        def of(text: str | None) -> tuple:
            words, hit, ids = scan(text, windows)
            return len(words), int(hit.sum()), sorted(ids), [dict(zip(("first_word", "last_word", "start", "end"), s, strict=True)) for s in _spans(text, hit)] if ids else []

        return of

    ddl = ", ".join(f"`{name}` {kind}" for name, kind in zip(names, ("bigint", "bigint", "array<string>", _SPANS), strict=True))
    return with_columns_from(docs, text_col, ddl, make)


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, automaton_bytes: int = AUTOMATON_BYTES, text_col: str = "text"
) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted as strings), and spans of hit words with offsets in the original text.

    benchmark holds item_id and text. All of it goes into one automaton; only where it has more than automaton_bytes of text is it
    dealt to several (a single longer item gets its own), so that what the driver gathers and a worker holds is bounded
    however large the table is; each further automaton means another scan of docs, whose hits are united row by row.
    Columns of docs that bear a new name are replaced; all others pass through.

    A null or empty text has no words and no hits; items with null, empty or wordless texts match nothing; equal
    items are all named; an item id that several rows share counts once; null item ids count by the name "null".
    Repeated rows stay. An empty benchmark hits nothing.
    """
    docs = docs.select(*[c for c in docs.columns if c not in _NAMES])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
    total = items.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, -(-2 * total // max(automaton_bytes, 1))) if total > automaton_bytes else 1
    found = None
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        one = [(r.item_id, r.text) for r in part.select("item_id", "text").toLocalIterator()]
        if found is None:
            found = _scan_once(docs, one, window_words, text_col, list(_NAMES))
        else:
            new = [f"{name}-{uuid4().hex}" for name in _NAMES]
            found = _united(_scan_once(found, one, window_words, text_col, new), docs.columns, new)
    return found


def _united(both: DataFrame, columns: list[str], new: list[str]) -> DataFrame:
    """Rows that hold what one scan found (columns named new) and what those before it found, with the two united."""
    edge = lambda s: F.struct(s["first_word"].alias("first_word"), s["last_word"].alias("last_word"), s["start"].alias("start"), s["end"].alias("end"))
    spans = F.array_sort(F.concat("spans", new[3]))
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate(
        spans,
        F.array().cast(_SPANS),
        lambda a, s: F.when((F.size(a) > 0) & (last(a)["last_word"] >= s["first_word"] - 1),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["first_word"].alias("first_word"), F.greatest(last(a)["last_word"], s["last_word"]).alias("last_word"), last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(edge(s)))),
    )
    quoted = [F.col(f"`{c}`") for c in columns]
    return both.select(*quoted, "n_words", F.array_sort(F.array_union("item_ids", new[2])).alias("item_ids"), merged.alias("spans")).select(
        *quoted, "n_words", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last_word"] - s["first_word"] + 1).alias("n_hit"), "item_ids", "spans"
    )


def is_contaminated():
    """The rule of the contract: some words are hit, and they are a twentieth of all words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the benchmark contaminates, for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


_OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, k, k + least(13, len(w)) - 1) AS win, least(13, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE_SQL = {"op7_decontaminate": _OP7_SQL}
