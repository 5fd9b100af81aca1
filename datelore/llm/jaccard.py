"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal sets of word shingles form a class; one document of each class is compared. Bands of MinHash
values bring candidates together; their MinHash values are compared a few at a time, and a pair is dropped when
the posterior probability that it reaches the threshold falls below a tolerance. What survives spans candidate groups,
within which every surviving pair is verified by the exact sets. Pairs are counted where they meet, never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from datelore.llm.common import checkpointed, dealt_in_blocks, grouped, read_table, with_columns_from, words_of
from datelore.llm.components import connected_components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: MinHash values, and values in a band: a pair at 0.8 shares no band with a probability of 5e-8.
HASHES, BAND = 128, 4
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-7
#: Documents of a group that meet in one task, while pruning and while verifying; there a block ends at so many bytes of shingle sets too.
PRUNE_ROWS, VERIFY_ROWS, VERIFY_BYTES = 512, 1024, 4 << 20

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(11).integers(1, 2**63, size=(2, HASHES), dtype=np.uint64) | _U(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of size words; of fewer words, but not none, the hash of the whole."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    size = min(size, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _P + w[k : n - size + 1 + k]
    return np.unique(_mixed(h))


def minhash(found: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits: the least of the set's images under each of as many functions."""
    least = np.full(HASHES, 2**32 - 1, np.uint64)
    for k in range(0, len(found), 1024):
        np.minimum(least, (((found[k : k + 1024, None] ^ _SEEDS[0]) * _SEEDS[1]) >> _U(32)).min(axis=0), out=least)
    return least


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of values, its number mixed in."""
    parts = values.reshape(-1, BAND)
    h = np.arange(len(parts), dtype=np.uint64)
    for k in range(BAND):
        h = _mixed(h * _P + parts[:, k])
    return h.view(np.int64)


@lru_cache
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For STEP, 2 * STEP, ... compared bytes, the fewest matches with which a pair stays.

    With a uniform prior the posterior of the share of matches after m of n is Beta(m + 1, n - m + 1), so the chance that it is t
    or more is that of at most m successes in n + 1 trials of t. One byte of unequal values matches by chance in one of 256 cases.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = (1 - t) ** (n + 1), 0
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving_pairs(signs: np.ndarray, sides: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of signs (bytes) that no step prunes: all pairs i < j, or those from side to side."""
    need = least_matches(threshold)
    n = len(signs)
    i, j = np.triu_indices(n, 1) if sides is None else np.nonzero(sides[:, None] < sides[None, :])
    matches = np.zeros(len(i), np.int16)
    for step, least in enumerate(need):
        part = np.ascontiguousarray(signs[:, step * STEP : (step + 1) * STEP])
        for k in range(0, len(i), 1 << 15):
            at = slice(k, k + (1 << 15))
            matches[at] += (part[i[at]] == part[j[at]]).sum(axis=1, dtype=np.int16)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
        if not len(i):
            break
    return i, j


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[i] and sets[j], from products of the incidence of shared elements, a slice at a time."""
    used = np.unique(np.concatenate([i, j]))
    row_of = np.zeros(len(sets), np.int64)
    row_of[used] = np.arange(len(used))
    rows = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    every, column, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    rows, column = rows[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(used), 4096), np.float32)
        part[rows[a:b], column[a:b] - start] = 1
        total += part @ part.T
    return total[row_of[i], row_of[j]].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row number that each of n rows reaches by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _met(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
    """(id, links, root) of the rows that have links. Rows of one id are one node, and two nodes have one link at most."""
    nodes, node_of = np.unique(ids, return_inverse=True)
    if len(nodes) < len(ids):
        pairs = np.unique(np.minimum(node_of[i], node_of[j]) * len(nodes) + np.maximum(node_of[i], node_of[j]))
        ids, i, j = nodes, pairs // len(nodes), pairs % len(nodes)
    other = ids[i] != ids[j]
    i, j = i[other], j[other]
    if not len(i):
        return None
    n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    at, root = np.flatnonzero(n), _roots(len(ids), i, j)
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at].astype(np.int64)), pa.array(ids[root[at]])], ["rep", "n", "root"])


_MET = "rep bigint, n bigint, root bigint"


def _described(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, fp, sign, bands, bytes): fp stands for the set of shingles, sign holds a byte of each MinHash value, bytes is the set's size; null without words."""

    def make():
        def of(text: str | None) -> tuple:
            found = shingles(words_of(text))
            if not len(found):
                return None, None, None, None
            values = minhash(found)
            return blake2b(found.tobytes(), digest_size=16).digest(), values.astype(np.uint8).tobytes(), bands(values).tolist(), found.nbytes

        return of

    return with_columns_from(docs.select("doc_id", F.col(text_col).alias("text")), "text", "fp binary, sign binary, bands array<bigint>, bytes bigint", make).drop("text")


def with_shingle_set(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a column that stands for the set of shingles of text_col, null without words."""

    def make():
        def of(text: str | None) -> tuple:
            found = shingles(words_of(text))
            return (blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None,)

        return of

    return with_columns_from(docs, text_col, f"{name} binary", make)


def _candidate_groups(reps: DataFrame, threshold: float) -> DataFrame:
    """(node, component): documents that chains of unpruned candidate pairs join."""
    dealt = dealt_in_blocks(reps.select("rep", F.explode("bands").alias("band")), ["band"], "rep", PRUNE_ROWS)
    group = ["band", "lo", "hi"]
    # A rep with several sets meets under each set's bands with all of its signs: candidates too many, but none too few.
    rows = dealt.join(reps.select("rep", "sign"), "rep").repartition(*group).sortWithinPartitions(*group).select(*group, "blk", "rep", "sign")

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, blk, ids, signs in grouped(batches, len(group)):
            signs = np.frombuffer(b"".join(signs), np.uint8).reshape(len(ids), HASHES)
            met = _met(np.array(ids, np.int64), *surviving_pairs(signs, None if key[1] == key[2] else np.array(blk), threshold))
            if met is not None:
                yield met

    edges = rows.mapInArrow(pruned, _MET)
    return connected_components(edges.select(F.col("rep").alias("a"), F.col("root").alias("b")))


def _verified(docs: DataFrame, reps: DataFrame, groups: DataFrame, threshold: float, text_col: str) -> DataFrame:
    """(rep, n, root): links that the exact sets confirm, counted by task."""
    members = checkpointed(groups.select(F.col("node").alias("rep"), "component").join(reps.select("rep", "fp", "bytes"), "rep"))
    texts = docs.select(F.col("doc_id").alias("rep"), F.col(text_col).alias("text")).join(members.select("rep", F.col("fp").alias("_fp")), "rep")

    def make():
        def of(text: str | None) -> tuple:
            found = shingles(words_of(text))
            return blake2b(found.tobytes(), digest_size=16).digest(), minhash(found).astype(np.uint8).tobytes(), found.tobytes()

        return of

    sets = with_columns_from(texts, "text", "fp binary, sign binary, hashes binary", make).where("fp = _fp").select("rep", "fp", "sign", "hashes").dropDuplicates(["rep", "fp"])
    group = ["component", "lo", "hi"]
    dealt = dealt_in_blocks(members, ["component"], "rep", VERIFY_ROWS, "bytes", VERIFY_BYTES)
    rows = dealt.join(sets, ["rep", "fp"]).repartition(*group).sortWithinPartitions(*group).select(*group, "blk", "rep", "sign", "hashes")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, blk, ids, signs, raw in grouped(batches, len(group)):
            signs = np.frombuffer(b"".join(signs), np.uint8).reshape(len(ids), HASHES)
            i, j = surviving_pairs(signs, None if key[1] == key[2] else np.array(blk), threshold)
            if not len(i):
                continue
            found = [np.frombuffer(x, np.uint64) for x in raw]
            sizes = np.array([len(x) for x in found])
            both = intersections(found, i, j)
            near = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
            met = _met(np.array(ids, np.int64), i[near], j[near])
            if met is not None:
                yield met

    return rows.mapInArrow(linked, _MET)


def near_documents(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, n_links, component_id, kept) for every row of docs.

    Documents with equal sets of shingles (five words; a shorter text is one shingle) are a class, called by its smallest
    doc_id. Classes link when the Jaccard similarity of their sets is threshold at least: n_links counts the other classes that a
    document's class links with, component_id is the smallest doc_id that links reach, and kept is true for that document.
    A pair at the threshold is missed with a probability of about 1e-6 (bands and pruning); no pair below it is linked.
    Null, empty and wordless texts are classes of their own without links and are kept. A doc_id on several rows is one
    node with the links of all its texts. Rows with a null doc_id count in their class, but cannot stand for it: a class
    with no other rows has a null id and no links, and such rows are not kept. Other columns are ignored.
    """
    told = checkpointed(_described(docs, text_col))
    classes = told.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"))
    # Of a class any row will do for sign and bands, which are functions of the set; only its representative's are moved.
    reps = told.where("doc_id is not null").join(classes.where("rep is not null").withColumnRenamed("fp", "_fp"), (F.col("fp") == F.col("_fp")) & (F.col("doc_id") == F.col("rep")))
    reps = checkpointed(reps.select("rep", "fp", "sign", "bands", "bytes").dropDuplicates(["rep", "fp"]))
    links = checkpointed(_verified(docs, reps, _candidate_groups(reps, threshold), threshold, text_col))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n_links"))
    parts = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    by_class = classes.join(counts, "rep", "left").join(parts, "rep", "left")
    own = F.when(F.col("fp").isNull(), F.col("doc_id"))
    out = told.select("doc_id", "fp").join(by_class.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"), "left")
    return out.select(
        "doc_id", F.coalesce("rep", own).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", own).alias("component_id"),
        F.coalesce(F.coalesce("component", "rep", own) == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, joined at a Jaccard similarity of 0.8 of their five-word shingles."""
    return near_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
