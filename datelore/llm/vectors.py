"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors within squared distance t of each other are, after a rotation cut into blocks, within t times the
block's share of the dimensions in one block at least. Each block is range-joined on its own: a vector goes to every cell
(sign pattern) of the block that the ball of half the block's radius about it touches, so two near vectors both reach
the cell of their midpoint. Candidates met there are verified by their exact cosine, each pair in one place only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.llm.common import checkpointed, dealt_in_blocks, grouped, read_table
from datelore.llm.components import connected_components

#: Dimensions of a block.
BLOCK_DIMS = 16
#: Cells are told apart by so many dimensions of their block that one would hold about as many rows of the largest label if no row were in
#: two. More cells copy each vector more often, and at a cosine of 0.93 compare hardly fewer pairs: in 64 dimensions 8 cells a block
#: mean 14 copies and 6.0 times the comparisons of one pass over a label, 256 cells 78 copies and 6.4 times.
ROWS_FOR_EACH_CELL = 1024
#: Rows of a cell that meet in one task, larger cells are cut into blocks of so many; rows compared with all of them at a time; pairs looked into at a time.
CELL_ROWS, TILE_ROWS, PAIRS = 4096, 512, 1 << 16
_SLACK = 1e-6  # of squared distances, for the rounding of rotated coordinates


@lru_cache
def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed orthonormal matrix: it spreads a vector's variance evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    n = max(1, round(dims / BLOCK_DIMS))
    edges = [dims * k // n for k in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _cells(block: np.ndarray, radius2: float, cell_dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for each cell that a ball of squared radius radius2 about a row touches: signs flip where their squares fit in it together."""
    block = block[:, :cell_dims]
    squares = block**2
    rows = np.arange(len(block))
    cell = ((block > 0) << np.arange(block.shape[1])).sum(axis=1)
    used = np.zeros(len(block))
    for d in range(squares.shape[1]):
        fits = used + squares[rows, d] <= radius2
        rows, cell, used = np.concatenate([rows, rows[fits]]), np.concatenate([cell, cell[fits] ^ (1 << d)]), np.concatenate([used, used[fits] + squares[rows[fits], d]])
    return rows, cell


def _spread(vectors: DataFrame, threshold: float, cell_dims: int) -> DataFrame:
    """(rid, vec_id, label, dims, vector, cells) of vectors that can link: vector as bytes of its components, cells as "block * 2**BLOCK_DIMS + cell"."""
    near2 = 2 - 2 * threshold + _SLACK
    kind = _component(vectors)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dims: dict[int, list] = {}
            for rid, vec_id, label, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if x and None not in x:
                    by_dims.setdefault(len(x), []).append((rid, vec_id, label, x))
            for dims, rows in by_dims.items():
                x = np.array([r[3] for r in rows], kind)
                unit = unit_rows(x)
                good = np.isfinite(unit).all(axis=1)
                rows = [r for r, g in zip(rows, good, strict=True) if g]
                if not rows:
                    continue
                x, turned = x[good], unit[good] @ rotation(dims)
                cells: list[list[int]] = [[] for _ in rows]
                for b, part in enumerate(blocks_of(dims)):
                    share = near2 * (part.stop - part.start) / dims
                    for r, c in zip(*(a.tolist() for a in _cells(turned[:, part], share / 4, cell_dims)), strict=True):
                        cells[r].append(b << BLOCK_DIMS | c)
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                columns += [pa.array([dims] * len(rows), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(cells, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "vec_id", "label", "dims", "vector", "cells"])

    return vectors.select("rid", "vec_id", "label", "embedding").mapInArrow(mapped, "rid bigint, vec_id bigint, label string, dims int, vector binary, cells array<int>")


def _component(vectors: DataFrame) -> str:
    return "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors of doubles; rows of zeros, or with a component that is no finite number, become NaN."""
    x = x.astype(float)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        odd = ~np.isfinite(norm) | (norm < 1e-140)  # components that leave the range of doubles when squared
        if odd.any():
            x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
            norm[odd] = np.sqrt((x[odd] * x[odd]).sum(axis=1))
        return x / norm[:, None]


def _near_pairs(x: np.ndarray, sides: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of pairs of unit vectors with a cosine of threshold at least, some at a time: all pairs i < j, or those from side to side.

    Single precision tells most pairs apart; those within its error of the threshold are decided by one and the same sum of
    doubles, whichever rows lie beside them.
    """
    small, slack = x.astype(np.float32), 1e-6 * (x.shape[1] + 10)
    above = np.arange(len(x)) if sides is None else np.flatnonzero(sides == sides.min())
    below = above if sides is None else np.flatnonzero(sides != sides.min())
    for start in range(0, len(below), TILE_ROWS):
        columns = below[start : start + TILE_ROWS]
        rows = above[: start + len(columns)] if sides is None else above
        cosine = small[rows] @ small[columns].T
        i, j = np.nonzero(cosine >= threshold - slack)
        sure = cosine[i, j] >= threshold + slack
        i, j = rows[i], columns[j]
        if sides is None:
            i, j, sure = i[i < j], j[i < j], sure[i < j]
        for k in range(0, len(i), PAIRS):
            a, b, good = i[k : k + PAIRS], j[k : k + PAIRS], sure[k : k + PAIRS].copy()
            open_ = ~good
            good[open_] = np.einsum("ij,ij->i", x[a[open_]], x[b[open_]]) >= threshold
            if good.any():
                yield a[good], b[good]


def _links_in_cell(cell: int, ids: np.ndarray, x: np.ndarray, sides: np.ndarray | None, threshold: float, cell_dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs of a cell's rows that link, those only that belong to this cell, some at a time.

    A pair belongs to the first block where it is within the budget, and there to the cell of its midpoint. Coordinates are
    summed row by row, so that every task finds the same ones for a vector.
    """
    dims = x.shape[1]
    turned = np.concatenate([(x[k : k + 256, None, :] * rotation(dims).T).sum(axis=2) for k in range(0, len(x), 256)])
    near2 = 2 - 2 * threshold + _SLACK
    parts, own = blocks_of(dims), cell >> BLOCK_DIMS
    low = slice(parts[own].start, parts[own].start + min(cell_dims, parts[own].stop - parts[own].start))
    weights = 1 << np.arange(low.stop - low.start)
    for i, j in _near_pairs(x, sides, threshold):
        for b, p in enumerate(parts[: own + 1]):
            within = ((turned[i, p] - turned[j, p]) ** 2).sum(axis=1) <= near2 * (p.stop - p.start) / dims
            keep = within if b == own else ~within
            i, j = i[keep], j[keep]
        middle = ((turned[i, low] + turned[j, low] > 0) * weights).sum(axis=1)
        mine = (middle == (cell & ((1 << BLOCK_DIMS) - 1))) & (ids[i] != ids[j])
        if mine.any():
            yield i[mine], j[mine]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row number that each of n rows reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _spelt_label(vectors: DataFrame) -> Column:
    """The label as a string, equal exactly where the labels are: numbers as they print in full, a negative zero as zero."""
    kind, label = vectors.schema["label"].dataType.typeName(), F.col("label")
    if kind in ("float", "double"):
        return (label + F.lit(0).cast(kind)).cast("string")
    return F.hex(label) if kind == "binary" else label.cast("string")


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Two vectors link when their labels, of any simple type, are equal and not null (NaN equals itself), their lengths are equal, and their cosine (in doubles) is
    threshold at least. n_links counts the links of a vector, component_id is the smallest vec_id that links reach,
    and kept is true for it. Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing.
    Links are counted where they are found, a cell or two blocks of one at a time, and never listed: a group
    of n equal vectors costs each task CELL_ROWS rows, and gives a row for each vector and task.
    The number of cells grows with the largest label, so that a cell's rows do not.
    A vec_id on rows with different vectors is one node: its rows get the links of all of them, none among themselves, and another vec_id
    that several of its vectors link with counts once (links of such ids are listed, to be told apart). A row with a null
    vec_id keeps its place with no links and a null component. Other columns are ignored; an empty table gives no rows.
    """
    kind = _component(vectors)
    told = vectors.where("vec_id is not null and label is not null and embedding is not null")
    rows = told.select("vec_id", _spelt_label(vectors).alias("label"), "embedding").distinct()
    most = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    cell_dims = int(min(BLOCK_DIMS - 1, max(0, np.ceil(np.log2(most / ROWS_FOR_EACH_CELL)))))
    found = checkpointed(_spread(rows.withColumn("rid", F.xxhash64("vec_id", "label", "embedding")), threshold, cell_dims))
    again = found.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("again"))
    keys = ["label", "dims", "cell"]
    dealt = dealt_in_blocks(found.select("label", "dims", F.explode("cells").alias("cell"), "rid", "vec_id"), keys, "rid", CELL_ROWS)
    group = [*keys, "lo", "hi"]
    wide = dealt.join(found.select("rid", "vec_id", "vector").join(again, "vec_id", "left"), ["rid", "vec_id"])
    sorted_rows = wide.repartition(*group).sortWithinPartitions(*group).select(*group, "blk", "vec_id", "vector", F.coalesce("again", F.lit(False)).alias("again"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "n", "root", "other"]
        for key, blk, ids, raw, again in grouped(batches, len(group)):
            x = unit_rows(np.frombuffer(b"".join(raw), kind).reshape(len(raw), key[1]))
            ids, again, n, stars = np.array(ids, np.int64), np.array(again, bool), np.zeros(len(ids), np.int64), []
            for i, j in _links_in_cell(key[2], ids, x, None if key[3] == key[4] else np.array(blk, np.int32), threshold, cell_dims):
                root = _roots(len(ids), i, j)
                at = np.flatnonzero(root != np.arange(len(ids)))
                stars.append((at, root[at]))
                told = again[i] | again[j]
                if told.any():
                    a, b = np.concatenate([ids[i[told]], ids[j[told]]]), np.concatenate([ids[j[told]], ids[i[told]]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), np.int64)), pa.array(np.minimum(a, b)), pa.array(b)], names)
                n += np.bincount(i[~told], minlength=len(ids)) + np.bincount(j[~told], minlength=len(ids))
            if stars:
                root = _roots(len(ids), *(np.concatenate(side) for side in zip(*stars, strict=True)))
                at = np.flatnonzero((n > 0) | (root != np.arange(len(ids))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(ids[root[at]]), pa.nulls(len(at), pa.int64())], names)

    links = checkpointed(sorted_rows.mapInArrow(linked, "vec_id bigint, n bigint, root bigint, other bigint"))
    counts = links.groupBy("vec_id").agg((F.sum("n") + F.countDistinct("other")).alias("n_links"))
    parts = connected_components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = vectors.select("vec_id").join(counts, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked within their labels at a cosine of 0.93."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"), 0.93)


_OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.c) AS component_id, min(r.c) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.n = e.vec_id GROUP BY e.vec_id
"""

QUERIES = {"op1_near_vectors": op1_near_vectors}
ORACLE_SQL = {"op1_near_vectors": _OP1_SQL}
