"""Sharding by Hilbert-curve ordering.

Several metadata dimensions are quantised, rows sorted by their index on the curve, and the order cut into runs
of equal counts, so that each shard spans a small box of every dimension and readers can prune by any of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datelore.llm.common import checkpointed, read_table

BITS = 5
_ROW_BITS = 33  # monotonically_increasing_id keeps the row of a partition in so many low bits


def curve_index(dims: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with coordinates below 2**bits, by Skilling's transform (2004)."""
    x = [np.array(d, np.int64) for d in dims]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in x:
            up = (d & q) != 0
            swap = np.where(up, 0, (x[0] ^ d) & low)
            flip = np.where(up, low, 0)
            first = x[0] ^ flip ^ swap
            d ^= swap
            x[0][:] = first if d is not x[0] else x[0] ^ flip
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for d in x:
            index = index << 1 | ((d ^ t) >> b & 1)
    return index


def _as_number(df: DataFrame, name: str) -> Column | None:
    """A double that keeps the order of a column of numbers, dates or times; none for other types."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal"):
        return F.col(name).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_timestamp(F.col(name).cast("timestamp")).cast("double")
    return None


def _text_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """At most cells - 1 values in order, each the least of its cell: of few different values each has a cell, of more the cells hold like shares of the rows.

    Rows are counted by value before anything moves; the values are sorted over tasks, and a count for each partition meets at the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(name).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = checkpointed(values.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).orderBy("part").collect()
    if sum(r.different for r in sums) <= cells:
        return sorted((r.v for r in placed.collect()), key=str.encode)[1:]  # cells values at most
    total, before, starts = sum(r.n for r in sums), 0, []
    for r in sums:
        starts.append((r.part, before))
        before += r.n
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "part int, first long"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = F.floor((F.col("first") + F.col("earlier")) * cells / total)
    found = placed.withColumn("earlier", earlier).join(first, "part").groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).collect()  # cells rows at most
    return sorted((r.v for r in found), key=str.encode)[1:]


def quantised(df: DataFrame, dims: list[str], bits: int, spread: bool = False) -> list[Column]:
    """Each dimension as an integer below 2**bits: the number of cuts below the value; null is 0. With spread, the numbers are spread evenly over the
    cells where a dimension has fewer cuts than these, so that few values (as of a language) differ in the highest bits, which the curve follows first.

    The cuts (2**bits - 1 values at most for each dimension) are quantiles of all rows: of numbers and times from one pass by mergeable
    sketches, of other types from the sorted different values of their whole text.
    """
    cells = 1 << bits
    numbers = {d: number for d in dims if (number := _as_number(df, d)) is not None}
    shares = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    cuts = df.agg(F.count(F.lit(1)), *[F.percentile_approx(x, shares, 1000).alias(f"_{k}") for k, x in enumerate(numbers.values())]).first()
    of_number = dict(zip(numbers, cuts[1:], strict=True))
    out = []
    for d in dims:
        if d in numbers:
            above = [F.when(numbers[d] > F.lit(e), 1).otherwise(0) for e in sorted(set(of_number[d] or []))]
        else:
            above = [F.when(F.col(d).cast("string") >= F.lit(e), 1).otherwise(0) for e in _text_cuts(df, d, cells)]
        cell = F.coalesce(sum(above, F.lit(0)), F.lit(0))
        out.append((F.floor(cell * cells / (len(above) + 1)) if spread else cell).cast("int"))
    return out


def hilbert_shards(rows: DataFrame, dims: list[str], ties: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """rows with curve (their index), shard (0 to shards - 1) and slot (place in the shard, gapless from 0).

    Rows are sorted by (curve, *ties), nulls first, and cut into runs whose counts differ by one at most. The sort
    is a range partitioning on all of the keys, so a hot cell spreads over tasks as far as ties tell its rows apart;
    the order is written to the shared checkpoint folder, and the only thing that meets in one place is a count for
    each partition. rows should hold slim columns only. Rows equal in all keys get neighbouring places in any order;
    an empty table gives no rows; columns of rows called curve, shard or slot are replaced.
    """
    rows = rows.drop("curve", "shard", "slot")

    @F.pandas_udf("long")
    def index_of(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(curve_index([cells[c].to_numpy() for c in cells], bits))

    cells = quantised(rows, dims, bits, spread=True)
    keyed = rows.withColumn("curve", index_of(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(cells)])))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        keyed.repartitionByRange(parts, "curve", *ties).sortWithinPartitions("curve", *ties).withColumn("_at", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one row for each partition
    total, before, starts = sum(r.n for r in counts), 0, []
    for r in counts:
        starts.append((r._part, before))
        before += r.n
    first = rows.sparkSession.createDataFrame(starts, "_part long, _first long")
    ranked = placed.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("_rank", F.col("_first") + row)
    return (
        ranked.withColumn("shard", F.expr(f"cast((_rank * {shards}) div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"_rank - (cast(shard as bigint) * {total} + {shards} - 1) div {shards}"))
        .drop("_part", "_first", "_rank", "_at")
    )


def write_shards(rows: DataFrame, path: str, ties: list[str]) -> None:
    """rows of hilbert_shards as Parquet, one folder a shard. Tasks take runs of the curve, so a shard of any size is several files, each of a small box."""
    order = ["shard", "curve", *ties]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, along a curve through language, source and size.

    Equal texts of one language and source share a cell and, tied by their checksum, lie side by side.
    """
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    return hilbert_shards(docs, ["lang", "source", "size"], ["text_crc32", "doc_id"], 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


QUERIES = {"op3_hilbert_shards": op3_hilbert_shards}
