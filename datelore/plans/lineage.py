"""Cutting lineage and numbering rows over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset, as in tests, one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """df with the place of each row (from 1) in the order of the whole table.

    A window without partitions would bring all rows to one task. Here the rows are range-partitioned by the order, and only a count
    for each partition meets in one place. order should end in a key, or equal rows get places in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each partition
        starts.append((r["part"], before))
        before += r["count"]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _first long"))
    return (
        placed.withColumn("_part", part).join(first, "_part")
        .withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_first")
    )
