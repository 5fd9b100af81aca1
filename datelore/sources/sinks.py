"""Sinks that never show half of what they write: data first, a manifest named by its batch next, and for versioned tables one pointer last.

Each step is a single new name in the folder, so it is there or not. A batch, or a version, that is written again changes nothing once its manifest stands; without
one it is an attempt that ended early, which nobody reads and the next attempt replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.sources.files import ExpectationError, content_id, expect

#: What runs between the steps of a write, with the name of the step that is done ("data", "manifest"): for tests of what a reader sees there.
Between = Callable[[str], None]


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def _mark(spark: SparkSession, path: str) -> bool:
    """A new empty file, whose name says all: the one step that makes a write visible. False where it is there already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    return files.createNewFile(place)


def append_batch(rows: DataFrame, path: str, batch: int | str, between: Between = lambda step: None) -> bool:
    """Appends rows to the log at path as a batch; false, and nothing is written, where that batch is there already. For foreachBatch, and for any write with an id."""
    spark = rows.sparkSession
    if str(batch) in _names(spark, f"{path}/manifests"):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/data/{batch}")
    between("data")
    return _mark(spark, f"{path}/manifests/{batch}")


def append_new(rows: DataFrame, path: str, key: str, batch: int | str, between: Between = lambda step: None) -> bool:
    """append_batch of those rows whose key (an extraction, a receipt) no other batch of the log holds."""
    known = read_log(rows.sparkSession, path, rows.schema.simpleString(), rows)
    return append_batch(rows.join(known.select(key).distinct(), key, "left_anti").select(*rows.columns), path, batch, between)


def read_log(spark: SparkSession, path: str, schema: str = "", like: DataFrame | None = None) -> DataFrame:
    """All rows of the batches that have a manifest. An empty log has the schema of like."""
    batches = _names(spark, f"{path}/manifests")
    if not batches:
        if like is None:
            raise ExpectationError(f"no batch in {path}")
        return spark.createDataFrame([], like.schema)
    return spark.read.parquet(*[f"{path}/data/{b}" for b in batches])


def publish(tables: dict[str, DataFrame], path: str, checks: dict[str, dict[str, Column]] | None = None, between: Between = lambda step: None) -> str:
    """Makes tables the current version at path and returns its id, which follows from their contents.

    The written tables are read back: they have to have the contents that the id stands for, and to meet the checks (by table, aggregate conditions by name), before the manifest
    and then the pointer are set. A version that is there already is not written again, but becomes the current one.
    """
    spark = next(iter(tables.values())).sparkSession
    ids = {name: content_id(df) for name, df in sorted(tables.items())}
    version = spark.range(1).select(F.sha2(F.lit(str(sorted(ids.items()))), 256)).first()[0]
    if version not in _names(spark, f"{path}/manifests"):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/data/{version}/{name}")
        between("data")
        for name, df in _tables(spark, path, version).items():
            if content_id(df) != ids[name]:
                raise ExpectationError(f"{name} is not what was to be written")
            expect(df, **(checks or {}).get(name, {"any": F.lit(True)}))
        _mark(spark, f"{path}/manifests/{version}")
        between("manifest")
    number, now = _current(spark, path)
    if now != version:
        _mark(spark, f"{path}/pointers/{number + 1:012d}-{version}")
    return version


def _current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    last = _names(spark, f"{path}/pointers")[-1:]
    return (int(last[0].split("-")[0]), last[0].split("-")[1]) if last else (0, None)


def _tables(spark: SparkSession, path: str, version: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/data/{version}/{name}") for name in _names(spark, f"{path}/data/{version}")}


def read_current(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current version; an error where there is none."""
    version = _current(spark, path)[1]
    if version is None:
        raise ExpectationError(f"nothing is published in {path}")
    return _tables(spark, path, version)


def reconstructs(predicted: str, *parts: str, tolerance: float = 1e-8) -> Column:
    """An aggregate condition: in every row the parts add up to what was predicted."""
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    return F.coalesce(F.bool_and(F.abs(total - F.col(predicted)) <= F.greatest(F.lit(tolerance), 1e-9 * F.abs(F.col(predicted)))), F.lit(True))
