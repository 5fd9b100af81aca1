"""What several operators of this subpackage share: words, lineage cuts, and bounded work on hot groups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of the contracts: everything but ASCII characters that are no digit and no small letter, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows of a batch that are worked on at a time.
BATCH_ROWS = 500

# UTF-8 bytes to UTF-8 bytes: A-Z in small letters, every other ASCII byte that no word holds becomes a space.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes; none for null. Bytes of 128 and more never separate words."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def _shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset, as in local tests, one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: The folders that this driver has written and not removed.
_WRITTEN: list[str] = []


def written_path(df: DataFrame) -> str:
    """The new folder in the shared one to which df was written as Parquet."""
    path = f"{_shared_folder(df.sparkSession)}/stage-{uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return path


def files_so_far() -> int:
    """A mark for discard_since."""
    return len(_WRITTEN)


def discard_since(spark: SparkSession, mark: int, keep: str) -> None:
    """Removes all folders written since a mark but one, and forgets them: for callers whose result no longer reads them."""
    for path in _WRITTEN[mark:]:
        if path != keep:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN[mark:] = [p for p in _WRITTEN[mark:] if p == keep]


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to a new folder in the shared one, and read again."""
    return df.sparkSession.read.parquet(written_path(df))


def discard(df: DataFrame) -> None:
    """Removes the files of a result of written() that nothing reads any more; files elsewhere stay."""
    spark, own = df.sparkSession, f"{_shared_folder(df.sparkSession)}/stage-"
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if "/stage-" in name and path.getName() == name.rsplit("/", 1)[1] and path.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(own).getParent().toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns the memory that a task's caches and batches held: a worker process outlives its tasks and serves other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def with_columns_from(docs: DataFrame, text_col: str, ddl: str, make: Callable[[], Callable[[object], tuple]]) -> DataFrame:
    """docs and the columns of ddl, computed row by row from text_col in Arrow batches where the rows lie.

    make runs once in each task and returns the function from a value of text_col to the new values. Columns of
    docs that bear a new name are replaced.
    """
    new = StructType.fromDDL(ddl)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new.names or c == text_col])
    kept = [c for c in docs.columns if c not in new.names]
    place, schema = docs.columns.index(text_col), StructType([*(docs.schema[c] for c in kept), *new.fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        of, arrow = make(), to_arrow_schema(new)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH_ROWS):  # small results: what waits to be sent is bounded by rows
                    part = batch.slice(start, BATCH_ROWS)
                    columns = zip(*[of(x.as_py()) for x in part.column(place)], strict=True)
                    made = [pa.array(list(column), field.type) for column, field in zip(columns, arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.names.index(c)) for c in kept), *made], [*kept, *new.names])
        finally:
            of = None
            give_back()

    return docs.mapInArrow(mapped, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_in_blocks(rows: DataFrame, keys: list[str], id_col: str, block_rows: int, bytes_col: str | None = None, block_bytes: int = 1) -> DataFrame:
    """rows of groups of two and more, dealt so that no task holds more than two blocks of a group.

    A group of n rows is cut by the hash of id_col into k = ceil(n / block_rows) blocks, or into as many as its rows' bytes_col
    fills with block_bytes each, where that is more; each row goes to the
    k pairs (lo, hi) of blocks that hold its own (blk), so every pair of rows of the group meets exactly once
    under (keys, lo, hi): within a block where lo = hi, else across the two. Groups of one row are left out,
    as nothing meets there.
    """
    total = F.sum(bytes_col) if bytes_col else F.lit(0)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), total.alias("_bytes")).where("_n > 1")
    # more blocks than rows would only copy them
    k = F.greatest(F.ceil(F.col("_n") / F.lit(block_rows)), F.least("_n", F.ceil(F.col("_bytes") / F.lit(block_bytes)))).cast("int")
    return (
        rows.join(sizes, keys)
        .withColumn("_k", k)
        .withColumn("blk", F.when(F.col("_k") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(id_col), F.col("_k"))).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("lo", F.least("blk", "_other"))
        .withColumn("hi", F.greatest("blk", "_other"))
        .drop("_n", "_bytes", "_k", "_other")
    )


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple]:
    """(key, *columns as lists) for each run of rows that agree in the first n_keys columns, over batch bounds; one group is held at a time."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*columns[:n_keys], strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                piece = [c[start:k] for c in columns[n_keys:]]
                if keys[start] == key:
                    for a, b in zip(held, piece, strict=True):
                        a.extend(b)
                else:
                    if key is not None:
                        yield key, *held
                    key, held = keys[start], piece
                start = k
    if key is not None:
        yield key, *held
