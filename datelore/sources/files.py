"""Scans of landed files with strict schemas, and content-addressed, verified sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LABELS = (
    "company_cik string, target_name string, assessment_cycle string, prediction_as_of date, score double, label_published_at date, source_name string, "
    "source_url string, source_date date, source_sha256 string, authorization_reference string"
)
_FACT = "struct<start:date,end:date,val:double,filed:date,accn:string,form:string,fp:string>"


class ExpectationError(ValueError):
    """What a scan expects of its input does not hold."""


def expect(df: DataFrame, **checks: Column) -> DataFrame:
    """df, if every check (an aggregate condition) holds; all are computed in one pass."""
    found = df.agg(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()]).first()
    failed = [name for name in checks if not found[name]]
    if failed:
        raise ExpectationError(", ".join(failed))
    return df


def unique(*columns: str) -> Column:
    return F.count(F.lit(1)) == F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV file whose header is exactly the template's; ids are padded, blank rows skipped, and a (company, cycle, date, target) may not repeat."""
    schema = StructType.fromDDL(LABELS)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    rows = rows.dropna(how="all").withColumn("company_cik", F.lpad(F.trim("company_cik"), 10, "0"))
    return expect(rows, unique_labels=unique("company_cik", "assessment_cycle", "prediction_as_of", "target_name"), scores_in_range=F.coalesce(F.min("score") >= 0, F.lit(True)) & F.coalesce(F.max("score") <= 100, F.lit(True)))


def read_filing_facts(spark: SparkSession, path: str, today: str) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected) of nested filing JSON: facts.us-gaap.<concept>.units.USD[] with a row for each fact; facts that start after their end, or end or were filed after today, are rejected."""
    schema = f"cik string, facts struct<`us-gaap`:map<string,struct<units:map<string,array<{_FACT}>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("cik", F.explode("facts.us-gaap").alias("concept", "body"))
    rows = rows.select("cik", "concept", F.explode(F.element_at("body.units", "USD")).alias("f")).select("cik", "concept", "f.*")
    day = F.lit(today).cast("date")
    bad = F.when(F.col("start") > F.col("end"), "starts_after_end").when((F.col("end") > day) | (F.col("filed") > day), "in_future").when(F.col("val").isNull(), "no_value")
    marked = rows.withColumn("reason", bad)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def read_parallel_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each place of several arrays of equal length; arrays of unequal length are an error."""
    same = F.min(F.coalesce(F.array_size(columns[0]), F.lit(0)) == F.least(*[F.coalesce(F.array_size(c), F.lit(0)) for c in columns])) & F.min(F.coalesce(F.array_size(columns[0]), F.lit(0)) == F.greatest(*[F.coalesce(F.array_size(c), F.lit(0)) for c in columns]))
    others = [c for c in df.columns if c not in columns]
    return expect(df, equal_lengths=F.coalesce(same, F.lit(True))).select(*others, F.inline(F.arrays_zip(*columns)))


def sniffed(files: DataFrame) -> DataFrame:
    """files (path, content) with format, by signature, then extension; unknown where neither tells."""
    head = F.hex(F.substring("content", 1, 4))
    text = F.ltrim(F.lower(F.substring("content", 1, 64).try_cast("string")))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = (
        F.when(head == "25504446", "pdf").when(head == "504B0304", "zip").when(F.startswith(head, F.lit("50415231")), "parquet").when(text.rlike(r"^(<!doctype html|<html)"), "html")
        .when(F.startswith(text, F.lit("<?xml")), "xml").when(text.rlike(r"^[\[{]"), "json").when(ext.isin("csv", "txt", "json", "html", "xml"), ext).otherwise("unknown")
    )
    return files.withColumn("format", kind)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Files by content: (sha256, shard, n_bytes, content), equal files once; shard is a folder for writing."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("sha256", F.sha2("content", 256))
    once = files.groupBy("sha256").agg(F.min("path").alias("path"), F.first("content").alias("content"))
    return once.select("sha256", F.substring("sha256", 1, 2).alias("shard"), F.length("content").alias("n_bytes"), "path", "content")


def content_id(df: DataFrame) -> tuple[str, int]:
    """(id, rows) of a table's content, the same however its rows are ordered or partitioned: sums of row hashes, hashed with the schema."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    a, b, c, n = df.agg(part(0), part(1), part(2), F.count(F.lit(1))).first()
    told = df.sparkSession.range(1).select(F.sha2(F.lit(f"{sorted(df.dtypes)}|{a}|{b}|{c}|{n}"), 256)).first()[0]
    return told, n


def write_snapshot(tables: dict[str, DataFrame], path: str) -> str:
    """Writes tables and a manifest (name, id, rows) below path/<id>, and returns the id; an equal snapshot that is there already is left alone.

    The manifest is written last: a folder without one is an attempt that did not finish, and its tables are written anew.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, *content_id(df)) for name, df in sorted(tables.items())]
    manifest = spark.createDataFrame(rows, "name string, id string, n long")
    snapshot = content_id(manifest)[0]
    try:
        spark.read.parquet(f"{path}/{snapshot}/manifest").first()
        return snapshot
    except Exception as error:  # noqa: BLE001  the class differs between file systems
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{snapshot}/{name}")
    manifest.write.mode("overwrite").parquet(f"{path}/{snapshot}/manifest")
    return snapshot


def read_snapshot(spark: SparkSession, path: str, snapshot: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, after their contents have been compared with the manifest."""
    tables = {}
    for r in spark.read.parquet(f"{path}/{snapshot}/manifest").collect():  # one row for each table
        tables[r["name"]] = df = spark.read.parquet(f"{path}/{snapshot}/{r['name']}")
        if content_id(df) != (r["id"], r["n"]):
            raise ExpectationError(f"{r['name']} is not what its manifest says")
    return tables
