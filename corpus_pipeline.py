"""A corpus from raw documents to token ids, in stages that are each written and read again.

Every stage takes what its predecessor kept and judges whole texts. ORACLE_SQL is None: models, joins by
exact shingle sets and byte pairs have no SQL form, so tests/llm compares the result with the plain rules.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.llm import bpe, decontaminate, jaccard, language, toxicity
from datelore.llm.common import discard_since, files_so_far, read_table, written, written_path

#: A text whose best language has no more than this share of the evidence is in none that the model knows.
LEAST_LANGUAGE_SCORE = 0.3
#: Pre-tokens remembered by a task of the last stage: fewer than for encoding alone, as its workers have served the stages before.
MEMO_ENTRIES = 200_000


def _packed(docs: DataFrame) -> DataFrame:
    """text, and the other columns in one, so that no column of an operator can meet one of theirs."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("kept"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, by a model of the labelled ones among them.

    A null or empty text has no toxic passage and stays; repeated rows are judged alike; an empty table stays empty, and without
    labelled documents of both kinds all stay. All columns pass through as they are, whatever they are called.
    """
    model = toxicity.fit_documents(docs, read_table(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score_toxicity(_packed(docs), model).where("score < 0.5"), docs)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach; texts without letters or without evidence go.

    Null and empty texts have no letter and go; repeated rows are judged alike; a document whose own lang is null is judged like
    any other; where no document has a lang, none stays. All columns pass through as they are.
    """
    found = language.identify(_packed(docs), language.fit_documents(docs))
    return _unpacked(found.where((F.col("lang_pred") != "und") & (F.col("score") > LEAST_LANGUAGE_SCORE)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal and near texts, the one with the smallest doc_id.

    Rows that repeat a doc_id with the same set of shingles are one document: that whose columns come first as JSON stays. Rows without a doc_id, for
    which no other can stand, stay too, and so do null, empty and wordless texts of different doc_ids. All columns pass through as they are.
    """
    found = written(jaccard.near_documents(docs.select("doc_id", "text")))
    kept = docs.join(found.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        told = jaccard.with_shingle_set(_packed(kept), "text", "shingles")
        alike = F.coalesce("shingles", F.col("text").cast("binary"))
        row = F.struct("text", "kept")
        same = told.withColumns({"shingles": alike, "doc_id": F.col("kept.doc_id")}).groupBy("doc_id", "shingles")
        kept = _unpacked(same.agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"), docs)
    return kept.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold test passages in a twentieth of their words.

    Null, empty and wordless texts hold none and stay; repeated rows are judged alike; an empty benchmark drops nothing.
    All columns pass through as they are.
    """
    found = decontaminate.mark_contamination(_packed(docs), read_table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(~decontaminate.is_contaminated()), docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every text, and whether they decode to it.

    A null or empty text has no tokens; each row has its own result; of the columns of docs, doc_id, lang and source stay.
    """
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs.select("doc_id", "lang", "source", "text")
    ids = bpe.decode_documents(bpe.encode_documents(docs, path, tokenizers.PATTERN, memo_entries=MEMO_ENTRIES), path)
    return ids.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again; what only earlier stages read is removed once a result is written."""
    docs, mark = read_table(spark, sf_dir, "documents"), files_so_far()
    for _, stage in STAGES[:-1]:
        path = written_path(stage(spark, docs, sf_dir))
        discard_since(spark, mark, path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
