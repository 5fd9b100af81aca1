"""The registered queries on the smallest tables, against their SQL or plain rules, and the pipeline against its stages' rules."""

import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from datelore.llm import decontaminate, language, registry, toxicity
from datelore.llm.common import words_of
from tests.compare import by_duckdb, rows


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(by_duckdb(registry.ORACLE_SQL[name], sf_dir))


def test_shards_of_documents(spark, sf_dir, documents):
    got = registry.QUERIES["op3_hilbert_shards"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(documents)
    for r in documents.itertuples():
        assert got.loc[r.doc_id, "size"] == len(r.text.encode()) + 16 and got.loc[r.doc_id, "text_crc32"] == zlib.crc32(r.text.encode())
    counts = got.groupby("shard").size()
    assert sorted(counts.index) == list(range(40)) and counts.max() - counts.min() <= 1


def test_language_of_held_out(spark, sf_dir, documents):
    got = registry.QUERIES["op4_language_id"](spark, sf_dir).toPandas().merge(documents)
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.98


def test_toxicity_of_held_out(spark, documents):
    sf_dir = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    got = registry.QUERIES["op5_toxicity"](spark, sf_dir).toPandas().merge(labels)
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.93


def test_license_words(spark, sf_dir, documents):
    got = registry.QUERIES["op8_license_scan"](spark, sf_dir).toPandas().set_index("doc_id")
    for r in documents.itertuples():
        words, places = words_of(r.text), []
        for phrase in (b"mit license", b"apache license", b"general public license"):
            p = phrase.split()
            places += [k for k in range(len(words)) if words[k : k + len(p)] == p]
        row = got.loc[r.doc_id]
        assert row.n_words == len(words) and row.n_base == len(places)
        assert (row.first_word, row.last_word) == (min(places), max(places)) if places else pd.isna(row.first_word)


def test_pipeline(spark, sf_dir, documents):
    """Every stage's rule restated over what the stage before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    frame, kept = documents, docs
    model = toxicity.fit_documents(kept, labels)
    frame = frame[[model.score(t)[0] < 0.5 for t in frame.text]]
    kept = docs.where(F.col("doc_id").isin(frame.doc_id.tolist()))
    model = language.fit_documents(kept)
    told = [model.predict(t) for t in frame.text]
    frame = frame[[lang != "und" and score > corpus_pipeline.LEAST_LANGUAGE_SCORE for lang, score in told]]
    sets = {}
    for r in frame.itertuples():
        w = words_of(r.text)
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    frame = frame[[find(k) == k for k in frame.doc_id]]
    items = [(str(r.item_id), r.text) for r in pd.read_parquet(f"{sf_dir}/benchmark.parquet").itertuples()]
    automaton = decontaminate.Windows(items, 13)
    clean = []
    for t in frame.text:
        words, hit, _ = decontaminate.scan(t, automaton)
        clean.append(not (hit.sum() and 20 * hit.sum() >= len(words)))
    frame = frame[clean]
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(got.doc_id) == sorted(frame.doc_id)
    assert got.round_trip.all() and 0 < len(got) < len(documents)
