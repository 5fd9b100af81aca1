"""Language ID by word-first backoff.

Known words are scored by their log frequency in each language; an unseen word falls back to its character
n-grams, the longest that the model knows first. The model is counted by Spark over a bounded sample of labelled
rows and keeps every word and n-gram counted there; scoring happens where the rows lie.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from datelore.llm.common import read_table, with_columns_from

#: Labelled rows that a model is fitted on, about; more labelled rows are thinned by a hash of their text. It bounds the model.
FIT_ROWS = 20_000
#: Lengths of n-grams in characters, in the order they are tried. A word is framed by spaces.
LENGTHS = (6, 5, 4, 3, 2, 1)
#: Weight of one n-gram against one known word.
GRAM_WEIGHT = 0.5
#: Words whose numbers a task remembers, about: a cache, which is emptied between texts when full.
REMEMBERED = 100_000

_WORD = r"\p{L}+"
_HAS_LETTER = regex.compile(r"\p{L}")
_SPLIT = regex.compile(_WORD)
_SEED = 42  # of Spark's xxhash64


class Table:
    """Rows of numbers by a string's 64-bit hash: sorted keys beside a matrix, a few bytes for each entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which of the items the table has, their rows)."""
        if not len(self.keys) or not items:
            return np.zeros(len(items), bool), self.values[:0]
        wanted = np.fromiter((xxh64_intdigest(x.encode("utf-8", "surrogatepass"), _SEED) for x in items), np.uint64, len(items))
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == wanted
        return known, self.values[at[known]]


class Model:
    """Log frequencies: words and n-grams as one number for each language, relative to their mean over the languages."""

    def __init__(self, langs: list[str], words: Table, grams: Table):
        self.langs, self.words, self.grams = langs, words, grams
        self._seen: dict[str, list[float]] = {}

    def learn(self, words: list[str]) -> None:
        """Remembers the numbers of words: a known word's own; of an unseen one, the sum over its n-grams of the first length of which any is known."""
        known, rows = self.words.find(words)
        self._seen.update(zip((w for w, k in zip(words, known.tolist(), strict=True) if k), rows.tolist(), strict=True))
        left = [w for w, k in zip(words, known.tolist(), strict=True) if not k]
        for n in LENGTHS:
            if not left:
                return
            grams = [[f" {w} "[k : k + n] for k in range(len(w) + 3 - n)] for w in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            known, rows = self.grams.find([g for of_word in grams for g in of_word])
            total = np.zeros((len(left), len(self.langs)))
            np.add.at(total, owner[known], rows)
            found = np.zeros(len(left), bool)
            found[owner[known]] = True
            self._seen.update((left[k], (GRAM_WEIGHT * total[k]).tolist()) for k in np.flatnonzero(found).tolist())
            left = [w for w, f in zip(left, found.tolist(), strict=True) if not f]
        self._seen.update((w, [0.0] * len(self.langs)) for w in left)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): und and 0 without a letter (or a language to choose), else the best and its share of the mean evidence, 0 to 1."""
        if not text or not self.langs or not _HAS_LETTER.search(text):
            return "und", 0.0
        counts = Counter(_SPLIT.findall(text.lower()))
        if len(self._seen) >= REMEMBERED:
            self._seen.clear()
        seen, total, words = self._seen, [0.0] * len(self.langs), 0
        if new := [w for w in counts if w not in seen]:
            self.learn(new)
        for word, n in counts.items():
            words += n
            for k, x in enumerate(seen[word]):
                total[k] += n * x
        # the evidence of a word, on average, counted at most ten times: long texts do not all end up at exactly 1
        scale = min(words, 10) / max(words, 1)
        best = max(total)
        odds = [math.exp((x - best) * scale) for x in total]
        return self.langs[total.index(best)], 1.0 / sum(odds)


def _bounded(rows: DataFrame, key: Column, fit_rows: int) -> DataFrame:
    """rows, thinned by a hash to about fit_rows where there are more; key has to tell rows apart, as rows of one key stay or go together."""
    n = rows.count()
    return rows if n <= fit_rows else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))


def log_frequencies(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Counts (items by languages) as logarithms of their frequencies, half a count added to each, less their mean over the languages."""
    logs = np.log((counts + 0.5) / (totals + 1.0))
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def _gathered(counts: DataFrame, item: str, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, lengths in characters, counts by language) of a table of counts, in Arrow: one entry for each item of the sample."""
    found = counts.select(F.xxhash64(item).alias("key"), F.length(item).alias("size"), *[F.col(f"n{k}").cast("double") for k in range(n_langs)]).toArrow()
    column = lambda name: found.column(name).to_numpy()
    return column("key").view(np.uint64), column("size"), np.column_stack([column(f"n{k}") for k in range(n_langs)])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, id_col: str | None = None) -> Model:
    """A model of (text, lang) rows; rows with a null text or lang teach nothing, and without rows it knows no language.

    Where there are more than fit_rows, a hash of text and id (where id_col names one) picks those that teach, so that copies of one text are thinned like other rows.
    Words and n-grams are counted by Spark, and all of them are kept: fit_rows bounds what comes to the driver and is sent to
    the tasks, some tens of bytes for each different word and n-gram of that many texts.
    """
    rows = _bounded(labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.col(id_col) if id_col else F.lit(None)).alias("id")), F.xxhash64("id", "text"), fit_rows)
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    none = Table(np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))
    if not langs:
        return Model([], none, none)
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("word")
    names = [f"n{k}" for k in range(len(langs))]
    counts = rows.select("lang", word).groupBy("word").agg(*[F.count_if(F.col("lang") == lang).alias(n) for n, lang in zip(names, langs, strict=True)]).persist()
    keys, _, seen = _gathered(counts, "word", len(langs))
    words = Table(keys, log_frequencies(seen, seen.sum(axis=0)))
    # n-grams weigh each word by the logarithm of its count: they stand for words not seen yet, not for the frequent ones
    framed = counts.select(F.concat(F.lit(" "), F.col("word"), F.lit(" ")).alias("w"), *[F.log2(F.col(n) + 1.0).alias(n) for n in names])
    starts = lambda n: F.when(F.length("w") >= n, F.sequence(F.lit(1), F.length("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
    cut = lambda n: F.transform(starts(n), lambda p: F.substr("w", p, F.lit(n)))
    pieces = F.flatten(F.array(*[cut(n) for n in LENGTHS]))
    keys, sizes, seen = _gathered(
        framed.select(F.explode(pieces).alias("gram"), *names).where("gram <> ' '").groupBy("gram").agg(*[F.sum(n).alias(n) for n in names]), "gram", len(langs)
    )
    counts.unpersist()
    values = np.zeros(seen.shape, np.float32)
    for n in LENGTHS:
        of_size = sizes == n
        values[of_size] = log_frequencies(seen[of_size], seen[of_size].sum(axis=0))
    return Model(langs, words, Table(keys, values))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. und (and 0) for null and empty texts and such without a letter; ties go to the language first in the alphabet.

    Rows are judged one by one on their whole text, so equal texts get equal results, repeated rows and other columns
    pass through, and columns called lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))  # bounded by the rows that it was fitted on

    def make():
        return Model(*shared.value).predict

    return with_columns_from(docs, text_col, "lang_pred string, score double", make)


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves fold when divided by folds; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """A model of the rows of documents that the contract lets it learn from."""
    return fit(docs.where(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"), id_col="doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, judged by its text alone."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
