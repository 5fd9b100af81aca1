"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and clean texts come from counts with an informative Dirichlet prior. A linear scan
finds every maximal run of tokens whose log-odds, less a fixed cost a token, add up to more than chance explains; extreme-
value statistics (Karlin and Altschul) turn the sums into bits that texts of any length share, and their total into a score.
"""

from __future__ import annotations

import math

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.llm.common import read_table, with_columns_from
from datelore.llm.language import held_out

#: Labelled rows that a model is fitted on, about; more are thinned by a hash of their id. It bounds the broadcast of their labels.
FIT_ROWS = 30_000
#: Labelled texts that must hold a word for its own odds to be used; rarer words fall back to prefixes.
KNOWN = 5
#: Lengths of the prefixes that an unknown word falls back to, the longest first: shorter ones than three letters are shared by unrelated
#: words, and longer ones than eight are hardly shared by words that are not known themselves.
PREFIXES = (8, 7, 6, 5, 4, 3)
#: Weight of the prior, in tokens of the background distribution.
PRIOR = 2000.0
#: Standard errors that log-odds must differ from none by to count; other tokens score 0.
TELLING = 1.5
#: What a token costs a segment.
COST = 0.6
#: Chance findings expected in one text up to which a segment is significant.
EXPECTED = 0.05

_TOKEN = r"\p{L}+"
_TOKENS = regex.compile(_TOKEN)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, sum), in time linear in the scores (Ruzzo and Tompa, 1999).

    Every candidate remembers the nearest one before it with a smaller sum to its left (lower). Candidates in between cannot
    start a longer segment for any later token, so they are never looked at again: each token passes over a candidate once.
    """
    first, last, left, right, lower = [], [], [], [], []
    total = 0.0
    for k, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, j = k, len(first) - 1
        while j >= 0 and left[j] >= before:
            j = lower[j]
        while j >= 0 and right[j] < total:  # a candidate and the token reach further together: they become one
            start, before = first[j], left[j]
            below = lower[j]
            for held in (first, last, left, right, lower):
                del held[j:]
            j = below
        for held, value in ((first, start), (last, k), (left, before), (right, total), (lower, j)):
            held.append(value)
    return [(a, b, r - l) for a, b, l, r in zip(first, last, left, right, strict=True)]


class Model:
    """Token scores, the constants of the extreme-value law, and the calibration from bits to a score."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], scale: float = 1.0, size: float = 1.0, curve: tuple[float, float] = (-1.0, 1.0)):
        self.words, self.prefixes, self.scale, self.size, self.curve = words, prefixes, scale, size, curve
        self._seen: dict[str, float] = {}

    def token(self, word: str) -> float:
        x = self.words.get(word)
        if x is None and (x := self._seen.get(word)) is None:
            x = next((p for n in PREFIXES if len(word) >= n and (p := self.prefixes.get(word[:n])) is not None), 0.0)
            if len(self._seen) >= 100_000:
                self._seen.clear()
            self._seen[word] = x
        return x

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int, float]]]:
        """(tokens, maximal segments as (first token, last token, start, end, sum)); offsets are characters of text."""
        if not text:
            return 0, []
        tokens = _TOKENS.findall(text.lower())
        raw = [self.token(t) for t in tokens]
        if not any(x > COST for x in raw):
            return len(tokens), []
        found = maximal_segments([x - COST for x in raw])
        places = [m.span() for m in _TOKENS.finditer(text)] if text.lower().__len__() == len(text) else None
        return len(tokens), [(a, b, *((places[a][0], places[b][1]) if places and len(places) == len(tokens) else (-1, -1)), s) for a, b, s in found]

    def evidence(self, tokens: int, segments: list[tuple[int, int, int, int, float]]) -> tuple[float, list]:
        """(bits of all significant segments, those segments): bits of a segment are minus the logarithm of the chance findings expected of its sum."""
        room = math.log(max(tokens, 1) * self.size)
        bits = [self.scale * s[4] - room for s in segments]
        kept = [(*s, b) for s, b in zip(segments, bits, strict=True) if b >= -math.log(EXPECTED)]
        return sum(s[5] for s in kept) or max(bits, default=-room), kept

    def score(self, text: str | None) -> tuple[float, list]:
        """(score from 0 to 1, significant segments)."""
        bits, kept = self.evidence(*self.segments(text))
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, a + b * math.copysign(math.log1p(abs(bits)), bits))))), kept


def _log_odds(y1: np.ndarray, y0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of class 1 against class 0, their z) of tokens, under a Dirichlet prior in proportion to the tokens' counts in both."""
    n1, n0 = y1.sum(), y0.sum()
    prior = PRIOR * (y1 + y0) / max(n1 + n0, 1.0) + 0.01
    total = prior.sum()
    odds = np.log((y1 + prior) / (n1 + total - y1 - prior)) - np.log((y0 + prior) / (n0 + total - y0 - prior))
    return odds, odds / np.sqrt(1.0 / (y1 + prior) + 1.0 / (y0 + prior))


def _scores(rows: list, name: str, n1: float, n0: float, rest: tuple[float, float]) -> dict[str, float]:
    """Scores of rows (name, toxic, clean); rest are the counts of what rows leaves out, so that totals hold."""
    if not rows:
        return {}
    y1, y0 = (np.array([*(float(r[c]) for r in rows), x]) for c, x in (("toxic", max(n1, rest[0])), ("clean", max(n0, rest[1]))))
    odds, z = _log_odds(y1, y0)
    return {r[name]: round(float(x), 4) if abs(s) >= TELLING else 0.0 for r, x, s in zip(rows, odds, z, strict=False)}


def _scale_of(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(root * values)) = 1: the decay of chance sums; 1 where there is none."""
    weights = weights / weights.sum()
    if values.max() <= 0 or (weights * values).sum() >= 0:
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if (weights * np.exp(np.minimum(mid * values, 600.0))).sum() > 1 else (mid, high)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge; labels a little softened, so that separable data stay finite."""
    y = y * 0.998 + 0.001
    w, design = np.zeros(2), np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of the texts of docs (doc_id, text) that labels (doc_id, toxic) judges; fit_rows of them at most, about.

    Labels that are null or have no document teach nothing; a document judged both ways counts as toxic. Without labelled
    texts of both classes every score is below one half.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    rows = docs.where("text is not null").join(F.broadcast(known), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0)))).alias("word")
    counts = rows.select("toxic", word).groupBy("word").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).persist()
    n1, n0 = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n1 or not n0:
        counts.unpersist()
        return Model({}, {}, curve=(-5.0, 0.0))
    seen = F.col("toxic") + F.col("clean")
    top = counts.where(seen >= KNOWN).orderBy("word").collect()  # words of fit_rows texts at most
    pieces = F.explode(F.array_compact(F.array(*[F.when(F.length("word") >= p, F.substring("word", 1, p)) for p in PREFIXES]))).alias("prefix")
    rare = counts.select(pieces, "toxic", "clean").groupBy("prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("forms"))
    ranked = rare.where((seen >= 2 * KNOWN) & (F.col("forms") > 1)).orderBy("prefix").collect()  # prefixes of the same texts
    counts.unpersist()
    some = lambda rows, c, n: n - sum(r[c] for r in rows)
    words = _scores(top, "word", 0, 0, (max(some(top, "toxic", n1), 0), max(some(top, "clean", n0), 0)))
    prefixes = {p: x for p, x in _scores(ranked, "prefix", n1, n0, (n1, n0)).items() if x}
    values = np.array([words[r.word] - COST for r in top] + [-COST])
    weights = np.array([float(r.clean) for r in top] + [float(max(some(top, "clean", n0), 1))])
    model = Model(words, prefixes, _scale_of(values, weights))

    shared = docs.sparkSession.sparkContext.broadcast((words, prefixes))

    def make():
        own = Model(*shared.value)

        def of(text: str | None) -> tuple:
            tokens, found = own.segments(text)
            return tokens, [s[4] for s in found]

        return of

    seen_rows = with_columns_from(rows, "text", "tokens bigint, sums array<double>", make).select("toxic", "tokens", "sums").collect()  # fit_rows at most
    best = [model.scale * max(r.sums) - math.log(r.tokens) for r in seen_rows if not r.toxic and r.sums]
    model.size = math.exp(float(np.mean(best)) - np.euler_gamma) if best else 1.0  # the mean of a Gumbel law
    bits = np.array([model.evidence(r.tokens, [(0, 0, 0, 0, s) for s in r.sums])[0] for r in seen_rows])
    model.curve = _logistic(np.sign(bits) * np.log1p(np.abs(bits)), np.array([float(r.toxic) for r in seen_rows]))
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and passages: significant segments as (start, end, sum, bits), offsets in characters.

    Null and empty texts, and such without letters, have no passages and the score of no evidence. Every row is scored on
    its whole text alone; repeated rows and other columns pass through; columns called score or passages are replaced.
    Offsets are -1 where lower case changes the length of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.prefixes, model.scale, model.size, model.curve))

    def make():
        own = Model(*shared.value)

        def of(text: str | None) -> tuple:
            score, kept = own.score(text)
            return score, [{"start": s[2], "end": s[3], "sum": s[4], "bits": s[5]} for s in kept]

        return of

    return with_columns_from(docs, text_col, "score double, passages array<struct<start:int,end:int,sum:double,bits:double>>", make)


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the rows that the contract lets it learn from."""
    return fit(docs.select("doc_id", "text"), labels.where(~held_out("doc_id", 5, 0)).select("doc_id", "toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, judged by its text alone."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, fit_documents(docs, read_table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages")
    )


QUERIES = {"op5_toxicity": op5_toxicity}
