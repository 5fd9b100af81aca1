"""Spelling variants by a relational trie frontier.

Words that differ by one inserted, deleted or replaced code point agree in their first or in their last half. So two tries, of the words
and of the words reversed, hold all of them in one edge table, and every word starts in both at the node of its half. States (word,
position, node, edits) are joined with the edge table level by level: an exact state follows its own letter, spends its edit on another
letter of the node, or drops its letter and stays; an edited state may only follow its letter. States that have used their edit and
end at the end of a word are neighbours. Drops alone find insertions too, from the longer word's side, and only larger letters
replace smaller ones, so each pair is met from one side.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.llm.common import checkpointed, discard, give_back, read_table, written, written_path

#: Code points of a word, at least; occurrences, at least; one of so many (document, run) pairs loses a letter.
LEAST_LETTERS, LEAST_COUNT, CUT_EVERY = 5, 3, 97
#: Words of up to so many code points go through the tries; a trie of longer ones would need as many joins, so these meet by hashes of what is
#: left of them without each one of their letters. Both ways are exact.
TRIE_LETTERS = 64
#: A node through which more words lead is salted: so many words, or a ten-thousandth of all letters where that is more, which leaves 10,000 such nodes at most.
NODE_WORDS = 10_000
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)  # greedy: whole maximal runs of so many and more
_MERSENNE, _BASE = (1 << 61) - 1, 1_000_003


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of letters, A-Z in small ones, a letter dropped where the checksum of document and run says so.

    Null texts have none; a null doc_id is written as nothing; rows are counted each, whatever their ids. Words of fewer than
    LEAST_LETTERS code points or LEAST_COUNT occurrences are left out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def batch_of(x: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.keys(), pa.string()), pa.array(x.values(), pa.int64())], ["word", "n"])

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    runs = Counter(_RUN.findall((text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
                    name = "" if doc_id is None else doc_id
                    for word, n in runs.items():
                        h = zlib.crc32(f"{name}:{word}".encode())
                        if h % CUT_EVERY == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < LEAST_LETTERS:
                                continue
                        held[word] = held.get(word, 0) + n
                    if len(held) >= HELD_WORDS:
                        yield batch_of(held)
                        held = {}
            if held:
                yield batch_of(held)
        finally:
            held = {}
            give_back()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _tries(words: DataFrame) -> DataFrame:
    """(key, word, n, way, spelt, size, start): each word forwards and backwards, from the node where its tries begin. One of the two halves holds no edit."""
    size = F.char_length("word")
    ways = F.array(
        F.struct(F.lit(">").alias("way"), F.col("word").alias("spelt"), F.floor(size / 2).cast("int").alias("start")),
        F.struct(F.lit("<").alias("way"), F.reverse("word").alias("spelt"), F.ceil(size / 2).cast("int").alias("start")),
    )
    return words.select("word", "n", size.alias("size"), F.inline(ways)).withColumn("key", _node("spelt"))


def _node(prefix: str | Column) -> Column:
    """The node of a prefix, in the trie of its way; a word's own node is its key."""
    return F.xxhash64("way", prefix)


def _edges(tries: DataFrame) -> DataFrame:
    """(node, letter, child, through): each edge once, with the number of words that it leads to. A word's edges begin at half of its letters, as no state meets it earlier."""
    depths = tries.select("way", "spelt", F.explode(F.sequence(F.floor(F.col("size") / 2).cast("int"), F.col("size") - 1)).alias("depth"))
    prefix = lambda d: F.substring(F.col("spelt"), F.lit(1), d)
    return depths.select(
        _node(prefix(F.col("depth"))).alias("node"), F.substring(F.col("spelt"), F.col("depth") + 1, F.lit(1)).alias("letter"), _node(prefix(F.col("depth") + 1)).alias("child")
    ).groupBy("node", "letter", "child").agg(F.count(F.lit(1)).alias("through"))


def _hot_nodes(edges: DataFrame, letters: int) -> DataFrame | None:
    """(node, salts) of nodes through which more words lead than one task should meet, 10,000 rows at most by their bound; none where there are none."""
    bound = max(NODE_WORDS, -(-2 * letters // 10_000))
    hot = edges.groupBy("node").agg(F.sum("through").alias("through")).where(F.col("through") > bound).select("node", F.ceil(F.col("through") / bound).cast("int").alias("salts"))
    rows = [(r.node, r.salts) for r in hot.collect()]
    return edges.sparkSession.createDataFrame(rows, "node long, salts int") if rows else None


def _trie_pairs(words: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, near, near_n): candidates from the tries of words (word, n), each pair from one side, and the files that they are read from.

    Hashes stand for nodes, so a pair may be wrong, but none is lost. A state holds the key of its word, the letters that it still has to
    go (rest), its node, whether its edit is used, and whether its next letter repeats the last, whose loss would leave the same word.
    """
    spark, tries = words.sparkSession, _tries(words)
    edges = stored = written(_edges(tries))
    hot = _hot_nodes(stored, words.agg(F.sum(F.char_length("word"))).first()[0] or 0)
    if hot is None:
        salted = lambda states: states.withColumn("salt", F.lit(0))
        edges = edges.withColumn("salt", F.lit(0))
    else:
        with_salts = lambda rows: rows.join(F.broadcast(hot), "node", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        salted = lambda states: with_salts(states).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).drop("salts")
        edges = with_salts(edges).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    edges = edges.select("node", "letter", "child", "salt")

    own, left, no = F.substring("rest", 1, 1), F.expr("substring(rest, 2)"), F.lit(False)
    start = F.substring(F.col("spelt"), F.lit(1), F.col("start"))
    levels = [written_path(tries.select("key", F.expr("substring(spelt, start + 1)").alias("rest"), _node(start).alias("node"), no.alias("edited"), no.alias("repeats")))]
    for _ in range(TRIE_LETTERS + 1):
        going = spark.read.parquet(levels[-1]).where("rest <> ''")
        if not going.limit(1).count():
            break
        dropped = going.where("not edited and not repeats").select("key", left.alias("rest"), "node", F.lit(True).alias("edited"), no.alias("repeats"))
        follows = (F.col("letter") == own) | ~F.col("edited") & (F.col("letter") > own)
        met = salted(going).alias("s").join(edges.alias("e"), (F.col("s.node") == F.col("e.node")) & (F.col("s.salt") == F.col("e.salt")) & follows)
        edited = F.col("edited") | (F.col("letter") != own)
        moved = met.select("key", left.alias("rest"), F.col("child").alias("node"), edited.alias("edited"), (~edited & (F.substring("rest", 2, 1) == own)).alias("repeats"))
        levels.append(written_path(moved.unionByName(dropped).where("rest <> '' or edited")))
    every = spark.read.parquet(*levels)
    names = tries.select("key", "word", "n")
    last = names.select(F.col("key").alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = every.where("rest = '' and edited").select("key", "node").join(names, "key").join(last, "node")
    return found.select("word", "n", "near", "near_n"), [every, stored]


def _left_without_one(word: str) -> Iterator[tuple[int, int]]:
    """(position, hash of word without the letter there), and (-1, hash of word), by polynomial hashes."""
    points = [ord(c) for c in word]
    before, after = 0, 0
    for c in points:
        after = (after * _BASE + c) % _MERSENNE
    power = pow(_BASE, len(points) - 1, _MERSENNE)  # of the first of the letters in after
    inverse = pow(_BASE, -1, _MERSENNE)
    for k, c in enumerate(points):
        after = (after - c * power) % _MERSENNE  # letters after k
        yield k, (before * power + after) % _MERSENNE
        before = (before * _BASE + c) % _MERSENNE
        power = power * inverse % _MERSENNE
    if points:
        yield -1, before


def _long_pairs(words: DataFrame) -> DataFrame:
    """Candidates among long words: what is left of one without a letter is the other, or is left of the other without the letter in the same place."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, key in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at, left = zip(*_left_without_one(word.as_py()), strict=True)
                for k in range(0, len(at), 10_000):
                    part = at[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array(left[k : k + 10_000], pa.int64())], ["key", "at", "left"])

    # words travel by their hashes: the rows are as many as letters, and must not each hold a word
    left = checkpointed(words.select("word", F.xxhash64("word").alias("key")).mapInArrow(hashed, "key long, at long, left long"))
    cut, whole = left.where("at >= 0"), left.where("at < 0").select("left", F.col("key").alias("near_key"))
    replaced = cut.join(cut.select("at", "left", F.col("key").alias("near_key")), ["at", "left"]).where("key < near_key")
    keys = cut.join(whole, "left").select("key", "near_key").union(replaced.select("key", "near_key")).distinct()
    named = words.select(F.xxhash64("word").alias("key"), "word", "n")
    return keys.join(named, "key").join(named.select(F.col("key").alias("near_key"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_key").select("word", "n", "near", "near_n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words that differ by exactly one code point inserted, deleted or replaced, from both sides. Written to the shared folder."""
    size = F.char_length("word")
    met, files = _trie_pairs(words.where(size <= TRIE_LETTERS))
    long = words.where(size >= TRIE_LETTERS)
    if long.where(size > TRIE_LETTERS).limit(1).count():
        met = met.union(_long_pairs(long))
    met = met.where(F.levenshtein("word", "near", 1) == 1)
    found = written(met.union(met.select("near", "near_n", "word", "n")).distinct())
    for x in files:
        discard(x)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): where following forms ends. Each round doubles the steps; n doubles with each, so rounds are a logarithm of a logarithm."""
    now, moves = checkpointed(forms.select("word", F.col("form").alias("root"))), forms.limit(1).count()
    while moves:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = checkpointed(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        moves = now.where("moved").limit(1).count()
        now = now.select("word", "root")
    return now


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word: different, n).

    A word's form is its near word of largest n, the smallest of equals in code-point order, if that n is at least twice its own; its root is where
    following forms ends, the word itself where it has none. An empty table gives no rows.
    """
    words = checkpointed(words.select("word", "n"))
    pairs = near_words(words)
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= 2 * F.col("n")
    told = checkpointed(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
        )
    )
    discard(pairs)
    roots = _roots(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, its usual form and the root of its group."""
    return group_variants(count_words(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


_OP12_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
told AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) AS BIGINT) - 64] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM told, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, k, left(word, k) || substr(word, k + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS k FROM words)),
pairs AS (SELECT c.word AS a, w.word AS b FROM cut c JOIN words w ON w.word = c.d UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.d UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.k = y.k AND x.d = y.d AND x.word <> y.word),
near AS (SELECT a, count(*) AS n_near, arg_min(b, (-w.n, b)) AS best, max(w.n) AS best_n FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM words LEFT JOIN near ON a = word),
follow(word, now_at) AS (SELECT word, word FROM forms UNION ALL SELECT f.word, x.form FROM follow f JOIN forms x ON x.word = f.now_at WHERE x.form IS NOT NULL),
roots AS (SELECT f.word, f.now_at AS root FROM follow f JOIN forms x ON x.word = f.now_at WHERE x.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLE_SQL = {"op12_spelling_variants": _OP12_SQL}
