"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most a sequence's tokens. Pieces that fill a sequence stand alone; the others are dealt by hash
to shards of a bounded number of pieces. On several islands of each shard populations of packings evolve: a crossover injects whole
well-filled sequences of one parent into another, sequences that hold a piece twice are dissolved, and the displaced pieces go
where they fit best. After each epoch an island's best packing migrates to the next island of its shard; a shard is done once one of
its islands needs no more sequences than a lower bound proves necessary. The least filled sequences of all shards are then pooled and
packed again, until one shard holds the pool, so the shards' open ends do not add up.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datelore.llm.common import checkpointed, give_back, read_table

#: Pieces of a shard, on average; islands of a shard; epochs, after each of which elites migrate; packings of an island; children of an epoch.
SHARD_PIECES, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 4, 3, 4, 30
#: Of each shard so many of the least filled sequences are packed again with those of other shards, if they hold no more than a sixteenth of its pieces.
POOLED = 4
#: Strings between blanks, and pre-tokens, whose ids a worker process remembers; bytes of text that are encoded at a time.
MEMO_ENTRIES, SLICE = 600_000, 32 << 20

# In a string of these characters only, lower case and composed form change no character's class, so pre-tokens can be found first.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds:
    """Ids of whole texts by a vocabulary of lower-case words, as the tokenizers library gives them, as little-endian unsigned 32-bit integers.

    No pre-token crosses a blank, so a text's ids are those of the strings between its blanks, and these repeat. New
    strings of plain characters are cut into pre-tokens for the vocabulary's merges; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # the names of control tokens inside a text are ordinary text
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.strings: dict[str, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}

    def _of_pre_token(self, x: str) -> bytes:
        found = self.pre_tokens.get(x)
        if found is None:
            shown = x if x.isascii() else x.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(x) <= 64:
                if len(self.pre_tokens) >= MEMO_ENTRIES:
                    self.pre_tokens.clear()
                self.pre_tokens[x] = found
        return found

    def _of_string(self, x: str) -> bytes:
        if x.isascii() or _PLAIN.fullmatch(x):
            small, of = x.lower(), self._of_pre_token
            if small.isalpha():
                found = of(small)
            elif small[:-1].isalpha():
                found = of(small[:-1]) + of(small[-1])
            else:
                found = b"".join([of(t) for t in _PRE_TOKEN.findall(small)])
        else:
            found = array("I", self.whole.encode(x, add_special_tokens=False).ids).tobytes()
        if len(x) <= 64:
            if len(self.strings) >= MEMO_ENTRIES:
                self.strings.clear()
            self.strings[x] = found
        return found

    def __call__(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text; of null none. The different strings of all texts are looked up once."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        strings = lists.flatten().dictionary_encode()
        known = self.strings.get
        ids = [self._of_string(x) if (found := known(x)) is None else found for x in strings.dictionary.to_pylist()]
        placed = pa.array(ids, pa.large_binary()).take(strings.indices)
        ends = np.frombuffer(placed.buffers()[1], np.int64)[np.asarray(lists.offsets)].tolist()
        every = memoryview(placed.buffers()[2] or b"")
        return [every[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about SLICE bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
            yield batch.slice(start, end - start)
            start = end


def encode_pieces(docs: DataFrame, path: str, tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each row of docs (doc_id, text) as its ids and end_id, cut after every so many tokens.

    A null or empty text is end_id alone. Each row is a document of its own, whatever its doc_id. ids are little-endian unsigned 32-bit
    integers; a text's pieces follow one another.
    """
    size = 4 * tokens
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = _word_ids(path), array("I", [end_id]).tobytes()
        try:
            for part in _by_bytes(batches):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of(part.column(1)), strict=True):
                    ids = bytes(ids) + last
                    for k in range(0, len(ids), size):
                        piece = ids[k : k + size]
                        rows.append((doc_id, k // size, k // 4, len(piece) // 4, zlib.crc32(piece), *([piece] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])
        finally:
            give_back()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, ddl)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Fewest sequences that any packing needs (Martello and Toth's second bound): large pieces meet no others of theirs, small ones fill what these leave."""
    s = np.sort(np.asarray(sizes, np.int64))
    if not len(s):
        return 0
    sums = np.concatenate([[0], np.cumsum(s)])
    half = np.searchsorted(s, capacity // 2, "right")
    best = -(-int(sums[-1]) // capacity)
    for a in np.unique(s[:half]):
        low, high = np.searchsorted(s, a), np.searchsorted(s, capacity - a, "right")
        lone, middle = len(s) - high, high - half
        open_room = middle * capacity - int(sums[high] - sums[half])
        best = max(best, lone + middle + max(0, -(-(int(sums[half] - sums[low]) - open_room) // capacity)))
    return max(best, len(s) - half)


def longest_first(pieces: Iterable[int], sizes: list[int]) -> list[int]:
    return sorted(pieces, key=lambda k: (-sizes[k], k))


class Packing:
    """Bins (lists of pieces) and what each holds in all."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Falkenauer's: fewer bins first, then full ones beside open ones before evenly filled ones. Larger is better."""
        return -len(self.bins), float(np.square(np.array(self.fills) / capacity).sum())


def best_fit(pieces: Iterable[int], sizes: list[int], capacity: int, start: Packing | None = None) -> Packing:
    """start with each of pieces put, in turn, where it leaves the least room; a new bin where it fits nowhere."""
    bins, fills = ([], []) if start is None else ([list(b) for b in start.bins], list(start.fills))
    by_room: dict[int, list[int]] = {}
    mask = 0
    for k, f in enumerate(fills):
        by_room.setdefault(capacity - f, []).append(k)
        mask |= 1 << capacity - f
    for k in pieces:
        size = sizes[k]
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            same = by_room[r]
            into = same.pop()
            if not same:
                mask ^= 1 << r
            bins[into].append(k)
            fills[into] += size
        else:
            r, into = capacity, len(bins)
            bins.append([k])
            fills.append(size)
        if r > size:
            by_room.setdefault(r - size, []).append(into)
            mask |= 1 << (r - size)
    return Packing(bins, fills)


def crossover(one: Packing, two: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """A packing from whole bins: well-filled ones of two are injected, those of one that share a piece with them dissolve, as do a few of the least
    filled; what is displaced goes where it fits best."""
    good = np.argsort(np.array(two.fills), kind="stable")[len(two.bins) // 2 :]
    take = rng.choice(good, rng.integers(1, len(good) + 1), replace=False).tolist()
    bins, fills = [two.bins[k] for k in take], [two.fills[k] for k in take]
    inside = {x for b in bins for x in b}
    loose = set(np.argsort(np.array(one.fills), kind="stable")[: int(rng.integers(0, 4))].tolist())
    displaced = []
    for k, b in enumerate(one.bins):
        if k in loose or not inside.isdisjoint(b):
            displaced += [x for x in b if x not in inside]
        else:
            bins.append(b)
            fills.append(one.fills[k])
    return best_fit(longest_first(displaced, sizes), sizes, capacity, Packing(bins, fills))


def evolve(population: list[Packing], sizes: list[int], capacity: int, bound: int, children: int, rng: np.random.Generator) -> list[Packing]:
    """population, best first, after so many children: each takes the place of the worst if it is better. It ends at once where the bound is reached."""
    ranked = sorted([(p.fitness(capacity), p) for p in population], key=lambda x: x[0], reverse=True)
    for _ in range(children):
        if len(ranked[0][1].bins) <= bound:
            break
        a, b = rng.integers(0, len(ranked), 2), rng.integers(0, len(ranked), 2)
        child = crossover(ranked[min(a)][1], ranked[min(b)][1], sizes, capacity, rng)
        fit = child.fitness(capacity)
        if fit > ranked[-1][0] and all(fit != f for f, _ in ranked):
            ranked[-1] = (fit, child)
            ranked.sort(key=lambda x: x[0], reverse=True)
    return [p for _, p in ranked]


def _coded(packing: Packing, n: int) -> bytes:
    owner = np.empty(n, np.int32)
    for k, b in enumerate(packing.bins):
        owner[b] = k
    return owner.tobytes()


def _packing(code: bytes, sizes: list[int]) -> Packing:
    owner = np.frombuffer(code, np.int32)
    bins: list[list[int]] = [[] for _ in range(int(owner.max(initial=-1)) + 1)]
    for k, b in enumerate(owner.tolist()):
        bins[b].append(k)
    return Packing(bins, np.bincount(owner, sizes).astype(int).tolist())


_STATE = "shard long, island int, pieces array<long>, sizes array<long>, packings array<binary>, n_bins int, bound int, filled double"


def _mapped(rows: DataFrame, ddl: str, of) -> DataFrame:
    """rows through of(row as a dict), which gives rows of ddl as tuples; one row of the input is held at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                made = of(batch.slice(k, 1).to_pylist()[0])
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(mapped, schema)


def _islands(states: DataFrame, capacity: int, epoch: int, children: int) -> DataFrame:
    """States of islands after an epoch. packings holds the island's own, best first, and, after the first, immigrants."""

    def of(r: dict) -> list[tuple]:
        rng = np.random.default_rng([r["shard"], r["island"], epoch])
        sizes, n = r["sizes"], len(r["sizes"])
        bound = r["bound"] or lower_bound(np.array(sizes), capacity)
        population = [_packing(p, sizes) for p in r["packings"]]
        while len(population) < POPULATION:  # a part of the pieces, in any order, is put before the others
            order = rng.permutation(n)
            early = order[: int(rng.integers(1, n + 1))].tolist()
            population.append(best_fit(longest_first(order[len(early) :].tolist(), sizes), sizes, capacity, best_fit(early, sizes, capacity)))
        population = evolve(population[:POPULATION], sizes, capacity, bound, children, rng)
        fewest, filled = population[0].fitness(capacity)
        return [(r["shard"], r["island"], r["pieces"], sizes, [_coded(p, n) for p in population], -fewest, bound, filled)]

    return _mapped(states, _STATE, of)


def _packed_level(items: DataFrame, capacity: int, shards: int, level: int, islands: int, epochs: int, children: int) -> DataFrame:
    """(shard, pieces, sizes, packings): the best packing found for each shard of items (item, length)."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
    held = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("held"))  # a shard's pieces are bounded by design
    tasks = max(1, min(shards * islands, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    open_ = held.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("held.item").alias("pieces"),
        F.col("held.length").alias("sizes"), F.array().cast("array<binary>").alias("packings"), F.lit(0).alias("bound"),
    )
    settled = []
    for epoch in range(epochs):
        if epoch:  # the best packing of each island goes to the next one of its shard, in the place of its worst
            elites = open_.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.get("packings", F.lit(0)).alias("_elite"))
            own = F.slice("packings", 1, F.greatest(F.size("packings") - 1, F.lit(1)))
            open_ = open_.join(elites, ["shard", "island"]).withColumn("packings", F.concat(own, F.array("_elite"))).drop("_elite")
        now = checkpointed(_islands(open_.repartition(tasks, "shard", "island"), capacity, epoch, children))
        best = now.withColumn("_place", F.row_number().over(Window.partitionBy("shard").orderBy("n_bins", F.desc("filled"), "island"))).where("_place = 1").drop("_place")
        if epoch == epochs - 1:
            settled.append(best)
            break
        settled.append(best.where("n_bins <= bound"))
        open_ = now.join(best.where("n_bins > bound").select("shard"), "shard", "left_semi")
        if not open_.limit(1).count():
            break
    return reduce(DataFrame.unionByName, settled)


def pack(items: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """(item, sequence_id, offset) for items (item: a unique long, length: 1 to capacity): sequences of at most capacity, as few as are found.

    sequence_id is the smallest item of its sequence; offsets are gapless from 0 in the order of items. The driver sees counts of pieces and of open shards.
    """
    full = items.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, pool, level = [full], items.where(F.col("length") < capacity).select("item", "length"), 0

    def spread(last: bool):
        def of(r: dict) -> list[tuple]:
            sizes = r["sizes"]
            best = _packing(r["packings"][0], sizes)
            bins, order = best.bins, np.argsort(np.array(best.fills), kind="stable").tolist()
            loose, held = set(), 0
            for k in order[: 0 if last else POOLED]:
                held += len(bins[k])
                if held > max(1, len(sizes) // 16):
                    break
                loose.add(k)
            made = []
            for k, b in enumerate(bins):
                at, first = 0, r["pieces"][min(b)]
                for x in sorted(b):
                    made.append((r["pieces"][x], sizes[x], first, at, k in loose))
                    at += sizes[x]
            return made

        return of

    while True:
        n = pool.count()
        if not n:
            break
        shards = -(-n // shard_pieces)
        solved = _packed_level(pool, capacity, shards, level, islands, epochs, children)
        rows = checkpointed(_mapped(solved.select("pieces", "sizes", "packings"), "item long, length long, sequence_id long, offset long, loose boolean", spread(shards == 1)))
        out.append(rows.where("not loose").select("item", "sequence_id", "offset"))
        if shards == 1:
            break
        pool, level = rows.where("loose").select("item", "length"), level + 1
    return reduce(DataFrame.unionByName, out)


def pack_documents(docs: DataFrame, path: str, tokens: int = 2048, end_id: int = 0, with_ids: bool = False, **settings: int) -> DataFrame:
    """The pieces of docs (doc_id, text) with sequence_id and offset, their place. See encode_pieces and pack.

    Documents of no more than so many tokens stay whole. Null and empty texts are one piece of end_id; repeated rows are documents of
    their own; an empty table gives no pieces; other columns of docs play no part. With ids the rows hold what token_sequences needs.
    """
    pieces = checkpointed(encode_pieces(docs, path, tokens, end_id, with_ids)).withColumn("item", F.monotonically_increasing_id())
    return pieces.join(pack(pieces.select("item", "length"), tokens, **settings), "item").drop("item")


def token_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences that a trainer reads, from pack_documents(with_ids=True). A sequence's pieces are bounded by its tokens."""
    told = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"), F.sum("length").alias("n_tokens"))
    return told.select("sequence_id", "n_tokens", F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized, in as few sequences of 2048 tokens as are found."""
    import public_tokenizers as tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
