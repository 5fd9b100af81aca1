"""Byte-level BPE encoding and decoding.

Two tiers: a whole pre-token that the vocabulary holds is resolved by one probe of a minimal perfect hash; any
other one is merged by a heap over linked bytes. Documents are encoded where they lie (no shuffle): the
vocabulary, whose size is fixed by its file, goes to every executor once.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from datelore.llm.common import read_table, with_columns_from

#: Pre-tokens that a task remembers the ids of, about 160 MB.
MEMO_ENTRIES = 800_000

# regex counts U+001C to U+001F among \s, the Unicode property White_Space does not; the pattern means the property.
_SPACE = r"[\t-\r \x85\xA0  -     　]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)


def compiled(pattern: str) -> regex.Pattern:
    """The split pattern with \\s and \\S spelt out as the Unicode property White_Space."""
    pattern = pattern.replace(r"[^\s", "[^" + _SPACE[1:-1]).replace(r"\s", _SPACE).replace(r"\S", _NOT_SPACE)
    return regex.compile(pattern, regex.V1)

_PRIME = 2**31 - 1


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys fill n slots, one displacement for each bucket of about two keys.

    get(key) is the value of a key, and None for any other string: the slot holds the key to compare with.
    """

    def __init__(self, values: dict[bytes, int]):
        n = self.n = max(1, len(values))
        self.buckets = n // 2 + 1
        members: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in values:
            b, h1, h2 = self._hash(key)
            members[b].append((h1, h2, key))
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        self.moves = [0] * self.buckets
        free = np.ones(n, bool)
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not members[b]:
                break
            d = 0
            while True:
                slots = [(h1 + d * h2) % _PRIME % n for h1, h2, _ in members[b]]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
                if d > 1000 * n:  # two keys that fall together at every displacement
                    raise ValueError("no displacement separates these keys")
            self.moves[b] = d
            for s, (_, _, key) in zip(slots, members[b], strict=True):
                free[s] = False
                self.keys[s], self.values[s] = key, values[key]

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = xxh64_intdigest(key)
        return h % self.buckets, h >> 32, h & 0xFFFFFFFF | 1

    def get(self, key: bytes) -> int | None:
        b, h1, h2 = self._hash(key)
        s = (h1 + self.moves[b] * h2) % _PRIME % self.n
        return self.values[s] if self.keys[s] == key else None


class Vocabulary:
    """Ranks of byte strings; encode() and decode() of single pre-tokens and id lists."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.whole = PerfectHash(ranks)
        self.token_of = {r: t for t, r in ranks.items()}
        #: Ids of two neighbours to the id of both together.
        self.joined = {(a, b): r for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        self.of_byte = [ranks[bytes([b])] for b in range(256)]

    def encode(self, piece: bytes) -> list[int]:
        found = self.whole.get(piece)
        return [found] if found is not None else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until no neighbours are in the vocabulary.

        Parts are linked by their start offsets; a heap holds (rank, start, end) of pairs, and one whose parts have
        changed since is skipped when it comes up.
        """
        n, joined, push, pop = len(piece), self.joined.get, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        twice, low = bits + bits, (1 << bits) - 1
        ids = [*map(self.of_byte.__getitem__, piece)]
        heap = [r << twice | i << bits | i + 2 for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (r := joined(pair)) is not None]
        if not heap:
            return ids
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heapq.heapify(heap)
        while heap:
            pair = pop(heap)
            i = pair >> bits & low
            j = after[i]
            end = pair & low
            if not 0 < j < n or after[j] != end:
                continue
            ids[i] = now = pair >> twice
            ids[j] = after[j] = -1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := joined((now, ids[end]))) is not None:
                    push(heap, r << twice | i << bits | after[end])
            if i and (r := joined((ids[p := before[i]], now))) is not None:
                push(heap, r << twice | p << bits | end)
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, one "base64 rank" a line. Kept by each worker process."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())})


class _Memo(dict):
    """Pre-token to its ids, packed as little-endian unsigned 32-bit integers.

    Holds so many entries at most: when full, the entries used since the last time it was full stay at hand in older.
    """

    def __init__(self, vocabulary: Vocabulary, entries: int):
        super().__init__()
        self.encode, self.older, self.half = vocabulary.encode, {}, entries // 2

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.encode(piece.encode("utf-8", "surrogatepass"))
            ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if len(self) >= self.half:
                self.older = self.copy()
                self.clear()
            self[piece] = ids
        return ids


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """docs and the column ids (binary: little-endian unsigned 32-bit integers) of every whole text.

    path names a rank file that is installed on every node; pattern splits a text, each match is encoded apart, and
    what no match covers is left out (the public pattern covers everything). No special tokens. A null or empty text
    gives no ids. Rows are independent: ties, repeated rows and extra columns pass through; a column of docs called
    ids is replaced.
    """

    def make():
        split, memo = compiled(pattern).findall, _Memo(load_vocabulary(path), memo_entries)
        return lambda text: (b"".join(map(memo.__getitem__, split(text))) if text else b"",)

    return with_columns_from(docs, text_col, "ids binary", make)


def decode_documents(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """docs and the column decoded (binary): the bytes that the ids of a row stand for; null ids give null."""

    def make():
        token_of = load_vocabulary(path).token_of.__getitem__
        return lambda ids: (None if ids is None else b"".join(map(token_of, np.frombuffer(ids, "<u4").tolist())),)

    return with_columns_from(docs, ids_col, "decoded binary", make)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode_documents(docs, path, tokenizers.PATTERN).drop("text")
    return decode_documents(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
