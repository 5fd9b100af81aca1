"""The prefix trie of conversations, its subtree totals found by time-forward processing.

Conversations that begin with the same turns share nodes. A node is named by a digest of its prefix, kept up along the sorted turns. Nodes with
many members, of which there can only be few, are the trunk; below it hang light subtrees, which are cut again where their depth
passes a bound. These pieces are the shards: each is sorted by reverse level order, and a node passes its totals forward in time to its
parent through a priority queue that spills. Totals of shard roots then pass through the tree of shards in the same way, and last through the trunk.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datelore.llm.common import checkpointed, read_table

#: A node of more members belongs to the trunk: so many, or a ten-thousandth of all turns where that is more, which leaves 10,000 such nodes at most.
LIGHT_MEMBERS = 50
#: Levels of a shard. Messages that a task holds in memory; ids of conversations that are joined at a time.
SHARD_LEVELS, HELD_MESSAGES, HELD_IDS = 1024, 200_000, 4096
_ROOT = bytes(16)


class Messages:
    """A priority queue of (level, node) and totals, smallest first. What is beyond limit goes to a temporary file of the task as a sorted run."""

    def __init__(self, limit: int):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self.heap.sort()
            kept = self.limit // 4
            self.runs.append(_Run(self.heap[kept:]))
            del self.heap[kept:]

    def take(self, key: tuple) -> list[int]:
        """The sums of all messages for key, the next one in order."""
        sums = [0, 0, 0]
        while True:
            self.runs = [r for r in self.runs if r.head is not None]
            run = min(self.runs, key=lambda r: r.head, default=None)
            if self.heap and self.heap[0][:2] == key:
                message = heapq.heappop(self.heap)
            elif run is not None and run.head[:2] == key:
                message = run.pop()
            else:
                return sums
            for k in range(3):
                sums[k] += message[2 + k]

    def __len__(self) -> int:
        return len(self.heap) + sum([r.head is not None for r in self.runs])


class _Run:
    """A sorted run in a nameless file, gone with the task; read back in blocks."""

    def __init__(self, messages: list[tuple]):
        self.file = tempfile.TemporaryFile()
        for k in range(0, len(messages), 1000):
            pickle.dump(messages[k : k + 1000], self.file)
        self.file.seek(0)
        self._next()

    def _next(self) -> None:
        try:
            self.block, self.at = pickle.load(self.file), 0
            self.head = self.block[0]
        except EOFError:
            self.head = None
            self.file.close()

    def pop(self) -> tuple:
        found, self.at = self.head, self.at + 1
        if self.at < len(self.block):
            self.head = self.block[self.at]
        else:
            self._next()
        return found


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}


def _batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """rows as batches of the columns of ddl."""
    names, types = zip(*[x.split() for x in ddl.split(", ")], strict=True)
    while held := list(islice(rows, 2000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


_TOTALS = "shard binary, depth long, node binary, parent binary, top boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def pass_up(nodes: DataFrame, held_messages: int = HELD_MESSAGES) -> DataFrame:
    """nodes (shard, depth, node, parent, top, conv_id, n_convs, leaves, saved, fixed, children) with the totals of what lies below each in its shard.

    A row with conv_id null is a message from another shard and adds children, leaves and saved to the node of its name. A node's total is its own leaves
    and saved and its messages'; where fixed is false its own leaves are 1 without children, else 0. A top node's parent is in another shard.
    Shards are dealt by hash; a task holds one message queue, bounded by its spilling.
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def totals() -> Iterator[tuple]:
            queue, now = Messages(held_messages), None
            for (shard, depth, node), same in groupby(_rows(batches), key=lambda r: r[:3]):
                if shard != now:
                    if len(queue):
                        raise ValueError("messages for a node that is not in its shard")
                    now = shard
                own, sums = None, queue.take((-depth, node))
                for r in same:
                    if r[5] is not None:
                        own = r
                    sums[0] += r[10]
                    sums[1] += r[7]
                    sums[2] += r[8]
                _, _, _, parent, top, conv_id, n_convs, _, _, fixed, _ = own
                if not fixed and not sums[0]:
                    sums[1] += 1
                if not top:
                    queue.push((1 - depth, parent, 1, sums[1], sums[2]))
                yield shard, depth, node, parent, top, conv_id, n_convs, *sums
            if len(queue):
                raise ValueError("messages for a node that is not in its shard")

        yield from _batches(totals(), _TOTALS)

    told = nodes.select("shard", "depth", "node", "parent", "top", "conv_id", "n_convs", "leaves", "saved", "fixed", "children")
    return told.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node").mapInArrow(walked, _TOTALS)


def sorted_turns(turns: DataFrame) -> DataFrame:
    """(part, conv_id, kind, skip, turn, chars): turns (conv_id, kind, skip, turn, role, text) in order, as digests and lengths of their texts, checkpointed.

    kind is -1 for a conversation's own row, which stands for the prefix without turns, 0 for turns that come first and all stay, 1 for those of which
    the first skip are left out. Within a kind the order is turn (null first), role, text. The order is a range partitioning, so that a conversation of any size
    spreads over tasks; part is the partition's number.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    ranges = turns.repartitionByRange(parts, "conv_id", "kind", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 32))
    placed = ranges.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")
    return checkpointed(placed.select(
        F.spark_partition_id().alias("part"), "conv_id", "kind", "skip", F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("turn"), F.char_length("text").cast("long").alias("chars")
    ))


def _kept(batches: Iterator[pa.RecordBatch], owns: dict[int, int], places: dict[int, tuple[int, int]]) -> Iterator[tuple]:
    """(part, conv_id, depth or None for rows that are left out, node, parent, chars) of a partition of sorted_turns.

    owns and places say what earlier partitions hold of the conversation that reaches into this one: its rows of kind 1, and its depth and digest.
    """
    last = None
    for part, conv, kind, skip, turn, chars in _rows(batches):
        if last is None:
            own, (depth, digest) = owns.get(part, 0), places.get(part, (-1, 0))
        elif conv != last:
            own, depth, digest = 0, -1, 0
        last = conv
        own += kind == 1
        if kind == 1 and own <= skip:
            yield part, conv, None, None, None, 0
            continue
        before, depth = digest, depth + 1
        if kind >= 0:  # a prefix is the set of its turns with their places, so digests of parts of it can be put together
            digest ^= int.from_bytes(hashlib.blake2b(turn + depth.to_bytes(8, "big"), digest_size=16).digest(), "big")
        yield part, conv, depth, digest.to_bytes(16, "big"), before.to_bytes(16, "big") if depth else None, chars


def _summed(turns: DataFrame, of, ddl: str) -> list:
    """One row for each partition that has any, in order: its number, first and last conversation, and what of(rows of the partition) says further."""
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = of(batches)
        yield from _batches(iter([] if found is None else [found]), ddl)

    return sorted(turns.mapInArrow(walked, ddl).collect(), key=lambda r: r.part)


def _carried(turns: DataFrame) -> tuple[dict[int, int], dict[int, tuple[int, int]], set[int]]:
    """owns and places of _kept, and the partitions whose last conversation has turns in a later one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        part, first, last, own = None, None, None, 0
        for p, conv, kind, *_ in _rows(batches):
            if part is None:
                part, first = p, conv
            if conv != last:
                last, own = conv, 0
            own += kind == 1
        return None if part is None else (part, first, last, own)

    owns, of = {}, (None, 0)
    for r in _summed(turns, counted, "part int, first long, last long, own long"):
        owns[r.part] = of[1] if of[0] == r.first else 0
        of = (r.last, r.own + (owns[r.part] if r.first == r.last else 0))

    def deep(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        part, first, last, n, of_first = None, None, None, 0, 0
        for p, conv, depth, *_ in _kept(batches, owns, {}):
            if part is None:
                part, first = p, conv
            if conv != last:
                last, n = conv, 0
            n += depth is not None
            if conv == first:
                of_first = n
        return None if part is None else (part, first, last, n, of_first)

    told = _summed(turns, deep, "part int, first long, last long, n long, of_first long")
    depths, of = {}, (None, -1)
    for r in told:
        depths[r.part] = of[1] if of[0] == r.first else -1
        of = (r.last, r.n + (depths[r.part] if r.first == r.last else -1))
    goes_on = set()
    ahead: tuple = (None, False)  # the next partition's first conversation, and whether it has turns there or further on
    for r in reversed(told):
        if ahead == (r.last, True):
            goes_on.add(r.part)
        ahead = (r.first, r.of_first > 0 or r.first == r.last and r.part in goes_on)

    def digested(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        part, last, digest = None, None, _ROOT
        for part, conv, depth, node, _, _ in _kept(batches, owns, {p: (d, 0) for p, d in depths.items()}):  # noqa: B007
            if conv != last:
                last, digest = conv, _ROOT
            if depth is not None:
                digest = node
        return None if part is None else (part, digest)

    digests = {r.part: int.from_bytes(r.digest, "big") for r in _summed(turns, digested, "part int, digest binary")}
    places, of = {}, (None, 0)
    for r in told:
        start = of[1] if of[0] == r.first else 0
        places[r.part] = (depths[r.part], start)
        of = (r.last, digests[r.part] ^ (start if r.first == r.last else 0))
    return owns, places, goes_on


def _trunk(turns: DataFrame, owns: dict, places: dict, light_members: int) -> set[bytes]:
    """The nodes with more members than a light one, at most one for each light_members turns: the bound of what the driver gets here."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((node,) for _, _, depth, node, _, _ in _kept(batches, owns, places) if depth is not None), "node binary")

    counts = turns.mapInArrow(named, "node binary").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return {bytes(r.node) for r in counts.where(F.col("n") > light_members).select("node").collect()}


_MEMBERS = "conv_id long, depth long, node binary, parent binary, chars long, ends boolean, shard binary, parent_shard binary, root binary, level long"


def _members(turns: DataFrame, light_members: int, shard_levels: int) -> DataFrame:
    """A row for each conversation and prefix of it, with the shard of the node: the light root or the last cut above it; null in the trunk. level counts cuts."""
    owns, places, goes_on = _carried(turns)
    trunk = _trunk(turns, owns, places, light_members)

    def reached(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        part, first, last, root, cut, cuts = None, None, None, None, None, 0
        for p, conv, depth, node, _, _ in _kept(batches, owns, places):
            if part is None:
                part, first = p, conv
            if conv != last:
                last, root, cut, cuts = conv, None, None, 0
            if depth is None or node in trunk:
                continue
            if root is None:
                root, at_root = node, depth % shard_levels == 0
            if depth % shard_levels == 0:
                cut, cuts = node, cuts + 1
        return None if part is None else (part, first, last, root, root is not None and at_root, cut, cuts)

    starts, of = {}, (None, None, None, 0)  # conversation, its light root, its last cut, its cuts
    for r in _summed(turns, reached, "part int, first long, last long, root binary, at_root boolean, cut binary, cuts long"):
        starts[r.part] = before = of[1:] if of[0] == r.first else (None, None, 0)
        if r.first == r.last and before[0] is not None:
            of = (r.last, before[0], before[1] if r.cut is None else bytes(r.cut), before[2] + r.cuts)
        elif r.root is not None:
            of = (r.last, bytes(r.root), bytes(r.root if r.cut is None else r.cut), r.cuts - r.at_root)
        else:
            of = (r.last, None, None, 0)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, last, part = None, None, None
            for part, conv, depth, node, parent, chars in _kept(batches, owns, places):
                if conv != last:
                    root, shard, level = starts[part] if last is None else (None, None, 0)
                    last = conv
                if depth is None:
                    continue
                if held is not None:
                    yield *held[:5], held[0] != conv, *held[5:]
                above = shard
                if node not in trunk:
                    if root is None:
                        root = shard = node
                    elif depth % shard_levels == 0:
                        shard, level = node, level + 1
                held = (conv, depth, node, parent, chars, shard, above, root, level)
            if held is not None:
                yield *held[:5], held[0] != last or part not in goes_on, *held[5:]

        yield from _batches(rows(), _MEMBERS)

    return checkpointed(turns.mapInArrow(walked, _MEMBERS))


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) for nodes at which conversations end: the digest of their ids in order.

    Ids are sorted by range and joined where they lie, so what meets in one task for one node is only the joined text, read through once:
    a digest is a chain, which no plan can split.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: list[str] = []
            now, first = None, None
            for node, conv in _rows(batches):
                if node != now or len(held) == HELD_IDS:
                    if held:
                        yield now, first, ",".join(held)
                    now, first, held = node, conv, []
                held.append(str(conv))
            if held:
                yield now, first, ",".join(held)

        yield from _batches(rows(), "node binary, first long, ids string")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (node,), same in groupby(_rows(batches), key=lambda r: r[:1]):
                told = hashlib.sha256()
                for k, (_, _, ids) in enumerate(same):
                    told.update(("," + ids if k else ids).encode())
                yield node, told.hexdigest()

        yield from _batches(rows(), "node binary, ends_sha256 string")

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = members.where("ends").select("node", "conv_id").repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ids.mapInArrow(joined, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digested, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, light_members: int | None = None, shard_levels: int = SHARD_LEVELS, held_messages: int = HELD_MESSAGES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node of the trie of turns (see sorted_turns).

    Each conversation has a row of kind -1. conv_id is a node's smallest member, parent_conv_id its parent's (null for the root); n_leaves and saved_tokens are sums
    over its subtree, of childless nodes and of (members - 1) x code points of the last text. Without conversations there are no nodes. Nodes are told apart by
    128-bit digests.
    """
    turns = sorted_turns(turns)
    if light_members is None:
        light_members = max(LIGHT_MEMBERS, turns.count() // 10_000)
    members = _members(turns, light_members, shard_levels)
    depends = ["node", "depth", "parent", "chars", "shard", "parent_shard", "root", "level"]  # all follow from the node
    nodes = checkpointed(members.groupBy(*depends).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")))
    zero, no = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = ["depth", "node", "parent", "top", "conv_id", "n_convs", zero.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.lit(False).alias("fixed"), zero.alias("children")]

    def message(shard: str, leaves, saved, children=None) -> list:
        """A message to the parent of a row's node."""
        return [
            F.col(shard).alias("shard"), (F.col("depth") - 1).alias("depth"), F.col("parent").alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(False).alias("top"),
            no.alias("conv_id"), no.alias("n_convs"), leaves.alias("leaves"), saved.alias("saved"), F.lit(False).alias("fixed"), (F.lit(1).cast("long") if children is None else children).alias("children"),
        ]

    light = nodes.where("shard is not null").withColumn("top", F.col("node") == F.col("shard"))
    told = light.select("shard", *own)
    deep = light.where("top and level > 0")
    is_deep = deep.limit(1).count() > 0
    if is_deep:  # totals inside the shards, then through the tree of the shards of each light root, then inside the shards with what comes from below
        within = pass_up(told.unionByName(deep.select(*message("parent_shard", zero, zero))), held_messages).where("top")
        tops = light.where("top").select("node", "parent_shard", "root", "level")
        across = within.select("node", "conv_id", "n_convs", F.col("n_leaves").alias("leaves"), "saved").join(tops, "node").select(
            F.col("root").alias("shard"), F.col("level").alias("depth"), "node", F.col("parent_shard").alias("parent"), (F.col("level") == 0).alias("top"),
            "conv_id", "n_convs", "leaves", "saved", F.lit(True).alias("fixed"), zero.alias("children"),
        )
        below = pass_up(across, held_messages).where("not top").select("node", "n_leaves", "saved")
        told = told.unionByName(deep.select("node", "depth", "parent", "parent_shard").join(below, "node").select(*message("parent_shard", F.col("n_leaves"), F.col("saved"))))
    totals = checkpointed(pass_up(told, held_messages))
    heavy = nodes.where("shard is null").withColumns({"top": F.col("depth") == 0, "shard": F.lit(_ROOT)})
    roots = totals.where("top and parent is not null")
    roots = roots.join(deep.select("node"), "node", "left_anti") if is_deep else roots
    sums = roots.groupBy("parent", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("n")).withColumn("shard", F.lit(_ROOT))
    trunk = checkpointed(pass_up(heavy.select("shard", *own).unionByName(sums.select(*message("shard", F.col("n_leaves"), F.col("saved"), F.col("n")))), held_messages))

    found = totals.unionByName(trunk)
    names = trunk.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    under_trunk = found.join(F.broadcast(names), "parent")  # the trunk is bounded by light_members
    top = found.where("parent is null").withColumn("parent_conv_id", no)
    under_light = found.join(totals.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    every = reduce(DataFrame.unionByName, [top, under_trunk, under_light])
    none = hashlib.sha256(b"").hexdigest()
    return every.join(_ends(members), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The turns of conversations (conv_id, turn, role, text) for sorted_turns, each conversation c after the first h turns of c - c % 100 in place of its own, h = crc32(c) % 6.

    Null roles and texts are empty; rows without conv_id belong to none and are left out; repeated rows are turns of their own.
    """
    said = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    # only the first five are asked for, so each task hands on no more of a conversation
    firsts = said.where("conv_id % 100 = 0").withColumn("place", F.row_number().over(order)).where("place <= 5").withColumnRenamed("conv_id", "base").drop("turn")
    convs = said.select("conv_id").distinct().withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "head": head})
    empty = F.lit("")
    return (
        convs.select("conv_id", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("skip"), F.lit(0).cast("long").alias("turn"), empty.alias("role"), empty.alias("text"))
        .union(convs.join(firsts, "base").where("place <= head").select("conv_id", F.lit(0), F.lit(0).cast("long"), F.col("place").cast("long"), "role", "text"))
        .union(said.select("conv_id", F.lit(1), head, F.col("turn").cast("long"), "role", "text"))
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, rebuilt with shared beginnings."""
    return prefix_trie(rebuilt(read_table(spark, sf_dir, "conversations")))


_OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)
), crc AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM said),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 6 AS head
  FROM (SELECT DISTINCT conv_id FROM said), crc),
turns AS (
  SELECT c.conv_id, 0 AS kind, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.head
  UNION ALL SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.head),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY kind, place) AS depth FROM turns),
told AS (SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
         UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM told),
nodes AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node),
children AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT m.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
         FROM nodes x JOIN members m ON m.conv_id = x.conv_id AND m.depth <= x.depth LEFT JOIN children c ON c.parent = x.node GROUP BY m.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.parent = n.node
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {"op13_prefix_trie": _OP13_SQL}
