"""Connected components of an edge table by alternating stars, each round one set of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelore.llm.common import checkpointed


#: A node of more edges than so many, or than a ten-thousandth of all where that is more, is hot: there are 10,000 of them at most.
NODE_EDGES = 1000


def _joined(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows (a, b) with m of least (a, m, n: edges of a). Hot nodes are broadcast, so that their edges are joined where they lie; the others meet by a shuffle."""
    bound = max(NODE_EDGES, -(-n_edges // 10_000))
    hot = F.broadcast(least.where(F.col("n") > bound).select("a", "m"))
    cold = rows.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.where(F.col("n") <= bound).select("a", "m"), "a")
    return rows.join(hot, "a").select("a", "b", "m").union(cold.select("a", "b", "m"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _joined(both.where("b > a"), least, 2 * n_edges).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _joined(down, least, n_edges).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes with two parents, or with a parent and a child: none are left once all trees are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that it can reach.

    Rows with a null end and loops count as no edge. Each round is written to the shared checkpoint folder;
    the driver sees two numbers a round. Rounds grow with the logarithm of the longest chain; more than max_rounds, which no table needs, are an error.
    """
    now = checkpointed(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(max_rounds):
        if not _unsettled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        n = now.count()
        now = checkpointed(_small_star(_large_star(now, n), n))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
