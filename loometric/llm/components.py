"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometric.llm.common import stored

MAX_ROUNDS = 60
# A node may have a third of all links: the one row that they meet is salted.
SALTS = 8


def _meeting(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (a, b) with what ``nodes`` says of a in its one row; the edges of one node are dealt over tasks by their other end."""
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"]).drop("salt")


def _hooked(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, and then each node itself, are linked with its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = (_meeting(both.where("b > a"), smallest).select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a <> b").distinct())
    # now a > b in every row: link the smaller neighbours of a node, and the node, with the smallest of them
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = _meeting(large, least).select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").where("a <> b").distinct()


def _is_flat(edges: DataFrame) -> bool:
    """Whether each node has one link, to a smaller node that has none of its own."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    worst = nodes.agg(F.max("out"), F.max(F.least("out", "into"))).first()
    return worst[0] is None or worst[0] <= 1 and worst[1] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node of its component.

    Star contraction: the links are rewritten until each node has one link, to its root. A node
    with many links is met by aggregates that combine before the shuffle and by joins that
    adaptive execution can split. Each round is written to the shared folder.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _is_flat(edges):
            break
        edges = stored(_hooked(edges), "links")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
