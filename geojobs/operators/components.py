"""Connected components of an undirected graph as DataFrame rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geojobs.operators.storage import settle


def with_least(edges: DataFrame, least: DataFrame, share: int) -> DataFrame:
    """``edges(a, b)`` with ``least(a, m, n)`` of their ``a``; the ``n`` edges of a node with over ``share`` are dealt over several tasks by
    ``b``. Fewer nodes than rows / share are such ones: that bounds what is broadcast."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / share)).cast("long")
    hot = least.where(F.col("n") > share).select("a", salts.alias("salts"))
    dealt = edges.join(F.broadcast(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1).cast("long"))).alias("salt"))
    copies = least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return dealt.join(copies, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame, share: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    return with_least(both, least, share).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, share: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = with_least(down, least, share).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, component)`` for each node of an edge; component is its smallest node.

    Every round is written to the shared folder and only its count and a checksum reach the driver. Null ends and loops are
    ignored, repeated edges are one; an empty table gives an empty result. A node with a share of all edges, as the smallest of a large
    component is, is spread over tasks. Raises if ``max_rounds`` don't suffice.
    """
    edges = settle(edges.where("a is not null and b is not null and a != b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    seen, tasks = None, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max_rounds):
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = mark
        share = max(1000, mark[0] // (2 * tasks))  # of a partition's rows, the half
        edges = settle(_small_star(_large_star(edges, share), share))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
