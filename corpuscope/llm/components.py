"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import hint_small, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of u on the smallest of u and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    return both.join(hint_small(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")  # one edge for one edge


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang u and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = down.join(hint_small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: one row per vertex of an edge, with the smallest id it can reach.

    Nulls and loops are dropped; repeated and reversed edges are allowed; an empty table gives an empty table. Each round
    writes its edges to the shared folder. A round moves each vertex onto a star of its smallest known vertex; the rounds
    needed grow with the logarithm of the longest path, and the work stops when a round changes nothing. Nothing but one
    pair of numbers per round goes to the driver. The least neighbours are written before they are joined, so that the
    edges of a hot centre meet them by broadcast or in a join whose skewed partitions Spark can split.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("count(distinct b)"), F.expr("count(distinct a)")).first()
    seen = mark(now)
    for _ in range(max_rounds):
        # a forest of stars: every vertex hangs once, and no centre hangs on another vertex
        if seen[0] == 0:
            break
        if seen[0] == seen[3] and now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() == 0:
            break
        now = written(_small_star(_large_star(now)), "cc")
        seen = mark(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
