"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than a node moves to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b), where root is the smallest node of its component.

    Edges from a node to itself make it a component; nulls are left out; repeated edges don't matter. Rounds are few: each
    halves the depth of the trees at least in practice, and the work of a node is spread by its edges, not collected.
    """
    edges = edges.filter("a is not null and b is not null")
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    now = stored(edges.filter("a <> b").distinct(), "edges")
    state = None
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        sums = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    known = found.union(roots)
    return known.union(loops.distinct().join(known, "node", "left_anti"))
