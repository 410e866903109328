"""Connected components of an edge table by alternating stars, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import written


def components(edges: DataFrame, name: str, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long); root is the smallest node of its component.

    Each round first hangs every larger neighbour of a node under the smallest one, then every smaller neighbour; the
    number of rounds grows with the logarithm of the longest path.  Minima are combined before the shuffle, so a node
    with very many edges costs no more than its edges.
    """
    now = written(_oriented(edges.select("a", "b")), f"{name}-edges")
    before = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _oriented(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        now = written(_oriented(small), f"{name}-edges")
    raise RuntimeError(f"components of {name} did not settle in {max_rounds} rounds")


def _oriented(edges: DataFrame) -> DataFrame:
    """Larger end first, without loops and repetitions."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
