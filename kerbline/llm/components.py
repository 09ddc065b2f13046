"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kerbline.llm.shared import dropped, stored

#: Edges from which on the least neighbours of all nodes are written before they are joined back. Both sides of the join are
#: then plain shuffles, and Spark's skew handling can split the edges of a hub; below, a hub is no burden to one task.
SPLIT_FROM = 1_000_000


def _joined(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return edges.join(stored(least, "components-least") if many else least, "a")


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _joined(both, least, many).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _joined(down, least, many).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b: long); component is the least node that it is connected with.

    Null ends and loops are ignored. Sums are made before rows are sent, and in large tables joins split a node with very
    many neighbours. Each step is stored in the shared folder; steps end when the edges stay the same.
    """

    def marked(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        marks = [F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("a", "b", F.lit(i))).alias(f"h{i}") for i in (1, 2)]]
        out = stored(df.observe(seen, *marks), "components")
        return out, tuple(seen.get[k] for k in ("n", "h1", "h2"))

    now, found = marked(edges.where("a != b").select("a", "b").distinct())
    seen = None
    while found[0] and found != seen:
        many = found[0] > SPLIT_FROM
        before, seen = now, found
        now, found = marked(_small_star(_large_star(now, many), many))
        dropped(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
