"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.storage import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Rows (node, root): root is the smallest node reachable, for every node of ``edges``.

    Alternating large-star and small-star rounds: each sends every neighbour to the smallest one seen, so that
    long chains shrink quickly; per node only a minimum is aggregated, never a neighbour list. Edges that hold a
    null are ignored, loops keep their node, repeated edges count once. Fails after ``max_rounds`` without rest.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    # Written once: the nodes below come from it too.
    first = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = first.select("u").union(first.select("v")).distinct()
    e = first.filter("u <> v")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = large.join(low, "u")
        small = links.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), "edges", replaces=e)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if tuple(now) == before and now[0] == now[2]:
            roots = e.groupBy("u").agg(F.min("v").alias("root"))
            return nodes.withColumnRenamed("u", "node").join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        before = tuple(now)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
