"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, stored

__all__ = ["connected_components"]


def _to_least(edges: DataFrame, key: str, other: str, written: bool) -> DataFrame:
    """edges with the least of each key's own and neighbouring values as `least`.

    A partial minimum and a join rather than a window. With the minima written both sides of the join are shuffles of their
    own, so that adaptive execution can split the edges of a very large star among tasks. Nothing is broadcast.
    """
    least = edges.groupBy(key).agg(F.least(F.min(other), F.min(key)).alias("least"))
    return edges.join(shuffled(stored(least, "least") if written else least), key)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node of its component.

    Self-loops, repeated edges and nulls are ignored; no edges give no rows. Rounds go on until nothing changes. Each is written
    to the shared folder, so lineage stays short and a lost executor costs one round at most; only a count and a checksum
    reach the driver.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, "u", "v", True).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        small = _to_least(large, "u", "v", False)  # large stars have brought all to their centres, so no u has many v here
        small = small.select("u", F.col("least").alias("v")).union(small.select(F.col("v").alias("u"), F.col("least").alias("v")))
        now = stored(small.where("u <> v").distinct(), "edges")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
