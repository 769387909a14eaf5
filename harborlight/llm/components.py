"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.session import written


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, component) for each node of `edges` (a, b) that is not its component's smallest.

    Each round is written to the shared folder, so a lost executor costs at most one round. The
    star steps only combine minima per node; a node with many neighbours is split by Spark's skew
    join. Null ends and loops are left out. An empty input gives no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges, state = written(edges.distinct(), label), None
    while True:
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first()
        if found == state or found[0] == 0:
            break
        state = found
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
