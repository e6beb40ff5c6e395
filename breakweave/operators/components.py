"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import WorkTables


def connected_components(edges: DataFrame, tables: WorkTables) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest node reachable.

    Alternates the two star contractions until the edge set is a set of stars. Every round is joins and
    minimum aggregations on node keys (partial sums before the shuffle, skewed joins split by the
    adaptive planner); nothing but a count and a checksum comes to the driver.
    """
    edges = edges.select("a", "b")
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    current = tables.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        # A summary of the edge set: equal before and after a round means that nothing moved.
        row = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == mark or row["n"] == 0:
            found = current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
        mark = (row["n"], row["x"])
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = tables.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        tables.drop(large)
        tables.drop(current)
        current = after
