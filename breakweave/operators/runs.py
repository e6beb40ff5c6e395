"""Values along a chromosome: running sums and neighbouring rows, in two levels so that no chromosome is one task.

Bins of places are worked on in parallel; what passes from bin to bin is carried over one row per bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096


def running_sums(rows: DataFrame, key: str, place: str, sums: dict[str, Column], bin_width: int = BIN) -> DataFrame:
    """``rows`` with running sums, this row included, in ascending order of ``place``; places are distinct within a key."""
    names = list(sums)
    held = rows.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.floor(F.col(place) / bin_width).alias("bin"), F.col(place).alias("at"), *[c.alias(n) for n, c in sums.items()])
    over = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = held.groupBy("k", "bin").agg(*[F.sum(n).alias(n) for n in names])
    carried = bins.select(F.col("k").alias("ck"), F.col("bin").alias("cbin"), *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"c_{n}") for n in names])
    inside = Window.partitionBy("k", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    met = held.withColumns({n: F.sum(n).over(inside) for n in names}).join(carried, F.col("k").eqNullSafe(F.col("ck")) & F.col("bin").eqNullSafe(F.col("cbin")))
    return met.select("row.*", *[(F.col(n) + F.col(f"c_{n}")).alias(n) for n in names])


def with_neighbours(rows: DataFrame, key: str, place: str, carried: list[str], bin_width: int = BIN) -> DataFrame:
    """``rows`` with ``before`` and ``after``: structs of ``carried`` of the rows next to each in order of ``place`` (null at the ends); places are distinct within a key."""
    held = rows.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.floor(F.col(place) / bin_width).alias("bin"), F.col(place).alias("at"), F.struct(*carried).alias("own"))
    bins = held.groupBy("k", "bin").agg(F.min_by("own", "at").alias("first"), F.max_by("own", "at").alias("last"))
    over = Window.partitionBy("k").orderBy("bin")
    bins = bins.select(F.col("k").alias("bk"), F.col("bin").alias("bb"), F.lag("last").over(over).alias("left"), F.lead("first").over(over).alias("right"))
    inside = Window.partitionBy("k", "bin").orderBy("at")
    met = held.withColumns({"b": F.lag("own").over(inside), "a": F.lead("own").over(inside)}).join(bins, F.col("k").eqNullSafe(F.col("bk")) & F.col("bin").eqNullSafe(F.col("bb")))
    return met.select("row.*", F.coalesce("b", "left").alias("before"), F.coalesce("a", "right").alias("after"))
