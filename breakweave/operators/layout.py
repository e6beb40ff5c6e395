"""Places of intervals along a drawing axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import running_sums


def layout(intervals: DataFrame, group: str, order: str, least: float = 0.02, gap: float = 0.1, foreign: Column | None = None, foreign_share: float = 0.2) -> DataFrame:
    """``intervals`` (start, end, ...) with ``left`` and ``right`` on an axis from 0 to 1 for each ``group``, in order of ``order`` (distinct within a group).

    Widths are in proportion to sizes, but at least ``least`` of the axis; what the narrow ones need is taken from
    the others in proportion. Gaps take ``gap`` of the axis, equally between neighbours. Where a group has rows of both
    kinds, ``foreign`` ones share ``foreign_share`` of the widths and the others the rest.
    """
    kind = F.coalesce(foreign, F.lit(False)) if foreign is not None else F.lit(False)
    rows = intervals.select(F.struct("*").alias("row"), F.col(group).alias("g"), F.col(order).alias("o"), kind.alias("f"), (F.col("end") - F.col("start") + 1).cast("double").alias("size"))
    parts = rows.groupBy("g", "f").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    both = Window.partitionBy("g")  # at most two rows
    parts = parts.withColumn("kinds", F.count("*").over(both)).withColumn("rows", F.sum("n").over(both))
    share = F.when(F.col("kinds") == 1, 1.0).when(F.col("f"), foreign_share).otherwise(1 - foreign_share)
    bars = 1 - F.when(F.col("rows") > 1, gap).otherwise(0.0)
    # A kind never needs more than its share for its narrow rows.
    parts = parts.select(F.col("g").alias("pg"), F.col("f").alias("pf"), "total", "rows", (share * bars).alias("room"), F.least(F.lit(least), share * bars / F.col("n")).alias("narrow"))
    met = rows.join(parts, F.col("g").eqNullSafe(F.col("pg")) & (F.col("f") == F.col("pf")))
    plain = F.col("room") * F.col("size") / F.col("total")
    small = met.groupBy("pg", "pf").agg(F.sum(F.when(plain < F.col("narrow"), F.col("narrow")).otherwise(0.0)).alias("taken"), F.sum(F.when(plain >= F.col("narrow"), F.col("size")).otherwise(0.0)).alias("wide"))
    small = small.select(F.col("pg").alias("sg"), F.col("pf").alias("sf"), "taken", "wide")
    met = met.join(small, F.col("pg").eqNullSafe(F.col("sg")) & (F.col("pf") == F.col("sf")))
    width = F.when(plain < F.col("narrow"), F.col("narrow")).otherwise((F.col("room") - F.col("taken")) * F.col("size") / F.col("wide"))
    placed = met.select("row", "g", "o", width.alias("width"), F.when(F.col("rows") > 1, gap / (F.col("rows") - 1)).otherwise(0.0).alias("space"))
    sums = running_sums(placed, "g", "o", {"right": F.col("width"), "before": F.lit(1).cast("bigint")})
    right = F.col("right") + (F.col("before") - 1) * F.col("space")
    return sums.select("row.*", (right - F.col("width")).alias("left"), right.alias("right"))
