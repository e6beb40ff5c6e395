"""Joins of intervals by overlap, and look-ups of the interval at a place.

Spark has no range join, so both sides are dealt into bins of the genome and joined on (chromosome, bin)
with the overlap as a residual condition. A pair that shares several bins counts in the bin where the
later of the two starts lies. Bins also spread a chromosome that holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import free_names


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(left: DataFrame, right: DataFrame, extend: int = 0, width: int = 256, how: str = "inner") -> DataFrame:
    """Join ``left`` and ``right`` (chrom, start, end, ...) where they overlap within ``extend``.

    Right columns are prefixed ``r_``. ``how``: inner, left_semi or left_anti. ``width`` should be near
    the usual length of the right intervals; it decides speed only, never the result. Rows with a null chromosome or
    bound, and rows whose start lies behind their end, overlap nothing.
    """
    mine, theirs = free_names([*left.columns, *[f"r_{c}" for c in right.columns]], "bin", "r_bin")
    sound = (F.col("start") <= F.col("end")) & F.col("chrom").isNotNull()
    r = right.where(sound).select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn(theirs, _bins(F.col("r_start"), F.col("r_end"), width))
    low, high = F.greatest(F.lit(0), F.col("start") - extend), F.col("end") + extend
    met = (F.col("chrom") == F.col("r_chrom")) & (F.col(mine) == F.col(theirs)) & (low <= F.col("r_end")) & (F.col("r_start") <= high)
    able = sound & (low <= high)
    if how == "inner":
        once = F.col(mine) == F.floor(F.greatest(low, F.col("r_start")) / width)
        return left.where(able).withColumn(mine, _bins(low, high, width)).join(r, met & once).drop(mine, theirs, "r_chrom")
    # Whether a row overlaps anything depends on its place alone, so only distinct places are joined and sent back.
    places = left.select("chrom", "start", "end").distinct().where(able)
    hit = places.withColumn(mine, _bins(low, high, width)).join(r, met, "left_semi").select("chrom", "start", "end").distinct()
    return left.join(hit, ["chrom", "start", "end"], how).select(*left.columns)


def point_join(points: DataFrame, spans: DataFrame, width: int = 256) -> DataFrame:
    """Each point (chrom, pos, ...) with every span that holds it; points and spans with nulls, and spans that end before their start, meet nothing."""
    (theirs,) = free_names([*points.columns, *[f"r_{c}" for c in spans.columns]], "r_bin")
    r = spans.where("start <= end").select(*[F.col(c).alias(f"r_{c}") for c in spans.columns]).withColumn(theirs, _bins(F.col("r_start"), F.col("r_end"), width))
    met = (F.col("chrom") == F.col("r_chrom")) & (F.floor(F.col("pos") / width) == F.col(theirs)) & F.col("pos").between(F.col("r_start"), F.col("r_end"))
    return points.join(r, met).drop(theirs, "r_chrom")


def asof_join(points: DataFrame, steps: DataFrame, value: str, bin_width: int = 4096) -> DataFrame:
    """Each point (chrom, pos, ...) with ``value`` of the last step (chrom, pos, value) at or before it on its chromosome.

    Steps sort before points at the same place, and of steps at one place the largest value counts. The
    last value runs within bins of the genome, and over one row per bin to carry it from bin to bin, so
    no chromosome is one task's sort.
    """
    steps = steps.groupBy("chrom", "pos").agg(F.max(value).alias(value))
    rest = [c for c in points.columns if c not in ("chrom", "pos")]
    both = points.select("chrom", "pos", F.struct(*rest).alias("__p"), F.lit(None).cast(steps.schema[value].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(
        steps.select("chrom", "pos", F.lit(None).cast(points.select(F.struct(*rest).alias("x")).schema["x"].dataType).alias("__p"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    )
    both = both.withColumn("__bin", F.floor(F.col("pos") / bin_width))
    over_bins = Window.partitionBy("chrom").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy("chrom", "__bin").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("pos"))).alias("__top"))
    bins = bins.select("chrom", "__bin", F.last("__top", ignorenulls=True).over(over_bins).alias("__carry"))
    inside = Window.partitionBy("chrom", "__bin").orderBy("pos", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1").join(bins, ["chrom", "__bin"])
    return found.select("chrom", "pos", *[F.col("__p")[c].alias(c) for c in rest], F.coalesce("__last", "__carry").alias(value))


def band_top1(left: DataFrame, right: DataFrame, band: int, order: list[Column], key: list[str]) -> DataFrame:
    """For each left row (chrom, pos, ...), the first by ``order`` of the right rows (chrom, pos, ...) at most ``band`` away."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r_bin", F.explode(F.array(*[F.floor(F.col("r_pos") / band) + k for k in (-1, 0, 1)])))
    met = (F.col("chrom") == F.col("r_chrom")) & (F.floor(F.col("pos") / band) == F.col("r_bin")) & (F.abs(F.col("pos") - F.col("r_pos")) <= band)
    first = Window.partitionBy(*key).orderBy(*order)
    return left.join(r, met).drop("r_bin", "r_chrom").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def _running(rows: DataFrame, bin_width: int) -> DataFrame:
    """``rows`` (chrom, pos, k, far; a row per place) with ``v``: sum of ``k`` and largest ``far`` up to each place, the place and the next one; and a row before each chromosome's first place. In two levels, by bins."""
    rows = rows.withColumn("bin", F.floor(F.col("pos") / bin_width))
    over_bins = Window.partitionBy("chrom").orderBy("bin")
    before = over_bins.rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("chrom", "bin").agg(F.sum("k").alias("sum"), F.max("far").alias("top"), F.min("pos").alias("first"))
    bins = bins.select("chrom", "bin", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("b_k"), F.max("top").over(before).alias("b_far"), F.lead("first").over(over_bins).alias("b_next"))
    order = Window.partitionBy("chrom", "bin").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"s_k": F.sum("k").over(so_far), "s_far": F.max("far").over(so_far), "s_next": F.lead("pos").over(order)}).join(bins, ["chrom", "bin"])
    value = lambda k, far, pos, after: F.struct(k.alias("k"), far.alias("far"), pos.alias("pos"), after.alias("next")).alias("v")
    none = F.lit(None).cast("bigint")
    head = rows.groupBy("chrom").agg(F.min("pos").alias("first")).select("chrom", F.lit(-(1 << 62)).alias("pos"), value(F.lit(0).cast("bigint"), none, none, F.col("first")))
    return rows.select("chrom", "pos", value(F.col("b_k") + F.col("s_k"), F.greatest("b_far", "s_far"), F.col("pos"), F.coalesce("s_next", "b_next"))).unionByName(head)


def overlap_homology(reads: DataFrame, spans: DataFrame, bin_width: int = 4096) -> DataFrame:
    """For every distinct span (chrom, start, end) that reads overlap: their number ``n``, and ``least`` and ``most`` of their homology with it.

    A read's homology (``functions.sequences.homology``) runs from the later start to the end of what began first. No read meets a
    span: numbers are differences of running counts at the span's bounds, and the extremes belong to reads next to these,
    so the work grows with the places and not with the depth. Rows with nulls, or that end before their start, overlap nothing.
    """
    sound = (F.col("start") <= F.col("end")) & F.col("chrom").isNotNull()
    reads, places = reads.where(sound), spans.select("chrom", "start", "end").where(sound).distinct()
    starts = reads.groupBy("chrom", F.col("start").alias("pos")).agg(F.count("*").alias("k"), F.max("end").alias("far"))
    ends = reads.groupBy("chrom", F.col("end").alias("pos")).agg(F.count("*").alias("k"), F.min("start").alias("far"))
    opened, closed = _running(starts, bin_width), _running(ends, bin_width)
    at = lambda frame, pos: frame.select("chrom", pos.alias("pos"), *[c for c in frame.columns if c != "chrom"])
    found = asof_join(at(places, F.col("end")), opened, "v").select("chrom", "start", "end", F.col("v.k").alias("upto"), F.col("v.pos").alias("last"))
    found = asof_join(at(found, F.col("start")), opened, "v").select(*found.columns, F.col("v.far").alias("far"), F.col("v.next").alias("next"))
    found = asof_join(at(found, F.col("start") - 1), closed, "v").select(*found.columns, (F.coalesce("upto", F.lit(0)) - F.coalesce("v.k", F.lit(0))).alias("n")).where("n > 0")
    # The first end behind a span's start of a read that began before it: an end counts only where the one before it does not.
    order = Window.partitionBy("chrom", "bin").orderBy("pos")
    ends = ends.withColumn("bin", F.floor(F.col("pos") / bin_width)).select("chrom", F.col("far").alias("low"), "pos", F.lag("pos").over(order).alias("p"), F.lag("far").over(order).alias("p_low"))
    part = lambda low, high: F.struct(low.alias("start"), high.alias("end"))
    parts = F.when(F.col("p").isNull(), F.array(part(F.col("low"), F.col("pos")))).otherwise(F.array(part(F.greatest(F.col("low"), F.col("p") + 1), F.col("pos")), part(F.col("low"), F.least(F.col("p"), F.col("p_low") - 1))))
    pieces = ends.select("chrom", "pos", F.explode(parts).alias("x")).select("chrom", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("pos").alias("stop")).where("start <= end")
    firsts = point_join(places.select("chrom", F.col("start").alias("pos")).distinct(), pieces).groupBy("chrom", F.col("pos").alias("start")).agg(F.min("r_stop").alias("stop"))
    found = found.join(firsts, ["chrom", "start"], "left")
    inside = lambda place, on: F.when(on, F.col("end") - F.col(place) + 1)
    least = F.least(F.col("stop") - F.col("start") + 1, inside("last", F.col("last") > F.col("start")))
    most = F.greatest(F.when(F.col("far") >= F.col("start"), F.col("far") - F.col("start") + 1), inside("next", F.col("next") <= F.col("end")))
    return found.select("chrom", "start", "end", "n", least.alias("least"), most.alias("most"))
