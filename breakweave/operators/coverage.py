"""Read coverage over windows of the genome, its statistics, and what counts as amplified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(counts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Distinct values and their counts ``n`` with ``upto`` (values up to this one) and ``total``, in each group."""
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def _at(rank: Column, value: str) -> Column:
    """The value at a rank (from 1), as an aggregate over a group's ranked values."""
    return F.min(F.when(F.col("upto") >= rank, F.col(value)))


def window_counts(reads: DataFrame, width: int, least_mapq: int = 5) -> DataFrame:
    """``chrom, win, n_reads, bases``: reads that start in a window, and bases of all reads within it.

    A read is cut at window bounds; both measures are sums, so they are partly added up before the shuffle.
    """
    good = reads.where(F.col("mapq") > least_mapq)
    cut = good.select("chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("win"))
    inside = F.least(F.col("end"), F.col("win") * width + width - 1) - F.greatest(F.col("start"), F.col("win") * width) + 1
    return cut.groupBy("chrom", "win").agg(F.sum((F.floor(F.col("start") / width) == F.col("win")).cast("bigint")).alias("n_reads"), F.sum(inside).alias("bases"))


def interval_coverage(intervals: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Mean depth of whole windows over each interval (chrom, start, end, ...): ``..., n_windows, depth``.

    It depends on the place alone, so distinct places are summed and repeated rows get the same values.
    """
    places = intervals.select("chrom", "start", "end").distinct()
    spread = places.withColumn("win", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    joined = spread.join(windows.select("chrom", "win", "bases"), ["chrom", "win"], "left")
    sums = joined.groupBy("chrom", "start", "end").agg(F.count("*").alias("n_windows"), (F.sum(F.coalesce("bases", F.lit(0))) / (F.count("*") * width)).alias("depth"))
    return intervals.join(sums, ["chrom", "start", "end"], "left").select(*intervals.columns, "n_windows", "depth")


def coverage_stats(windows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Upper median, mean and population deviation of a value over windows, outliers (0, or 5 medians and more) left out.

    Everything runs over distinct values and their counts, never over the windows themselves.
    """
    group, v, n = Window.partitionBy(*keys), F.col(value), F.col("n")
    counts = _ranked(windows.where(v.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), value, keys)
    half = F.col("total") / 2
    rough = (_at(F.ceil(half), value).over(group) + _at(F.floor(half) + 1, value).over(group)) / 2
    fine = counts.withColumn("rough", rough).where((v > 0) & (v < 5 * F.col("rough"))).select(*keys, value, "n")
    fine = _ranked(fine, value, keys).withColumn("mean", F.sum(n * v).over(group) / F.col("total"))
    return fine.groupBy(*keys).agg(
        F.sum("n").alias("n_windows"), _at(F.floor(half) + 1, value).alias("median"), F.first("mean").alias("mean"), F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum("n")).alias("deviation")
    )


def gc_scaling(windows: DataFrame, gc: str, value: str) -> DataFrame:
    """Mean of a value per tenth of GC content, over the mean of all."""
    tenth = F.least(F.lit(9), F.floor(F.col(gc) * 10)).cast("bigint")
    parts = windows.groupBy(tenth.alias("gc_bin")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = parts.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return parts.crossJoin(F.broadcast(whole)).select("gc_bin", "n", (F.col("s") / F.col("n") / F.col("mean")).alias("scale"))  # one row against ten


def amplified_threshold(median: Column, deviation: Column, arm_median: Column, sensitive: bool = False) -> Column:
    """Depth from which a window counts as amplified, against the genome's or the arm's median."""
    root = F.sqrt(arm_median / median)
    arm = arm_median + 3 * deviation * root
    whole = median + 3 * deviation
    if not sensitive:
        arm, whole = F.greatest(arm, arm_median + 1.5 * median), F.greatest(whole, 2.5 * median)
    return F.when(median < arm_median, arm).otherwise(whole)


def keep_share(reads: DataFrame, name: str, ratio: float) -> DataFrame:
    """Both mates of a pair stay or go together, by a hash of the pair's name; about ``ratio`` of the pairs stay."""
    draw = F.conv(F.substring(F.md5(F.col(name).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return reads.where(draw < ratio)


def mean_insert_stats(reads: DataFrame) -> DataFrame:
    """Read length and its deviation, share of proper pairs: one row."""
    size = F.col("end") - F.col("start") + 1
    return reads.agg(F.count("*").alias("n_reads"), F.avg(size).alias("read_length"), F.stddev_pop(size).alias("read_deviation"), (F.sum(F.col("proper").cast("bigint")) / F.count("*")).alias("share_proper"))


def weighted_mappability(intervals: DataFrame, track: DataFrame, width: int = 256) -> DataFrame:
    """Overlap-weighted repeat content: 5 where the score is 0, otherwise one over the score; 1 without any hit."""
    from ..functions.intervals import overlap_size
    from .overlap import overlap_join

    hit = overlap_join(intervals.select("chrom", "start", "end").distinct(), track, width=width)
    shared = overlap_size(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    weight = F.when(F.col("r_score") == 0, 5.0).otherwise(1 / F.col("r_score"))
    sums = hit.groupBy("chrom", "start", "end").agg((F.sum(shared * weight) / F.sum(shared)).alias("rep_content"))
    return intervals.join(sums, ["chrom", "start", "end"], "left").select(*intervals.columns, F.coalesce("rep_content", F.lit(1.0)).alias("rep_content"))


def segdup_uniqueness(intervals: DataFrame, duplicated: DataFrame, width: int = 256) -> DataFrame:
    """Own size over own size plus all overlaps with duplicated segments."""
    from ..functions.intervals import overlap_size
    from .overlap import overlap_join

    hit = overlap_join(intervals.select("chrom", "start", "end").distinct(), duplicated, width=width)
    sums = hit.groupBy("chrom", "start", "end").agg(F.sum(overlap_size(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("covered"))
    own = F.col("end") - F.col("start") + 1
    return intervals.join(sums, ["chrom", "start", "end"], "left").select(*intervals.columns, (own / (own + F.coalesce("covered", F.lit(0)))).alias("uniqueness"))


def arm_gained(calls: DataFrame, arms: DataFrame, whole: DataFrame, gain: float, large: int = 10_000_000) -> DataFrame:
    """Calls (chrom, start, end, cn) whose copy number exceeds the gain that their arm's depth asks for.

    ``arms`` (chrom, arm) and ``whole`` (one row: median) hold median depths. An arm above the genome's median raises
    the limit by two copies per median; a call of ``large`` bases or more also needs 1.5 times the gain.
    """
    ratios = arms.crossJoin(F.broadcast(whole)).select("chrom", (F.col("arm") / F.col("median")).alias("ratio")).where("ratio > 0")  # one row against the arms
    needed = F.lit(gain) + 2 * F.greatest(F.lit(1.0), F.col("ratio")) - 2
    small = F.col("end") - F.col("start") + 1 < large
    return calls.join(ratios, "chrom").where((F.col("cn") > needed) & (small | (F.col("cn") > 1.5 * gain))).drop("ratio")


def high_level(windows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The value that a twentieth of the windows reach (with fewer than 20 windows the least): ``keys, level``.

    Ranks run over distinct values and their counts, never over the windows themselves.
    """
    counts = _ranked(windows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), value, keys)
    rank = F.when(F.col("total") < 20, 1).otherwise(F.col("total") - F.floor(F.col("total") / 20) + 1)
    return counts.groupBy(*keys).agg(_at(rank, value).alias("level"))


def amplicon_summary(segments: DataFrame, keys: list[str], amplified: float = 2.5, high: float = 5.0) -> DataFrame:
    """Per amplicon, of its segments (start, end, cn): sizes, size-weighted copy number of what is amplified, segments above ``high``."""
    size, gained = F.col("end") - F.col("start") + 1, F.col("cn") >= amplified
    return segments.groupBy(*keys).agg(
        F.count("*").alias("n_segments"), F.sum(size).alias("total_size"), F.coalesce(F.sum(F.when(gained, size)), F.lit(0)).alias("amplified_size"),
        (F.sum(F.when(gained, size * F.col("cn"))) / F.sum(F.when(gained, size))).alias("average_cn"), F.sum((F.col("cn") > high).cast("bigint")).alias("n_high"),
    )
