"""Merging, counting and splitting of interval sets.

What runs along a chromosome (the furthest end so far, the depth so far) is computed in two levels:
within bins of the genome in parallel, and over one row per bin to carry results from bin to bin. So a
chromosome with most of the rows is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none of them is a column (letter case does not tell columns apart)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def label_clusters(intervals: DataFrame, extend: int = 0, bin_width: int = BIN) -> DataFrame:
    """``intervals`` with ``cluster``: a number per chromosome, the same for intervals connected by overlap within ``extend``.

    Bounds may come in either order. Rows with a null chromosome or bound are in no cluster and are left
    out; all columns stay, of any name but ``cluster``, which is replaced.
    """
    intervals = intervals.drop("cluster")
    low, high, part, carry, furthest, opens, run, before, top, n = free_names(intervals.columns, "low", "high", "bin", "carry", "furthest", "opens", "run", "before", "top", "n")
    rows = intervals.withColumns({low: F.least("start", "end"), high: F.greatest("start", "end")}).where(F.col("chrom").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    rows = rows.withColumn(part, F.floor(F.col(low) / bin_width))
    over_bins = Window.partitionBy("chrom").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("chrom", part).agg(F.max(high).alias(top)).withColumn(carry, F.max(top).over(over_bins)).select("chrom", part, carry)
    inside = Window.partitionBy("chrom", part).orderBy(low, high)
    reached = F.greatest(F.col(carry), F.max(high).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(carried, ["chrom", part]).withColumn(furthest, reached)
    rows = rows.withColumn(opens, (F.col(furthest).isNull() | (F.col(low) > F.col(furthest) + extend)).cast("bigint"))
    # Rows with equal bounds come in any order, but only the first of them can open a cluster.
    rows = rows.withColumn(run, F.sum(opens).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = rows.groupBy("chrom", part).agg(F.sum(opens).alias(n)).withColumn(before, F.coalesce(F.sum(n).over(over_bins), F.lit(0))).select("chrom", part, before)
    return rows.join(earlier, ["chrom", part]).select(*intervals.columns, (F.col(before) + F.col(run)).alias("cluster"))


def merge_clusters(intervals: DataFrame, extend: int = 0) -> DataFrame:
    """Hull and number of members of every cluster: ``chrom, start, end, members``."""
    return label_clusters(intervals, extend).groupBy("chrom", "cluster").agg(F.min(F.least("start", "end")).alias("start"), F.max(F.greatest("start", "end")).alias("end"), F.count("*").alias("members")).drop("cluster")


def depth_steps(intervals: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Where the number of intervals changes: ``chrom, pos, next_pos, depth`` (depth holds from pos to next_pos - 1)."""
    ends = intervals.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).withColumn("bin", F.floor(F.col("pos") / bin_width))
    over_bins = Window.partitionBy("chrom").orderBy("bin")
    bins = steps.groupBy("chrom", "bin").agg(F.sum("d").alias("d"), F.min("pos").alias("first"))
    bins = bins.select("chrom", "bin", F.coalesce(F.sum("d").over(over_bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"), F.lead("first").over(over_bins).alias("after"))
    inside = Window.partitionBy("chrom", "bin").orderBy("pos")
    steps = steps.join(bins, ["chrom", "bin"]).select("chrom", "pos", F.coalesce(F.lead("pos").over(inside), F.col("after")).alias("next_pos"), (F.col("carry") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("depth"))
    return steps.where(F.col("next_pos").isNotNull())


def depth_regions(intervals: DataFrame, least: int) -> DataFrame:
    """Maximal regions that at least ``least`` intervals cover: ``chrom, start, end``."""
    deep = depth_steps(intervals).where(F.col("depth") >= least).select("chrom", F.col("pos").alias("start"), (F.col("next_pos") - 1).alias("end"))
    return merge_clusters(deep, extend=1).drop("members")


def atomize(first: DataFrame, second: DataFrame) -> DataFrame:
    """Disjoint atoms of two interval sets with the number of intervals of each over them: ``chrom, start, end, n_first, n_second``."""
    cuts = lambda f: f.select("chrom", F.explode(F.array("start", F.col("end") + 1)).alias("pos"))
    marks = lambda f, side: f.select("chrom", "start", "end", F.lit(1 - side).alias("x"), F.lit(side).alias("y"))
    both = marks(first, 0).unionByName(marks(second, 1))
    ends = both.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("x").alias("x"), F.col("y").alias("y")), F.struct((F.col("end") + 1).alias("pos"), (-F.col("x")).alias("x"), (-F.col("y")).alias("y")))).alias("e"))
    steps = ends.groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.x").alias("x"), F.sum("e.y").alias("y")).withColumn("bin", F.floor(F.col("pos") / BIN))
    over_bins = Window.partitionBy("chrom").orderBy("bin")
    past = over_bins.rowsBetween(Window.unboundedPreceding, -1)
    bins = steps.groupBy("chrom", "bin").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min("pos").alias("first"))
    bins = bins.select("chrom", "bin", F.coalesce(F.sum("sx").over(past), F.lit(0)).alias("cx"), F.coalesce(F.sum("sy").over(past), F.lit(0)).alias("cy"), F.lead("first").over(over_bins).alias("after"))
    inside = Window.partitionBy("chrom", "bin").orderBy("pos")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    atoms = steps.join(bins, ["chrom", "bin"]).select(
        "chrom", F.col("pos").alias("start"), (F.coalesce(F.lead("pos").over(inside), F.col("after")) - 1).alias("end"),
        (F.col("cx") + F.sum("x").over(run)).alias("n_first"), (F.col("cy") + F.sum("y").over(run)).alias("n_second"),
    )
    return atoms.where("end is not null and n_first + n_second > 0")


def subtract(intervals: DataFrame, masks: DataFrame, pad: int = 0, width: int = 256) -> DataFrame:
    """What is left of each interval outside the masks widened by ``pad``; a piece starts and ends on the padded bounds.

    Other columns of ``intervals`` are kept on every piece, and repeated rows are cut each. Masks are merged
    first; what is left depends on a row's place alone, so each distinct place meets the masks once.
    """
    from .overlap import overlap_join

    solid = merge_clusters(masks, extend=2 * pad).select("chrom", F.greatest(F.lit(0), F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    places = intervals.select("chrom", "start", "end").distinct()
    hits = overlap_join(places, solid, width=width).groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_set(F.struct("r_start", "r_end"))).alias("m"))
    # Gaps lie between the end of one mask and the start of the next.
    lefts = F.concat(F.array("start"), F.transform("m", lambda x: x["r_end"]))
    rights = F.concat(F.transform("m", lambda x: x["r_start"]), F.array("end"))
    gaps = F.filter(F.arrays_zip(lefts.alias("a"), rights.alias("b")), lambda g: g["a"] < g["b"])
    whole = F.array(F.struct(F.col("start").alias("a"), F.col("end").alias("b")))
    hits = hits.select(F.col("chrom").alias("h_chrom"), F.col("start").alias("h_start"), F.col("end").alias("h_end"), gaps.alias("gaps"))
    same = (F.col("chrom") == F.col("h_chrom")) & (F.col("start") == F.col("h_start")) & (F.col("end") == F.col("h_end"))
    cut = intervals.join(hits, same, "left").withColumn("g", F.explode(F.when(F.col("h_chrom").isNull(), whole).otherwise(F.col("gaps"))))
    return cut.select(*[F.col("g.a").alias(c) if c == "start" else F.col("g.b").alias(c) if c == "end" else F.col(c) for c in intervals.columns])
