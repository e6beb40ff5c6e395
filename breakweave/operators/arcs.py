"""Reads that lead out of a set of intervals, and copy-number shifts that no edge explains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .breakpoints import step_edges
from .overlap import overlap_join


def outside_reads(mated: DataFrame, intervals: DataFrame, width: int = 4096) -> DataFrame:
    """``mated`` (chrom, start, end, strand, m_chrom, m_start; null: mate unmapped) whose mate is unmapped or in none of all the intervals, counted per place: ``chrom, start, end, strand, k``."""
    counted = mated.groupBy("chrom", "start", "end", "strand", "m_chrom", "m_start").agg(F.count("*").alias("k"))
    mates = counted.select(F.struct("chrom", "start", "end", "strand", "k").alias("own"), F.col("m_chrom").alias("chrom"), F.col("m_start").alias("start"), F.col("m_start").alias("end"))
    lost = mates.where("chrom is null or start is null").select("own")
    away = overlap_join(mates.where("chrom is not null and start is not null"), intervals.select("chrom", "start", "end"), width=width, how="left_anti").select("own")
    return lost.unionByName(away).groupBy(*[F.col(f"own.{c}").alias(c) for c in ("chrom", "start", "end", "strand")]).agg(F.sum("own.k").alias("k"))


def crossing_arcs(places: DataFrame, outside: DataFrame, width: int = 4096) -> DataFrame:
    """``places`` (chrom, start, end, strand, ...) with ``arcs``: outside reads of the strand that meet each."""
    spots = places.select("chrom", "start", "end", "strand").distinct()
    met = overlap_join(spots, outside, width=width).where("strand = r_strand").groupBy("chrom", "start", "end", "strand").agg(F.sum("r_k").alias("arcs"))
    return places.join(met, ["chrom", "start", "end", "strand"], "left").select(*places.columns, F.coalesce("arcs", F.lit(0)).alias("arcs"))


def bare_shifts(shifts: DataFrame, edges: DataFrame, max_insert: int, precision: int) -> DataFrame:
    """``shifts`` (chrom, pos, drop) without an edge that leads out of the higher side within an insert length plus the precision, as vertices ``chrom, pos, strand``.

    ``pos`` is the last place before a shift. A fall leaves the interval at it (+), a rise enters behind it (-).
    """
    left = step_edges(shifts.withColumn("refined", F.lit(True)), edges, max_insert, precision, precision).where("edge is null")
    return left.select("chrom", F.when(F.col("drop") > 0, F.col("pos")).otherwise(F.col("pos") + 1).alias("pos"), F.when(F.col("drop") > 0, 1).otherwise(-1).alias("strand")).distinct()
