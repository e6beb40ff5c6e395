"""Fold-back edges: which of them are artefacts of reads that turn back on themselves, and where the others break.

A fold-back joins two places of one strand within a read length. Inverted pairs say nothing about it, and
the rest must agree on a place: the densest stretch of read ends that an insert allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def foldback_pairs(pairs: DataFrame, read_length: int) -> DataFrame:
    """``pairs`` (edge, qname, chrom, start, end, strand, m_chrom, m_start, m_end, m_strand, folded, m_folded) of fold-back edges, with ``x, y, inverted``.

    ``x`` and ``y`` are the reads' outer ends, signed so that outward is up: an end on +, minus a start on -. A pair is
    inverted if both reads start alike (+) or end alike (-), or if either read's other alignment overlaps it (``folded``).
    """
    outer = lambda p: F.when(F.col(f"{p}strand") == 1, F.col(f"{p}end")).otherwise(-F.col(f"{p}start"))
    one = pairs.where((F.col("chrom") == F.col("m_chrom")) & (F.col("strand") == F.col("m_strand"))).withColumns({"x": outer(""), "y": outer("m_")})
    near = one.groupBy("edge").agg(F.max("x").alias("tip1"), F.max("y").alias("tip2")).where(F.abs(F.col("tip1") - F.col("tip2")) <= read_length).select("edge")
    alike = F.when(F.col("strand") == 1, F.col("start") == F.col("m_start")).otherwise(F.col("end") == F.col("m_end"))
    return one.join(near, "edge", "left_semi").withColumn("inverted", alike | F.coalesce("folded", F.lit(False)) | F.coalesce("m_folded", F.lit(False)))


def densest_anchor(pairs: DataFrame, width: int) -> DataFrame:
    """Of each edge the end ``anchor`` that closes the stretch of ``width`` with most pairs (ties: the outermost): ``edge, anchor, dense``.

    Distinct ends are counted first, so an edge is as many rows as it has places.
    """
    places = pairs.groupBy("edge", "x").agg(F.count("*").alias("k"))
    within = Window.partitionBy("edge").orderBy("x").rangeBetween(-(width - 1), 0)
    return places.withColumn("n", F.sum("k").over(within)).groupBy("edge").agg(F.max(F.struct("n", "x")).alias("m")).select("edge", F.col("m.x").alias("anchor"), F.col("m.n").alias("dense"))


def foldback_edges(pairs: DataFrame, read_length: int, max_insert: int, support: int, refined: DataFrame | None = None) -> DataFrame:
    """Fold-back edges that are no artefacts: ``edge, chrom, strand, pos1, pos2, n_pairs, n_names, n_inverted``.

    An edge needs ``support`` names among its pairs that are not inverted, as many pairs in its densest stretch,
    whose outermost ends are the break (``refined`` (edge, pos1, pos2) may give a better one), and as many
    pairs once names are left out of which any pair starts behind the break or spans more than an insert.
    """
    rows = foldback_pairs(pairs, read_length)
    inverted = rows.groupBy("edge").agg(F.sum(F.col("inverted").cast("bigint")).alias("n_inverted"))
    kept = rows.where("not inverted")
    named = kept.groupBy("edge").agg(F.count_distinct("qname").alias("names")).where(F.col("names") >= support).select("edge")
    kept = kept.join(named, "edge", "left_semi")
    width = max(1, max_insert - 2 * read_length)
    dense = kept.join(densest_anchor(kept, width), "edge").where((F.col("x") <= F.col("anchor")) & (F.col("x") > F.col("anchor") - width))
    tips = dense.groupBy("edge").agg(F.count("*").alias("n"), F.max("x").alias("t1"), F.max("y").alias("t2")).where(F.col("n") >= support)
    if refined is not None:
        better = refined.select(F.col("edge"), F.col("pos1").alias("r1"), F.col("pos2").alias("r2"))
        signs = dense.groupBy("edge").agg(F.first("strand").alias("sign"))
        tips = tips.join(better, "edge", "left").join(signs, "edge").select("edge", F.coalesce(F.col("r1") * F.col("sign"), "t1").alias("t1"), F.coalesce(F.col("r2") * F.col("sign"), "t2").alias("t2"))
    placed = dense.join(tips.select("edge", "t1", "t2"), "edge")
    inner = lambda p: F.when(F.col("strand") == 1, F.col(f"{p}start")).otherwise(-F.col(f"{p}end"))
    bad = (F.greatest(inner(""), inner("m_")) > F.col("t1")) | (F.col("t1") - inner("") + F.col("t2") - inner("m_") > max_insert)
    excluded = placed.where(bad).select("edge", "qname").distinct()
    left = placed.join(excluded, ["edge", "qname"], "left_anti")
    found = left.groupBy("edge").agg(F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), (F.first("t1") * F.first("strand")).alias("pos1"), (F.first("t2") * F.first("strand")).alias("pos2"), F.count("*").alias("n_pairs"), F.count_distinct("qname").alias("n_names"))
    return found.where(F.col("n_pairs") >= support).join(inverted, "edge")


def both_ways(edges: DataFrame) -> DataFrame:
    """Fold-backs whose two places differ, also with their ends changed over (``turned``)."""
    back = edges.where("pos1 <> pos2").withColumns({"pos1": F.col("pos2"), "pos2": F.col("pos1")})
    return edges.withColumn("turned", F.lit(False)).unionByName(back.withColumn("turned", F.lit(True)))
