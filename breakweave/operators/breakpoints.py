"""Breakpoint edges: exact places from split reads, support, quality, and copy-number steps that lack an edge.

An edge is a row (edge, chrom1, pos1, strand1, chrom2, pos2, strand2, ...); ``edge`` names it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .overlap import overlap_join, point_join
from .pairs import pair_edges
from .work import WorkTables

#: Alignments of one read up to which all of them are paired with each other.
CROWD = 64
EDGE = ("edge", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2")


def turned(edges: DataFrame) -> DataFrame:
    """The edges read from their other end; other columns stay."""
    swap = {f"{c}{a}": F.col(f"{c}{b}") for c in ("chrom", "pos", "strand") for a, b in ((1, 2), (2, 1))}
    return edges.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in edges.columns])


def _window(side: int, reach: int) -> tuple[Column, Column]:
    """First and last place from which an alignment reaches back from one end of an edge."""
    pos, plus = F.col(f"pos{side}"), F.col(f"strand{side}") == 1
    return F.greatest(F.lit(0), F.when(plus, pos - reach).otherwise(pos)), F.when(plus, pos).otherwise(pos + reach)


def _aligned(x: Callable[[str], Column], strand: Column) -> Column:
    return F.struct(x("q_start").alias("q_start"), x("q_end").alias("q_end"), F.when(strand == 1, x("end")).otherwise(x("start")).alias("place"), x("mapq").alias("mapq"))


def _near_end(edges: DataFrame, alignments: DataFrame, side: int, reach: int) -> DataFrame:
    """One row per edge and read key for the alignments that reach back from one end; keys that two alignments share are left out.

    The second side's key is written as the first side's alignment of the same read must have it:
    the other of primary and secondary, and the other direction where both ends have one strand.
    """
    low, high = _window(side, reach)
    same = (F.col("strand1") == F.col("strand2")) if side == 2 else F.lit(False)
    spans = edges.select("edge", F.col(f"chrom{side}").alias("chrom"), low.alias("start"), high.alias("end"), F.col(f"strand{side}").alias("strand"), same.alias("same"))
    met = overlap_join(spans, alignments, width=max(256, reach))
    secondary = ~F.col("r_secondary") if side == 2 else F.col("r_secondary")
    keyed = met.select("edge", F.col("r_qname").alias("qname"), F.col("r_first").alias("first"), (F.col("r_reverse") != F.col("same")).alias("reverse"), secondary.alias("secondary"), _aligned(lambda c: F.col(f"r_{c}"), F.col("strand")).alias("x"))
    return keyed.groupBy("edge", "qname", "first", "reverse", "secondary").agg(F.max("x").alias(f"x{side}"), F.count("*").alias("n")).where("n = 1").drop("n")


def _paired(edges: DataFrame, alignments: DataFrame, reach: int) -> DataFrame:
    """What joining ``_near_end`` of both sides gives: ``edge, qname, first, reverse, secondary, x1, x2``, by pairing the alignments of each read before any edge is looked at.

    Every alignment of a key at one end comes with every one at the other, so a key has one of each exactly if it has one row.
    """
    width = max(256, reach)
    sound = (F.col("start") <= F.col("end")) & F.col("chrom").isNotNull()
    rows = alignments.where(sound).select("qname", "first", "reverse", "secondary", "chrom", "start", "end", "q_start", "q_end", "mapq")
    x = rows.select("qname", "first", *[F.col(c).alias(f"x_{c}") for c in rows.columns[2:]])
    y = rows.select("qname", "first", *[F.col(c).alias(f"y_{c}") for c in rows.columns[2:]])
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    (low1, high1), (low2, high2) = _window(1, reach), _window(2, reach)
    ends = edges.select("edge", F.col("chrom1").alias("x_chrom"), low1.alias("low1"), high1.alias("high1"), "strand1", F.col("chrom2").alias("y_chrom"), low2.alias("low2"), high2.alias("high2"), "strand2", (F.col("strand1") == F.col("strand2")).alias("same"))
    ends = ends.where("low1 <= high1 and low2 <= high2").withColumn("bin1", bins(F.col("low1"), F.col("high1"))).withColumn("bin2", bins(F.col("low2"), F.col("high2")))
    pairs = x.join(y, ["qname", "first"]).where("x_secondary != y_secondary").withColumn("same", F.col("x_reverse") != F.col("y_reverse"))
    pairs = pairs.withColumn("bin1", bins(F.col("x_start"), F.col("x_end"))).withColumn("bin2", bins(F.col("y_start"), F.col("y_end")))
    met = pairs.join(ends, ["x_chrom", "bin1", "y_chrom", "bin2", "same"]).where("low1 <= x_end and x_start <= high1 and low2 <= y_end and y_start <= high2")
    met = met.where((F.col("bin1") == F.floor(F.greatest("low1", "x_start") / width)) & (F.col("bin2") == F.floor(F.greatest("low2", "y_start") / width)))
    met = met.select("edge", "qname", "first", F.col("x_reverse").alias("reverse"), F.col("x_secondary").alias("secondary"), _aligned(lambda c: F.col(f"x_{c}"), F.col("strand1")).alias("x1"), _aligned(lambda c: F.col(f"y_{c}"), F.col("strand2")).alias("x2"))
    return met.groupBy("edge", "qname", "first", "reverse", "secondary").agg(F.max("x1").alias("x1"), F.max("x2").alias("x2"), F.count("*").alias("n")).where("n = 1").drop("n")


def split_matches(edges: DataFrame, alignments: DataFrame, reach: int) -> DataFrame:
    """Split reads with one part at each end of an edge: ``edge, hom, p1, p2, mapq1, mapq2``, a row per read.

    ``alignments`` (qname, first, reverse, secondary, chrom, start, end, q_start, q_end, mapq) hold the
    span of the read that each covers. ``hom`` counts bases in both spans (negative: bases in neither).
    Reads whose one span holds the other, or whose order contradicts the edge's direction, don't count.
    Alignments of one read are paired and then meet the edges; reads of more than ``CROWD`` alignments meet the edges first.
    """
    spark, read = edges.sparkSession, ["qname", "first"]
    crowded = WorkTables(spark).save(alignments.groupBy(*read).count().where(F.col("count") > CROWD).select(*read), "crowded")
    if crowded.isEmpty():
        both = _paired(edges, alignments, reach)
    else:
        many = alignments.join(crowded, read, "left_semi")
        key = ["edge", *read, "reverse", "secondary"]
        both = _paired(edges, alignments.join(crowded, read, "left_anti"), reach).unionByName(_near_end(edges, many, 1, reach).join(_near_end(edges, many, 2, reach), key))
    ahead = (F.col("x1.q_start") <= F.col("x2.q_start")) & (F.col("x1.q_end") <= F.col("x2.q_end"))
    behind = (F.col("x1.q_start") >= F.col("x2.q_start")) & (F.col("x1.q_end") >= F.col("x2.q_end"))
    hom = F.when(ahead, F.col("x1.q_end") - F.col("x2.q_start") + 1).when(behind, F.col("x2.q_end") - F.col("x1.q_start") + 1)
    facts = edges.select("edge", (F.col("strand1") == 1).alias("plus"), ((F.col("chrom1") == F.col("chrom2")) & (F.col("pos1") == F.col("pos2")) & (F.col("strand1") == F.col("strand2"))).alias("loop"))
    rows = both.withColumn("hom", hom).withColumn("ahead", ahead).where("hom is not null").join(facts, "edge")
    fits = ((F.col("plus") == ~F.col("reverse")) == F.col("ahead")) & (~F.col("loop") | (F.col("x1.place") >= F.col("x2.place")))
    return rows.where(fits).select("edge", "hom", F.col("x1.place").alias("p1"), F.col("x2.place").alias("p2"), F.col("x1.mapq").alias("mapq1"), F.col("x2.mapq").alias("mapq2"))


def refine_edges(edges: DataFrame, alignments: DataFrame, reach: int) -> DataFrame:
    """Edges with the places and homology that most split reads show: ``edge, p1, p2, hom, n, mapq1, mapq2`` (largest qualities).

    An edge without split reads, or with several most frequent places, has no row.
    """
    counted = split_matches(edges, alignments, reach).groupBy("edge", "hom", "p1", "p2").agg(F.count("*").alias("n"), F.max("mapq1").alias("mapq1"), F.max("mapq2").alias("mapq2"))
    order = Window.partitionBy("edge")
    return counted.withColumn("most", F.max("n").over(order)).where("n = most").withColumn("ties", F.count("*").over(order)).where("ties = 1").drop("most", "ties")


def good_quality(mapq1: Column, mapq2: Column, entropy1: Column, entropy2: Column, least_mapq: int = 20, least_entropy: float = 0.75) -> Column:
    """The best read at each end maps well and is not of low complexity."""
    return (F.least(mapq1, mapq2) >= least_mapq) & (F.least(entropy1, entropy2) >= least_entropy)


def artefact(edges: DataFrame, max_insert: int) -> DataFrame:
    """``edges`` with ``kind`` and ``artefact``: everted or discordant within one insert length of itself."""
    from ..functions.edges import edge_type

    kind = edge_type(*[F.col(c) for c in EDGE[1:]])
    close = (F.col("chrom1") == F.col("chrom2")) & (F.abs(F.col("pos1") - F.col("pos2")) < max_insert)
    return edges.withColumn("kind", kind).withColumn("artefact", close & F.col("kind").isin("everted", "discordant"))


def interval_edges(pairs: DataFrame, intervals: DataFrame, masks: DataFrame, extend: int, support: int, max_insert: int, tables: WorkTables, width: int = 256) -> DataFrame:
    """Supported edges that start in the intervals, by pairs of reads none of which lies in a mask.

    A pair is looked at from both of its reads. Pairs whose reads overlap each other don't count, nor
    do edges that close on themselves within an insert length.
    """
    sides = ("chrom", "start", "end", "strand")
    flip = {**{c: f"m_{c}" for c in sides}, **{f"m_{c}": c for c in sides}}
    both = pairs.unionByName(pairs.select(*[F.col(flip.get(c, c)).alias(c) for c in pairs.columns]).withColumn("pair", F.concat("pair", F.lit("/back"))))
    apart = (F.col("chrom") != F.col("m_chrom")) | (F.col("end") < F.col("m_start")) | (F.col("m_end") < F.col("start"))
    other = lambda f: f.select(*[F.col(flip.get(c, c)).alias(c) for c in f.columns])
    kept = tables.save(overlap_join(both.where(apart), intervals, width=width, how="left_semi"), "inside")
    kept = tables.save(overlap_join(kept, masks, width=width, how="left_anti"), "clear")
    kept = tables.save(other(overlap_join(other(kept), masks, width=width, how="left_anti")), "kept")
    found = pair_edges(kept, extend, support, tables).withColumn("edge", F.concat_ws("/", *EDGE[1:]))
    return artefact(found, max_insert).where("not artefact").drop("artefact")


def concordant_support(vertices: DataFrame, pairs: DataFrame, max_insert: int, read_length: int, support: int, margin: int = 0) -> DataFrame:
    """``vertices`` (chrom, pos, strand) with ``n``, the proper pairs spanning each, and ``partner``, the vertex it is joined to if ``n`` exceeds ``support``.

    ``pairs`` (chrom, start, end, m_chrom, m_start) hold the forward read first. A pair spans the places
    after its start up to its mate's start, as long as it is no longer than an insert.
    """
    spanning = pairs.where((F.col("chrom") == F.col("m_chrom")) & (F.col("m_start") < F.col("start") + max_insert - read_length) & (F.col("m_start") > F.col("start") + margin))
    spans = spanning.groupBy("chrom", (F.col("start") + margin + 1).alias("start"), F.col("m_start").alias("end")).agg(F.max("end").alias("last"), F.count("*").alias("k"))
    places = vertices.select("chrom", "pos").distinct()
    met = point_join(places, spans, width=max(256, max_insert)).groupBy("chrom", "pos").agg(F.sum("r_k").alias("n"), F.min("r_end").alias("first"), F.max("r_last").alias("last"))
    partner = F.when(F.col("strand") == 1, F.greatest(F.col("pos") + 1, "first")).otherwise(F.least(F.col("pos") - 1, "last"))
    return vertices.join(met, ["chrom", "pos"], "left").select(*vertices.columns, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > support, partner).alias("partner"))


def expected_support(level: Column, step: Column, depth: Column, insert: Column, read_length: Column, proper: Column, floor: Column, sensitive: bool = False) -> Column:
    """Pairs that an edge must have at a place of copy number ``level``, or of a step ``step`` in the edge's direction (null: none)."""
    cn = F.greatest(F.lit(1.0), F.coalesce(step, level))
    cn = F.least(cn, F.lit(10.0)) if sensitive else cn
    return F.greatest(depth * cn / 20 * ((insert - read_length) / 2 / read_length) * proper, F.lit(2.0), floor)


def step_edges(steps: DataFrame, edges: DataFrame, max_insert: int, fine: int = 300, coarse: int = 10_000) -> DataFrame:
    """``steps`` (chrom, pos, drop, refined) with the edge that explains each: ``edge, support``, null where none does.

    An edge explains a step if it leads out of the higher side (strand times drop positive) and starts
    within an insert length plus the step's precision. Edges within ``fine`` of it come first, then
    the better supported, then the last name.
    """
    band = max_insert + coarse
    r = edges.select(F.col("edge").alias("r_edge"), F.col("chrom1").alias("r_chrom"), F.col("pos1").alias("r_pos"), F.col("strand1").alias("r_strand"), F.col("support").alias("r_support"))
    r = r.withColumn("r_bin", F.explode(F.array(*[F.floor(F.col("r_pos") / band) + k for k in (-1, 0, 1)])))
    away = F.abs(F.col("pos") - F.col("r_pos"))
    met = (F.col("chrom") == F.col("r_chrom")) & (F.floor(F.col("pos") / band) == F.col("r_bin")) & (F.col("r_strand") * F.col("drop") > 0) & (away < max_insert + F.when(F.col("refined"), fine).otherwise(coarse))
    best = steps.join(r, met).groupBy(*steps.columns).agg(F.max(F.struct((away < fine).alias("near"), F.col("r_support").alias("support"), F.col("r_edge").alias("edge"))).alias("b"))
    best = best.select(*[F.col(c).alias(f"b_{c}") for c in steps.columns], F.col("b.edge").alias("edge"), F.col("b.support").alias("support"))
    alike = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in steps.columns]
    on = alike[0]
    for c in alike[1:]:
        on = on & c
    return steps.distinct().join(best, on, "left").select(*steps.columns, "edge", "support")


def sensitive_edges(edges: DataFrame, weak: DataFrame, steps: DataFrame, intervals: DataFrame, max_insert: int, fine: int = 300, coarse: int = 10_000) -> DataFrame:
    """``edges`` and, for every refined step that none of them explains, the best of the ``weak`` ones around it, from its other end too where that lies in the intervals."""
    bare = step_edges(steps.where("refined"), edges, max_insert, fine, coarse).where("edge is null").drop("edge", "support")
    wide = step_edges(bare.withColumn("refined", F.lit(False)), weak, max_insert, fine, coarse).where("edge is not null").select("edge").distinct()
    added = weak.join(wide, "edge", "left_semi")
    ends = overlap_join(added.select("edge", F.col("chrom2").alias("chrom"), F.col("pos2").alias("start"), F.col("pos2").alias("end")), intervals, how="left_semi").select("edge").distinct()
    back = turned(added.join(ends, "edge", "left_semi")).withColumn("edge", F.concat_ws("/", *EDGE[1:]))
    place = list(EDGE[1:])
    fresh = added.unionByName(back.join(added.select(*place), place, "left_anti")).join(edges.select(*place), place, "left_anti")
    return edges.unionByName(fresh.select(*edges.columns))


def touches(edges: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Edges with either end in a region."""
    inside = lambda k: (F.col(f"chrom{k}") == chrom) & F.col(f"pos{k}").between(start, end)
    return edges.where(inside(1) | inside(2))


def supplementary_near(tag: Column, chrom: Column, start: Column, end: Column, reverse: Column, read_length: int) -> Column:
    """Whether an alignment's first supplementary one (``chrom,pos,strand,...``) lies within a read length on the same chromosome, turned round."""
    f = F.split(tag, ",")
    at = F.get(f, F.lit(1)).try_cast("bigint")
    near = F.least(F.abs(at - start), F.abs(at - end)) <= read_length
    return F.coalesce((F.get(f, F.lit(0)) == chrom) & ((F.get(f, F.lit(2)) == "+") == reverse) & near, F.lit(False))
