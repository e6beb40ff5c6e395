"""Edits of cycle sets where overlapping, not only equal, segments meet: hybrid segments, new ids, and what is left of the copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE = "0"


def _flip(steps: Column) -> Column:
    return F.transform(F.reverse(steps), lambda s: F.struct(s["seg"].alias("seg"), (-s["orient"]).alias("orient")))


def _before(steps: Column, place: Column) -> Column:
    return F.slice(steps, F.lit(1), place - 1)


def _behind(steps: Column, place: Column) -> Column:
    return F.slice(steps, place + 1, F.greatest(F.lit(0), F.size(steps) - place))


def _with_segments(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """``edits`` (grp, seg1, seg2, ...) with both segments' places: ``chrom_1, start_1, end_1`` and so on (null: no such segment)."""
    for k in (1, 2):
        own = segments.select(F.col("grp").alias(f"g{k}"), F.col("seg").alias(f"id{k}"), F.col("chrom").alias(f"chrom_{k}"), F.col("start").alias(f"start_{k}"), F.col("end").alias(f"end_{k}"))
        edits = edits.join(own, F.col("grp").eqNullSafe(F.col(f"g{k}")) & (F.col(f"seg{k}") == F.col(f"id{k}")), "left").drop(f"g{k}", f"id{k}")
    return edits


def _overlap() -> Column:
    return (F.col("chrom_1") == F.col("chrom_2")) & (F.col("start_1") <= F.col("end_2")) & (F.col("start_2") <= F.col("end_1"))


def judged_merges(cycles: DataFrame, segments: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (grp, c1, c2, i, j; places from 1) with both cycles and ``problem``, null where the edit can be made.

    A cycle through the source becomes the first one. Problems: ``two sources``, ``source segment`` (the source itself is asked
    for), ``no copies`` (either copy number is not above 0), ``no overlap``, ``no such place``.
    """
    passes = lambda c: F.exists(c, lambda s: s["seg"] == SOURCE)
    for k in ("1", "2"):
        own = cycles.select(F.col("grp").alias(f"g{k}"), F.col("cycle").alias(f"n{k}"), F.col("cn").alias(f"cn{k}"), F.col("segments").alias(f"s{k}"))
        edits = edits.join(own, F.col("grp").eqNullSafe(F.col(f"g{k}")) & (F.col(f"c{k}") == F.col(f"n{k}")), "left").drop(f"g{k}", f"n{k}")
    one = edits.withColumn("both", F.coalesce(passes("s1") & passes("s2"), F.lit(False))).withColumn("swap", F.coalesce(passes("s2") & ~passes("s1"), F.lit(False)))
    turn = lambda a, b: F.when(F.col("swap"), F.col(b)).otherwise(F.col(a))
    rows = one.select("grp", "both", *[turn(a, b).alias(a) for x, y in (("c1", "c2"), ("cn1", "cn2"), ("s1", "s2"), ("i", "j")) for a, b in ((x, y), (y, x))])
    rows = rows.withColumns({"e1": F.get("s1", F.col("i") - 1), "e2": F.get("s2", F.col("j") - 1)}).withColumns({"seg1": F.col("e1.seg"), "seg2": F.col("e2.seg")})
    rows = _with_segments(rows, segments)
    problem = F.when(F.col("both"), "two sources").when(F.col("e1").isNull() | F.col("e2").isNull(), "no such place").when((F.col("seg1") == SOURCE) | (F.col("seg2") == SOURCE), "source segment")
    problem = problem.when(~((F.col("cn1") > 0) & (F.col("cn2") > 0)), "no copies").when(~F.coalesce(_overlap(), F.lit(False)), "no overlap")
    return rows.withColumn("problem", problem).drop("both")


def judged_pivots(cycles: DataFrame, segments: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (grp, c1, i, j; i < j) with the cycle and ``problem``: ``no such place``, ``source segment``, ``same way`` (both places pass alike), ``no overlap``."""
    own = cycles.select(F.col("grp").alias("g1"), F.col("cycle").alias("n1"), F.col("cn").alias("cn1"), F.col("segments").alias("s1"))
    rows = edits.join(own, F.col("grp").eqNullSafe(F.col("g1")) & (F.col("c1") == F.col("n1")), "left").drop("g1", "n1")
    rows = rows.withColumns({"e1": F.get("s1", F.col("i") - 1), "e2": F.get("s1", F.col("j") - 1)}).withColumns({"seg1": F.col("e1.seg"), "seg2": F.col("e2.seg")})
    rows = _with_segments(rows, segments)
    problem = F.when(F.col("e1").isNull() | F.col("e2").isNull() | (F.col("i") >= F.col("j")), "no such place").when((F.col("seg1") == SOURCE) | (F.col("seg2") == SOURCE), "source segment")
    return rows.withColumn("problem", problem.when(F.col("e1.orient") == F.col("e2.orient"), "same way").when(~F.coalesce(_overlap(), F.lit(False)), "no overlap"))


def _hybrids(rows: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``h1, h2``, the ids of the two hybrids in the order of the walk, and all segments with the new ones.

    A hybrid takes its start from one segment and its end from the other. One that is a segment already has that
    segment's id, by its place; others get the next free numbers of their group, in order of place.
    """
    span = lambda a, b: F.struct(F.col("chrom_1").alias("chrom"), F.col(f"start_{a}").alias("start"), F.col(f"end_{b}").alias("end"))
    forward = F.col("e1.orient") == 1
    rows = rows.withColumn("x1", F.when(forward, span(1, 2)).otherwise(span(2, 1))).withColumn("x2", F.when(forward, span(2, 1)).otherwise(span(1, 2)))
    wanted = rows.select("grp", F.explode(F.array("x1", "x2")).alias("x")).select("grp", "x.*").distinct()
    place = ["chrom", "start", "end"]
    known = segments.groupBy("grp", *place).agg(F.min("seg").alias("seg"))
    held = known.select(F.col("grp").alias("kg"), *[F.col(c).alias(f"k_{c}") for c in place], F.col("seg").alias("had"))
    same = F.col("grp").eqNullSafe(F.col("kg")) & (F.col("chrom") == F.col("k_chrom")) & (F.col("start") == F.col("k_start")) & (F.col("end") == F.col("k_end"))
    found = wanted.join(held, same, "left").select("grp", *place, "had")
    tops = segments.groupBy("grp").agg(F.max(F.col("seg").try_cast("bigint")).alias("top")).select(F.col("grp").alias("tg"), "top")
    order = Window.partitionBy("grp").orderBy(*place)  # the new segments of one set of cycles
    fresh = found.where("had is null").withColumn("n", F.row_number().over(order)).join(tops, F.col("grp").eqNullSafe(F.col("tg")), "left")
    fresh = fresh.select("grp", *place, (F.coalesce("top", F.lit(0)) + F.col("n")).cast("string").alias("seg"))
    ids = found.where("had is not null").select("grp", *place, F.col("had").alias("seg")).unionByName(fresh)
    for k in (1, 2):
        own = ids.select(F.col("grp").alias("ig"), F.struct(*place).alias("ix"), F.col("seg").alias(f"h{k}"))
        rows = rows.join(own, F.col("grp").eqNullSafe(F.col("ig")) & (F.col(f"x{k}") == F.col("ix"))).drop("ig", "ix")
    return rows, segments.select("grp", "seg", *place).unionByName(fresh.select("grp", "seg", *place))


def _numbered(cycles: DataFrame, made: DataFrame, changed: DataFrame) -> DataFrame:
    """``cycles`` with the copies of ``changed`` (grp, cycle, left) and the new ones of ``made`` (grp, c1, cn, segments) under the next free numbers."""
    tops = cycles.groupBy("grp").agg(F.max("cycle").alias("top")).select(F.col("grp").alias("tg"), "top")
    fresh = made.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("c1"))).join(tops, F.col("grp").eqNullSafe(F.col("tg")))
    left = changed.select(F.col("grp").alias("lg"), F.col("cycle").alias("lc"), "left")
    kept = cycles.join(left, F.col("grp").eqNullSafe(F.col("lg")) & (F.col("cycle") == F.col("lc")), "left")
    return kept.select("grp", "cycle", F.coalesce("left", "cn").alias("cn"), "segments").unionByName(fresh.select("grp", (F.col("top") + F.col("n")).cast("bigint").alias("cycle"), "cn", "segments"))


def merge_at(cycles: DataFrame, segments: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cycles, segments) after all possible ``edits`` (grp, c1, c2, i, j), made at once; a cycle takes part in at most one.

    ``cycles``: grp, cycle (a number), cn, segments (seg, orient); ``segments``: grp, seg, chrom, start, end. The second cycle is
    opened at place j and put into the first at place i, between the two hybrids of the segments there; it is turned
    round where they pass oppositely. The new cycle has as many copies as both have; they keep the rest.
    """
    rows, every = _hybrids(judged_merges(cycles, segments, edits).where("problem is null"), segments)
    step = lambda h: F.array(F.struct(F.col(h).alias("seg"), F.col("e1.orient").alias("orient")))
    around = F.concat(_behind(F.col("s2"), F.col("j")), _before(F.col("s2"), F.col("j")))
    span = F.when(F.col("e1.orient") == F.col("e2.orient"), around).otherwise(_flip(around))
    both = F.least("cn1", "cn2")
    made = rows.select("grp", "c1", both.alias("cn"), F.concat(_before(F.col("s1"), F.col("i")), step("h1"), span, step("h2"), _behind(F.col("s1"), F.col("i"))).alias("segments"))
    left = rows.select("grp", F.explode(F.array(F.struct(F.col("c1").alias("cycle"), (F.col("cn1") - both).alias("left")), F.struct(F.col("c2").alias("cycle"), (F.col("cn2") - both).alias("left")))).alias("x")).select("grp", "x.*")
    return _numbered(cycles, made, left), every


def pivot_at(cycles: DataFrame, segments: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cycles, segments) after all possible ``edits`` (grp, c1, i, j), made at once; a cycle takes part in at most one.

    What lies between two opposite passes of overlapping segments is turned round, between their hybrids. The new cycle
    has all copies, the one it came from none.
    """
    rows, every = _hybrids(judged_pivots(cycles, segments, edits).where("problem is null"), segments)
    one, two = (F.array(F.struct(F.col(h).alias("seg"), (F.col("e1.orient") * sign).alias("orient"))) for h, sign in (("h1", 1), ("h2", -1)))
    middle = F.slice("s1", F.col("i") + 1, F.col("j") - F.col("i") - 1)
    made = rows.select("grp", "c1", F.col("cn1").alias("cn"), F.concat(_before(F.col("s1"), F.col("i")), one, _flip(middle), two, _behind(F.col("s1"), F.col("j"))).alias("segments"))
    return _numbered(cycles, made, rows.select("grp", F.col("c1").alias("cycle"), F.lit(0.0).alias("left"))), every
