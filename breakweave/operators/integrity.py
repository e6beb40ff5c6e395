"""Rules that a breakpoint graph keeps, as queries for what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlap import overlap_join

SOURCE = "0:-1-"


def _place(v: Column) -> tuple[Column, Column, Column]:
    """Chromosome, position and strand of a vertex's text."""
    return F.regexp_extract(v, r"^(.*):-?\d+[+-]$", 1), F.regexp_extract(v, r":(-?\d+)[+-]$", 1).cast("bigint"), F.when(v.endswith("+"), 1).otherwise(-1)


def graph_violations(graph: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """What in ``graph`` (amplicon, kind, v1, v2) breaks a rule: ``amplicon, rule, item, n``; nothing for a sound graph.

    Rules: an edge is given once, whichever way round (``repeated``); a vertex ends one sequence edge
    (``shared``); a sequence edge runs from - to + along one chromosome (``turned``); a concordant edge
    joins neighbouring places, + to - (``apart``); every vertex of another edge but the source ends a
    sequence edge (``loose``). ``segments`` (amplicon, chrom, start, end): each must be covered by sequence edges of its
    amplicon base by base (``uncovered``).
    """
    rows = graph.select("amplicon", "kind", "v1", "v2")
    name = F.concat_ws(" ", "kind", F.least("v1", "v2"), F.greatest("v1", "v2"))
    out = [rows.groupBy("amplicon", name.alias("item")).agg(F.count("*").alias("n")).where("n > 1").select("amplicon", F.lit("repeated").alias("rule"), "item", "n")]
    tiles, others = rows.where("kind = 'sequence'").distinct(), rows.where("kind <> 'sequence'")
    ends = tiles.select("amplicon", F.explode(F.array("v1", "v2")).alias("item")).groupBy("amplicon", "item").agg(F.count("*").alias("n"))
    out.append(ends.where("n > 1").select("amplicon", F.lit("shared").alias("rule"), "item", "n"))
    (c1, p1, s1), (c2, p2, s2) = _place(F.col("v1")), _place(F.col("v2"))
    one = lambda frame, rule: frame.select("amplicon", F.lit(rule).alias("rule"), F.concat_ws(">", "v1", "v2").alias("item"), F.lit(1).cast("bigint").alias("n"))
    out.append(one(tiles.where((c1 != c2) | (s1 != -1) | (s2 != 1) | (p1 > p2)), "turned"))
    near = (c1 == c2) & (((s1 == 1) & (s2 == -1) & (p2 == p1 + 1)) | ((s1 == -1) & (s2 == 1) & (p1 == p2 + 1)))
    out.append(one(others.where((F.col("kind") == "concordant") & ~near).distinct(), "apart"))
    used = others.select("amplicon", F.explode(F.array("v1", "v2")).alias("item")).where(F.col("item") != SOURCE).groupBy("amplicon", "item").agg(F.count("*").alias("n"))
    out.append(used.join(ends.select("amplicon", "item"), ["amplicon", "item"], "left_anti").select("amplicon", F.lit("loose").alias("rule"), "item", "n"))
    if segments is not None:
        # The amplicon is part of the key, so that only its own edges cover a segment.
        keyed = lambda frame, chrom, start, end: frame.select(F.concat_ws("|", "amplicon", chrom).alias("chrom"), start.alias("start"), end.alias("end"), "amplicon")
        spans = keyed(segments, F.col("chrom"), F.col("start"), F.col("end")).distinct()
        met = overlap_join(spans, keyed(tiles.where(p1 <= p2), c1, p1, p2).drop("amplicon"), width=4096)
        covered = met.groupBy("amplicon", "chrom", "start", "end").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start") + 1).alias("bases"))
        left = spans.join(covered, ["amplicon", "chrom", "start", "end"], "left").withColumn("n", F.col("end") - F.col("start") + 1 - F.coalesce("bases", F.lit(0))).where("n > 0")
        out.append(left.select("amplicon", F.lit("uncovered").alias("rule"), F.concat(F.regexp_extract("chrom", r"\|([^|]*)$", 1), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("item"), "n"))
    return reduce(DataFrame.unionByName, out)
