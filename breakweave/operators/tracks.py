"""Annotation tracks: several interval sets under their tags, met in one overlap pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import merge_clusters
from .overlap import overlap_join

#: Tags of a track table, and what they mean for an interval.
EXCLUDE, CONSERVED, MAPPABILITY = "exclude", "conserved", "mappability"


def track_table(**tracks: DataFrame) -> DataFrame:
    """Tracks (chrom, start, end; ``score`` where there is one) as one table ``tag, chrom, start, end, score``; centromeres are merged where they touch."""
    out = None
    for tag, rows in tracks.items():
        rows = merge_clusters(rows.select("chrom", "start", "end"), 1).drop("members") if tag == "centromere" else rows
        score = F.col("score").cast("double") if "score" in rows.columns else F.lit(None).cast("double")
        own = rows.select(F.lit(tag).alias("tag"), "chrom", "start", "end", score.alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


def track_hits(intervals: DataFrame, tracks: DataFrame, width: int = 256) -> DataFrame:
    """Per distinct place of ``intervals`` (chrom, start, end): the tags that it meets, and bases and weight of its mappability: ``tags, rep_content``.

    A stretch weighs 5 where its score is 0, otherwise one over the score, by the bases it shares; a place without
    any such stretch has 1.
    """
    places = intervals.select("chrom", "start", "end").distinct()
    met = overlap_join(places, tracks, width=width)
    shared = (F.least("end", "r_end") - F.greatest("start", "r_start") + 1).cast("double")
    weight = F.when(F.col("r_score") == 0, 5.0).otherwise(1 / F.col("r_score"))
    mapped = F.col("r_tag") == MAPPABILITY
    hits = met.groupBy("chrom", "start", "end").agg(F.collect_set("r_tag").alias("tags"), (F.sum(F.when(mapped, shared * weight)) / F.sum(F.when(mapped, shared))).alias("rep_content"))
    rows = places.join(hits, ["chrom", "start", "end"], "left")
    return rows.select("chrom", "start", "end", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("rep_content", F.lit(1.0)).alias("rep_content"))


def repeats(intervals: DataFrame, tracks: DataFrame, most: float = 4.5, width: int = 256) -> DataFrame:
    """``intervals`` with ``rep_content`` and ``repeat``: it meets an excluded or conserved region, or its repeat content exceeds ``most``."""
    hits = track_hits(intervals, tracks, width)
    bad = F.arrays_overlap("tags", F.array(F.lit(EXCLUDE), F.lit(CONSERVED))) | (F.col("rep_content") > most)
    return intervals.join(hits.select("chrom", "start", "end", "rep_content", bad.alias("repeat")), ["chrom", "start", "end"]).select(*intervals.columns, "rep_content", "repeat")
