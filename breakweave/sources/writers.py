"""Lines of the text formats, as one-column frames for ``DataFrame.write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement


def graph_lines(edges: DataFrame) -> DataFrame:
    """Inverse of ``read_graph``."""
    tile = F.concat_ws("\t", "kind", "v1", "v2", F.col("cn").cast("string"), F.lit(""), F.col("size").cast("string"), F.col("count").cast("string"))
    other = F.concat_ws("\t", "kind", F.concat_ws("->", "v1", "v2"), F.col("cn").cast("string"), F.col("count").cast("string"))
    return edges.select(F.when(F.col("kind") == "sequence", tile).otherwise(other).alias("value"))


def cycle_lines(cycles: DataFrame) -> DataFrame:
    """Inverse of the cycles part of ``read_cycles``."""
    steps = F.array_join(F.transform("segments", lambda s: F.concat(s["seg"], F.when(s["orient"] == 1, "+").otherwise("-"))), ",")
    return cycles.select(F.concat(F.lit("Cycle="), "cycle", F.lit(";Copy_count="), F.col("cn").cast("string"), F.lit(";Segments="), steps).alias("value"))


def bed_lines(intervals: DataFrame, *extra: str) -> DataFrame:
    return intervals.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), *[F.col(c).cast("string") for c in extra]).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edge checkpoint, inverse of ``read_edges``: ``v1, v2`` as text, support, homology and its bases; null is ``None``."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return edges.select(F.concat_ws("\t", F.concat_ws("->", "v1", "v2"), F.col("support").cast("string"), some("hom"), some("hom_seq")).alias("value"))


def segment_lines(segments: DataFrame) -> DataFrame:
    """Copy-number checkpoint, inverse of ``read_segments`` but for the header line, which each file's reader skips."""
    return segments.select(F.concat_ws("\t", "chrom", *[F.col(c).cast("string") for c in ("start", "end", "cn", "start_refined", "end_refined")]).alias("value"))


def cycle_file_lines(intervals: DataFrame, segments: DataFrame, cycles: DataFrame) -> DataFrame:
    """Whole cycles file of one amplicon, inverse of ``read_cycles``; sort by ``place`` (kind, number) before it is written where the order matters."""
    place = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("bigint").alias("n")).alias("place")
    row = lambda f, kind, key, k: f.select(F.concat_ws("\t", F.lit(kind), key, "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"), place(k, F.col(key)))
    steps = F.array_join(F.transform("segments", lambda s: F.concat(s["seg"], F.when(s["orient"] == 1, "+").otherwise("-"))), ",")
    walks = cycles.select(F.concat(F.lit("Cycle="), F.col("cycle").cast("string"), F.lit(";Copy_count="), F.col("cn").cast("string"), F.lit(";Segments="), steps).alias("value"), place(2, F.col("cycle")))
    return row(intervals, "Interval", "id", 0).unionByName(row(segments, "Segment", "seg", 1)).unionByName(walks).orderBy("place").select("value")


def fasta_lines(cycles: DataFrame, segments: DataFrame) -> DataFrame:
    """One record per cycle: the bases of its segments (amplicon, seg, bases) one after another, turned round where they run backwards; the source adds none."""
    steps = cycles.select("amplicon", "cycle", F.posexplode("segments").alias("n", "s")).select("amplicon", "cycle", "n", F.col("s.seg").alias("seg"), F.col("s.orient").alias("orient"))
    met = steps.join(segments.select("amplicon", "seg", "bases"), ["amplicon", "seg"])
    part = F.struct("n", F.when(F.col("orient") == 1, F.col("bases")).otherwise(reverse_complement(F.col("bases"))).alias("bases"))
    joined = met.groupBy("amplicon", "cycle").agg(F.array_sort(F.collect_list(part)).alias("x"))
    return joined.select(F.concat(F.lit(">"), F.concat_ws("_cycle", "amplicon", F.col("cycle").cast("string")), F.lit("\n"), F.array_join(F.transform("x", lambda p: p["bases"]), "")).alias("value"))


def summary_lines(facts: DataFrame) -> DataFrame:
    """``[amplicon] name = value`` for every column of ``facts`` but the amplicon."""
    names = [c for c in facts.columns if c != "amplicon"]
    entries = F.array(*[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names])
    return facts.select("amplicon", F.explode(entries).alias("x")).select(F.concat(F.lit("["), "amplicon", F.lit("] "), "x").alias("value"))
