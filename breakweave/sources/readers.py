"""Readers of the text formats. Each takes a path that Spark can open and returns typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.edges import breakend, sv_support, vertex
from ..functions.intervals import with_prefix


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def bed(lines: DataFrame) -> DataFrame:
    """White-space fields: chrom, start, end (numbers in any notation, in either order), then extra columns; ``#`` lines are left out."""
    f = F.split(F.trim("value"), r"\s+")
    number = lambda k: f[k].cast("double").cast("bigint")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 3))
    return rows.select(with_prefix(f[0]).alias("chrom"), F.least(number(1), number(2)).alias("start"), F.greatest(number(1), number(2)).alias("end"), F.slice(f, 4, F.greatest(F.lit(0), F.size(f) - 3)).alias("extra"))


def gff(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 9))
    return rows.select(f[0].alias("chrom"), f[3].cast("bigint").alias("start"), f[4].cast("bigint").alias("end"), F.when(f[6] == "-", -1).otherwise(1).alias("strand"), f[5].alias("variant"), F.str_to_map(f[8], F.lit(";"), F.lit("=")).alias("attributes"))


def region(text: Column) -> Column:
    """``chrom:start-end`` or ``chrom:pos``; bounds in either order, strand - where they come reversed."""
    a, b = (F.regexp_extract(text, r"^(.*):(\d+)(?:-(\d+))?$", k) for k in (2, 3))
    a, b = a.cast("bigint"), F.when(b == "", a).otherwise(b).cast("bigint")
    return F.struct(F.regexp_extract(text, r"^(.*):", 1).alias("chrom"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), F.when(a <= b, 1).otherwise(-1).alias("strand"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return bed(_lines(spark, path))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return gff(_lines(spark, path))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Names and lengths in file order, with the genome-wide offset of each: ``chrom, length, chrom_num, offset``."""
    from pyspark.sql import Window

    f = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).select(f[0].alias("chrom"), f[1].cast("bigint").alias("length"), F.monotonically_increasing_id().alias("line"))
    order = Window.orderBy("line")  # a genome's contigs: thousands of rows at most
    return rows.select("chrom", "length", F.row_number().over(order).alias("chrom_num"), F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def read_sv_vcf(spark: SparkSession, path: str, only_passed: bool = True) -> DataFrame:
    """Breakends of a structural-variant VCF: both ends, inserted bases and support."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.size(f) >= 8))
    if only_passed:
        rows = rows.where(f[6].isin("PASS", "."))
    ends = rows.select(breakend(f[0], f[1].cast("bigint"), f[3], f[4]).alias("e"), sv_support(f[7], F.coalesce(F.get(f, F.lit(8)), F.lit("")), F.coalesce(F.get(f, F.lit(9)), F.lit(""))).alias("support"))
    return ends.where("e is not null").select("e.*", "support")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a graph file: ``kind, v1, v2, cn, size, count``."""
    f = F.split("value", "\t")
    arrow = F.split(f[1], "->")
    number = lambda k, kind: F.get(f, F.lit(k)).try_cast(kind)
    rows = _lines(spark, path).where(f[0].isin("sequence", "concordant", "discordant", "source", "breakpoint"))
    tile = f[0] == "sequence"
    return rows.select(
        f[0].alias("kind"), F.when(tile, f[1]).otherwise(arrow[0]).alias("v1"), F.when(tile, F.get(f, F.lit(2))).otherwise(F.get(arrow, F.lit(1))).alias("v2"),
        F.when(tile, number(3, "double")).otherwise(number(2, "double")).alias("cn"), F.when(tile, number(5, "bigint")).alias("size"), F.when(tile, number(6, "bigint")).otherwise(number(3, "bigint")).alias("count"),
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge checkpoint: ``v1, v2`` (structs), support, homology and its bases; ``None`` is null."""
    f = F.split("value", "\t")
    some = lambda k: F.when(F.get(f, F.lit(k)) != "None", F.get(f, F.lit(k)))
    return _lines(spark, path).where(f[0].contains("->")).select(vertex(F.split(f[0], "->")[0]).alias("v1"), vertex(F.split(f[0], "->")[1]).alias("v2"), f[1].cast("bigint").alias("support"), some(2).cast("int").alias("hom"), some(3).alias("hom_seq"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Copy-number checkpoint; the refined marks are read as the booleans that they spell."""
    f = F.split("value", "\t")
    return _lines(spark, path).where(~F.col("value").startswith("#")).select(f[0].alias("chrom"), f[1].cast("bigint").alias("start"), f[2].cast("bigint").alias("end"), f[3].cast("double").alias("cn"), (F.lower(f[4]) == "true").alias("start_refined"), (F.lower(f[5]) == "true").alias("end_refined"))


def read_cycles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Intervals, segments and cycles of a cycles file."""
    lines = _lines(spark, path)
    f = F.split("value", "\t")
    spans = lambda kind: lines.where(f[0] == kind).select(f[1].alias("id"), f[2].alias("chrom"), f[3].cast("bigint").alias("start"), f[4].cast("bigint").alias("end"))
    facts = F.str_to_map("value", F.lit(";"), F.lit("="))
    step = lambda s: F.struct(F.substring(s, F.lit(1), F.length(s) - 1).alias("seg"), F.when(s.endswith("+"), 1).otherwise(-1).alias("orient"))
    cycles = lines.where(F.col("value").startswith("Cycle=")).select(facts["Cycle"].alias("cycle"), facts["Copy_count"].cast("double").alias("cn"), F.transform(F.split(facts["Segments"], ","), step).alias("segments"))
    return spans("Interval"), spans("Segment"), cycles


def runs_of_codes(lines: DataFrame) -> DataFrame:
    """Mappability codes as runs: from (chrom, pos, code) to ``chrom, start, end, score`` without the zero runs.

    Codes (fixed values): ! 1, " 0.5, # 0.33, $ 0.25, anything else 0.
    """
    from pyspark.sql import Window

    score = F.when(F.col("code") == "!", 1.0).when(F.col("code") == '"', 0.5).when(F.col("code") == "#", 0.33).when(F.col("code") == "$", 0.25).otherwise(0.0)
    rows = lines.select("chrom", "pos", score.alias("score")).where("score > 0")
    order = Window.partitionBy("chrom", "score").orderBy("pos")
    return rows.withColumn("run", F.col("pos") - F.row_number().over(order)).groupBy("chrom", "score", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("run")


def in_region(rows: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows (chrom, start, end, ...) that meet a region; its bounds may come in either order. Plain comparisons, so that they reach the scan."""
    low, high = min(start, end), max(start, end)
    return rows.where((F.col("chrom") == chrom) & (F.col("start") <= high) & (F.col("end") >= max(0, low)))


def sam(lines: DataFrame) -> DataFrame:
    """Text alignments: ``qname, flag, chrom, pos`` (from 0), ``mapq, cigar, mate_chrom, mate_pos, template_length, bases, tags``; header lines are left out.

    A file is split wherever Spark splits text, as each line stands for itself.
    """
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    rows = lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    return rows.select(
        at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("chrom"), (at(3).cast("bigint") - 1).alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_chrom"), (at(7).cast("bigint") - 1).alias("mate_pos"), at(8).cast("bigint").alias("template_length"), at(9).alias("bases"),
        F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.lit(0), F.size(f) - 11)), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")))).alias("tags"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return sam(_lines(spark, path))


def read_sv_vcfs(spark: SparkSession, path: str, only_passed: bool = True) -> DataFrame:
    """Calls of all breakend files under a path, plain or gzip, each once per file and in both directions."""
    from ..operators.breakends import paired, sv_records

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return paired(sv_records(lines, only_passed))


def exons(lines: DataFrame) -> DataFrame:
    """Annotation lines of exons: those drawn in the colour 000080 (a fixed value)."""
    return gff(lines).where(F.col("attributes")["color"] == "000080")


def read_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """A data folder's file list, a key and a file name per line, as a map; at most a few dozen lines."""
    f = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.size(f) >= 2).select(f[0].alias("key"), f[1].alias("file")).limit(1000).collect()
    return {r["key"]: r["file"] for r in rows}
