"""Structural-variant calls from breakend files: one call per pair of mates, and both of its directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import breakend, sv_support, vertex_text
from ..functions.sequences import reverse_complement


def sv_records(lines: DataFrame, only_passed: bool = True) -> DataFrame:
    """Calls of breakend files, ``lines`` (file, value): ``file, chrom1, pos1, strand1, chrom2, pos2, strand2, inserted, support``.

    A file's header names its fields. Files with more than one sample are refused, all of them by name. In a row with
    more fields than its header names, the last one is the sample. Other ALT forms than breakends are left out.
    """
    f = F.split(F.rtrim("value"), r"\s+")
    heads = lines.where(F.col("value").startswith("#CHROM")).select("file", F.size(f).alias("width"), F.array_contains(f, "FORMAT").alias("formats")).groupBy("file").agg(F.max("width").alias("width"), F.max("formats").alias("formats"))
    wide = [r["file"] for r in heads.where("formats and width > 10").select("file").orderBy("file").limit(20).collect()]
    if wide:
        raise ValueError(f"files with more than one sample: {', '.join(wide)}")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 8)).select("file", f.alias("f")).join(heads.select("file", "width"), "file", "left")
    if only_passed:
        rows = rows.where(F.col("f")[6].isin("PASS", "."))
    field = lambda k: F.get("f", F.lit(k))
    sample = F.when(F.size("f") > F.coalesce("width", F.lit(8)), F.element_at("f", -1)).otherwise(field(9))
    ends = rows.select("file", breakend(field(0), field(1).cast("bigint"), field(3), field(4)).alias("e"), sv_support(field(7), F.coalesce(field(8), F.lit("")), F.coalesce(sample, F.lit(""))).alias("support"))
    return ends.where("e is not null").select("file", "e.*", "support")


def paired(records: DataFrame) -> DataFrame:
    """``records`` with each call once per file whichever mate names it, in both directions: ``file, v1, v2, hom, hom_seq, support``.

    Of a call's rows the best supported counts (ties: the smaller first vertex). The other direction has its bases
    turned round; a call without inserted bases has neither homology nor bases.
    """
    text = lambda k: vertex_text(F.col(f"chrom{k}"), F.col(f"pos{k}"), F.col(f"strand{k}"))
    rows = records.select("file", text(1).alias("v1"), text(2).alias("v2"), F.when(F.col("inserted") != "", F.col("inserted")).alias("hom_seq"), "support")
    first = Window.partitionBy("file", F.least("v1", "v2"), F.greatest("v1", "v2")).orderBy(F.desc("support"), "v1", "v2", "hom_seq")  # the rows of one call
    once = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    back = once.select("file", F.col("v2").alias("v1"), F.col("v1").alias("v2"), reverse_complement(F.col("hom_seq")).alias("hom_seq"), "support")
    return once.unionByName(back).select("file", "v1", "v2", F.length("hom_seq").alias("hom"), "hom_seq", "support")
