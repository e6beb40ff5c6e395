"""Seed preparation: amplified copy-number calls, cleaned, merged and weighed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import label_clusters, subtract
from ..operators.coverage import segdup_uniqueness
from ..operators.work import WorkTables


def prepare_seeds(calls: DataFrame, conserved: DataFrame, duplicated: DataFrame, gain: float = 4.5, pad: int = 1_000_000, extend: int = 300_000, least: int = 50_000, width: int = 65_536) -> DataFrame:
    """``calls`` (chrom, start, end, cn) above ``gain``, outside the conserved regions widened by ``pad``,
    unique enough to stay above ``gain``, merged within ``extend`` and longer than ``least`` in sum.

    Result: ``chrom, start, end, cn`` (cn weighted by size), ``members``. Each step uses its input more than
    once, so the two that feed others are written in between; they hold gained calls only.
    """
    tables = WorkTables(calls.sparkSession)
    carved = tables.save(subtract(calls.where(F.col("cn") > gain), conserved, pad, width), "carved")
    unique = segdup_uniqueness(carved, duplicated, width).where(F.col("cn") * F.col("uniqueness") > gain).drop("uniqueness")
    unique = tables.save(unique, "unique")
    tables.drop(carved)
    size = F.col("end") - F.col("start") + 1
    merged = label_clusters(unique, extend).groupBy("chrom", "cluster").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(size).alias("size"), (F.sum(size * F.col("cn")) / F.sum(size)).alias("cn"), F.count("*").alias("members")
    )
    return merged.where(F.col("size") > least).select("chrom", "start", "end", "cn", "members")
