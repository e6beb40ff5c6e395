"""Breakpoint vertices and edges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = r"^(.*):(-?\d+)([+-])$"


def vertex_text(chrom: Column, pos: Column, strand: Column) -> Column:
    return F.concat(chrom, F.lit(":"), pos.cast("string"), F.when(strand == 1, "+").otherwise("-"))


def vertex(text: Column) -> Column:
    return F.struct(
        F.regexp_extract(text, VERTEX, 1).alias("chrom"),
        F.regexp_extract(text, VERTEX, 2).cast("bigint").alias("pos"),
        F.when(F.regexp_extract(text, VERTEX, 3) == "+", 1).otherwise(-1).alias("strand"),
    )


def edge_type(c1: Column, p1: Column, s1: Column, c2: Column, p2: Column, s2: Column) -> Column:
    """source, discordant, everted, forward, reverse or concordant, by places and strands of the two ends."""
    first = p1 <= p2
    low, high = F.when(first, s1).otherwise(s2), F.when(first, s2).otherwise(s1)
    return (
        F.when((p1 == -1) | (p2 == -1), "source")
        .when(c1 != c2, "discordant")
        .when((p1 == p2) & (s1 != s2), "everted")
        .when((low == -1) & (high == 1), "everted")
        .when((s1 == 1) & (s2 == 1), "forward")
        .when((s1 == -1) & (s2 == -1), "reverse")
        .when(F.abs(p1 - p2) != 1, "discordant")
        .otherwise("concordant")
    )


def similar(a: tuple[Column, ...], b: tuple[Column, ...], cutoff: int = 100) -> Column:
    """Two edges (c1, p1, s1, c2, p2, s2) with the same chromosomes, an even number of - strands, and ends near each other."""
    return (a[0] == b[0]) & (a[3] == b[3]) & (a[2] * a[5] * b[2] * b[5] > 0) & (F.abs(a[1] - b[1]) + F.abs(a[4] - b[4]) < cutoff)


def breakend(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Both ends and the inserted bases of a breakend ALT in one of its four forms; null for anything else."""
    form = F.when(alt.rlike(r"^[A-Za-z]+\[[^\[]+:\d+\[$"), 1).when(alt.rlike(r"^[A-Za-z]+\][^\]]+:\d+\]$"), 2).when(alt.rlike(r"^\][^\]]+:\d+\][A-Za-z]+$"), 3).when(alt.rlike(r"^\[[^\[]+:\d+\[[A-Za-z]+$"), 4)
    bases = F.regexp_extract(alt, r"^([A-Za-z]*)", 1)
    tail = F.regexp_extract(alt, r"([A-Za-z]*)$", 1)
    inserted = F.when(form <= 2, F.substring(bases, F.lit(2), F.length(bases))).otherwise(F.substring(tail, F.lit(1), F.length(tail) - 1))
    return F.when(
        form.isNotNull(),
        F.struct(
            chrom.alias("chrom1"), pos.alias("pos1"), F.when(form <= 2, 1).otherwise(-1).alias("strand1"),
            F.regexp_extract(alt, r"[\[\]]([^\[\]]+):\d+[\[\]]", 1).alias("chrom2"), F.regexp_extract(alt, r"[\[\]][^\[\]]+:(\d+)[\[\]]", 1).cast("bigint").alias("pos2"),
            F.when(form.isin(1, 4), -1).otherwise(1).alias("strand2"), inserted.alias("inserted"),
        ),
    )


def sv_support(info: Column, form: Column, sample: Column) -> Column:
    """Supporting pairs: INFO PE, then RP, then FORMAT PR (its last number), then DR, then 0."""
    facts = F.str_to_map(info, F.lit(";"), F.lit("="))
    values = F.map_from_arrays(F.split(form, ":"), F.split(sample, ":"))
    last = F.element_at(F.split(F.try_element_at(values, F.lit("PR")), ","), -1)
    whole = lambda c: c.try_cast("int")
    return F.coalesce(whole(F.try_element_at(facts, F.lit("PE"))), whole(F.try_element_at(facts, F.lit("RP"))), whole(last), whole(F.try_element_at(values, F.lit("DR"))), F.lit(0))
