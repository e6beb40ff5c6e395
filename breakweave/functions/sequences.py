"""Nucleotide strings, CIGARs and read spans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gc_content(sequence: Column) -> Column:
    """Share of G and C in either case; 0.5 for an empty string."""
    n = F.length(sequence)
    return F.when(n == 0, F.lit(0.5)).otherwise((n - F.length(F.translate(sequence, "GCgc", ""))) / n)


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), "ACGTacgt", "TGCAtgca")


def unmasked(sequence: Column) -> Column:
    """Number of upper-case A, C, G and T."""
    return F.length(F.regexp_replace(sequence, "[^ACGT]", ""))


def kmers(sequence: Column, k: int) -> Column:
    n = F.length(sequence) - k + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(sequence, i, F.lit(k)))))


def shared_kmers(a: Column, b: Column, k: int = 10) -> Column:
    return F.size(F.array_intersect(kmers(a, k), kmers(b, k)))


def base_entropy(sequence: Column) -> Column:
    """Shannon entropy (natural logarithm) of the bases A, C, G, T; other letters are left out."""
    counts = [F.length(sequence) - F.length(F.replace(sequence, F.lit(b), F.lit(""))) for b in "ACGT"]
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, -(c / total) * F.log(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, sum(terms[1:], terms[0])).otherwise(0.0)


def _parts(cigar: Column, operations: str) -> Column:
    return F.transform(F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{operations}]"), F.lit(1)), lambda x: x.cast("bigint"))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers (M, D, N, X)."""
    return F.aggregate(_parts(cigar, "MDNX"), F.lit(0).cast("bigint"), lambda a, x: a + x)


def query_span(cigar: Column, reverse: Column) -> Column:
    """First and last aligned base of the whole read, hard and soft clips counted, as the read was sequenced."""
    first = F.coalesce(F.aggregate(_parts(F.regexp_extract(cigar, r"^((?:\d+[HS])*)", 1), "HS"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0))
    last = F.coalesce(F.aggregate(_parts(F.regexp_extract(cigar, r"((?:\d+[HS])*)$", 1), "HS"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0))
    aligned = F.aggregate(_parts(cigar, "MIX="), F.lit(0).cast("bigint"), lambda a, x: a + x)
    start = F.when(reverse, last).otherwise(first)
    return F.struct(start.alias("start"), (start + aligned - 1).alias("end"))


def homology(a: Column, b: Column) -> Column:
    """Overlap of two query spans of one read: positive for homology, negative for inserted bases."""
    return F.when(a["start"] <= b["start"], a["end"] - b["start"] + 1).otherwise(b["end"] - a["start"] + 1)
