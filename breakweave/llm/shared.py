"""Pieces that several training-data operators share: fold rules, counts, samples, and the engine's work tables and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.work import WorkTables, shared_folder

__all__ = ["SPACE", "WorkTables", "bounded_rows", "class_sample", "connected_components", "fold", "shared_folder", "word_count"]

#: Bytes that count as white space in the text contracts: blank, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"


def fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null id: null)."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(column.cast("string").cast("binary")) % folds


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``, without building an array of them (null: 0)."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.length(F.rtrim(marks, F.lit(" \t\n\x0b\x0c\r"))).cast("bigint")


#: Label values that a classifier can have: the most frequent ones, ties by value. Bytes of text that a sample of one label may hold.
MOST_CLASSES, SAMPLE_BYTES = 2000, 16_000_000
_SPAN = 1 << 30


def _share_rule(label: str, shares: dict, hashed: Column) -> Column:
    share = F.lit(0)
    for value, part in shares.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(_SPAN, int(part * _SPAN) + 1))).otherwise(share)
    return F.col(label).isNotNull() & (F.pmod(hashed, F.lit(_SPAN)) < share)


def class_sample(marks: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """Distinct (key, label) rows, about ``per_class`` of every label value by a hash of the key, marked for broadcast under a bound.

    Counts each class first (one row per class reaches the driver) and keeps the rows whose hash falls
    under the class's share, so no rows are sorted or gathered to choose them.
    """
    marks = marks.select(key, label).distinct()
    counts = {r[label]: r["count"] for r in marks.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_CLASSES).collect()}
    rule = _share_rule(label, {v: per_class / n for v, n in counts.items()}, F.xxhash64(F.col(key), F.lit("sample")))
    return F.broadcast(marks.where(rule).limit((2 * per_class + 100) * len(counts) + 1))


def bounded_rows(rows: DataFrame, per_class: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Distinct rows of ``key, label, text`` with whole texts, chosen by a hash of key and text: the bound of a training sample.

    Of every label value about ``per_class`` rows, or fewer where these would hold more than
    ``most_bytes``. One pass counts rows and bytes, a second one takes the chosen rows; repeated rows
    (same key, label and text) are one, so a key that holds most of the table can't swell the sample.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    found = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"), F.sum(size).alias("b")).orderBy(F.desc("n"), "label").limit(MOST_CLASSES).collect()
    shares = {r["label"]: min(1.0, per_class / r["n"], most_bytes / max(1, r["b"])) for r in found}
    mark = F.xxhash64("key", "text", F.lit("sample"))
    chosen = rows.where(_share_rule("label", shares, mark)).groupBy("key", "label", mark.alias("mark")).agg(F.any_value("text").alias("text"))
    return chosen.select("key", "label", "text")
