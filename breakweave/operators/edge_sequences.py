"""Bases of breakpoint edges: the homology that split reads show, and both flanks read along the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amplicons import fetch_bases


def homology_bases(sequence: Column, start: Column, end: Column, strand: Column, hom: Column) -> Column:
    """Bases of a split read at its break: of a part aligned from ``start`` to ``end`` (from 0, end one past), on the side that ``strand`` breaks at.

    A homology lies inside the aligned part, an insertion (``hom`` negative) outside it.
    """
    size = F.abs(hom)
    at = F.when(hom >= 0, F.when(strand == 1, end - hom).otherwise(start)).otherwise(F.when(strand == 1, end).otherwise(start - size))
    return F.substring(sequence, (at + 1).cast("int"), size.cast("int"))


def edge_sequences(edges: DataFrame, chunks: DataFrame, width: int, flank: int = 1000) -> DataFrame:
    """``edges`` (edge, chrom1, pos1, strand1, chrom2, pos2, strand2, hom, hom_seq) with ``bases``: left flank, homology or inserted bases, right flank.

    Flanks begin behind the homology, which both ends share, so it is read once; inserted bases (``hom`` negative) belong to
    neither flank. An edge of unknown homology has 20 letters N there. A flank that the edge reads against its
    strand is turned round. A source edge (pos1 -1) has the flank of its other end only. ``chunks`` as in ``fetch_bases``.
    """
    h = F.greatest(F.coalesce("hom", F.lit(0)), F.lit(0)).cast("bigint")
    # Behind a + end a flank lies to the left of it, behind a - end to the right.
    low = lambda k: F.when(F.col(f"strand{k}") == 1, F.col(f"pos{k}") - h - flank + 1).otherwise(F.col(f"pos{k}") + h)
    flanks = lambda k, turn: F.struct(F.lit(k).alias("k"), F.col(f"chrom{k}").alias("chrom"), low(k).alias("start"), (low(k) + flank - 1).alias("end"), turn.alias("strand"))
    source, same = F.col("pos1") == -1, F.col("strand1") == F.col("strand2")
    # The first end is read as it is; the second is turned round where both have one strand.
    parts = edges.withColumn("first", flanks(1, F.lit(1))).withColumn("second", flanks(2, F.when(~source & same, -1).otherwise(1)))
    wanted = parts.select("edge", F.explode(F.when(source, F.array("second")).otherwise(F.array("first", "second"))).alias("f")).select("edge", "f.*").where("chrom is not null")
    asked = wanted.select(F.concat_ws("|", F.col("k").cast("string"), "edge").alias("id"), "edge", "k", "chrom", "start", "end", "strand")
    found = fetch_bases(asked, chunks, width).groupBy("edge").agg(F.max(F.when(F.col("k") == 1, F.col("bases"))).alias("b1"), F.max(F.when(F.col("k") == 2, F.col("bases"))).alias("b2"))
    middle = F.when(F.col("hom").isNull(), F.lit("N" * 20)).otherwise(F.coalesce("hom_seq", F.lit("")))
    one, two = F.coalesce("b1", F.lit("")), F.coalesce("b2", F.lit(""))
    # On the left stands the end that is read towards the break: the first one on +, else the second; of a source edge, a second one on +.
    first_left = F.when(source, F.col("strand2") != 1).otherwise(F.col("strand1") == 1)
    text = F.when(first_left, F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return edges.join(found, "edge", "left").select(*edges.columns, text.alias("bases"))
