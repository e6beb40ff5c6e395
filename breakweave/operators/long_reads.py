"""Long reads as walks over the genome: one segment per aligned block, in the order of the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cigar_blocks(cigar: Column, split: int | None = None) -> Column:
    """What an alignment's CIGAR covers: ``lead``, ``trail`` (clipped bases, hard and soft apart), ``blocks`` and ``length``.

    Operations are walked once, in order. A block is (query start, query end, reference start, reference
    end), from the alignment's first base and with ends one past the last; a deletion or skip of ``split``
    bases or more begins another block. ``length`` are the bases of the read without hard clips.
    """
    number = lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("bigint")
    steps = F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(number(x).alias("n"), F.right(x, F.lit(1)).alias("op")))
    zero = F.lit(0).cast("bigint")
    block = "struct<q0:bigint,q1:bigint,r0:bigint,r1:bigint>"
    start = F.struct(zero.alias("soft0"), zero.alias("hard0"), zero.alias("soft1"), zero.alias("hard1"), F.lit(False).alias("inside"), zero.alias("q"), zero.alias("r"), F.array().cast(f"array<{block}>").alias("done"), F.struct(zero.alias("q0"), zero.alias("q1"), zero.alias("r0"), zero.alias("r1")).alias("open"))

    def step(a: Column, x: Column) -> Column:
        op, n = x["op"], x["n"]
        clip, query, reference = op.isin("S", "H"), op.isin("M", "I", "=", "X"), op.isin("M", "D", "N", "=", "X")
        add = lambda name, when: F.when(when, a[name] + n).otherwise(a[name]).alias(name)
        q, r = F.when(query, a["q"] + n).otherwise(a["q"]), F.when(reference, a["r"] + n).otherwise(a["r"])
        cut = (op.isin("D", "N") & (n >= split) & (a["open"]["q1"] > a["open"]["q0"])) if split else F.lit(False)
        grown = F.struct(a["open"]["q0"].alias("q0"), q.alias("q1"), a["open"]["r0"].alias("r0"), F.when(op.isin("D", "N"), a["open"]["r1"]).otherwise(r).alias("r1"))
        fresh = F.struct(q.alias("q0"), q.alias("q1"), r.alias("r0"), r.alias("r1"))
        # A gap belongs to the block only once aligned bases follow it.
        return F.struct(
            add("soft0", (op == "S") & ~a["inside"]), add("hard0", (op == "H") & ~a["inside"]), add("soft1", (op == "S") & a["inside"]), add("hard1", (op == "H") & a["inside"]), (a["inside"] | ~(clip | (op == "P"))).alias("inside"),
            q.alias("q"), r.alias("r"), F.when(cut, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(cut, fresh).when(clip | (op == "P"), a["open"]).otherwise(grown).alias("open"),
        )

    def finish(a: Column) -> Column:
        blocks = F.when(a["open"]["q1"] > a["open"]["q0"], F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        return F.struct(a["soft0"].alias("soft0"), a["hard0"].alias("hard0"), a["soft1"].alias("soft1"), a["hard1"].alias("hard1"), blocks.alias("blocks"), (a["soft0"] + a["q"] + a["soft1"]).alias("length"))

    return F.aggregate(steps, start, step, finish)


def read_segments(alignments: DataFrame, hard_clips: bool = True, split: int | None = None) -> DataFrame:
    """``alignments`` (qname, flag, chrom, pos, cigar) as ``read, n, chrom, start, end, read_start, read_end, strand, read_length``.

    ``pos`` counts from 0 and ends are one past the last base. A reference named ``chrom:start-end`` is a piece
    of the chromosome, and places are moved by its start. Read places are those of the sequenced read: turned
    round where the alignment is reversed, hard clips counted unless ``hard_clips`` is false (then a read's
    length is that of each alignment's own bases). ``n`` numbers a read's segments from 1 by their read
    place (ties by place on the genome). Unmapped rows and rows without a CIGAR are left out.
    """
    piece = F.regexp_extract("chrom", r"^(.+):(\d+)-(\d+)$", 1)
    offset = F.when(piece != "", F.regexp_extract("chrom", r"^(.+):(\d+)-(\d+)$", 2).cast("bigint")).otherwise(F.lit(0))
    mapped = alignments.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("cigar") != "*"))
    rows = mapped.select(F.col("qname").alias("read"), F.when(piece != "", piece).otherwise(F.col("chrom")).alias("chrom"), (offset + F.col("pos")).alias("at"), (F.col("flag").bitwiseAND(16) != 0).alias("reverse"), cigar_blocks(F.col("cigar"), split).alias("c"))
    hard = (F.col("c.hard0"), F.col("c.hard1")) if hard_clips else (F.lit(0), F.lit(0))
    length = F.col("c.length") + hard[0] + hard[1]
    lead = F.col("c.soft0") + hard[0]
    rows = rows.select("read", "chrom", "at", "reverse", length.alias("read_length"), lead.alias("lead"), F.explode("c.blocks").alias("b"))
    first, last = F.col("lead") + F.col("b.q0"), F.col("lead") + F.col("b.q1")
    placed = rows.select(
        "read", "chrom", (F.col("at") + F.col("b.r0")).alias("start"), (F.col("at") + F.col("b.r1")).alias("end"),
        F.when(F.col("reverse"), F.col("read_length") - last).otherwise(first).alias("read_start"), F.when(F.col("reverse"), F.col("read_length") - first).otherwise(last).alias("read_end"),
        F.when(F.col("reverse"), -1).otherwise(1).alias("strand"), "read_length",
    )
    order = Window.partitionBy("read").orderBy("read_start", "read_end", "chrom", "start", "end", "strand")  # one read's alignments
    return placed.withColumn("n", F.row_number().over(order).cast("bigint"))


def read_walks(segments: DataFrame) -> DataFrame:
    """Each read's segments as a walk from the source to it: ``read, segments, walk``."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("n", "strand"))), lambda s: F.concat(s["n"].cast("string"), F.when(s["strand"] == 1, "+").otherwise("-")))
    return segments.groupBy("read").agg(F.count("*").alias("segments"), F.concat(F.lit("0+,"), F.array_join(steps, ","), F.lit(",0-")).alias("walk"))
