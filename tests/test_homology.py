"""Homology of reads and spans without joining them."""

import random

import pytest
from pyspark.sql import functions as F

from breakweave.functions import sequences
from breakweave.operators import overlap

SPAN = "chrom string, start bigint, end bigint"


def brute_force(reads, spans):
    out = {}
    for c, s, e in spans:
        hom = [(re - s if rs <= s else e - rs) + 1 for rc, rs, re in reads if rc == c and c is not None and None not in (rs, re, s, e) and rs <= re and s <= e and rs <= e and s <= re]
        if hom:
            out[c, s, e] = (len(hom), min(hom), max(hom))
    return out


@pytest.mark.parametrize("longest", [3, 40, 900])
def test_homology_equals_brute_force(spark, longest):
    for seed, width in ((1, 16), (2, 4096)):
        rng = random.Random(seed)
        draw = lambda n: [(rng.choice("ab"), s, s + rng.choice((0, rng.randint(0, longest)))) for s in (rng.randint(-20, 1000) for _ in range(n))]
        reads, spans = draw(300), draw(150)
        reads += reads[:40] + [(None, 1, 9), ("a", None, 9), ("a", 9, None), ("a", 50, 40)]
        spans += spans[:10] + [(None, 1, 9), ("a", None, 9), ("a", 90, 40), ("z", 1, 5), ("a", 2000, 2001)]
        got = overlap.overlap_homology(spark.createDataFrame(reads, SPAN), spark.createDataFrame(spans, SPAN), width).collect()
        assert {(r.chrom, r.start, r.end): (r.n, r.least, r.most) for r in got} == brute_force(reads, spans)
        assert len(got) == len({(r.chrom, r.start, r.end) for r in got})


def test_deep_reads_over_many_spans(spark):
    """400,000 reads of one place over 20,000 spans: eight billion pairs, which were all made."""
    reads = spark.range(400_000).select(F.lit("a").alias("chrom"), (F.col("id") % 40 + 100).alias("start"), (F.col("id") % 40 + 100 + F.col("id") % 7 * 30).alias("end"))
    spans = spark.range(20_000).select(F.lit("a").alias("chrom"), (F.col("id") % 100).alias("start"), (F.col("id") % 100 + 150 + F.col("id")).alias("end"))
    got = overlap.overlap_homology(reads, spans)
    assert got.agg(F.count("*"), F.sum("n"), F.min("least"), F.max("most")).first() == (20_000, 8_000_000_000, 12, 20_149)
