"""Split reads at edges: pairs of alignments first, edges second."""

import random
import time

import pytest
from pyspark.sql import functions as F

from breakweave.operators import breakpoints, pairs

ALIGNED = "qname long, first boolean, reverse boolean, secondary boolean, chrom string, start long, end long, q_start long, q_end long, mapq int"
EDGES = "edge string, chrom1 string, pos1 long, strand1 int, chrom2 string, pos2 long, strand2 int"
KEY = ["edge", "qname", "first", "reverse", "secondary"]


def some(seed):
    rng = random.Random(seed)
    place = lambda: (rng.choice("ab"), rng.randint(0, 900))
    edges = [(f"e{k}", *place(), rng.choice((1, -1)), *place(), rng.choice((1, -1))) for k in range(40)]
    rows = []
    for _ in range(500):
        c, s = place()
        q = rng.randint(0, 50)
        rows.append((rng.choice((rng.randint(0, 60), 7, None)) if rng.random() < 0.2 else rng.randint(0, 60), *(rng.random() < 0.5 for _ in range(3)), c, s, s + rng.choice((0, 20, 400)), q, q + 20, rng.randint(0, 60)))
    return edges, rows + rows[:30] + [(1, True, False, True, None, 5, 9, 0, 5, 9), (1, True, False, True, "a", 50, 10, 0, 5, 9), (1, None, False, None, "a", 50, 60, 0, 5, 9)]


@pytest.mark.parametrize("crowd", [64, 9, 0])
def test_pairs_of_alignments_equal_joined_ends(spark, monkeypatch, crowd):
    """Reads of few alignments, of many, and both: what meets both ends, keys of several alignments left out."""
    monkeypatch.setattr(breakpoints, "CROWD", crowd)
    for seed, reach in ((1, 100), (2, 700)):
        edges, rows = some(seed)
        edges, rows = spark.createDataFrame(edges, EDGES), spark.createDataFrame(rows, ALIGNED)
        joined = breakpoints._near_end(edges, rows, 1, reach).join(breakpoints._near_end(edges, rows, 2, reach), KEY)
        shown = lambda f: sorted(map(str, f.select(*KEY, "x1", "x2").collect()))
        expected = shown(joined)
        assert len(expected) > 20
        assert shown(breakpoints._paired(edges, rows, reach)) == expected
        assert breakpoints.split_matches(edges, rows, reach).count() == _matches(edges, joined)


def _matches(edges, joined):
    strand = {e.edge: e for e in edges.collect()}
    n = 0
    for r in joined.collect():
        e, x, y = strand[r.edge], r.x1, r.x2
        ahead = x.q_start <= y.q_start and x.q_end <= y.q_end
        held = not ahead and not (x.q_start >= y.q_start and x.q_end >= y.q_end)
        loop = (e.chrom1, e.pos1, e.strand1) == (e.chrom2, e.pos2, e.strand2)
        n += not held and ((e.strand1 == 1) == (not r.reverse)) == ahead and (not loop or x.place >= y.place)
    return n


def test_deep_reads_at_many_edges(spark):
    """40,000 whole reads and one split read near both ends of 4,000 edges: 320 million rows, which were all grouped."""
    edges = spark.range(4000).select(F.col("id").cast("string").alias("edge"), F.lit("a").alias("chrom1"), (F.col("id") % 50 + 3000).alias("pos1"), F.lit(1).alias("strand1"), F.lit("a").alias("chrom2"), (F.col("id") % 50 + 9000).alias("pos2"), F.lit(-1).alias("strand2"))
    one = spark.createDataFrame([(-1, True, False, True, "a", 2000, 2050, 0, 50, 60), (-1, True, False, False, "a", 9100, 9150, 48, 98, 60)], ALIGNED)
    whole = spark.range(40_000).select(F.col("id").alias("qname"), F.lit(True).alias("first"), F.lit(False).alias("reverse"), (F.col("id") % 2 == 0).alias("secondary"), F.lit("a").alias("chrom"), (F.col("id") % 2 * 8000 + 1500).alias("start"), (F.col("id") % 2 * 8000 + 1550).alias("end"), F.lit(0).cast("bigint").alias("q_start"), F.lit(50).cast("bigint").alias("q_end"), F.lit(60).alias("mapq"))
    start = time.monotonic()
    found = breakpoints.refine_edges(edges, whole.unionByName(one), 3000)
    assert found.groupBy("p1", "p2", "hom", "n").count().collect() == [(2050, 9100, 3, 1, 4000)]
    assert time.monotonic() - start < 60


def test_pair_edges_count_pairs_by_place(spark):
    """Pairs of one place are one row from the start, and each counts."""
    span = "pair string, chrom string, start long, end long, strand int, m_chrom string, m_start long, m_end long, m_strand int"
    rows = [(f"p{k}", "a", 100 + k % 3, 120 + k % 3, 1, "b", 500 + k % 2, 520, -1) for k in range(30)] + [("q", "a", 5000, 5020, 1, "b", 500, 520, -1)]
    got = pairs.pair_edges(spark.createDataFrame(rows, span), 200, 2).collect()
    assert [(r.chrom1, r.pos1, r.strand1, r.chrom2, r.pos2, r.strand2, r.support, r.spans1, r.spans2) for r in got] == [("a", 122, 1, "b", 500, -1, 30, 3, 2)]
