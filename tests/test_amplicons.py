"""Refinement, growth, search and graphs on small fixtures worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from breakweave.operators import amplicons, breakpoints
from breakweave.operators.work import WorkTables
from breakweave.sources import readers, writers

EDGE = "edge string, chrom1 string, pos1 bigint, strand1 int, chrom2 string, pos2 bigint, strand2 int, support bigint"
ALIGNED = "qname bigint, first boolean, reverse boolean, secondary boolean, chrom string, start bigint, end bigint, q_start bigint, q_end bigint, mapq int"


def edge(c1, p1, s1, c2, p2, s2, n=5):
    return ("/".join(map(str, (c1, p1, s1, c2, p2, s2))), c1, p1, s1, c2, p2, s2, n)


def test_split_reads_give_place_and_homology(spark):
    edges = spark.createDataFrame([edge("a", 1000, 1, "b", 500, -1), edge("a", 9000, 1, "b", 500, -1)], EDGE)
    part = lambda q, c, s, e, qs, qe, second, first=True: (q, first, False, second, c, s, e, qs, qe, 30 + q)
    rows = []
    for q in (1, 2):  # both show a:990 -> b:510 with 3 shared bases
        rows += [part(q, "a", 931, 990, 0, 59, False), part(q, "b", 510, 552, 57, 99, True)]
    rows += [part(3, "a", 931, 980, 0, 49, False), part(3, "b", 520, 560, 57, 97, True)]  # a lone other place
    rows += [part(4, "a", 931, 990, 0, 59, False), part(4, "b", 510, 552, 57, 99, False)]  # both primary: not one read in two parts
    rows += [part(5, "a", 931, 990, 0, 59, False), part(5, "a", 940, 985, 0, 45, False), part(5, "b", 510, 552, 57, 99, True)]  # mapped twice at one end
    rows += [part(6, "a", 931, 990, 40, 99, False), part(6, "b", 510, 552, 0, 42, True)]  # order against the direction
    found = breakpoints.refine_edges(edges, spark.createDataFrame(rows, ALIGNED), 100).collect()
    assert [(r.edge, r.p1, r.p2, r.hom, r.n, r.mapq1) for r in found] == [("a/1000/1/b/500/-1", 990, 510, 3, 2, 32)]


def test_equally_frequent_places_give_none(spark):
    edges = spark.createDataFrame([edge("a", 1000, 1, "b", 500, -1)], EDGE)
    rows = [(q, True, False, s, c, p, p + 59, 0 if not s else 62, 59 if not s else 99, 9) for q in (1, 2) for s, c, p in ((False, "a", 900 + q), (True, "b", 510 + q))]
    assert breakpoints.refine_edges(edges, spark.createDataFrame(rows, ALIGNED), 100).count() == 0
    assert [r.hom for r in breakpoints.split_matches(edges, spark.createDataFrame(rows, ALIGNED), 100).collect()] == [-2, -2]


def test_weak_edges_explain_bare_steps_only(spark):
    strong, weak = [edge("a", 1000, 1, "b", 5000, -1, 9)], [edge("a", 3000, 1, "b", 5100, -1, 2), edge("a", 3040, 1, "c", 70, 1, 3), edge("a", 1010, 1, "c", 9, 1, 2), edge("a", 3000, -1, "c", 8, 1, 9)]
    steps = spark.createDataFrame([("a", 1005, 4, True), ("a", 3010, 3, True), ("a", 60_000, 2, True), ("a", 3010, -3, False)], "chrom string, pos bigint, drop int, refined boolean")
    inside = spark.createDataFrame([("c", 0, 100)], "chrom string, start bigint, end bigint")
    found = breakpoints.sensitive_edges(spark.createDataFrame(strong, EDGE), spark.createDataFrame(weak, EDGE), steps, inside, 100)
    assert sorted(r.edge for r in found.collect()) == ["a/1000/1/b/5000/-1", "a/3040/1/c/70/1", "c/70/1/a/3040/1"]


def test_growth_over_amplified_windows(spark):
    spans = spark.createDataFrame([("a", 1000, 1100, 7), ("a", 1000, 1100, 7), ("b", 1000, 1100, 8)], "chrom string, start bigint, end bigint, x int")
    windows = spark.createDataFrame([("a", w * 100, w * 100 + 99) for w in (11, 12, 16)], "chrom string, start bigint, end bigint")
    edges = spark.createDataFrame([edge("b", 1150, 1, "a", 5, 1), edge("b", 950, 1, "a", 5, 1)], EDGE)
    found = amplicons.extend_intervals(spans, windows, edges, 100).collect()
    # On a both bounds have an amplified window within two windows; on b one edge leads out at the end, the other leads inwards.
    assert sorted((r.chrom, r.start, r.end, r.x) for r in found) == [("a", 0, 2699, 7), ("a", 0, 2699, 7), ("b", 1000, 1300, 8)]


def test_search_follows_edges_best_first(spark):
    edges = spark.createDataFrame([edge("a", 1050, 1, "b", 5000, -1, 9), edge("b", 5010, 1, "c", 700, -1, 4), edge("b", 5020, 1, "c", 720, -1, 4), edge("d", 1, 1, "e", 2, 1, 4)], EDGE)
    seeds = spark.createDataFrame([("s", "a", 1000, 1100)], "seed string, chrom string, start bigint, end bigint")
    windows = spark.createDataFrame([], "chrom string, start bigint, end bigint")
    found = amplicons.hops(seeds, edges, windows, 100, 150, merge=100).collect()
    assert sorted((r.chrom, r.start, r.end) for r in found) == [("a", 1000, 1100), ("b", 4850, 5150), ("c", 550, 870)]
    alone = amplicons.hops(seeds, edges, windows, 100, 150, merge=100, rounds=1).collect()
    assert [(r.chrom, r.start, r.end) for r in alone] == [("a", 1000, 1100)]


def test_graph_of_one_amplicon(spark):
    spans = spark.createDataFrame([("x", "a", 1, 1000)], "amplicon string, chrom string, start bigint, end bigint")
    edges = spark.createDataFrame([edge("a", 800, 1, "a", 201, -1, 7), edge("a", 201, -1, "a", 800, 1, 7), edge("a", 500, 1, "b", 9, -1, 3)], EDGE)
    reads = spark.createDataFrame([("a", 150, 249), ("a", 990, 1020), ("b", 1, 50)], "chrom string, start bigint, end bigint")
    pairs = spark.createDataFrame([("a", 450, 480, "a", 520), ("a", 300, 320, "a", 900)], "chrom string, start bigint, end bigint, m_chrom string, m_start bigint")
    rows = amplicons.amplicon_graph(spans, edges, reads, pairs, 200, 50, 20.0, WorkTables(spark)).collect()
    assert sorted((r.kind, r.v1, r.v2, r["size"], r["count"], r.cost) for r in rows) == [
        ("concordant", "a:200+", "a:201-", 0, 0, 20.0), ("concordant", "a:500+", "a:501-", 0, 1, 20.0), ("concordant", "a:800+", "a:801-", 0, 0, 20.0), ("discordant", "a:201-", "a:800+", 0, 7, 20.0),
        ("sequence", "a:1-", "a:200+", 200, 1, 40.0), ("sequence", "a:201-", "a:500+", 300, 1, 60.0), ("sequence", "a:501-", "a:800+", 300, 0, 60.0), ("sequence", "a:801-", "a:1000+", 200, 1, 40.0),
        ("source", "0:-1-", "a:1-", 0, 0, 20.0), ("source", "0:-1-", "a:1000+", 0, 0, 20.0), ("source", "0:-1-", "a:500+", 0, 3, 20.0),
    ]


def test_walks_become_oriented_segments(spark):
    edges = [("x", "q1", "sequence", "a:1-", "a:100+"), ("x", "q2", "sequence", "a:101-", "a:400+"), ("x", "c", "concordant", "a:100+", "a:101-"), ("x", "q3", "sequence", "b:5-", "b:50+"), ("x", "d1", "discordant", "a:400+", "b:50+"), ("x", "d2", "discordant", "a:1-", "b:5-"), ("x", "s1", "source", "0:-1-", "a:1-"), ("x", "s2", "source", "0:-1-", "a:400+")]
    graph = spark.createDataFrame(edges, "amplicon string, edge string, kind string, v1 string, v2 string")
    walks = [("x", 1, 3.0, "d2,q3,d1,q2,c,q1"), ("x", 2, 1.0, "s1,q1,c,q2,s2")]
    segments, cycles = amplicons.cycle_segments(graph, spark.createDataFrame(walks, "amplicon string, cycle bigint, cn double, path string"))
    assert sorted((r.seg, r.chrom, r.start, r.end) for r in segments.collect()) == [("1", "a", 1, 400), ("2", "b", 5, 50)]
    shown = {r.cycle: [(s.seg, s.orient) for s in r.segments] for r in cycles.collect()}
    # The first walk is turned round so that its longest segment is forward.
    assert shown == {1: [("1", 1), ("2", -1)], 2: [("1", 1), ("0", -1), ("0", 1)]}


def test_bases_are_joined_across_chunks(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("ACGTacgt") for _ in range(95))
    chunks = spark.createDataFrame([("a", s, text[s : s + 10]) for s in range(0, 95, 10) if s != 40], "chrom string, start bigint, bases string")
    held = text[:40] + "n" * 10 + text[50:] + "n" * 100
    turn = str.maketrans("ACGTacgt", "TGCAtgca")
    wanted = [(i, "a", s, s + rng.randrange(60), rng.choice([1, -1])) for i, s in enumerate(rng.randrange(95) for _ in range(40))] + [(99, "z", 3, 7, 1)]
    got = {r.id: r.bases for r in amplicons.fetch_bases(spark.createDataFrame(wanted, "id int, chrom string, start bigint, end bigint, strand int"), chunks, 10).collect()}
    for i, chrom, s, e, strand in wanted:
        expected = held[s : e + 1] if chrom == "a" else "n" * (e - s + 1)
        assert got[i] == (expected if strand == 1 else expected[::-1].translate(turn))


def test_concordant_partner(spark):
    places = spark.createDataFrame([("a", 500, 1), ("a", 500, -1), ("a", 5000, 1)], "chrom string, pos bigint, strand int")
    rows = [("a", 440, 470, "a", 530), ("a", 450, 480, "a", 510), ("a", 460, 490, "a", 505), ("a", 500, 530, "a", 560), ("a", 100, 130, "a", 900), ("a", 450, 480, "b", 505)]
    found = breakpoints.concordant_support(places, spark.createDataFrame(rows, "chrom string, start bigint, end bigint, m_chrom string, m_start bigint"), 200, 50, 2).collect()
    assert sorted((r.pos, r.strand, r.n, r.partner) for r in found) == [(500, -1, 3, 490), (500, 1, 3, 505), (5000, 1, 0, None)]


@pytest.mark.parametrize("tag,near", [("a,120,-,30M,60,0", True), ("a,120,+,30M,60,0", False), ("b,120,-,30M,60,0", False), ("a,400,-,30M,60,0", False), (None, False)])
def test_supplementary_tag(spark, tag, near):
    rows = spark.createDataFrame([(tag, "a", 100, 150, False)], "tag string, chrom string, start bigint, end bigint, reverse boolean")
    assert rows.select(breakpoints.supplementary_near(F.col("tag"), F.col("chrom"), F.col("start"), F.col("end"), F.col("reverse"), 50)).first()[0] is near


def test_copy_numbers_balance_at_every_vertex(spark):
    from breakweave.operators.graph import flow_constraints
    from breakweave.plans.amplicons import _solved

    solved = _solved(spark, "/root/testdata/sf0.01")
    assert solved.where("kind = 'discordant'").count() > 0
    flows = flow_constraints(solved).join(solved.select("amplicon", "edge", "cn"), ["amplicon", "edge"])
    sums = flows.groupBy("amplicon", "vertex").agg(F.abs(F.sum(F.col("value") * F.col("cn"))).alias("left"), F.max("cn").alias("most"))
    assert sums.where("left > 1e-3 * (1 + most)").count() == 0


def test_checkpoints_and_cycles_come_back(spark, tmp_path):
    def back(lines, reader, name):
        lines.coalesce(1).write.text(str(tmp_path / name))
        return reader(spark, str(tmp_path / name))

    edges = spark.createDataFrame([("chr8:127100000+", "chr8:128400000-", 23, 3, "ACG"), ("chr8:5+", "chr9:7+", 9, None, None)], "v1 string, v2 string, support bigint, hom int, hom_seq string")
    found = back(writers.edge_lines(edges), readers.read_edges, "edges").collect()
    assert sorted((r.v1.pos, r.v2.chrom, r.support, r.hom, r.hom_seq) for r in found) == [(5, "chr9", 9, None, None), (127100000, "chr8", 23, 3, "ACG")]
    segments = spark.createDataFrame([("chr1", 1, 99, 2.5, True, False)], "chrom string, start bigint, end bigint, cn double, start_refined boolean, end_refined boolean")
    assert back(writers.segment_lines(segments), readers.read_segments, "segments").collect() == segments.collect()
    parts = spark.createDataFrame([("x", "1", "chr1", 5, 9), ("x", "2", "chr1", 20, 29)], "amplicon string, seg string, chrom string, start bigint, end bigint")
    cycles = spark.createDataFrame([("x", 1, 2.5, [("1", 1), ("2", -1)]), ("x", 2, 1.0, [("0", 1), ("2", 1), ("0", -1)])], "amplicon string, cycle bigint, cn double, segments array<struct<seg: string, orient: int>>")
    spans = spark.createDataFrame([("1", "chr1", 1, 50)], "id string, chrom string, start bigint, end bigint")
    i, s, c = back(writers.cycle_file_lines(spans, parts, cycles), readers.read_cycles, "cycles")
    assert [tuple(r) for r in i.collect()] == [("1", "chr1", 1, 50)]
    assert sorted(tuple(r) for r in s.collect()) == [("1", "chr1", 5, 9), ("2", "chr1", 20, 29)]
    assert sorted((r.cycle, r.cn, [tuple(x) for x in r.segments]) for r in c.collect()) == [("1", 2.5, [("1", 1), ("2", -1)]), ("2", 1.0, [("0", 1), ("2", 1), ("0", -1)])]
    bases = parts.withColumn("bases", F.when(F.col("seg") == "1", "ACGTT").otherwise("AAAAACCCCC"))
    fasta = {r.value.split("\n")[0]: r.value.split("\n")[1] for r in writers.fasta_lines(cycles, bases).collect()}
    assert fasta == {">x_cycle1": "ACGTT" + "GGGGGTTTTT", ">x_cycle2": "AAAAACCCCC"}
    facts = spark.createDataFrame([("x", 2, 1000)], "amplicon string, Intervals int, TotalIntervalSize bigint")
    assert [r.value for r in writers.summary_lines(facts).orderBy("value").collect()] == ["[x] Intervals = 2", "[x] TotalIntervalSize = 1000"]


def test_coarse_bounds_move_to_fine_ones(spark):
    from breakweave.operators.segmentation import refined_segments

    rng = random.Random(1)
    level = lambda w: 2.0 if w < 1237 else 12.0
    fine = [("a", w, level(w) + rng.gauss(0, 0.3)) for w in range(2400)]
    coarse = [("a", k, sum(x[2] for x in fine[k * 30 : k * 30 + 30]) / 30) for k in range(80)]
    schema = "chrom string, win bigint, depth double"
    rows = refined_segments(spark.createDataFrame(coarse, schema), spark.createDataFrame(fine, schema), 30).orderBy("start").collect()
    assert [(r.chrom, r.start, r.end, r.start_refined, r.end_refined) for r in rows] == [("a", 0, 1236, False, True), ("a", 1237, 2399, True, False)]


def test_merged_and_turned_cycles_share_copies(spark):
    from breakweave.operators.graph import merge_copies, pivot_copies

    kind = "array<struct<seg: string, orient: int>>"
    rows = spark.createDataFrame([([("1", 1), ("2", 1)], 5.0, [("1", 1), ("3", 1)], 2.0), ([("0", 1), ("1", 1), ("0", -1)], 5.0, [("0", 1), ("1", 1), ("0", -1)], 2.0), ([("1", 1)], 1.0, [("2", 1)], 2.0)], f"a {kind}, x double, b {kind}, y double")
    found = [r.m for r in rows.select(merge_copies(F.col("a"), F.col("x"), F.col("b"), F.col("y"), 1, 1).alias("m")).collect()]
    assert [(s.seg, s.orient) for s in found[0].segments] == [("1", 1), ("3", 1), ("1", 1), ("2", 1)]
    assert (found[0].cn, found[0].first_rest, found[0].second_rest) == (2.0, 3.0, 0.0)
    assert found[1:] == [None, None]  # both pass the source; the segments at the places differ
    turn = spark.createDataFrame([([("1", 1), ("2", 1), ("1", -1)], 4.0), ([("1", 1), ("2", 1), ("1", 1)], 4.0)], f"a {kind}, x double")
    done = [r.p for r in turn.select(pivot_copies(F.col("a"), F.col("x"), 1, 3).alias("p")).collect()]
    assert ([(s.seg, s.orient) for s in done[0].segments], done[0].cn, done[0].rest) == ([("1", 1), ("2", -1), ("1", -1)], 4.0, 0.0)
    assert done[1] is None
