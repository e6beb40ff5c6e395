"""Small fixtures with results worked out by hand or by brute force."""

import math
import random
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from breakweave.functions import edges as E
from breakweave.operators import clusters, coverage, graph, overlap, pairs, segmentation
from breakweave.operators.components import connected_components
from breakweave.operators.coverage import keep_share
from breakweave.operators.pairs import modal_split, pair_components
from breakweave.operators.work import WorkTables
from breakweave.sources import readers, writers

SPAN = "chrom string, start bigint, end bigint"


def spans(spark, rows):
    return spark.createDataFrame(rows, SPAN)


def triples(frame):
    return sorted((r.chrom, r.start, r.end) for r in frame.collect())


def random_spans(n, seed, length=60, top=3000):
    rng = random.Random(seed)
    return [(rng.choice("ab"), s, s + rng.randrange(length)) for s in (rng.randrange(top) for _ in range(n))]


def test_touching_intervals_merge(spark):
    rows = spans(spark, [("a", 1, 10), ("a", 10, 20), ("a", 22, 30)])
    assert triples(clusters.merge_clusters(rows)) == [("a", 1, 20), ("a", 22, 30)]
    assert triples(clusters.merge_clusters(rows, 2)) == [("a", 1, 30)]


def test_merge_does_not_depend_on_bins(spark):
    rows = random_spans(300, 3, 9000, 100_000)
    frame = spans(spark, rows)
    want = clusters.label_clusters(frame, 5, bin_width=1 << 40).groupBy("chrom", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    got = clusters.label_clusters(frame, 5, bin_width=64).groupBy("chrom", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    assert triples(got) == triples(want)


def test_nested_intervals_all_meet(spark):
    left, right = spans(spark, [("a", 10, 20), ("b", 10, 20)]), spans(spark, [("a", 5, 12), ("a", 25, 30), ("a", 15, 40)])
    got = overlap.overlap_join(left, right, width=8).select("r_start", "r_end").collect()
    assert sorted(tuple(r) for r in got) == [(5, 12), (15, 40)]


def test_overlap_joins_equal_brute_force(spark):
    a, b = random_spans(200, 1), random_spans(200, 2)
    meets = lambda x, y, e: x[0] == y[0] and max(0, x[1] - e) <= y[2] and y[1] <= x[2] + e
    for extend in (0, 7):
        for width in (4, 100):
            got = overlap.overlap_join(spans(spark, a), spans(spark, b), extend, width).count()
            assert got == sum(meets(x, y, extend) for x in a for y in b)
            anti = overlap.overlap_join(spans(spark, a), spans(spark, b), extend, width, "left_anti")
            assert triples(anti) == sorted(x for x in a if not any(meets(x, y, extend) for y in b))
            semi = overlap.overlap_join(spans(spark, a), spans(spark, b), extend, width, "left_semi")
            assert triples(semi) == sorted(x for x in a if any(meets(x, y, extend) for y in b))


def test_depth_regions(spark):
    assert triples(clusters.depth_regions(spans(spark, [("a", 1, 10), ("a", 5, 15), ("a", 8, 20)]), 2)) == [("a", 5, 15)]
    rows = random_spans(150, 5)
    got = triples(clusters.depth_regions(spans(spark, rows), 3))
    deep = [(c, p) for c in "ab" for p in range(3100) if sum(x[0] == c and x[1] <= p <= x[2] for x in rows) >= 3]
    assert [(c, p) for c, s, e in got for p in range(s, e + 1)] == deep


def test_atoms_are_disjoint_and_cover(spark):
    a, b = random_spans(60, 7), random_spans(60, 8)
    atoms = clusters.atomize(spans(spark, a), spans(spark, b)).collect()
    for r in random.Random(1).sample(atoms, 40):
        for p in (r.start, r.end):
            assert r.n_first == sum(x[0] == r.chrom and x[1] <= p <= x[2] for x in a)
            assert r.n_second == sum(x[0] == r.chrom and x[1] <= p <= x[2] for x in b)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(1000, 1000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"), WorkTables(spark)).collect()}
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), WorkTables(spark)).count() == 0


def test_pair_components_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, "a", 1, rng.randrange(600), "b", -1, rng.randrange(600)) for i in range(120)] + [(200, "b", 1, 5, "b", -1, 5)]
    frame = spark.createDataFrame(rows, "pair bigint, chrom string, strand int, start bigint, m_chrom string, m_strand int, m_start bigint")
    got = {r.pair: r.root for r in pair_components(frame, 40, WorkTables(spark)).collect()}
    # Two pairs of one cell (half a band wide) are near each other, so cells add no links of their own.
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for x in rows:
            for y in rows:
                if x[1:3] + x[4:6] == y[1:3] + y[4:6] and abs(x[3] - y[3]) < 40 and abs(x[6] - y[6]) < 40:
                    root[x[0]] = root[y[0]] = min(root[x[0]], root[y[0]])
    assert got == root


def test_modal_split_rejects_ties(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in modal_split(frame, ["k"], ["v"]).collect()] == [("a", 1, 2)]


def test_flow_closed_form():
    # One sequence edge between two source edges: all copy numbers are the sum of counts over the sum of costs.
    x = graph.solve_flow(np.array([1000.0, 3, 3]), np.array([5200.0, 10, 40]), np.array([[1, -1, 0], [1, 0, -1]]))
    assert np.allclose(x, 5250 / 1006)
    # A foldback loop counts twice at its vertex.
    x = graph.solve_flow(np.array([100.0, 2, 2]), np.array([500.0, 10, 30]), np.array([[1, -2, 0], [1, 0, -1]]))
    assert np.allclose(x[0], 2 * x[1]) and np.allclose(x[0], x[2]) and abs(x @ [100, 2, 2] - 540) < 1e-6


def test_flow_forces_dead_ends_to_zero():
    x = graph.solve_flow(np.array([1.0, 1]), np.array([5.0, 5]), np.array([[1, -1], [1, 0]]))
    assert x.tolist() == [0, 0]


def test_cycles_of_a_ring_with_a_branch():
    edges = pd.DataFrame(
        [("g", "s1", "sequence", "a-", "a+", 3.0, 100), ("g", "s2", "sequence", "b-", "b+", 2.0, 50), ("g", "e1", "concordant", "a+", "b-", 2.0, 0), ("g", "e2", "discordant", "b+", "a-", 2.0, 0), ("g", "e3", "discordant", "a+", "a-", 1.0, 0)],
        columns=["amplicon", "edge", "kind", "v1", "v2", "cn", "size"],
    )
    out = graph.peel_cycles(edges)
    assert out["cn"].tolist() == [2.0, 1.0]
    assert [sorted(p.split(",")) for p in out["path"]] == [["e1", "e2", "s1", "s2"], ["e3", "s1"]]


def test_segments_of_a_step():
    rng = np.random.default_rng(0)
    depth = np.r_[rng.normal(10, 1, 80), rng.normal(30, 2, 60), rng.normal(10, 1, 70)]
    starts = segmentation.segment_series(depth)
    assert len(starts) == 3 and abs(starts[1] - 80) <= 2 and abs(starts[2] - 140) <= 2
    assert segmentation.segment_series(rng.normal(10, 1, 100)) == [0]


def test_student_tail():
    assert abs(segmentation.beta_tail(2.0, 10) - 0.07338803) < 1e-6
    assert abs(segmentation.beta_tail(0.5, 3) - 0.65145) < 1e-4
    assert math.isclose(segmentation.beta_tail(0.0, 5), 1.0)


def test_edge_types(spark):
    cases = [("a", 100, 1, "a", 200, -1, "discordant"), ("a", 100, -1, "a", 200, 1, "everted"), ("a", 100, 1, "a", 200, 1, "forward"), ("a", 100, -1, "a", 200, -1, "reverse"), ("a", 100, 1, "a", 101, -1, "concordant"), ("a", -1, 1, "a", 5, -1, "source"), ("a", 1, 1, "b", 2, -1, "discordant")]
    frame = spark.createDataFrame(cases, "c1 string, p1 bigint, s1 int, c2 string, p2 bigint, s2 int, want string")
    kind = E.edge_type(*[F.col(c) for c in ("c1", "p1", "s1", "c2", "p2", "s2")])
    assert all(r.got == r.want for r in frame.select(kind.alias("got"), "want").collect())


def test_mates_share_their_fate(spark):
    frame = spark.range(2000).select((F.col("id") % 1000).alias("name"))
    kept = keep_share(frame, "name", 0.3).groupBy("name").count()
    assert kept.where("count <> 2").count() == 0 and 200 < kept.count() < 400


def test_text_round_trips(spark, tmp_path):
    graph_rows = [("sequence", "a:0-", "a:9+", 3.5, 10, 40), ("discordant", "a:9+", "a:0-", 2.5, None, 7)]
    edges = spark.createDataFrame(graph_rows, "kind string, v1 string, v2 string, cn double, size bigint, count bigint")
    writers.graph_lines(edges).write.text(str(tmp_path / "g"))
    assert sorted(tuple(r) for r in readers.read_graph(spark, str(tmp_path / "g")).collect()) == sorted(graph_rows)
    cycles = spark.createDataFrame([("1", 9.5, [("1", 1), ("2", -1)])], "cycle string, cn double, segments array<struct<seg:string,orient:int>>")
    writers.cycle_lines(cycles).write.text(str(tmp_path / "c"))
    assert readers.read_cycles(spark, str(tmp_path / "c"))[2].collect() == cycles.collect()
    (tmp_path / "b.bed").write_text("# note\nchr8\t127.0 5 x 12.4\n7 1 2\n")
    assert [tuple(r)[:3] for r in readers.read_bed(spark, str(tmp_path / "b.bed")).collect()] == [("chr8", 5, 127), ("chr7", 1, 2)]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nchr8\t100\tb\tA\tA[chr8:400[\t.\tPASS\tSVTYPE=BND;PE=14\nchr8\t100\tb\tA\tA[chr8:400[\t.\tLOW\tPE=1\n")
    row = readers.read_sv_vcf(spark, str(tmp_path / "v.vcf")).collect()
    assert [(r.chrom1, r.pos1, r.strand1, r.chrom2, r.pos2, r.strand2, r.support) for r in row] == [("chr8", 100, 1, "chr8", 400, -1, 14)]


def test_entry_without_training_operators(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules.update({'breakweave.llm': None, 'corpus_pipeline': None}); import importlib; e = importlib.import_module('__spark_entry__'); assert 'seeds_pipeline' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_repeated_and_null_rows_count_once_each(spark):
    rows = [("c", 1, 100, "x", 1.0), ("c", 1, 100, "x", 1.0), ("c", 1, 100, None, 2.0), ("c", 500, 600, None, None), ("d", 1, 100, "y", 3.0)]
    frame = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, name string, cn double")
    half = spark.createDataFrame([("c", 51, 150, 0.5)], "chrom string, start bigint, end bigint, score double")
    got = sorted(round(r.uniqueness, 6) for r in coverage.segdup_uniqueness(frame, half.drop("score")).collect())
    assert got == [round(100 / 150, 6)] * 3 + [1.0] * 2
    assert sorted(r.rep_content for r in coverage.weighted_mappability(frame, half).collect()) == [1.0, 1.0, 2.0, 2.0, 2.0]
    pieces = sorted((r.chrom, r.start, r.end, r.name or "") for r in clusters.subtract(frame, half.drop("score")).collect())
    assert pieces == [("c", 1, 51, ""), ("c", 1, 51, "x"), ("c", 1, 51, "x"), ("c", 500, 600, ""), ("d", 1, 100, "y")]
    windows = spark.createDataFrame([("c", 0, 500), ("c", 1, 100)], "chrom string, win bigint, bases bigint")
    covered = coverage.interval_coverage(frame, windows, 100).collect()
    assert len(covered) == 5 and [(r.n_windows, r.depth) for r in covered if (r.chrom, r.start) == ("c", 1)] == [(2, 3.0)] * 3
    places = spark.createDataFrame([("c", 10, None), ("c", 10, None), ("c", 90_000, "z")], "chrom string, pos bigint, name string")
    pairs_ = spark.createDataFrame([("c", 5, 1, "c", 70, 1)], "chrom string, start bigint, strand int, m_chrom string, m_start bigint, m_strand int")
    assert sorted(r.foldups for r in pairs.foldup_count(places, pairs_).collect()) == [0, 1, 1]


def test_coverage_stats_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([0, 1, 2, 3, 5, 8, 100, None])) for _ in range(301)]
    frame = spark.createDataFrame(rows, "chrom string, bases bigint")
    for keys in ([], ["chrom"]):
        got = {tuple(r[k] for k in keys): r for r in coverage.coverage_stats(frame, "bases", keys).collect()}
        for key in {tuple(c for c, _ in [row] if keys) for row in rows}:
            own = sorted(v for c, v in rows if v is not None and (not keys or (c,) == key))
            fine = [v for v in own if 0 < v < 5 * statistics.median(own)]
            r = got[key]
            assert (r.n_windows, r.median) == (len(fine), fine[len(fine) // 2])
            assert abs(r["mean"] - statistics.fmean(fine)) < 1e-9 and abs(r.deviation - statistics.pstdev(fine)) < 1e-9


def test_names_that_operators_use(spark):
    """Columns named like the operators' own helpers stay; nulls and reversed bounds have a defined place."""
    from breakweave.operators import clusters, overlap

    names = "chrom string, start bigint, end bigint, bin int, run int, carry int, low int, cluster string, r_bin int"
    rows = [("a", 1, 10, 1, 2, 3, 4, "x", 5), ("a", 12, 8, 1, 2, 3, 4, "x", 5), (None, 1, 2, 1, 2, 3, 4, "x", 5), ("a", None, 3, 1, 2, 3, 4, "x", 5), ("a", 30, 40, 1, 2, 3, 4, "x", 5)]
    frame = spark.createDataFrame(rows, names)
    got = sorted((r["start"], r["cluster"], r["bin"], r["run"], r["carry"], r["low"], r["r_bin"]) for r in clusters.label_clusters(frame).collect())
    assert got == [(1, 1, 1, 2, 3, 4, 5), (12, 1, 1, 2, 3, 4, 5), (30, 2, 1, 2, 3, 4, 5)]
    assert sorted((r["start"], r["end"], r["members"]) for r in clusters.merge_clusters(frame).collect()) == [(1, 12, 2), (30, 40, 1)]
    met = overlap.overlap_join(frame, frame.where("start = 1"), width=4).collect()
    assert [(r["start"], r["bin"], r["r_bin"], r["r_start"]) for r in met] == [(1, 1, 5, 1)] or {r["start"] for r in met} == {1}
    assert {r["start"] for r in overlap.overlap_join(frame, frame.where("start = 1"), width=4, how="left_anti").collect()} == {12, 1, None, 30}
    assert overlap.point_join(frame.select("chrom", (F.col("start") + 1).alias("pos"), "bin"), frame, width=4).count() == 2
