"""Fixtures with known results for long reads, shifts, fold-backs, edge sequences, statistics, calls, tracks, integrity and layout."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.functions.edges import vertex_text
from breakweave.operators import arcs, breakends, edge_sequences, foldbacks, integrity, layout, long_reads, runs, shifts, statistics, tracks
from breakweave.operators.segmentation import beta_tail
from breakweave.operators.work import WorkTables, release
from breakweave.sources import readers

# --- long reads -------------------------------------------------------------------------------------

SAM = [
    "@HD\tVN:1.6",
    "r1\t0\tchr1:100-900\t11\t60\t5S20M3I4D10M2H\t*\t0\t0\tA\t*\tNM:i:3",
    "r1\t16\tchr2\t51\t60\t4H10M20N10=6S\t*\t0\t0\tA\t*",
    "r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*",
    "r3\t0\tchr1\t1\t60\t10M\t=\t5\t7\tA\t*",
]


def test_long_read_segments(spark, tmp_path):
    (tmp_path / "x.sam").write_text("\n".join(SAM) + "\n")
    rows = long_reads.read_segments(readers.read_sam(spark, str(tmp_path / "x.sam")))
    got = {(r["read"], r["n"]): (r["chrom"], r["start"], r["end"], r["read_start"], r["read_end"], r["strand"], r["read_length"]) for r in rows.collect()}
    assert got == {
        ("r1", 1): ("chr1", 110, 144, 5, 38, 1, 40),  # 20 + 4 deleted + 10 on the genome, 20 + 3 + 10 of the read
        ("r1", 2): ("chr2", 50, 90, 6, 26, -1, 30),  # turned round: six bases behind it come first
        ("r3", 1): ("chr1", 0, 10, 0, 10, 1, 10),
    }
    soft = {r["n"]: (r["read_start"], r["read_end"], r["read_length"]) for r in long_reads.read_segments(readers.read_sam(spark, str(tmp_path)), hard_clips=False).where("read = 'r1'").collect()}
    assert soft == {1: (5, 38, 38), 2: (6, 26, 26)}
    cut = long_reads.read_segments(readers.read_sam(spark, str(tmp_path)), split=10).where("read = 'r1' and chrom = 'chr2'").orderBy("n").collect()
    assert [(r["start"], r["end"], r["read_start"], r["read_end"]) for r in cut] == [(80, 90, 6, 16), (50, 60, 16, 26)]
    walks = {r["read"]: r["walk"] for r in long_reads.read_walks(rows).collect()}
    assert walks == {"r1": "0+,1+,2-,0-", "r3": "0+,1+,0-"}


def test_long_reads_empty(spark):
    none = spark.createDataFrame([], "qname string, flag int, chrom string, pos bigint, cigar string")
    assert long_reads.read_walks(long_reads.read_segments(none)).count() == 0


# --- running values and shifts ----------------------------------------------------------------------


def test_running_values(spark):
    rng = random.Random(3)
    rows = [(k, x, rng.randint(0, 9), "row") for k in ("a", None, "b") for x in rng.sample(range(-50, 300), 60)]
    frame = spark.createDataFrame(rows, "k string, at bigint, bin int, row string")  # names that the operator uses itself
    got = runs.with_neighbours(runs.running_sums(frame, "k", "at", {"s": F.col("bin")}, 16), "k", "at", ["at"], 16).collect()
    for key in ("a", None, "b"):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["at"])
        assert [r["s"] for r in mine] == list(np.cumsum([r[2] for r in own])) and {r["row"] for r in mine} == {"row"}
        assert [r["before"] and r["before"]["at"] for r in mine] == [None, *[r[1] for r in own[:-1]]]
        assert [r["after"] and r["after"]["at"] for r in mine] == [*[r[1] for r in own[1:]], None]


def plain_p(a, b):
    if len(a) > 1 and len(b) > 1:
        va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
        if va + vb == 0:
            return 0.0 if np.mean(a) != np.mean(b) else 1.0
        return beta_tail(abs(np.mean(a) - np.mean(b)) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))
    if min(len(a), len(b)) == 1 and max(len(a), len(b)) > 1:
        both = list(a) + list(b)
        one = a[0] if len(a) == 1 else b[0]
        return math.erfc(abs(one - np.mean(both)) / np.std(both) / math.sqrt(2)) / 2 if np.std(both) > 0 else 1.0
    return 1.0


def plain_merge(depth, bounds, alpha):
    bounds = sorted(bounds)
    while bounds:
        ends = [0, *bounds, len(depth)]
        gone = []
        for k in range(1, len(ends) - 1):
            left, right = depth[ends[k - 1] : ends[k]], depth[ends[k] : ends[k + 1]]
            trims = lambda x: [x, x[1:], x[:-1], x[1:-1]]
            if min([1.0, *(plain_p(a, b) for a in trims(left) for b in trims(right))]) > alpha:
                gone.append(ends[k])
        if not gone:
            break
        bounds = [b for b in bounds if b not in gone]
    return bounds


@pytest.mark.parametrize("seed", [1, 2])
def test_shift_merge(spark, seed):
    rng = np.random.default_rng(seed)
    series, bounds, want = [], [], {}
    for chrom in ("chr1", "chr2"):
        depth = np.concatenate([rng.normal(m, 3, n).round(2) for m, n in ((10, 30), (20, 5), (20, 40), (11, 1), (11, 25), (11.5, 30))]).tolist()
        cuts = sorted({30, 35, 75, 76, 101, *rng.choice(range(1, len(depth)), 8, replace=False).tolist()})
        wins = np.cumsum(rng.integers(1, 3, len(depth))).tolist()  # windows with gaps between them
        series += [(chrom, w, x) for w, x in zip(wins, depth, strict=True)]
        bounds += [(chrom, wins[c]) for c in cuts]
        want[chrom] = [(wins[c], c) for c in plain_merge(depth, cuts, 0.01)]
    frame = spark.createDataFrame(series, "chrom string, win bigint, depth double")
    got = shifts.merge_shifts(frame, spark.createDataFrame(bounds, "chrom string, win bigint"), "depth", 0.01, WorkTables(spark)).collect()
    assert {c: sorted((r["win"], r["at"]) for r in got if r["chrom"] == c) for c in want} == want
    assert any(want.values()) and len(got) < len(bounds)


# --- fold-backs and arcs ----------------------------------------------------------------------------

PAIR = "edge string, qname bigint, chrom string, start bigint, end bigint, strand int, m_chrom string, m_start bigint, m_end bigint, m_strand int, folded boolean, m_folded boolean"


def fold(edge, q, start, m_start, strand=1, folded=False):
    return (edge, q, "chr1", start, start + 100, strand, "chr1", m_start, m_start + 100, strand, folded, False)


def test_foldbacks(spark):
    good = [fold("good", k, 1000 + k, 1010 + 2 * k) for k in range(4)]
    rows = good + [fold("good", 9, 300, 1005), fold("good", 8, 1001, 1001), fold("good", 7, 1000, 1012, folded=True)]  # far off, inverted, folded
    rows += [fold("inverted", k, 5000 + k, 5000 + k) for k in range(5)]
    rows += [fold("one-name", 1, 7000 + k, 7020 + k) for k in range(5)]
    rows += [fold("far", k, 9000 + k, 9900 + k) for k in range(5)]  # ends further apart than a read
    rows += [fold("minus", k, 2000 - k, 2030 - k, strand=-1) for k in range(3)]
    got = {r["edge"]: r for r in foldbacks.both_ways(foldbacks.foldback_edges(spark.createDataFrame(rows, PAIR), 150, 600, 2)).where("not turned").collect()}
    assert set(got) == {"good", "minus"}
    assert (got["good"]["pos1"], got["good"]["pos2"], got["good"]["n_pairs"], got["good"]["n_inverted"]) == (1103, 1116, 4, 2)
    assert (got["minus"]["pos1"], got["minus"]["pos2"], got["minus"]["n_pairs"]) == (1998, 2028, 3)
    # A better place in front of some starts leaves these names out.
    refined = spark.createDataFrame([("good", 1001, 1116)], "edge string, pos1 bigint, pos2 bigint")
    assert foldbacks.foldback_edges(spark.createDataFrame(good, PAIR), 150, 600, 2, refined).collect() == []
    # All pairs of a name with an impossible one go.
    twice = [*good, ("good", 2, "chr1", 850, 1102, 1, "chr1", 1000, 1105, 1, False, False)]  # together longer than an insert
    row = foldbacks.foldback_edges(spark.createDataFrame(twice, PAIR), 150, 330, 2).first()
    assert (row["n_names"], row["n_pairs"]) == (3, 3)


def test_arcs_and_bare_shifts(spark):
    mated = spark.createDataFrame([("chr1", 10, 20, 1, None, None), ("chr1", 12, 22, 1, "chr1", 50), ("chr1", 14, 24, -1, "chr9", 5), ("chr1", 15, 25, 1, "chr9", 5)], "chrom string, start bigint, end bigint, strand int, m_chrom string, m_start bigint")
    iv = spark.createDataFrame([("chr1", 0, 100)], "chrom string, start bigint, end bigint")
    out = arcs.outside_reads(mated, iv)
    places = spark.createDataFrame([("a", "chr1", 0, 16, 1), ("b", "chr1", 0, 13, -1), ("c", "chr1", 23, 30, -1)], "id string, chrom string, start bigint, end bigint, strand int")
    assert {r["id"]: r["arcs"] for r in arcs.crossing_arcs(places, out).collect()} == {"a": 2, "b": 0, "c": 1}
    steps = spark.createDataFrame([("chr1", 500, 1), ("chr1", 900, -1)], "chrom string, pos bigint, drop int")
    edges = spark.createDataFrame([("e", "chr1", 520, 1, "chr2", 5, 1, 7), ("f", "chr1", 905, 1, "chr2", 5, 1, 7)], "edge string, chrom1 string, pos1 bigint, strand1 int, chrom2 string, pos2 bigint, strand2 int, support bigint")
    assert [tuple(r) for r in arcs.bare_shifts(steps, edges, 100, 10).collect()] == [("chr1", 901, -1)]  # the edge at 905 leads the other way


# --- sequences of edges -----------------------------------------------------------------------------


def test_edge_sequences(spark):
    rng = random.Random(5)
    genome = {c: "".join(rng.choice("ACGT") for _ in range(500)) for c in ("chr1", "chr2")}
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    edges, want = [], {}
    for s1 in (1, -1):
        for s2 in (1, -1):
            for hom, mid in ((3, "CCC"), (0, ""), (-2, "GG"), (None, None)):
                name = f"{s1}/{s2}/{hom}"
                edges.append((name, "chr1", 200, s1, "chr2", 300, s2, hom, mid))
                h = max(hom or 0, 0)
                side = lambda c, p, s: genome[c][p - h - 19 : p - h + 1] if s == 1 else genome[c][p + h : p + h + 20]
                one, two = side("chr1", 200, s1), side("chr2", 300, s2)
                two = back(two) if s1 == s2 else two
                middle = "N" * 20 if hom is None else mid
                want[name] = one + middle + two if s1 == 1 else two + middle + one
    edges += [("source+", "0", -1, -1, "chr2", 300, 1, 0, ""), ("source-", "0", -1, -1, "chr2", 300, -1, 0, "")]
    want |= {"source+": genome["chr2"][281:301], "source-": genome["chr2"][300:320]}
    frame = spark.createDataFrame(edges, "edge string, chrom1 string, pos1 bigint, strand1 int, chrom2 string, pos2 bigint, strand2 int, hom int, hom_seq string")
    chunks = spark.createDataFrame([(c, at, g[at : at + 64]) for c, g in genome.items() for at in range(0, 500, 64)], "chrom string, start bigint, bases string")
    assert {r["edge"]: r["bases"] for r in edge_sequences.edge_sequences(frame, chunks, 64, 20).collect()} == want


# --- statistics -------------------------------------------------------------------------------------


def test_kept_statistics(spark, tmp_path):
    calls = []
    good = [5.0, 5.0, 1.0, 5.0, 5.0, 1.0, 100.0, 300.0, 30.0, 210.0, 390.0, 4.0, 0.9, 3.0, 77.0]
    frame = lambda values: spark.createDataFrame([values], ", ".join(f"{v} double" for v in statistics.VALUES))

    def measure():
        calls.append(1)
        return frame(good)

    table = str(tmp_path / "stats")
    one = lambda name="a", size=77, sd=3.0, least=2: statistics.kept_statistics(spark, table, name, size, measure, sd, least).first()
    assert list(one()) == good and list(one()) == good and len(calls) == 1  # the second call measures nothing
    assert list(one("b")) == good and len(calls) == 2
    one("a", size=78)  # another size is another data set
    one("a", sd=4.0)
    one("a", least=5)
    assert len(calls) == 5
    for bad in ([*good[:3], None, *good[4:]], [*good[:3], float("nan"), *good[4:]]):
        frame(bad).select(F.lit("c").alias("name"), *statistics.VALUES, F.current_timestamp().alias("written")).write.mode("append").parquet(table)
    one("c")
    assert len(calls) == 6
    row = statistics.scaled(frame([40.0, *good[1:]]), 10.0).first()
    assert row["ratio"] == 0.25 and row["coarse_mean"] == 1.25 and row["fine_deviation"] == 0.5 and row["pair_support"] == 2.0
    assert statistics.scaled(frame(good), -1).first()["ratio"] == 1.0


def test_fingerprint_opens_no_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    first = statistics.fingerprint(spark, str(tmp_path))
    (tmp_path / "b.txt").write_text("more")
    second = statistics.fingerprint(spark, str(tmp_path))
    assert first[1] == 5 and second[1] == 9 and first[0] != second[0]


def test_drawn_windows_keep_away(spark):
    contigs = spark.createDataFrame([("chr1", 10_000), ("chr2", 250)], "chrom string, length bigint")
    masks = spark.createDataFrame([("chr1", 4000, 4100)], "chrom string, start bigint, end bigint")
    rows = [(r["chrom"], r["start"], r["end"]) for r in statistics.drawn_windows(contigs, masks, 100, 1000).collect()]
    assert {c for c, _, _ in rows} == {"chr1"} and all(s >= 100 and e + 100 < 10_000 and (e + 100 < 4000 or s - 100 > 4100) for _, s, e in rows)
    assert sorted(rows)[:2] == [("chr1", 100, 199), ("chr1", 200, 299)] and statistics.drawn_windows(contigs, masks, 100, 7).count() == 7


# --- calls, tracks, integrity, layout ---------------------------------------------------------------

HEAD = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone"


def test_breakend_files(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    rows = ["chr1\t100\ta\tA\tAT]chr2:200]\t.\tPASS\tPE=3\tGT\t0/1", "chr2\t200\tb\tA\tAA]chr1:100]\t.\tPASS\tPE=5\tGT\t0/1", "chr1\t5\tc\tA\tA[chr1:9[\t.\tLow\tPE=9\tGT\t0/1", "chr1\t7\td\tA\tA[chr1:90[\t.\t.\tx=1\tGT:PR\textra\t0/1:4,6"]
    (folder / "a.vcf").write_text("\n".join([HEAD, *rows]) + "\n")
    (folder / "b.vcf").write_text("\n".join([HEAD, rows[0]]) + "\n")
    got = sorted((r["file"][-5:], r["v1"], r["v2"], r["hom"], r["hom_seq"], r["support"]) for r in readers.read_sv_vcfs(spark, str(folder)).collect())
    assert got == sorted([
        ("a.vcf", "chr2:200+", "chr1:100+", 1, "A", 5), ("a.vcf", "chr1:100+", "chr2:200+", 1, "T", 5), ("a.vcf", "chr1:7+", "chr1:90-", None, None, 6), ("a.vcf", "chr1:90-", "chr1:7+", None, None, 6),
        ("b.vcf", "chr1:100+", "chr2:200+", 1, "T", 3), ("b.vcf", "chr2:200+", "chr1:100+", 1, "A", 3),
    ])
    (folder / "c.vcf").write_text(HEAD + "\ttwo\n" + rows[0] + "\t0/1\n")
    with pytest.raises(ValueError, match=r"c\.vcf"):
        readers.read_sv_vcfs(spark, str(folder))


def test_tracks(spark):
    iv = lambda rows: spark.createDataFrame(rows, "chrom string, start bigint, end bigint")
    scored = spark.createDataFrame([("chr1", 0, 9, 0.0), ("chr1", 10, 19, 0.5)], "chrom string, start bigint, end bigint, score double")
    table = tracks.track_table(exclude=iv([("chr2", 0, 5)]), conserved=iv([("chr3", 0, 5)]), mappability=scored, centromere=iv([("chr4", 0, 5), ("chr4", 6, 9)]))
    assert table.where("tag = 'centromere'").count() == 1
    got = {(r["chrom"], r["start"]): (round(r["rep_content"], 3), r["repeat"]) for r in tracks.repeats(iv([("chr1", 0, 19), ("chr1", 0, 9), ("chr2", 3, 9), ("chr3", 5, 9), ("chr9", 0, 1)]), table).collect()}
    assert got == {("chr1", 0): (5.0, True)} | got and got[("chr2", 3)] == (1.0, True) and got[("chr3", 5)] == (1.0, True) and got[("chr9", 0)] == (1.0, False)


def test_integrity(spark):
    v = lambda p, s: f"chr1:{p}{s}"
    sound = [("x", "sequence", v(1, "-"), v(10, "+")), ("x", "sequence", v(11, "-"), v(20, "+")), ("x", "concordant", v(10, "+"), v(11, "-")), ("x", "source", "0:-1-", v(1, "-")), ("x", "discordant", v(20, "+"), v(1, "-"))]
    kind = "amplicon string, kind string, v1 string, v2 string"
    segments = spark.createDataFrame([("x", "chr1", 1, 20)], "amplicon string, chrom string, start bigint, end bigint")
    rules = lambda rows, s=segments: sorted((r["rule"], r["n"]) for r in integrity.graph_violations(spark.createDataFrame(rows, kind), s).collect())
    assert rules(sound) == []
    assert rules([*sound, ("x", "discordant", v(1, "-"), v(20, "+"))]) == [("repeated", 2)]
    assert rules([*sound, ("x", "sequence", v(1, "-"), v(5, "+"))]) == [("shared", 2)]
    assert ("apart", 1) in rules([*sound, ("x", "concordant", v(10, "+"), v(1, "-"))])
    assert rules([x for x in sound if x[3] != v(20, "+") or x[1] != "sequence"]) == [("loose", 1), ("loose", 1), ("uncovered", 10)]
    assert ("turned", 1) in rules([*sound, ("x", "sequence", v(30, "+"), v(21, "-"))])
    assert spark.range(1).select(vertex_text(F.lit("chr1"), F.lit(5), F.lit(-1)).alias("v")).first()["v"] == v(5, "-")


def test_layout(spark):
    rows = [("a", 1, 0, 99, False), ("a", 2, 0, 0, False), ("a", 3, 0, 899, False), ("b", 1, 0, 9, True), ("b", 2, 0, 9, False), ("c", 1, 5, 5, True)]
    got = {(r["g"], r["k"]): (round(r["left"], 4), round(r["right"], 4)) for r in layout.layout(spark.createDataFrame(rows, "g string, k int, start bigint, end bigint, far boolean"), "g", "k", foreign=F.col("far")).collect()}
    assert got[("c", 1)] == (0, 1) and got[("b", 1)] == (0, 0.18) and got[("b", 2)] == (0.28, 1.0)
    assert round(got[("a", 2)][1] - got[("a", 2)][0], 4) == 0.02 and got[("a", 3)][1] == 1.0 and round(got[("a", 2)][0] - got[("a", 1)][1], 4) == 0.05


def test_release(spark):
    tables = WorkTables(spark)
    tables.save(spark.range(3), "numbers")
    folder = tables.folder.removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    tables.close()
    assert not os.path.isdir(folder) and callable(release)


# --- edits of cycles --------------------------------------------------------------------------------

CYCLE = "grp string, cycle bigint, cn double, segments array<struct<seg:string,orient:int>>"


def test_cycle_edits(spark):
    from breakweave.operators import cycle_edits as edits

    places = [("g", "1", "chr1", 0, 100), ("g", "2", "chr1", 50, 200), ("g", "3", "chr1", 300, 400), ("g", "4", "chr1", 0, 200), ("g", "5", "chr2", 0, 10)]
    segments = spark.createDataFrame(places, "grp string, seg string, chrom string, start bigint, end bigint")
    rows = [("g", 1, 5.0, [("3", 1), ("1", 1), ("5", 1)]), ("g", 2, 2.0, [("5", -1), ("2", -1), ("3", 1)]), ("g", 3, 1.0, [("0", 1), ("2", -1), ("0", -1)]), ("g", 4, 3.0, [("0", 1), ("1", 1), ("0", -1)]), ("g", 5, 0.0, [("1", 1)]), ("g", 6, 4.0, [("1", 1), ("3", 1), ("5", -1), ("2", -1), ("3", -1)])]
    cycles = spark.createDataFrame(rows, CYCLE)
    asked = [("g", 1, 2, 2, 2), ("g", 3, 4, 2, 2), ("g", 1, 5, 2, 1), ("g", 1, 2, 1, 2), ("g", 1, 2, 9, 1), ("g", 3, 1, 1, 1)]
    frame = spark.createDataFrame(asked, "grp string, c1 bigint, c2 bigint, i int, j int")
    problems = {(r["c1"], r["c2"], r["i"], r["j"]): r["problem"] for r in edits.judged_merges(cycles, segments, frame).collect()}
    assert problems == {(1, 2, 2, 2): None, (3, 4, 2, 2): "two sources", (1, 5, 2, 1): "no copies", (1, 2, 1, 2): "no overlap", (1, 2, 9, 1): "no such place", (3, 1, 1, 1): "source segment"}
    text = lambda s: ",".join(x["seg"] + "+-"[x["orient"] < 0] for x in s)

    # Forward: the first hybrid (0..200) is segment 4, the second (50..100) is new; cycle 2 passes oppositely and is turned round.
    after, every = edits.merge_at(cycles, segments, frame.where("i = 2 and j = 2 and c1 = 1"))
    got = {r["cycle"]: (r["cn"], text(r["segments"])) for r in after.collect()}
    assert got[7] == (2.0, "3+,4+,5+,3-,6+,5+") and got[1][0] == 3.0 and got[2][0] == 0.0 and len(got) == 7
    assert sorted(tuple(r) for r in every.collect()) == sorted([*places, ("g", "6", "chr1", 50, 100)])
    # Backward, the cycle through the source put first: hybrids 0..200 and 50..100 in the other order.
    back = spark.createDataFrame([("g", 1, 3, 2, 2)], frame.schema)
    after, _ = edits.merge_at(cycles, segments, back)
    got = {r["cycle"]: (r["cn"], text(r["segments"])) for r in after.collect()}
    assert got[7] == (1.0, "0+,4-,3-,5-,6-,0-") and got[3][0] == 0.0 and got[1][0] == 4.0

    turn = spark.createDataFrame([("g", 6, 1, 4), ("g", 6, 2, 5), ("g", 6, 1, 2)], "grp string, c1 bigint, i int, j int")
    assert sorted((r["i"], r["j"], r["problem"] or "") for r in edits.judged_pivots(cycles, segments, turn).collect()) == [(1, 2, "same way"), (1, 4, ""), (2, 5, "")]
    after, _ = edits.pivot_at(cycles, segments, turn.where("j = 4"))
    got = {r["cycle"]: (r["cn"], text(r["segments"])) for r in after.collect()}
    assert got[7] == (4.0, "4+,5+,3-,6-,3-") and got[6][0] == 0.0
