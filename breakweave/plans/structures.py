"""Queries on long reads, tested copy-number shifts, fold-backs, sequences of edges, statistics, tracks and graph integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import breakpoints as B
from ..operators import cycle_edits as Y
from ..operators import edge_sequences as S
from ..operators import foldbacks as D
from ..operators import long_reads as L
from ..operators import pairs as P
from ..operators import shifts as H
from ..operators import statistics as T
from ..operators import tracks as K
from ..operators.amplicons import foreign_expansion as foreign
from ..operators.clusters import merge_clusters
from ..operators.integrity import graph_violations as graph_integrity
from ..operators.layout import layout
from ..operators.runs import with_neighbours
from ..operators.work import WorkTables
from ..sources import readers as R
from .amplicons import CHUNK, INSERT, _amplified, _chunks, _graph, edges
from .bindings import SQL, calls, flows, genes, reads, table
from .catalogue import EDGE_SQL, SHARED, WIN, _merge_sql, _named_pairs, query, windows

# --- long reads -------------------------------------------------------------------------------------

SPLIT = 10
#: Line items as long alignments: clips, matches, an insertion, a deletion, matches again.
SQL["long_reads"] = """SELECT l_orderkey AS qname, CASE WHEN l_linestatus <> 'F' THEN 16 ELSE 0 END AS flag, 'chr' || CAST(l_suppkey % 25 + 1 AS VARCHAR) AS chrom, l_linenumber * 1000 AS shift, l_partkey AS pos,
    l_partkey % 60 AS lead, l_suppkey % 40 AS trail, l_tax >= 0.04 AS hard, CAST(floor(l_quantity) AS BIGINT) AS m, CAST(l_linenumber AS BIGINT) AS ins, CAST(l_linenumber * 2 AS BIGINT) AS del, CAST(l_partkey % 7 + 1 AS BIGINT) AS tail FROM lineitem"""
SHARED["long_blocks"] = f"""SELECT qname, chrom, flag, lead, trail, lead + m + ins + tail + trail AS len, shift + pos + CASE WHEN k = 1 THEN m + del ELSE 0 END AS "start", shift + pos + CASE WHEN del >= {SPLIT} AND k = 0 THEN m ELSE m + del + tail END AS "end",
    lead + CASE WHEN k = 1 THEN m + ins ELSE 0 END AS q0, lead + CASE WHEN del >= {SPLIT} AND k = 0 THEN m + ins ELSE m + ins + tail END AS q1 FROM long_reads, (VALUES (0), (1)) AS b(k) WHERE k = 0 OR del >= {SPLIT}"""
SHARED["long_segments"] = """SELECT *, row_number() OVER (PARTITION BY read ORDER BY read_start, read_end, chrom, "start", "end", strand) AS n FROM (SELECT CAST(qname AS VARCHAR) AS read, chrom, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end",
    CAST(CASE WHEN flag = 16 THEN len - q1 ELSE q0 END AS BIGINT) AS read_start, CAST(CASE WHEN flag = 16 THEN len - q0 ELSE q1 END AS BIGINT) AS read_end, CASE WHEN flag = 16 THEN -1 ELSE 1 END AS strand, CAST(len AS BIGINT) AS read_length FROM long_blocks) AS s"""


def _long_segments(spark: SparkSession, d: str) -> DataFrame:
    """Line items written as text alignments, read back by Spark's text reader, cut at deletions of ten bases and more."""
    t, text = table(spark, d, "lineitem"), lambda c: c.cast("string")
    part = lambda n, op: F.when(n > 0, F.concat(text(n), F.lit(op))).otherwise("")
    lead, trail, shift = F.col("l_partkey") % 60, F.col("l_suppkey") % 40, F.col("l_linenumber").cast("bigint") * 1000
    clip = F.when(F.col("l_tax") >= 0.04, "H").otherwise("S")
    clipped = lambda n: F.when(n > 0, F.concat(text(n), clip)).otherwise("")
    cigar = F.concat(clipped(lead), part(F.col("l_quantity").cast("bigint"), "M"), part(F.col("l_linenumber"), "I"), part(F.col("l_linenumber") * 2, "D"), part(F.col("l_partkey") % 7 + 1, "="), clipped(trail))
    chrom = F.concat(F.lit("chr"), text(F.col("l_suppkey") % 25 + 1), F.lit(":"), text(shift), F.lit("-"), text(shift + 100_000))
    flag = F.when(F.col("l_linestatus") != "F", "16").otherwise("0")
    line = F.concat_ws("\t", text(F.col("l_orderkey")), flag, chrom, text(F.col("l_partkey") + 1), F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    tables = WorkTables(spark)
    path = tables.write_text(t.select(line.alias("value")), "alignments")
    return L.read_segments(R.read_sam(spark, path), split=SPLIT)


@query("""SELECT read, n, chrom, "start", "end", read_start, read_end, strand, read_length FROM long_segments""")
def long_read_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of every long read in the order of the read."""
    return _long_segments(spark, d).select("read", "n", "chrom", "start", "end", "read_start", "read_end", "strand", "read_length")


@query("""SELECT read, CAST(count(*) AS BIGINT) AS segments, '0+,' || string_agg(n || CASE WHEN strand = 1 THEN '+' ELSE '-' END, ',' ORDER BY n) || ',0-' AS walk FROM long_segments GROUP BY read""")
def long_read_walks(spark: SparkSession, d: str) -> DataFrame:
    """Each read's segments as a walk from the source to it."""
    return L.read_walks(_long_segments(spark, d))


# --- shifts of copy number --------------------------------------------------------------------------

ALPHA = 0.01
SHARED["shift_series"] = f"""SELECT chrom, win, bases, row_number() OVER w AS n, sum(bases) OVER w AS s, sum(bases * bases) OVER w AS q, count(*) OVER (PARTITION BY chrom) AS total, sum(bases) OVER (PARTITION BY chrom) AS s_all, sum(bases * bases) OVER (PARTITION BY chrom) AS q_all,
    bases > (SELECT sum(bases) / count(*) * 1.5 FROM win_cov) AS high, lag(bases) OVER w AS prior FROM win_cov WINDOW w AS (PARTITION BY chrom ORDER BY win)"""
SHARED["shift_bounds"] = """SELECT chrom, win, n - 1 AS place, n, s, q, s - bases AS s0, q - bases * bases AS q0, bases AS v, prior AS u FROM (SELECT *, lag(high) OVER (PARTITION BY chrom ORDER BY win) AS was FROM shift_series) AS f WHERE high <> was"""
SHARED["shift_ends"] = """SELECT chrom, place, s0, q0, v, u FROM shift_bounds UNION ALL SELECT chrom, 0, 0, 0, bases, 0 FROM shift_series WHERE n = 1 UNION ALL SELECT chrom, n, s, q, 0, bases FROM shift_series WHERE n = total"""
_SIDES = """SELECT chrom, place, {side} AS side, x, y, hi_place - lo_place - x - y AS n, hi_s - lo_s - x * lo_v - y * hi_u AS s, hi_q - lo_q - x * lo_v * lo_v - y * hi_u * hi_u AS q FROM (SELECT b.*, {low}, {high} FROM around AS b) AS z, (VALUES (0), (1)) AS a(x), (VALUES (0), (1)) AS c(y)"""
_LEFT = _SIDES.format(side=0, low="p_place AS lo_place, p_s AS lo_s, p_q AS lo_q, p_v AS lo_v", high="place AS hi_place, s0 AS hi_s, q0 AS hi_q, u AS hi_u")
_RIGHT = _SIDES.format(side=1, low="place AS lo_place, s0 AS lo_s, q0 AS lo_q, v AS lo_v", high="f_place AS hi_place, f_s AS hi_s, f_q AS hi_q, f_u AS hi_u")
SHARED["around"] = """SELECT * FROM (SELECT *, lag(place) OVER w AS p_place, lag(s0) OVER w AS p_s, lag(q0) OVER w AS p_q, lag(v) OVER w AS p_v, lead(place) OVER w AS f_place, lead(s0) OVER w AS f_s, lead(q0) OVER w AS f_q, lead(u) OVER w AS f_u FROM shift_ends WINDOW w AS (PARTITION BY chrom ORDER BY place)) AS r WHERE p_place IS NOT NULL AND f_place IS NOT NULL"""


def _shift_bounds(spark: SparkSession, d: str, tables: WorkTables) -> tuple[DataFrame, DataFrame]:
    """Coverage per window, and the windows where it begins or ceases to be half above the mean."""
    w = tables.save(windows(spark, d).select("chrom", "win", "bases"), "windows")
    high = w.join(w.agg((F.sum("bases") / F.count("*") * 1.5).alias("bound"))).select("chrom", "win", (F.col("bases") > F.col("bound")).alias("high"))
    return w, with_neighbours(high, "chrom", "win", ["high"]).where("before.high <> high").select("chrom", "win")


@query(f"""SELECT l.chrom, CAST(l.place AS BIGINT) AS place, CAST(count(*) AS BIGINT) AS n_tests, round(max(abs(l.s / l.n - r.s / r.n) / sqrt((l.q - l.s * l.s / l.n) / (l.n - 1) / l.n + (r.q - r.s * r.s / r.n) / (r.n - 1) / r.n)), 6) AS t
    FROM ({_LEFT}) AS l JOIN ({_RIGHT}) AS r ON l.chrom = r.chrom AND l.place = r.place WHERE l.n > 1 AND r.n > 1 AND (l.q - l.s * l.s / l.n) / (l.n - 1) / l.n + (r.q - r.s * r.s / r.n) / (r.n - 1) / r.n > 1e-9 GROUP BY l.chrom, l.place""")
def shift_tests(spark: SparkSession, d: str) -> DataFrame:
    """One round of tests: of every bound the largest Welch statistic over the runs beside it, whole and trimmed."""
    tables = WorkTables(spark)
    w, bounds = _shift_bounds(spark, d, tables)
    rows = H.tested(H.placed_bounds(w, bounds, "bases", tables))
    welch = F.filter("tests", lambda t: (t["df"] > 0) & (t["t"] < float("inf")))
    return rows.select("chrom", F.col("at").alias("place"), F.size(welch).cast("bigint").alias("n_tests"), F.round(F.array_max(F.transform(welch, lambda t: t["t"])), 6).alias("t")).where("n_tests > 0")


@query()
def shift_merge(spark: SparkSession, d: str) -> DataFrame:
    """The bounds that stay once those without a significant step are merged, round by round."""
    tables = WorkTables(spark)
    w, bounds = _shift_bounds(spark, d, tables)
    return H.merge_shifts(w, bounds, "bases", ALPHA, tables).withColumnRenamed("at", "place")


# --- graphs with shifts -----------------------------------------------------------------------------

#: Every read with the place of the next read of its name; the last one's mate counts as unmapped.
SHARED["mated"] = """SELECT chrom, "start", "end", strand, lead(chrom) OVER w AS m_chrom, lead("start") OVER w AS m_start FROM reads WINDOW w AS (PARTITION BY qname ORDER BY number, part, "start", "end", chrom, strand)"""
SHARED["bare"] = f"""SELECT chrom, CASE WHEN was THEN pos ELSE pos + 1 END AS pos, CASE WHEN was THEN 1 ELSE -1 END AS strand, pos AS cut FROM (SELECT chrom, win * {WIN} - 1 AS pos, lag(high) OVER (PARTITION BY chrom ORDER BY win) AS was, high FROM shift_series) AS f
    WHERE high <> was AND NOT EXISTS (SELECT 1 FROM edge_rows AS e WHERE e.chrom1 = f.chrom AND e.strand1 * (CASE WHEN was THEN 1 ELSE -1 END) > 0 AND abs(e.pos1 - f.pos) < {INSERT + WIN})"""
SHARED["bare_in"] = """SELECT b.*, s.span FROM bare AS b JOIN spans AS s ON s.chrom = b.chrom AND b.cut >= s."start" AND b.cut < s."end\""""
SHARED["tiles_shifted"] = SHARED["tiles"].replace("FROM tips UNION ALL", "FROM tips UNION ALL SELECT span, cut FROM bare_in UNION ALL")
SHARED["outside"] = """SELECT * FROM mated AS m WHERE NOT EXISTS (SELECT 1 FROM spans AS s WHERE s.chrom = m.m_chrom AND m.m_start BETWEEN s."start" AND s."end")"""
SHARED["spots"] = f"""SELECT span, chrom, "start" AS pos, -1 AS strand, "start" AS a, "start" + {INSERT} AS b FROM spans UNION ALL SELECT span, chrom, "end", 1, greatest(0, "end" - {INSERT}), "end" FROM spans UNION ALL SELECT span, chrom, pos, strand, greatest(0, pos - {2 * INSERT}), pos + {2 * INSERT} FROM bare_in"""
SHARED["arcs"] = """SELECT s.span, s.chrom || ':' || s.pos || CASE WHEN s.strand = 1 THEN '+' ELSE '-' END AS tip, count(o.chrom) AS support FROM spots AS s LEFT JOIN outside AS o ON o.chrom = s.chrom AND o.strand = s.strand AND o."start" <= s.b AND o."end" >= s.a GROUP BY ALL"""
_BOUNDS = """UNION ALL SELECT amplicon, chrom || ':' || "start" || '-', 0 FROM spans JOIN amps USING (span) UNION ALL SELECT amplicon, chrom || ':' || "end" || '+', 0 FROM spans JOIN amps USING (span)"""
assert _BOUNDS in SHARED["graph_rows"]
SHARED["shifted_rows"] = SHARED["graph_rows"].replace("FROM tiles", "FROM tiles_shifted").replace(_BOUNDS, "UNION ALL SELECT amplicon, tip, support FROM arcs JOIN amps USING (span)")


def _mated(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("qname").orderBy("number", "part", "start", "end", "chrom", "strand")  # one read name's alignments
    return reads(spark, d).select("chrom", "start", "end", "strand", F.lead("chrom").over(order).alias("m_chrom"), F.lead("start").over(order).alias("m_start"))


def _shifts(spark: SparkSession, d: str, tables: WorkTables) -> DataFrame:
    """Where coverage begins or ceases to be half above the mean: the last place before, and whether it falls."""
    w = tables.save(windows(spark, d).select("chrom", "win", "bases"), "windows")
    high = w.join(w.agg((F.sum("bases") / F.count("*") * 1.5).alias("bound"))).select("chrom", "win", (F.col("bases") > F.col("bound")).alias("high"))
    return with_neighbours(high, "chrom", "win", ["high"]).where("before.high <> high").select("chrom", (F.col("win") * WIN - 1).alias("pos"), F.when(F.col("before.high"), 1).otherwise(-1).alias("drop"))


@query("""SELECT amplicon, edge, kind, v1, v2, size, "count", round(cost, 6) AS cost FROM shifted_rows""")
def amplicon_graph_shifts(spark: SparkSession, d: str) -> DataFrame:
    """The amplicons' graphs, cut also at shifts that no edge explains; bounds and shifts count the reads that lead out of all intervals."""
    return _graph(spark, d, _shifts(spark, d, WorkTables(spark)), _mated(spark, d)).withColumn("cost", F.round("cost", 6))


# --- fold-backs -------------------------------------------------------------------------------------

FOLD_READ, FOLD_INSERT, FOLD_SUPPORT = 1500, 12_000, 2
SHARED["fold_pairs"] = """SELECT a.chrom || '/' || a.strand AS edge, a.qname, a.strand, a."start", a."end", b."start" AS m_start, b."end" AS m_end, CASE WHEN a.strand = 1 THEN a."end" ELSE -a."start" END AS x, CASE WHEN a.strand = 1 THEN b."end" ELSE -b."start" END AS y,
    a.chrom, (CASE WHEN a.strand = 1 THEN a."start" = b."start" ELSE a."end" = b."end" END) OR a.part % 10 = 0 OR b.part % 10 = 0 AS inverted FROM reads AS a JOIN reads AS b ON a.qname = b.qname AND a.number < b.number AND a.chrom = b.chrom AND a.strand = b.strand"""
SHARED["fold_near"] = f"""SELECT *, count(DISTINCT CASE WHEN NOT inverted THEN qname END) OVER (PARTITION BY edge) AS names, sum(CASE WHEN inverted THEN 1 ELSE 0 END) OVER (PARTITION BY edge) AS n_inverted FROM (SELECT *, max(x) OVER (PARTITION BY edge) AS tip1, max(y) OVER (PARTITION BY edge) AS tip2 FROM fold_pairs) AS t WHERE abs(tip1 - tip2) <= {FOLD_READ}"""
SHARED["fold_kept"] = f"""SELECT *, count(*) OVER (PARTITION BY edge ORDER BY x RANGE BETWEEN {FOLD_INSERT - 2 * FOLD_READ - 1} PRECEDING AND CURRENT ROW) AS dense FROM fold_near WHERE NOT inverted AND names >= {FOLD_SUPPORT}"""
SHARED["fold_dense"] = f"""SELECT *, count(*) OVER (PARTITION BY edge) AS n, max(x) OVER (PARTITION BY edge) AS t1, max(y) OVER (PARTITION BY edge) AS t2 FROM (SELECT k.*, a.anchor FROM fold_kept AS k JOIN (SELECT edge, max(x) AS anchor FROM (SELECT *, max(dense) OVER (PARTITION BY edge) AS most FROM fold_kept) AS m WHERE dense = most GROUP BY edge) AS a USING (edge)) AS d
    WHERE x <= anchor AND x > anchor - {FOLD_INSERT - 2 * FOLD_READ}"""
SHARED["fold_bad"] = f"""SELECT DISTINCT edge, qname FROM fold_dense WHERE n >= {FOLD_SUPPORT} AND (greatest(CASE WHEN strand = 1 THEN "start" ELSE -"end" END, CASE WHEN strand = 1 THEN m_start ELSE -m_end END) > t1
    OR t1 - CASE WHEN strand = 1 THEN "start" ELSE -"end" END + t2 - CASE WHEN strand = 1 THEN m_start ELSE -m_end END > {FOLD_INSERT})"""
SHARED["fold_edges"] = f"""SELECT edge, chrom, strand, CAST(t1 * strand AS BIGINT) AS pos1, CAST(t2 * strand AS BIGINT) AS pos2, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(DISTINCT qname) AS BIGINT) AS n_names, CAST(n_inverted AS BIGINT) AS n_inverted
    FROM fold_dense AS d WHERE n >= {FOLD_SUPPORT} AND NOT EXISTS (SELECT 1 FROM fold_bad AS b WHERE b.edge = d.edge AND b.qname = d.qname) GROUP BY edge, chrom, strand, t1, t2, n_inverted HAVING count(*) >= {FOLD_SUPPORT}"""


@query("""SELECT *, false AS turned FROM fold_edges UNION ALL SELECT edge, chrom, strand, pos2, pos1, n_pairs, n_names, n_inverted, true FROM fold_edges WHERE pos1 <> pos2""")
def foldback_edges(spark: SparkSession, d: str) -> DataFrame:
    """Fold-backs between reads of one name, an edge for each contig and strand: inverted pairs removed, the densest stretch kept, names with an impossible pair left out."""
    r = reads(spark, d).withColumn("folded", F.col("part") % 10 == 0).drop("part", "mapq", "proper")
    mates = r.select(*[F.col(c).alias(f"m_{c}") for c in r.columns])
    pairs = r.join(mates, (F.col("qname") == F.col("m_qname")) & (F.col("number") < F.col("m_number")) & (F.col("chrom") == F.col("m_chrom")) & (F.col("strand") == F.col("m_strand")))
    pairs = WorkTables(spark).save(pairs.withColumn("edge", F.concat_ws("/", "chrom", "strand")), "fold-pairs")
    return D.both_ways(D.foldback_edges(pairs, FOLD_READ, FOLD_INSERT, FOLD_SUPPORT))


# --- sequences of edges -----------------------------------------------------------------------------

FLANK = 60
SHARED["text_edges"] = """SELECT doc_id, doc_id + 1 AS other, coalesce(text, '') AS t, 10 + length(coalesce(text, '')) // 2 AS pos1, 10 + doc_id % 300 AS pos2, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS strand1, CASE WHEN doc_id // 2 % 2 = 0 THEN 1 ELSE -1 END AS strand2,
    CASE WHEN doc_id % 5 > 0 THEN doc_id % 8 - 3 END AS hom FROM documents"""


def _flank_sql(text: str, pos: str, strand: str, turn: str) -> str:
    low = f"CASE WHEN {strand} = 1 THEN {pos} - greatest(coalesce(hom, 0), 0) - {FLANK - 1} ELSE {pos} + greatest(coalesce(hom, 0), 0) END"
    piece = f"rpad(repeat('n', CAST(greatest(0, -({low})) AS BIGINT)) || substr({text}, CAST(greatest(0, {low}) + 1 AS BIGINT), CAST({FLANK} + least(0, {low}) AS BIGINT)), {FLANK}, 'n')"
    return f"CASE WHEN {turn} THEN translate(reverse({piece}), 'ACGTacgt', 'TGCAtgca') ELSE {piece} END"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS edge, hom_seq, CASE WHEN strand1 = 1 THEN f1 || mid || f2 ELSE f2 || mid || f1 END AS bases FROM (SELECT *, {_flank_sql('t', 'pos1', 'strand1', 'false')} AS f1, {_flank_sql('o', 'pos2', 'strand2', 'strand1 = strand2')} AS f2, coalesce(hom_seq, repeat('N', 20)) AS mid FROM (
    SELECT e.*, coalesce(d.text, '') AS o, CASE WHEN hom >= 0 THEN substr(t, CASE WHEN strand1 = 1 THEN 40 - hom ELSE 5 END + 1, hom) WHEN hom < 0 THEN substr(t, CASE WHEN strand1 = 1 THEN 40 ELSE 5 + hom END + 1, -hom) END AS hom_seq FROM text_edges AS e LEFT JOIN documents AS d ON d.doc_id = e.other) AS x) AS y""")
def edge_sequences(spark: SparkSession, d: str) -> DataFrame:
    """An edge from the middle of every text into the next text, with the bases of its homology and both flanks, from chunked texts."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    sign = lambda c: F.when(c % 2 == 0, 1).otherwise(-1)
    hom = F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 8 - 3).cast("int"))
    ends = docs.select(
        F.col("doc_id").cast("string").alias("edge"), F.col("doc_id").cast("string").alias("chrom1"), (10 + F.floor(F.length("t") / 2)).alias("pos1"), sign(F.col("doc_id")).alias("strand1"),
        (F.col("doc_id") + 1).cast("string").alias("chrom2"), (10 + F.col("doc_id") % 300).alias("pos2"), sign(F.floor(F.col("doc_id") / 2)).alias("strand2"), hom.alias("hom"), "t",
    )
    found = ends.withColumn("hom_seq", S.homology_bases(F.col("t"), F.lit(5), F.lit(40), F.col("strand1"), F.col("hom"))).drop("t")
    return S.edge_sequences(found, _chunks(spark, d), CHUNK, FLANK).select("edge", "hom_seq", "bases")


# --- statistics -------------------------------------------------------------------------------------

COARSE, FINE, DRAWN = 1000, 100, 200
SHARED["stat_reads"] = """SELECT *, CASE WHEN m_chrom = chrom THEN m_start - "start" END AS template FROM (SELECT chrom, "start", "end", strand, proper, lead(chrom) OVER w AS m_chrom, lead("start") OVER w AS m_start FROM reads WINDOW w AS (PARTITION BY qname ORDER BY number, part, "start", "end", chrom, strand, proper)) AS r"""


def _drawn_sql(width: int) -> str:
    return f"""SELECT chrom, k * {width} AS a, k * {width} + {width - 1} AS b FROM (SELECT chrom, unnest(range(1, len // {width} - 1)) AS k FROM (SELECT chrom, CAST(max("end") AS BIGINT) AS len FROM reads GROUP BY chrom) AS c) AS g
        WHERE NOT EXISTS (SELECT 1 FROM genes AS m WHERE m.size_class >= 48 AND m.chrom = g.chrom AND m."start" <= k * {width} + {width - 1} + {width} AND m."end" >= greatest(0, k * {width} - {width})) ORDER BY md5('0:' || chrom || ':' || k * {width} || ':' || {width}), chrom, k LIMIT {DRAWN}"""


def _depth_sql(width: int) -> str:
    depths = f"""SELECT coalesce(sum(CASE WHEN r.chrom IS NOT NULL THEN least(w.b, r."end") - greatest(w.a, r."start") + 1 END), 0) / {width} AS depth FROM ({_drawn_sql(width)}) AS w LEFT JOIN reads AS r ON r.chrom = w.chrom AND r."start" <= w.b AND r."end" >= w.a GROUP BY w.chrom, w.a"""
    return f"""SELECT max(CASE WHEN rank = n // 2 THEN depth END) AS med, avg(depth) AS mean, stddev_pop(depth) AS sd FROM (SELECT depth, row_number() OVER (ORDER BY depth) - 1 AS rank, count(*) OVER () AS n FROM (SELECT depth, median(depth) OVER () AS rough FROM ({depths}) AS d) AS e WHERE depth > 0 AND depth < 5 * rough) AS f"""


SHARED["stat_lengths"] = f"""SELECT count(*) AS n, avg(r."end" - r."start" + 1) AS rl, count(*) FILTER (good) AS k, avg(template) FILTER (good) AS ins, stddev_pop(template) FILTER (good) AS isd
    FROM ({_drawn_sql(COARSE)}) AS w JOIN (SELECT *, coalesce(proper AND strand = 1 AND template > 0 AND template < 10000, false) AS good FROM stat_reads) AS r ON r.chrom = w.chrom AND r."start" <= w.b AND r."end" >= w.a"""
SHARED["stat_row"] = f"""SELECT c.med AS coarse_median, c.mean AS coarse_mean, c.sd AS coarse_deviation, f.med AS fine_median, f.mean AS fine_mean, f.sd AS fine_deviation, rl AS read_length, ins AS insert_size, isd AS insert_deviation, greatest(0, ins - 3 * isd) AS min_insert, ins + 3 * isd AS max_insert,
    greatest(round(f.mean / 10 * ((ins - rl) / 2 / rl) * (2 * k / n)), 2) AS pair_support, 2 * k / n AS share_proper, 3.0 AS deviations, (SELECT count(*) FROM reads) AS size FROM ({_depth_sql(COARSE)}) AS c, ({_depth_sql(FINE)}) AS f, stat_lengths"""


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("qname").orderBy("number", "part", "start", "end", "chrom", "strand", "proper")  # one read name's alignments
    r = reads(spark, d).withColumns({"m_chrom": F.lead("chrom").over(order), "m_start": F.lead("start").over(order)})
    r = r.select("chrom", "start", "end", "strand", "proper", F.when(F.col("m_chrom") == F.col("chrom"), F.col("m_start") - F.col("start")).alias("template"))
    contigs = r.groupBy("chrom").agg(F.max("end").alias("length"))
    return T.sample_statistics(r, contigs, genes(spark, d).where("size_class >= 48"), F.lit(r.count()), COARSE, FINE, DRAWN)


@query("SELECT " + ", ".join(f"round(CAST({v} AS DOUBLE), 5) AS {v}" for v in T.VALUES) + " FROM stat_row")
def sample_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen statistics of the reads, on windows drawn by a hash."""
    return _statistics(spark, d).select(*[F.round(v, 5).alias(v) for v in T.VALUES])


@query(f"""SELECT round(r, 6) AS ratio, round(coarse_mean * r, 5) AS coarse_mean, round(fine_deviation * sqrt(r), 5) AS fine_deviation, round(CAST(CASE WHEN r < 1 THEN greatest(fine_mean * r / 10 * ((insert_size - read_length) / 2 / read_length) * share_proper, 2) ELSE pair_support END AS DOUBLE), 5) AS pair_support
    FROM (SELECT *, CASE WHEN coarse_median > 2 THEN 2 / coarse_median ELSE 1.0 END AS r FROM stat_row) AS s""")
def kept_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The same row taken from the table that keeps it, scaled to a depth of 2."""
    tables = WorkTables(spark)
    name, size = T.fingerprint(spark, f"{d}/lineitem.parquet")
    measure = lambda: _statistics(spark, d).withColumn("size", F.lit(float(size)))
    for _ in range(2):  # the second call finds the row that the first has written
        row = T.kept_statistics(spark, f"{tables.folder}/statistics", name, size, measure)
    return T.scaled(row, 2.0).select(F.round("ratio", 6).alias("ratio"), *[F.round(v, 5).alias(v) for v in ("coarse_mean", "fine_deviation", "pair_support")])


# --- calls of other tools, tracks, integrity, layout ------------------------------------------------

HEADER = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"
SHARED["call_rows"] = """SELECT v1, v2, support, support % 2 AS file, CASE WHEN support % 2 = 0 THEN 'CA' END AS hom_seq FROM flows WHERE support % 7 > 0 UNION ALL SELECT v2, v1, support, support % 2, CASE WHEN support % 2 = 0 THEN 'TG' END FROM flows WHERE support % 7 > 0 AND support % 3 = 0"""
SHARED["call_once"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, least(v1, v2), greatest(v1, v2) ORDER BY support DESC, v1, v2, hom_seq NULLS FIRST) AS k FROM call_rows) AS r WHERE k = 1"""


@query("""SELECT v1, v2, CAST(length(hom_seq) AS INTEGER) AS hom, hom_seq, CAST(support AS INTEGER) AS support FROM call_once UNION ALL SELECT v2, v1, CAST(length(hom_seq) AS INTEGER), translate(reverse(hom_seq), 'ACGTacgt', 'TGCAtgca'), CAST(support AS INTEGER) FROM call_once""")
def breakend_mates(spark: SparkSession, d: str) -> DataFrame:
    """Flows written as breakend files, a third of them with their mates too, and read as calls in both directions."""
    f = flows(spark, d)

    def lines(a: int, b: int, inserted: str, rows: DataFrame) -> DataFrame:
        more = F.when(F.col("support") % 2 == 0, inserted).otherwise("")
        place = F.concat(f"chrom{b}", F.lit(":"), F.col(f"pos{b}").cast("string"))
        mark = F.when(F.col(f"strand{b}") == 1, "]").otherwise("[")
        alt = F.when(F.col(f"strand{a}") == 1, F.concat(F.lit("A"), more, mark, place, mark)).otherwise(F.concat(mark, place, mark, more, F.lit("A")))
        passed = F.when(F.col("support") % 7 == 0, "LowQual").otherwise("PASS")
        info = F.concat(F.lit("SVTYPE=BND;PE="), F.col("support").cast("string"))
        return rows.select("support", F.concat_ws("\t", f"chrom{a}", F.col(f"pos{a}").cast("string"), F.lit("x"), F.lit("A"), alt, F.lit("."), passed, info, F.lit("GT"), F.lit("0/1")).alias("value"))

    every = lines(1, 2, "CA", f).unionByName(lines(2, 1, "TG", f.where("support % 3 = 0")))
    tables = WorkTables(spark)
    head = spark.createDataFrame([(HEADER,)], "value string")
    for k in (0, 1):
        tables.write_text(head.unionByName(every.where(F.col("support") % 2 == k).select("value")).coalesce(1), f"calls-{k}")  # a file has one header
    return R.read_sv_vcfs(spark, f"{tables.folder}/*-calls-*").drop("file")


@query("""SELECT c.id, c.chrom, c."start", c."end", round(coalesce(sum(CASE WHEN g.chrom IS NOT NULL THEN (least(c."end", g."end") - greatest(c."start", g."start") + 1) * CASE WHEN score = 0 THEN 5.0 ELSE 1 / score END END) / sum(CASE WHEN g.chrom IS NOT NULL THEN least(c."end", g."end") - greatest(c."start", g."start") + 1 END), 1.0), 6) AS rep_content,
    coalesce(bool_or(size_class <= 3 OR size_class >= 48), false) OR coalesce(sum(CASE WHEN g.chrom IS NOT NULL THEN (least(c."end", g."end") - greatest(c."start", g."start") + 1) * CASE WHEN score = 0 THEN 5.0 ELSE 1 / score END END) / sum(CASE WHEN g.chrom IS NOT NULL THEN least(c."end", g."end") - greatest(c."start", g."start") + 1 END), 1.0) > 4.5 AS "repeat"
    FROM calls AS c LEFT JOIN genes AS g ON g.chrom = c.chrom AND g."start" <= c."end" AND g."end" >= c."start" GROUP BY c.id, c.chrom, c."start", c."end\"""")
def filter_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Calls that meet excluded or conserved regions, or have a repeat content over 4.5; three tracks in one pass."""
    g = genes(spark, d)
    tracks = K.track_table(exclude=g.where("size_class <= 3"), conserved=g.where("size_class >= 48"), mappability=g)
    found = K.repeats(calls(spark, d).select("id", "chrom", "start", "end"), tracks)
    return found.withColumn("rep_content", F.round("rep_content", 6))


#: The amplicons' graphs with damage: every fifth edge twice, every seventh sequence edge missing, every ninth one turned, every eleventh concordant edge moved.
SHARED["broken"] = """SELECT amplicon, kind, CASE WHEN kind = 'sequence' AND h % 9 = 0 THEN v2 WHEN kind = 'concordant' AND h % 11 = 0 THEN v2 ELSE v1 END AS v1, CASE WHEN kind = 'sequence' AND h % 9 = 0 THEN v1 ELSE v2 END AS v2 FROM (SELECT *, length(v1) * 31 + length(v2) * 17 + size + "count" AS h FROM graph_rows) AS g, (VALUES (0), (1)) AS t(k)
    WHERE (k = 0 OR h % 5 = 0) AND NOT (kind = 'sequence' AND h % 7 = 0)"""
SHARED["broken_places"] = """SELECT *, regexp_extract(v1, '^(.*):-?[0-9]+[+-]$', 1) AS c1, CAST(regexp_extract(v1, ':(-?[0-9]+)[+-]$', 1) AS BIGINT) AS p1, right(v1, 1) AS s1, regexp_extract(v2, '^(.*):-?[0-9]+[+-]$', 1) AS c2, CAST(regexp_extract(v2, ':(-?[0-9]+)[+-]$', 1) AS BIGINT) AS p2, right(v2, 1) AS s2 FROM broken"""
SHARED["broken_ends"] = """SELECT amplicon, item, count(*) AS n FROM (SELECT amplicon, v1 AS item FROM (SELECT DISTINCT * FROM broken WHERE kind = 'sequence') AS a UNION ALL SELECT amplicon, v2 FROM (SELECT DISTINCT * FROM broken WHERE kind = 'sequence') AS b) AS e GROUP BY ALL"""


@query("""SELECT amplicon, 'repeated' AS rule, kind || ' ' || least(v1, v2) || ' ' || greatest(v1, v2) AS item, CAST(count(*) AS BIGINT) AS n FROM broken GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT amplicon, 'shared', item, CAST(n AS BIGINT) FROM broken_ends WHERE n > 1
    UNION ALL SELECT DISTINCT amplicon, 'turned', v1 || '>' || v2, 1 FROM broken_places WHERE kind = 'sequence' AND (c1 <> c2 OR s1 <> '-' OR s2 <> '+' OR p1 > p2)
    UNION ALL SELECT DISTINCT amplicon, 'apart', v1 || '>' || v2, 1 FROM broken_places WHERE kind = 'concordant' AND NOT (c1 = c2 AND (s1 = '+' AND s2 = '-' AND p2 = p1 + 1 OR s1 = '-' AND s2 = '+' AND p1 = p2 + 1))
    UNION ALL SELECT amplicon, 'loose', item, CAST(count(*) AS BIGINT) FROM (SELECT amplicon, v1 AS item FROM broken WHERE kind <> 'sequence' UNION ALL SELECT amplicon, v2 FROM broken WHERE kind <> 'sequence') AS u WHERE item <> '0:-1-' AND NOT EXISTS (SELECT 1 FROM broken_ends AS e WHERE e.amplicon = u.amplicon AND e.item = u.item) GROUP BY amplicon, item
    UNION ALL SELECT a.amplicon, 'uncovered', s.chrom || ':' || s."start" || '-' || s."end", CAST(s."end" - s."start" + 1 - coalesce((SELECT sum(least(s."end", t.p2) - greatest(s."start", t.p1) + 1) FROM (SELECT DISTINCT amplicon, c1, p1, p2 FROM broken_places WHERE kind = 'sequence' AND p1 <= p2) AS t WHERE t.amplicon = a.amplicon AND t.c1 = s.chrom AND t.p1 <= s."end" AND t.p2 >= s."start"), 0) AS BIGINT) AS n
        FROM spans AS s JOIN amps AS a USING (span) WHERE s."end" - s."start" + 1 > coalesce((SELECT sum(least(s."end", t.p2) - greatest(s."start", t.p1) + 1) FROM (SELECT DISTINCT amplicon, c1, p1, p2 FROM broken_places WHERE kind = 'sequence' AND p1 <= p2) AS t WHERE t.amplicon = a.amplicon AND t.c1 = s.chrom AND t.p1 <= s."end" AND t.p2 >= s."start"), 0)""")
def graph_violations(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the amplicons' graphs once they are damaged by rule; the graphs themselves break none."""
    g = _graph(spark, d)
    tables = WorkTables(spark)
    places = g.where("kind = 'sequence'").select("amplicon", F.regexp_extract("v1", r"^(.*):", 1).alias("chrom"), F.regexp_extract("v1", r":(\d+)-$", 1).cast("bigint").alias("start"), F.regexp_extract("v2", r":(\d+)\+$", 1).cast("bigint").alias("end"))
    spans = merge_clusters(places.select(F.concat_ws("|", "amplicon", "chrom").alias("chrom"), "start", "end"), 1)  # tiles of one interval touch
    spans = tables.save(spans.select(F.regexp_extract("chrom", r"^(.*)\|", 1).alias("amplicon"), F.regexp_extract("chrom", r"\|([^|]*)$", 1).alias("chrom"), "start", "end"), "spans")
    h = F.length("v1") * 31 + F.length("v2") * 17 + F.col("size") + F.col("count")
    marked = g.withColumn("h", h).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where(((F.col("k") == 0) | (F.col("h") % 5 == 0)) & ~((F.col("kind") == "sequence") & (F.col("h") % 7 == 0)))
    turned, moved = (F.col("kind") == "sequence") & (F.col("h") % 9 == 0), (F.col("kind") == "concordant") & (F.col("h") % 11 == 0)
    broken = marked.select("amplicon", "kind", F.when(turned | moved, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(turned, F.col("v1")).otherwise(F.col("v2")).alias("v2"))
    return graph_integrity(tables.save(broken, "broken"), spans)


SHARED["laid"] = """SELECT *, "end" - "start" + 1 AS size, size_class >= 45 AS f FROM (SELECT DISTINCT chrom, "start", "end", size_class, gene FROM genes) AS g"""
SHARED["laid_parts"] = """SELECT *, least(0.02, room / n) AS narrow FROM (SELECT *, (CASE WHEN kinds = 1 THEN 1.0 WHEN f THEN 0.2 ELSE 0.8 END) * (CASE WHEN rows > 1 THEN 0.9 ELSE 1.0 END) AS room FROM (SELECT *, count(*) OVER (PARTITION BY chrom) AS kinds, sum(n) OVER (PARTITION BY chrom) AS rows FROM (SELECT chrom, f, CAST(sum(size) AS DOUBLE) AS total, count(*) AS n FROM laid GROUP BY ALL) AS p) AS q) AS r"""
SHARED["laid_widths"] = """SELECT l.*, p.rows, p.room, p.narrow, p.room * l.size / p.total AS plain, sum(CASE WHEN p.room * l.size / p.total < narrow THEN narrow ELSE 0 END) OVER (PARTITION BY l.chrom, l.f) AS taken, sum(CASE WHEN p.room * l.size / p.total >= narrow THEN l.size ELSE 0 END) OVER (PARTITION BY l.chrom, l.f) AS wide FROM laid AS l JOIN laid_parts AS p ON p.chrom = l.chrom AND p.f = l.f"""


@query("""SELECT chrom, gene, round(x - width, 6) AS "left", round(x, 6) AS "right" FROM (SELECT chrom, gene, width, sum(width) OVER w + (row_number() OVER w - 1) * (CASE WHEN rows > 1 THEN 0.1 / (rows - 1) ELSE 0 END) AS x FROM (SELECT *, CASE WHEN plain < narrow THEN narrow ELSE (room - taken) * size / wide END AS width FROM laid_widths) AS a WINDOW w AS (PARTITION BY chrom ORDER BY gene)) AS b""")
def axis_layout(spark: SparkSession, d: str) -> DataFrame:
    """Genes of every contig along an axis: least widths, gaps of a tenth, and a fifth for the largest ones."""
    g = genes(spark, d).select("chrom", "start", "end", "size_class", "gene").distinct()
    return layout(g, "chrom", "gene", foreign=F.col("size_class") >= 45).select("chrom", "gene", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


# --- edits of cycles --------------------------------------------------------------------------------

#: Orders as cycles over forty overlapping segments, in 25 sets; an even order is merged with the next one at their first places.
SHARED["order_steps"] = """SELECT l_orderkey AS cycle, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey % 40 + 1 AS seg, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END AS orient FROM lineitem"""
SHARED["seg_places"] = """SELECT k AS seg, k * 50 AS a, k * 50 + 30 + k % 9 * 60 AS b FROM (SELECT unnest(range(1, 41)) AS k) AS s"""
SHARED["met_orders"] = """SELECT CAST(c1 // 2 % 25 AS BIGINT) AS grp, c1, c1 + 1 AS c2, least(cn1, cn2) AS cn, cn1 - least(cn1, cn2) AS rest1, cn2 - least(cn1, cn2) AS rest2, x.orient AS o1, y.orient AS o2, p.a AS a1, p.b AS b1, q.a AS a2, q.b AS b2 FROM (
    SELECT o.o_orderkey AS c1, round(o.o_totalprice / 50000, 2) AS cn1, round(r.o_totalprice / 50000, 2) AS cn2 FROM orders AS o JOIN orders AS r ON r.o_orderkey = o.o_orderkey + 1 WHERE o.o_orderkey % 2 = 0) AS m
    JOIN order_steps AS x ON x.cycle = c1 AND x.place = 1 JOIN order_steps AS y ON y.cycle = c1 + 1 AND y.place = 1 JOIN seg_places AS p ON p.seg = x.seg JOIN seg_places AS q ON q.seg = y.seg WHERE cn1 > 0 AND cn2 > 0 AND p.a <= q.b AND q.a <= p.b"""
SHARED["new_places"] = """SELECT w.grp, w.a, w.b, s.seg AS had, 40 + CASE WHEN s.seg IS NULL THEN row_number() OVER (PARTITION BY w.grp, s.seg IS NULL ORDER BY w.a, w.b) END AS fresh FROM (SELECT grp, a1 AS a, b2 AS b FROM met_orders UNION SELECT grp, a2, b1 FROM met_orders) AS w LEFT JOIN seg_places AS s ON s.a = w.a AND s.b = w.b"""


@query("""SELECT m.grp, c1, c2, round(cn, 6) AS cn, round(rest1, 6) AS rest1, round(rest2, 6) AS rest2, concat_ws(',', coalesce(h.had, h.fresh) || CASE WHEN o1 = 1 THEN '+' ELSE '-' END,
    (SELECT string_agg(seg || CASE WHEN orient * o1 * o2 = 1 THEN '+' ELSE '-' END, ',' ORDER BY place * o1 * o2) FROM order_steps AS s WHERE s.cycle = m.c2 AND place > 1), coalesce(k.had, k.fresh) || CASE WHEN o1 = 1 THEN '+' ELSE '-' END,
    (SELECT string_agg(seg || CASE WHEN orient = 1 THEN '+' ELSE '-' END, ',' ORDER BY place) FROM order_steps AS s WHERE s.cycle = m.c1 AND place > 1)) AS walk FROM met_orders AS m
    JOIN new_places AS h ON h.grp = m.grp AND h.a = CASE WHEN o1 = 1 THEN a1 ELSE a2 END AND h.b = CASE WHEN o1 = 1 THEN b2 ELSE b1 END JOIN new_places AS k ON k.grp = m.grp AND k.a = CASE WHEN o1 = 1 THEN a2 ELSE a1 END AND k.b = CASE WHEN o1 = 1 THEN b1 ELSE b2 END""")
def cycle_edits(spark: SparkSession, d: str) -> DataFrame:
    """Cycles merged where overlapping segments meet, with hybrid segments under new numbers, and the copies that are left of both."""
    tables = WorkTables(spark)
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cycle"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), (F.col("l_partkey") % 40 + 1).cast("string").alias("seg"), F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(-1).alias("orient"))
    listed = steps.groupBy("cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "seg", "orient"))), lambda s: F.struct(s["seg"].alias("seg"), s["orient"].alias("orient"))).alias("segments"))
    priced = table(spark, d, "orders").select(F.col("o_orderkey").alias("cycle"), F.round(F.col("o_totalprice") / 50000, 2).alias("cn"))
    cycles = tables.save(listed.join(priced, "cycle").select(F.floor(F.floor(F.col("cycle") / 2) % 25).alias("grp"), "cycle", "cn", "segments"), "cycles")
    places = spark.range(1, 41).select(F.col("id").cast("string").alias("seg"), F.lit("chr1").alias("chrom"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 30 + F.col("id") % 9 * 60).alias("end"))
    segments = tables.save(cycles.select("grp").distinct().withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(40)))).join(places, F.col("x").cast("string") == F.col("seg")).select("grp", "seg", "chrom", "start", "end"), "segments")
    evens = cycles.where("cycle % 2 = 0").select("grp", F.col("cycle").alias("c1"), (F.col("cycle") + 1).alias("c2"), F.lit(1).alias("i"), F.lit(1).alias("j"))
    edits = tables.save(evens.join(cycles.select(F.col("cycle").alias("c2")), "c2", "left_semi"), "edits")
    after, _ = Y.merge_at(cycles, segments, edits)
    after = tables.save(after, "after")
    # New cycles are told from old ones by their numbers, and numbered in the order of the first cycle they were made of.
    top = cycles.groupBy("grp").agg(F.max("cycle").alias("top"))
    made = after.join(top, "grp").where(F.col("cycle") > F.col("top")).withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("cycle")))
    done = Y.judged_merges(cycles, segments, edits).where("problem is null").select("grp", "c1", "c2", F.row_number().over(Window.partitionBy("grp").orderBy("c1")).alias("n"))
    rest = lambda c, name: after.select("grp", F.col("cycle").alias(c), F.col("cn").alias(name))
    walk = F.array_join(F.transform("segments", lambda s: F.concat(s["seg"], F.when(s["orient"] == 1, "+").otherwise("-"))), ",")
    found = made.join(done, ["grp", "n"]).join(rest("c1", "rest1"), ["grp", "c1"]).join(rest("c2", "rest2"), ["grp", "c2"])
    return found.select("grp", "c1", "c2", F.round("cn", 6).alias("cn"), F.round("rest1", 6).alias("rest1"), F.round("rest2", 6).alias("rest2"), walk.alias("walk"))


# --- seeds of a second genome, weak edges at bare shifts ---------------------------------------------

FOREIGN = """(SELECT chrom, "start", "end" FROM genes WHERE size_class >= 49)"""
FOREIGN_POINTS = f"""(SELECT chrom, "start", "end" FROM (SELECT e.chrom1 AS chrom, e.pos1 AS "start", e.pos1 AS "end" FROM edge_rows AS e WHERE EXISTS (SELECT 1 FROM {FOREIGN} AS s WHERE s.chrom = e.chrom1 AND e.pos1 BETWEEN s."start" AND s."end")
    UNION ALL SELECT e.chrom2, e.pos2, e.pos2 FROM edge_rows AS e WHERE EXISTS (SELECT 1 FROM {FOREIGN} AS s WHERE s.chrom = e.chrom1 AND e.pos1 BETWEEN s."start" AND s."end") UNION ALL SELECT * FROM {FOREIGN} AS f) AS p)"""


@query(f"""SELECT c.chrom, greatest(0, c."start" - 50) AS "start", least(c."end" + 50, l.length) AS "end" FROM ({_merge_sql(FOREIGN_POINTS, 600)}) AS c JOIN (SELECT chrom, CAST(max("end") AS BIGINT) AS length FROM (SELECT chrom, "end" FROM reads UNION ALL SELECT chrom, "end" FROM genes) AS x GROUP BY chrom) AS l ON l.chrom = c.chrom
    WHERE EXISTS (SELECT 1 FROM amp_win AS a WHERE a.chrom = c.chrom AND a."start" <= c."end" AND a."end" >= c."start") OR EXISTS (SELECT 1 FROM {FOREIGN} AS s WHERE s.chrom = c.chrom AND s."start" <= c."end" AND s."end" >= c."start")""")
def foreign_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Where the largest genes, taken as seeds of a second genome, lead to along edges."""
    tables = WorkTables(spark)
    g = genes(spark, d)
    contigs = reads(spark, d).select("chrom", "end").unionByName(g.select("chrom", "end")).groupBy("chrom").agg(F.max("end").alias("length"))
    return foreign(g.where("size_class >= 49"), edges(spark, d, tables), tables.save(_amplified(spark, d, tables), "amplified"), contigs, 600, 50)


SHARED["weak_rows"] = f"""SELECT *, concat_ws('/', chrom1, pos1, strand1, chrom2, pos2, strand2) AS edge FROM ({EDGE_SQL.replace("THEN 4 ELSE 2 END", "THEN 2 ELSE 1 END").replace('"end")) >= 2', '"end")) >= 1').replace("m_end)) >= 2", "m_end)) >= 1")}) AS e"""
SHARED["bare_steps"] = f"""SELECT chrom, pos, "drop" FROM (SELECT chrom, win * {WIN} - 1 AS pos, CASE WHEN was THEN 1 ELSE -1 END AS "drop" FROM (SELECT chrom, win, high, lag(high) OVER (PARTITION BY chrom ORDER BY win) AS was FROM shift_series) AS f WHERE high <> was) AS b
    WHERE NOT EXISTS (SELECT 1 FROM edge_rows AS e WHERE e.chrom1 = b.chrom AND e.strand1 * b."drop" > 0 AND abs(e.pos1 - b.pos) < 150)"""
SHARED["weak_found"] = """SELECT DISTINCT edge FROM (SELECT w.edge, row_number() OVER (PARTITION BY b.chrom, b.pos, b."drop" ORDER BY abs(b.pos - w.pos1) < 50 DESC, w.support DESC, w.edge DESC) AS k FROM bare_steps AS b JOIN weak_rows AS w ON w.chrom1 = b.chrom AND w.strand1 * b."drop" > 0 AND abs(w.pos1 - b.pos) < 300) AS r WHERE k = 1"""
SHARED["weak_added"] = """SELECT w.edge, chrom1, pos1, strand1, chrom2, pos2, strand2, support FROM weak_rows AS w JOIN weak_found AS f ON f.edge = w.edge"""
SHARED["weak_both"] = """SELECT * FROM weak_added UNION ALL SELECT concat_ws('/', chrom2, pos2, strand2, chrom1, pos1, strand1), chrom2, pos2, strand2, chrom1, pos1, strand1, support FROM weak_added AS a WHERE EXISTS (SELECT 1 FROM spans AS s WHERE s.chrom = a.chrom2 AND a.pos2 BETWEEN s."start" AND s."end")
    AND NOT EXISTS (SELECT 1 FROM weak_added AS b WHERE b.chrom1 = a.chrom2 AND b.pos1 = a.pos2 AND b.strand1 = a.strand2 AND b.chrom2 = a.chrom1 AND b.pos2 = a.pos1 AND b.strand2 = a.strand1)"""


@query("""SELECT edge, chrom1, pos1, strand1, chrom2, pos2, strand2, support FROM edge_rows UNION ALL SELECT * FROM weak_both AS w WHERE NOT EXISTS (SELECT 1 FROM edge_rows AS e WHERE e.edge = w.edge)""")
def sensitive_edges(spark: SparkSession, d: str) -> DataFrame:
    """Supported edges, and for shifts that none of them explains the best of those that fewer pairs support, from both ends where the second lies in an interval."""
    tables = WorkTables(spark)
    pairs = tables.save(_named_pairs(spark, d), "pairs")
    named = lambda support: tables.save(P.pair_edges(pairs, 200, support).withColumn("edge", F.concat_ws("/", *B.EDGE[1:])).select(*B.EDGE, "support"), f"edges-{support}")
    steps = tables.save(_shifts(spark, d, tables).withColumn("refined", F.lit(True)), "steps")
    spans = tables.save(merge_clusters(genes(spark, d).where("size_class >= 20").select("chrom", "start", "end")), "spans")
    return B.sensitive_edges(named(2), named(1), steps, spans, 100, 50, 200)
