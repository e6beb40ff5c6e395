"""Queries from edges to amplicons: refinement, support, growth of intervals, graphs, copy numbers and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import amplicons as A
from ..operators import breakpoints as B
from ..operators import clusters as C
from ..operators import coverage as V
from ..operators import graph as G
from ..operators import overlap as O
from ..operators import pairs as P
from ..operators import segmentation as M
from ..operators.arcs import bare_shifts
from ..operators.components import connected_components
from ..operators.work import WorkTables
from ..sources import readers as R
from .bindings import SQL, calls, genes, reads, table
from .catalogue import EDGE_SQL, SHARED, WIN, _merge_sql, _named_pairs, query, windows

REACH, INSERT, READ, DEPTH, CHUNK = 3000, 400, 26, 2.0, 1000

SQL["alignments"] = SQL["reads"].replace("FROM lineitem", ", l_linenumber % 2 = 1 AS first, l_linestatus <> 'F' AS reverse, l_tax >= 0.04 AS secondary, l_partkey % 60 AS q_start, l_partkey % 60 + CAST(floor(l_quantity) AS BIGINT) AS q_end FROM lineitem")
SHARED["edge_rows"] = f"""SELECT *, concat_ws('/', chrom1, pos1, strand1, chrom2, pos2, strand2) AS edge FROM ({EDGE_SQL}) AS e"""
SHARED["proper_pairs"] = """SELECT a.chrom, a."start", a."end", b.chrom AS m_chrom, b."start" AS m_start FROM reads AS a JOIN reads AS b ON a.qname = b.qname AND a.number <> b.number WHERE a.proper AND b.proper AND a.mapq > 5 AND b.mapq > 5 AND a.strand = 1"""


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """Line items as primary and secondary alignments with the span of the read that each covers."""
    more = table(spark, d, "lineitem").withColumns({"q_start": F.col("l_partkey") % 60, "first": F.col("l_linenumber") % 2 == 1, "reverse": F.col("l_linestatus") != "F", "secondary": F.col("l_tax") >= 0.04})
    days = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("bigint") * 10 + F.col("l_linenumber")
    size = F.col("l_quantity").cast("bigint")
    return more.select(F.col("l_orderkey").alias("qname"), "first", "reverse", "secondary", F.concat(F.lit("chr"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("chrom"), days.alias("start"), (days + size).alias("end"), "q_start", (F.col("q_start") + size).alias("q_end"), (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"))


def edges(spark: SparkSession, d: str, tables: WorkTables) -> DataFrame:
    """The supported edges between clusters of read ends, each with a name, written once."""
    return tables.save(P.pair_edges(_named_pairs(spark, d), 200, 2, tables).withColumn("edge", F.concat_ws("/", *B.EDGE[1:])), "edges")


def proper_pairs(spark: SparkSession, d: str) -> DataFrame:
    good = reads(spark, d).where("proper and mapq > 5")
    mates = good.select("qname", F.col("number").alias("m_number"), F.col("chrom").alias("m_chrom"), F.col("start").alias("m_start"))
    return good.where("strand = 1").join(mates, "qname").where("number <> m_number").select("chrom", "start", "end", "m_chrom", "m_start")


# --- edges ------------------------------------------------------------------------------------------


def _near_sql(k: int) -> str:
    same = "false" if k == 1 else "e.strand1 = e.strand2"
    return f"""SELECT e.edge, a.qname, a.first, a.reverse <> ({same}) AS reverse, {'a.secondary' if k == 1 else 'NOT a.secondary'} AS secondary, max(q_start) AS qs, max(q_end) AS qe, max(CASE WHEN e.strand{k} = 1 THEN a."end" ELSE a."start" END) AS p, max(mapq) AS mapq
        FROM edge_rows AS e JOIN alignments AS a ON a.chrom = e.chrom{k} AND a."start" <= CASE WHEN e.strand{k} = 1 THEN e.pos{k} ELSE e.pos{k} + {REACH} END AND a."end" >= CASE WHEN e.strand{k} = 1 THEN greatest(0, e.pos{k} - {REACH}) ELSE e.pos{k} END
        GROUP BY ALL HAVING count(*) = 1"""


@query(f"""SELECT edge, p1, p2, hom, n, mapq1, mapq2 FROM (SELECT *, count(*) OVER (PARTITION BY edge) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY edge) AS most FROM (
    SELECT edge, hom, p1, p2, CAST(count(*) AS BIGINT) AS n, max(mapq1) AS mapq1, max(mapq2) AS mapq2 FROM (
        SELECT x.edge, x.p AS p1, y.p AS p2, x.mapq AS mapq1, y.mapq AS mapq2, x.reverse, x.qs <= y.qs AND x.qe <= y.qe AS ahead,
            CASE WHEN x.qs <= y.qs AND x.qe <= y.qe THEN x.qe - y.qs + 1 WHEN x.qs >= y.qs AND x.qe >= y.qe THEN y.qe - x.qs + 1 END AS hom
        FROM ({_near_sql(1)}) AS x JOIN ({_near_sql(2)}) AS y ON x.edge = y.edge AND x.qname = y.qname AND x.first = y.first AND x.reverse = y.reverse AND x.secondary = y.secondary) AS r JOIN edge_rows AS f USING (edge)
    WHERE hom IS NOT NULL AND ((f.strand1 = 1) = (NOT reverse)) = ahead AND (NOT (chrom1 = chrom2 AND pos1 = pos2 AND strand1 = strand2) OR p1 >= p2) GROUP BY edge, hom, p1, p2) AS c) AS m WHERE n = most) AS t WHERE ties = 1""")
def refined_edges(spark: SparkSession, d: str) -> DataFrame:
    """Exact places and homology of the edges, by split reads."""
    return B.refine_edges(edges(spark, d, WorkTables(spark)), alignments(spark, d), REACH)


@query(f"""SELECT edge, chrom, pos, strand, n, CASE WHEN n > 2 THEN CASE WHEN strand = 1 THEN greatest(pos + 1, lo) ELSE least(pos - 1, hi) END END AS partner FROM (
    SELECT e.edge, e.chrom1 AS chrom, e.pos1 AS pos, e.strand1 AS strand, CAST(count(p.chrom) AS BIGINT) AS n, min(p.m_start) AS lo, max(p."end") AS hi FROM edge_rows AS e LEFT JOIN proper_pairs AS p
    ON p.chrom = e.chrom1 AND p.m_chrom = p.chrom AND p."start" < e.pos1 AND p.m_start >= e.pos1 AND p.m_start < p."start" + {INSERT - READ} GROUP BY ALL) AS c""")
def concordant_reads(spark: SparkSession, d: str) -> DataFrame:
    """Proper pairs spanning the first end of every edge, and the vertex they join it to."""
    ends = edges(spark, d, WorkTables(spark)).select("edge", F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), F.col("strand1").alias("strand"))
    return B.concordant_support(ends, proper_pairs(spark, d), INSERT, READ, 2)


@query(f"""SELECT *, kind IN ('everted', 'discordant') AND chrom1 = chrom2 AND abs(pos1 - pos2) < {INSERT} AS artefact FROM (SELECT edge, chrom1, pos1, strand1, chrom2, pos2, strand2, CASE WHEN pos1 = -1 OR pos2 = -1 THEN 'source' WHEN chrom1 <> chrom2 THEN 'discordant'
    WHEN pos1 = pos2 AND strand1 <> strand2 THEN 'everted' WHEN pos1 <= pos2 AND strand1 = -1 AND strand2 = 1 OR pos1 > pos2 AND strand2 = -1 AND strand1 = 1 THEN 'everted' WHEN strand1 = 1 AND strand2 = 1 THEN 'forward'
    WHEN strand1 = -1 AND strand2 = -1 THEN 'reverse' WHEN abs(pos1 - pos2) <> 1 THEN 'discordant' ELSE 'concordant' END AS kind FROM edge_rows) AS k""")
def edge_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """Kind of every edge, and whether it closes on itself within an insert length."""
    return B.artefact(edges(spark, d, WorkTables(spark)), INSERT).select(*B.EDGE, "kind", "artefact")


STEPS_SQL = f"""SELECT chrom, (win + 1) * {WIN} AS pos, bases - nxt AS "drop", win % 2 = 0 AS refined FROM (SELECT *, lead(bases) OVER (PARTITION BY chrom ORDER BY win) AS nxt, lead(win) OVER (PARTITION BY chrom ORDER BY win) AS w2 FROM win_cov) AS w WHERE w2 = win + 1 AND bases <> nxt"""


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Changes of coverage from one window to the next; those after even windows count as refined."""
    w = windows(spark, d).select("chrom", "win", "bases")
    after = w.select("chrom", (F.col("win") - 1).alias("win"), F.col("bases").alias("next"))
    return w.join(after, ["chrom", "win"]).where("bases <> next").select("chrom", ((F.col("win") + 1) * WIN).alias("pos"), (F.col("bases") - F.col("next")).alias("drop"), (F.col("win") % 2 == 0).alias("refined"))


@query(f"""SELECT chrom, pos, "drop", refined, edge, support FROM (SELECT s.*, e.edge, e.support, row_number() OVER (PARTITION BY s.chrom, s.pos ORDER BY abs(s.pos - e.pos1) < 50 DESC, e.support DESC, e.edge DESC) AS k
    FROM ({STEPS_SQL}) AS s LEFT JOIN edge_rows AS e ON e.chrom1 = s.chrom AND e.strand1 * s."drop" > 0 AND abs(s.pos - e.pos1) < CASE WHEN s.refined THEN 150 ELSE 300 END) AS j WHERE k = 1""")
def step_edges(spark: SparkSession, d: str) -> DataFrame:
    """Coverage steps with the edge that explains each."""
    return B.step_edges(_steps(spark, d), edges(spark, d, WorkTables(spark)), 100, 50, 200)


@query(f"""SELECT e.edge, round(greatest(2.0 * least(10.0, greatest(1.0, c.cn)) / 20 * (({INSERT} - {READ}) / 2.0 / {READ}) * p.share, 2.0), 6) AS expected FROM edge_rows AS e
    JOIN (SELECT chrom, sum(cn) / count(*) AS cn FROM calls GROUP BY chrom) AS c ON c.chrom = e.chrom1 CROSS JOIN (SELECT avg(CASE WHEN proper THEN 1.0 ELSE 0.0 END) AS share FROM reads) AS p""")
def expected_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that each edge should have, given its contig's copy number."""
    level = calls(spark, d).groupBy("chrom").agg((F.sum("cn") / F.count("*")).alias("cn"))
    share = reads(spark, d).agg(F.avg(F.col("proper").cast("double")).alias("share"))
    rows = edges(spark, d, WorkTables(spark)).select("edge", F.col("chrom1").alias("chrom")).join(level, "chrom").join(share)
    return rows.select("edge", F.round(B.expected_support(F.col("cn"), F.lit(None).cast("double"), F.lit(DEPTH), F.lit(float(INSERT)), F.lit(float(READ)), F.col("share"), F.lit(2.0), sensitive=True), 6).alias("expected"))


@query()
def interval_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that start in amplified intervals, by pairs outside repeats; read from both ends."""
    g = genes(spark, d)
    cut = lambda f: f.select("chrom", "start", "end")
    tables = WorkTables(spark)
    pairs = tables.save(_named_pairs(spark, d), "pairs").drop("qname", "number", "m_number")
    return B.interval_edges(pairs, cut(g.where("size_class >= 20")), cut(g.where("size_class <= 5")), 200, 2, INSERT, tables)


# --- intervals --------------------------------------------------------------------------------------

SHARED["amp_win"] = f"""SELECT chrom, win * {WIN} AS "start", win * {WIN} + {WIN - 1} AS "end" FROM win_cov WHERE bases > (SELECT sum(bases) / count(*) * 1.5 FROM win_cov)"""


def _amplified(spark: SparkSession, d: str, tables: WorkTables) -> DataFrame:
    """Windows with half more than the mean coverage of all windows."""
    w = tables.save(windows(spark, d), "windows")
    mean = w.agg((F.sum("bases") / F.count("*") * 1.5).alias("bound"))
    return w.join(mean).where("bases > bound").select("chrom", (F.col("win") * WIN).alias("start"), (F.col("win") * WIN + WIN - 1).alias("end"))


BIG = '(SELECT chrom, "start", "end" FROM genes WHERE size_class >= 45)'
SHARED["grown"] = f"""SELECT s.chrom, s."start" AS s0, s."end" AS e0, least(s."start", coalesce(min(t."start"), s."start")) AS "start", greatest(s."end", coalesce(max(t."end"), s."end")) AS "end"
    FROM ({_merge_sql(BIG, 0)}) AS s LEFT JOIN ({_merge_sql('amp_win', 4 * WIN)}) AS t ON t.chrom = s.chrom AND greatest(0, s."start" - {WIN}) <= t."end" AND t."start" <= s."end" + {WIN} GROUP BY s.chrom, s."start", s."end\""""
SHARED["padded"] = f"""SELECT chrom, s0, e0, CASE WHEN EXISTS (SELECT 1 FROM amp_win AS w WHERE w.chrom = g.chrom AND w."start" <= g."start" + {2 * WIN} AND w."end" >= greatest(0, g."start" - {2 * WIN})) THEN greatest(0, "start" - {10 * WIN}) ELSE "start" END AS "start",
    CASE WHEN EXISTS (SELECT 1 FROM amp_win AS w WHERE w.chrom = g.chrom AND w."start" <= g."end" + {2 * WIN} AND w."end" >= greatest(0, g."end" - {2 * WIN})) THEN "end" + {10 * WIN} ELSE "end" END AS "end" FROM grown AS g"""


@query(f"""SELECT chrom, s0, e0, CASE WHEN EXISTS (SELECT 1 FROM edge_rows AS e WHERE e.chrom1 = p.chrom AND strand1 = -1 AND pos1 BETWEEN greatest(0, p."start" - {WIN}) AND p."start" - 1) THEN greatest(0, "start" - {2 * WIN}) ELSE "start" END AS "start",
    CASE WHEN EXISTS (SELECT 1 FROM edge_rows AS e WHERE e.chrom1 = p.chrom AND strand1 = 1 AND pos1 BETWEEN p."end" + 1 AND p."end" + {WIN}) THEN "end" + {2 * WIN} ELSE "end" END AS "end" FROM padded AS p""")
def interval_extend(spark: SparkSession, d: str) -> DataFrame:
    """Merged large genes grown over the amplified stretches around them."""
    tables = WorkTables(spark)
    merged = C.merge_clusters(genes(spark, d).where("size_class >= 45").select("chrom", "start", "end")).select("chrom", "start", "end", F.col("start").alias("s0"), F.col("end").alias("e0"))
    return A.extend_intervals(merged, tables.save(_amplified(spark, d, tables), "amplified"), edges(spark, d, tables), WIN).select("chrom", "s0", "e0", "start", "end")


@query()
def interval_hops(spark: SparkSession, d: str) -> DataFrame:
    """Intervals that edges reach from each contig's large genes, best first."""
    tables = WorkTables(spark)
    seeds = genes(spark, d).where("size_class >= 50").select(F.col("chrom").alias("seed"), "chrom", "start", "end")
    return A.hops(seeds, edges(spark, d, tables), tables.save(_amplified(spark, d, tables), "amplified"), WIN, INSERT, merge=10 * WIN)


@query()
def meanshift_refined(spark: SparkSession, d: str) -> DataFrame:
    """Copy-number segments of coarse windows, their bounds moved to those of windows of a fifth."""
    series = lambda width: V.window_counts(reads(spark, d), width).select("chrom", "win", (F.col("bases") / width).alias("depth"))
    return M.refined_segments(series(WIN), series(WIN // 5), 5)


@query(f"""SELECT chrom, CAST(count(*) AS BIGINT) AS pieces, CAST(sum("end" - "start" + 1) AS BIGINT) AS span FROM ({_merge_sql('genes', 99)}) AS m GROUP BY chrom""")
def compact_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Length of the genes per contig with gaps of less than 100 closed."""
    return A.compact_span(genes(spark, d), 100)


@query("""SELECT name AS chrom, lo AS "start", hi AS "end", n FROM (SELECT chrom AS name, min("start") AS lo, max("end") AS hi, CAST(count(*) AS BIGINT) AS n FROM reads WHERE chrom IN ('chr3', 'chr7') AND "start" <= 12000 AND "end" >= 4000 GROUP BY chrom) AS r""")
def region_scan(spark: SparkSession, d: str) -> DataFrame:
    """Extent and number of the reads that meet either of two regions, one given the wrong way round."""
    both = R.in_region(reads(spark, d), "chr3", 12000, 4000).unionByName(R.in_region(reads(spark, d), "chr7", 4000, 12000))
    return both.groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as sequences in chunks."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chrom"), F.coalesce("text", F.lit("")).alias("text"))
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.length("text") - 1) / CHUNK))
    return docs.select("chrom", "text", F.explode(places).alias("k")).select("chrom", (F.col("k") * CHUNK).cast("bigint").alias("start"), F.substring("text", (F.col("k") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("bases")).where("bases <> ''")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 1 THEN translate(reverse(t), 'ACGTacgt', 'TGCAtgca') ELSE t END AS bases FROM (
    SELECT doc_id, rpad(substr(coalesce(text, ''), CAST(a + 1 AS INTEGER), 200 + 1500), 1700, 'n') AS t FROM (SELECT *, doc_id % 1500 AS a FROM documents) AS x) AS y""")
def region_sequence(spark: SparkSession, d: str) -> DataFrame:
    """1,700 letters of every text from its own place on, joined from chunks; odd ids reverse complemented."""
    start = F.col("doc_id") % 1500
    wanted = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("chrom"), start.alias("start"), (start + 1699).alias("end"), F.when(F.col("doc_id") % 2 == 1, -1).otherwise(1).alias("strand"))
    return A.fetch_bases(wanted, _chunks(spark, d), CHUNK).select("id", "bases")


# --- graphs -----------------------------------------------------------------------------------------

MID = '(SELECT chrom, "start", "end" FROM genes WHERE size_class >= 20)'
SHARED["once_edges"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(v1, v2), greatest(v1, v2) ORDER BY support DESC, v1, v2) AS k FROM (
    SELECT *, chrom1 || ':' || pos1 || CASE WHEN strand1 = 1 THEN '+' ELSE '-' END AS v1, chrom2 || ':' || pos2 || CASE WHEN strand2 = 1 THEN '+' ELSE '-' END AS v2 FROM edge_rows) AS v) AS o WHERE k = 1"""
SHARED["spans"] = f"""SELECT chrom, "start", "end", chrom || ':' || "start" AS span FROM ({_merge_sql(MID, 0)}) AS m"""
SHARED["tips"] = """SELECT t.*, s.span FROM (SELECT v1, v2, 1 AS side, chrom1 AS chrom, pos1 AS pos, strand1 AS strand, support FROM once_edges UNION ALL SELECT v1, v2, 2, chrom2, pos2, strand2, support FROM once_edges) AS t JOIN spans AS s ON s.chrom = t.chrom AND t.pos BETWEEN s."start" AND s."end\""""
SHARED["amps"] = """SELECT * FROM (WITH RECURSIVE l AS (SELECT DISTINCT a.span AS a, b.span AS b FROM tips AS a JOIN tips AS b ON a.v1 = b.v1 AND a.v2 = b.v2), r(node, seen) AS (SELECT span, span FROM spans UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
    SELECT node AS span, min(seen) AS amplicon FROM r GROUP BY node) AS z"""
SHARED["tiles"] = """SELECT amplicon, chrom, pos + 1 AS "start", nxt AS "end", lead(pos + 1) OVER (PARTITION BY span ORDER BY pos) AS after, lead(nxt) OVER (PARTITION BY span ORDER BY pos) AS last FROM (SELECT *, lead(pos) OVER (PARTITION BY span ORDER BY pos) AS nxt FROM (
    SELECT DISTINCT span, pos FROM (SELECT span, CASE WHEN strand = 1 THEN pos ELSE pos - 1 END AS pos FROM tips UNION ALL SELECT span, "start" - 1 FROM spans UNION ALL SELECT span, "end" FROM spans) AS c) AS d) AS e JOIN amps USING (span) JOIN spans USING (span) WHERE nxt IS NOT NULL""".replace(
    'pos + 1 AS "start", nxt AS "end"', 'e.pos + 1 AS "start", e.nxt AS "end"'
)
SHARED["sides"] = """SELECT v1, v2, max(support) AS support, max(CASE WHEN side = 1 THEN amplicon END) AS a1, max(CASE WHEN side = 2 THEN amplicon END) AS a2 FROM tips JOIN amps USING (span) GROUP BY v1, v2"""
SHARED["graph_rows"] = f"""SELECT *, left(kind, 1) || ':' || v1 || '>' || v2 AS edge, CASE WHEN kind = 'sequence' THEN size * {DEPTH / 2} / {READ} ELSE {INSERT} * {DEPTH / 2} / 2 / {READ} END AS cost FROM (
    SELECT t.amplicon, 'sequence' AS kind, t.chrom || ':' || t."start" || '-' AS v1, t.chrom || ':' || t."end" || '+' AS v2, t."end" - t."start" + 1 AS size, CAST(count(r.chrom) AS BIGINT) AS "count" FROM tiles AS t LEFT JOIN reads AS r ON r.chrom = t.chrom AND r."start" <= t."end" AND r."end" >= t."start" GROUP BY ALL
    UNION ALL SELECT t.amplicon, 'concordant', t.chrom || ':' || t."end" || '+', t.chrom || ':' || (t."end" + 1) || '-', 0, CAST(count(p.chrom) AS BIGINT) FROM tiles AS t LEFT JOIN proper_pairs AS p ON p.chrom = t.chrom AND p.m_chrom = p.chrom AND p."start" < t."end" AND p.m_start >= t."end" AND p.m_start < p."start" + {INSERT - READ} WHERE t.last IS NOT NULL GROUP BY ALL
    UNION ALL SELECT a1, 'discordant', v1, v2, 0, support FROM sides WHERE a1 = a2
    UNION ALL SELECT amplicon, 'source', '{A.SOURCE}', tip, 0, CAST(sum(support) AS BIGINT) FROM (SELECT a1 AS amplicon, v1 AS tip, support FROM sides WHERE a1 IS NOT NULL AND a1 IS DISTINCT FROM a2 UNION ALL SELECT a2, v2, support FROM sides WHERE a2 IS NOT NULL AND a1 IS DISTINCT FROM a2
        UNION ALL SELECT amplicon, chrom || ':' || "start" || '-', 0 FROM spans JOIN amps USING (span) UNION ALL SELECT amplicon, chrom || ':' || "end" || '+', 0 FROM spans JOIN amps USING (span)) AS o GROUP BY amplicon, tip) AS g"""


def _graph(spark: SparkSession, d: str, shifts: DataFrame | None = None, mated: DataFrame | None = None) -> DataFrame:
    """Merged genes, grouped to amplicons by the edges between them, as breakpoint graphs; written once."""
    tables = WorkTables(spark)
    found = edges(spark, d, tables)
    if shifts is not None:
        shifts = bare_shifts(shifts, found, INSERT, WIN)
    spans = tables.save(C.merge_clusters(genes(spark, d).where("size_class >= 20").select("chrom", "start", "end")).select("chrom", "start", "end", F.concat_ws(":", "chrom", F.col("start").cast("string")).alias("span")), "spans")
    tip = lambda k: O.point_join(found.select("edge", F.col(f"chrom{k}").alias("chrom"), F.col(f"pos{k}").alias("pos")), spans, width=4096).select("edge", F.col("r_span").alias("ab"[k - 1]))
    roots = connected_components(tip(1).join(tip(2), "edge").select("a", "b").distinct(), tables)
    named = spans.join(roots, spans["span"] == roots["node"], "left").select(F.coalesce("root", "span").alias("amplicon"), "chrom", "start", "end")
    return tables.save(A.amplicon_graph(tables.save(named, "intervals"), found, reads(spark, d), proper_pairs(spark, d), INSERT, READ, DEPTH, tables, shifts, mated), "graph")


@query("""SELECT amplicon, edge, kind, v1, v2, size, "count", round(cost, 6) AS cost FROM graph_rows""")
def amplicon_graph(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).withColumn("cost", F.round("cost", 6))


@query("""SELECT amplicon, vertex, edge, CAST(sum(value) AS BIGINT) AS value FROM (SELECT amplicon, edge, v1 AS vertex, CASE WHEN kind = 'sequence' THEN 1 ELSE -1 END AS value FROM graph_rows UNION ALL SELECT amplicon, edge, v2, CASE WHEN kind = 'sequence' THEN 1 ELSE -1 END FROM graph_rows) AS e
    WHERE EXISTS (SELECT 1 FROM graph_rows AS s WHERE s.amplicon = e.amplicon AND s.kind = 'sequence' AND e.vertex IN (s.v1, s.v2)) GROUP BY ALL""")
def flow_constraints(spark: SparkSession, d: str) -> DataFrame:
    return G.flow_constraints(_graph(spark, d))


@query()
def copy_number_solve(spark: SparkSession, d: str) -> DataFrame:
    return G.copy_numbers(_graph(spark, d))


def _solved(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return WorkTables(spark).save(g.join(G.copy_numbers(g), ["amplicon", "edge"]), "solved")


@query()
def cycle_decompose(spark: SparkSession, d: str) -> DataFrame:
    return G.decompose(_solved(spark, d))


@query()
def cycle_segments(spark: SparkSession, d: str) -> DataFrame:
    """The decomposed cycles as numbered, oriented segments."""
    solved = _solved(spark, d)
    cycles = A.cycle_segments(solved, WorkTables(spark).save(G.decompose(solved), "cycles"))[1]
    return cycles.withColumn("segments", F.array_join(F.transform("segments", lambda s: F.concat(s["seg"], F.when(s["orient"] == 1, "+").otherwise("-"))), ","))


@query()
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return G.shortest_paths(_graph(spark, d).withColumn("cn", F.lit(1.0)))
