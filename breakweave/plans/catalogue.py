"""All registered queries of the engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import edges as E
from ..functions import intervals as I
from ..functions import sequences as S
from ..operators import clusters as C
from ..operators import coverage as V
from ..operators import graph as G
from ..operators import overlap as O
from ..operators import pairs as P
from ..operators import segmentation as M
from ..operators.components import connected_components
from ..operators.work import WorkTables
from ..sources import readers as R
from .bindings import SQL, calls, flows, genes, reads, table
from .seeds import prepare_seeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WIN = 100
SEED_GAIN = 4.5


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL; virtual tables that the SQL names are put before it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            has = lambda name, text: re.search(rf"\b{name}\b", text)
            virtual, needed, texts = {**SQL, **SHARED}, set(), [sql]
            while texts:  # a virtual table may name earlier ones
                text = texts.pop()
                fresh = {n for n in virtual if n not in needed and has(n, text)}
                needed |= fresh
                texts += [virtual[n] for n in fresh]
            used = ", ".join(f"{n} AS ({t})" for n, t in virtual.items() if n in needed)
            ORACLES[f.__name__] = f"WITH {used} {sql}" if used else sql
        return f

    return add


#: Derived tables that several SQL texts use.
SHARED = {
    "win_cov": f"""SELECT chrom, w AS win, CAST(sum(CASE WHEN "start" // {WIN} = w THEN 1 ELSE 0 END) AS BIGINT) AS n_reads,
        CAST(sum(least("end", w * {WIN} + {WIN - 1}) - greatest("start", w * {WIN}) + 1) AS BIGINT) AS bases
        FROM (SELECT *, unnest(range("start" // {WIN}, "end" // {WIN} + 1)) AS w FROM reads WHERE mapq > 5) AS s GROUP BY ALL""",
    "pair_rows": """SELECT a.*, b.chrom AS m_chrom, b."start" AS m_start, b."end" AS m_end, b.strand AS m_strand, b.number AS m_number FROM
        (SELECT * FROM reads WHERE NOT proper AND mapq > 5) AS a JOIN (SELECT * FROM reads WHERE NOT proper AND mapq > 5) AS b ON a.qname = b.qname AND a.number < b.number""",
}


def windows(spark: SparkSession, d: str) -> DataFrame:
    return V.window_counts(reads(spark, d), WIN)


def disc_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.mate_pairs(P.discordant(reads(spark, d)))


# --- coordinates and text formats ---------------------------------------------------------------------


@query("""SELECT chrom, len, CAST(coalesce(sum(len) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM (SELECT chrom, CAST(max("end") AS BIGINT) AS len FROM reads GROUP BY chrom) AS c""")
def contig_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and genome-wide offsets of the contigs that the reads cover."""
    return _with_offsets(reads(spark, d).groupBy("chrom").agg(F.max("end").alias("len")))


def _with_offsets(lengths: DataFrame) -> DataFrame:
    order = Window.orderBy("chrom")  # one row per contig
    return lengths.withColumn("offset", F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _absolute(spark: SparkSession, d: str, catalog: DataFrame) -> DataFrame:
    return genes(spark, d).join(catalog, "chrom").select("gene", "chrom", "start", (F.col("start") + F.col("offset")).alias("abs_pos"))


@query("""SELECT gene, chrom, "start", "start" + (SELECT coalesce(sum(len), 0) FROM (SELECT chrom, max("end") AS len FROM reads GROUP BY chrom) AS c WHERE c.chrom < genes.chrom)::BIGINT AS abs_pos FROM genes""")
def abs_pos(spark: SparkSession, d: str) -> DataFrame:
    """Genes on the genome-wide axis; a contig without reads has no length and starts where the one before it ends."""
    lengths = reads(spark, d).select("chrom", F.col("end").alias("len")).unionByName(genes(spark, d).select("chrom", F.lit(0).cast("bigint").alias("len")))
    return _absolute(spark, d, _with_offsets(lengths.groupBy("chrom").agg(F.max("len").alias("len"))))


@query("""SELECT gene, chrom, "start" FROM genes""")
def chr_pos(spark: SparkSession, d: str) -> DataFrame:
    """Genome-wide positions back to contig and place.

    Here a contig is as long as its reads and genes need, places 0 to its last: the inverse is defined for every gene only then.
    """
    ends = reads(spark, d).select("chrom", "end").unionByName(genes(spark, d).select("chrom", "end"))
    catalog = _with_offsets(ends.groupBy("chrom").agg((F.max("end") + 1).alias("len")))
    places = _absolute(spark, d, catalog).select("gene", F.lit("genome").alias("chrom"), F.col("abs_pos").alias("pos"))
    spans = catalog.select(F.lit("genome").alias("chrom"), F.col("offset").alias("start"), (F.col("offset") + F.col("len") - 1).alias("end"), F.col("chrom").alias("name"))
    return O.point_join(places, spans, width=4096).select("gene", F.col("r_name").alias("chrom"), (F.col("pos") - F.col("r_start")).alias("start"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'chr' || CAST(o_custkey % 22 + 1 AS VARCHAR) WHEN o_custkey % 3 = 1 THEN 'chr' || CAST(o_custkey % 22 + 1 AS VARCHAR) ELSE 'ctg' || CAST(o_custkey AS VARCHAR) END AS chrom,
    least(o_orderkey, o_custkey) AS "start", greatest(o_orderkey, o_custkey) AS "end", o_orderstatus AS extra FROM orders""")
def bed_normalize(spark: SparkSession, d: str) -> DataFrame:
    bare = (F.col("o_custkey") % 22 + 1).cast("string")
    name = F.when(F.col("o_custkey") % 3 == 0, bare).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("chr"), bare)).otherwise(F.concat(F.lit("ctg"), F.col("o_custkey").cast("string")))
    lines = table(spark, d, "orders").select(F.concat(name, F.lit("\t"), F.col("o_orderkey").cast("string"), F.lit(".0  "), F.col("o_custkey").cast("string"), F.lit("\t"), "o_orderstatus", F.lit(" "), F.col("o_orderkey").cast("string")).alias("value"))
    return R.bed(lines).select(F.col("extra")[1].cast("bigint").alias("id"), "chrom", "start", "end", F.col("extra")[0].alias("extra"))


@query("""SELECT gene AS id, name, "start", "end", CASE WHEN gene % 2 = 0 THEN -1 ELSE 1 END AS strand FROM genes""")
def gff_attributes(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d)
    lines = g.select(F.concat_ws("\t", "chrom", F.lit("src"), F.lit("gene"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.when(F.col("gene") % 2 == 0, "-").otherwise("+"), F.lit("."), F.concat(F.lit("ID="), F.col("gene").cast("string"), F.lit(";Name="), "name")).alias("value"))
    return R.gff(lines).select(F.col("attributes")["ID"].cast("bigint").alias("id"), F.col("attributes")["Name"].alias("name"), "start", "end", "strand")


@query("""SELECT id, chrom, least("start", CAST(floor(cn * 1000) AS BIGINT)) AS "start", greatest("start", CAST(floor(cn * 1000) AS BIGINT)) AS "end", CASE WHEN "start" <= CAST(floor(cn * 1000) AS BIGINT) THEN 1 ELSE -1 END AS strand FROM calls""")
def region_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.floor(F.col("cn") * 1000).cast("string"))
    return calls(spark, d).select("id", R.region(text).alias("r")).select("id", "r.*")


@query("""SELECT v1, chrom1 AS chrom, pos1 AS pos, strand1 AS strand, CAST(sum(support) AS BIGINT) AS support FROM flows GROUP BY ALL""")
def vertex_parse(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select("v1", E.vertex(F.col("v1")).alias("v"), "support").groupBy("v1", "v.chrom", "v.pos", "v.strand").agg(F.sum("support").alias("support"))


@query("""SELECT doc_id, lower("left"(lang, 1)) AS code, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[!"#$]+')) AS run FROM documents) AS r GROUP BY doc_id, lang""")
def code_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of mappability codes in a text, counted; equal neighbours form one run per score."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(r'[!"#$]+'), F.lit(0))))
    return rows.groupBy("doc_id", F.lower(F.left("lang", F.lit(1))).alias("code")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS chrom, score, CAST(min(pos) AS BIGINT) AS "start", CAST(max(pos) AS BIGINT) AS "end" FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY doc_id, score ORDER BY pos) AS run FROM (
        SELECT doc_id, pos, CASE c WHEN '!' THEN 1.0::DOUBLE WHEN '"' THEN 0.5 WHEN '#' THEN 0.33 ELSE 0.25 END AS score FROM (
            SELECT doc_id, unnest(range(1, length(text) + 1)) AS pos, substr(text, unnest(range(1, length(text) + 1)), 1) AS c FROM (SELECT item_id AS doc_id, translate(text, 'aeio', '!"#$') AS text FROM benchmark) AS b) AS x WHERE c IN ('!', '"', '#', '$')) AS y) AS z
    GROUP BY doc_id, score, run""")
def code_track(spark: SparkSession, d: str) -> DataFrame:
    """Run-length encoding of a track of one code per base (vowels of the benchmark texts stand for codes)."""
    text = F.translate("text", "aeio", '!"#$')
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("chrom"), F.posexplode(F.split(text, "")).alias("at", "code"))
    return R.runs_of_codes(rows.select("chrom", (F.col("at") + 1).cast("bigint").alias("pos"), "code"))


# --- sequences and reads ------------------------------------------------------------------------------


@query("""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.5 ELSE (length(text) - length(translate(text, 'GCgc', '')))::DOUBLE / length(text) END, 6) AS gc,
    length(regexp_replace(text, '[^ACGT]', '', 'g'))::INTEGER AS unmasked FROM documents""")
def gc_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(S.gc_content(F.col("text")), 6).alias("gc"), S.unmasked(F.col("text")).alias("unmasked"))


@query("""SELECT doc_id, md5(translate(reverse(text), 'ACGTacgt', 'TGCAtgca')) AS digest FROM documents""")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(S.reverse_complement(F.col("text"))).alias("digest"))


@query("""SELECT item_id, (SELECT count(*) FROM (SELECT DISTINCT substr(text, i, 10) FROM range(1, length(text) - 8) AS r(i) INTERSECT SELECT DISTINCT substr(r2, i, 10) FROM (SELECT translate(reverse(text), 'ACGTacgt', 'TGCAtgca') AS r2) AS q, range(1, length(text) - 8) AS s(i)) AS k)::INTEGER AS shared FROM benchmark""")
def kmer_overlap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", S.shared_kmers(F.col("text"), S.reverse_complement(F.col("text"))).alias("shared"))


@query("""SELECT doc_id, round(CASE WHEN t = 0 THEN 0 ELSE coalesce(CASE WHEN a > 0 THEN -(a / t) * ln(a / t) END, 0) + coalesce(CASE WHEN c > 0 THEN -(c / t) * ln(c / t) END, 0) + coalesce(CASE WHEN g > 0 THEN -(g / t) * ln(g / t) END, 0) + coalesce(CASE WHEN u > 0 THEN -(u / t) * ln(u / t) END, 0) END::DOUBLE, 6) AS entropy
    FROM (SELECT *, a + c + g + u AS t FROM (SELECT doc_id, (length(x) - length(replace(x, 'A', '')))::DOUBLE AS a, (length(x) - length(replace(x, 'C', '')))::DOUBLE AS c, (length(x) - length(replace(x, 'G', '')))::DOUBLE AS g, (length(x) - length(replace(x, 'T', '')))::DOUBLE AS u FROM (SELECT doc_id, upper(text) AS x FROM documents) AS b) AS n) AS m""")
def base_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(S.base_entropy(F.upper("text")), 6).alias("entropy"))


CIGAR_SQL = "CAST(number AS VARCHAR) || CASE WHEN strand = 1 THEN 'H' ELSE 'S' END || CAST(\"end\" - \"start\" AS VARCHAR) || 'M' || CAST(mapq + 1 AS VARCHAR) || 'D' || CAST(part % 7 + 1 AS VARCHAR) || 'I5M' || CAST(part % 11 + 1 AS VARCHAR) || 'S'"


def _cigars(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: c.cast("string")
    return reads(spark, d).withColumn("cigar", F.concat(text(F.col("number")), F.when(F.col("strand") == 1, "H").otherwise("S"), text(F.col("end") - F.col("start")), F.lit("M"), text(F.col("mapq") + 1), F.lit("D"), text(F.col("part") % 7 + 1), F.lit("I5M"), text(F.col("part") % 11 + 1), F.lit("S")))


@query("""SELECT qname, number, part, "start", "end" - "start" + mapq + 6 AS ref_length, CAST(count(*) AS BIGINT) AS n FROM reads GROUP BY ALL""")
def cigar_ref_length(spark: SparkSession, d: str) -> DataFrame:
    rows = _cigars(spark, d).select("qname", "number", "part", "start", S.reference_length(F.col("cigar")).alias("ref_length"))
    return rows.groupBy("qname", "number", "part", "start", "ref_length").agg(F.count("*").alias("n"))


@query("""SELECT qname, number, part, "start", q, q + ("end" - "start") + part % 7 + 5 AS q_end, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, CASE WHEN strand = -1 THEN part % 11 + 1 ELSE number END AS q FROM reads) AS r GROUP BY ALL""")
def clip_span(spark: SparkSession, d: str) -> DataFrame:
    rows = _cigars(spark, d).select("qname", "number", "part", "start", S.query_span(F.col("cigar"), F.col("strand") == -1).alias("s"))
    return rows.groupBy("qname", "number", "part", "start", F.col("s.start").alias("q"), F.col("s.end").alias("q_end")).agg(F.count("*").alias("n"))


@query("""SELECT gene, name, CAST(count(*) AS BIGINT) AS n, CAST(min(hom) AS BIGINT) AS least, CAST(max(hom) AS BIGINT) AS most FROM (
    SELECT g.gene, g.name, CASE WHEN r."start" <= g."start" THEN r."end" - g."start" + 1 ELSE g."end" - r."start" + 1 END AS hom FROM reads r JOIN genes g ON r.chrom = g.chrom AND r."start" <= g."end" AND g."start" <= r."end") AS h GROUP BY ALL""")
def span_homology(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of read and gene spans as homology, per gene."""
    known = genes(spark, d)
    met = known.join(O.overlap_homology(reads(spark, d), known), ["chrom", "start", "end"])
    return met.groupBy("gene", "name").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


# --- edges --------------------------------------------------------------------------------------------

TYPE_SQL = """CASE WHEN p1 = -1 OR p2 = -1 THEN 'source' WHEN c1 <> c2 THEN 'discordant' WHEN p1 = p2 AND s1 <> s2 THEN 'everted'
    WHEN (CASE WHEN p1 <= p2 THEN s1 ELSE s2 END) = -1 AND (CASE WHEN p1 <= p2 THEN s2 ELSE s1 END) = 1 THEN 'everted'
    WHEN s1 = 1 AND s2 = 1 THEN 'forward' WHEN s1 = -1 AND s2 = -1 THEN 'reverse' WHEN abs(p1 - p2) <> 1 THEN 'discordant' ELSE 'concordant' END"""


@query(f"""SELECT {TYPE_SQL} AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(number) AS BIGINT) AS total FROM (
    SELECT chrom AS c1, "end" AS p1, strand AS s1, m_chrom AS c2, m_start AS p2, m_strand AS s2, number FROM pair_rows) AS e GROUP BY ALL""")
def edge_type(spark: SparkSession, d: str) -> DataFrame:
    kind = E.edge_type(F.col("chrom"), F.col("end"), F.col("strand"), F.col("m_chrom"), F.col("m_start"), F.col("m_strand"))
    return disc_pairs(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("number").alias("total"))


@query("""SELECT a.v1, a.v2, CAST(count(*) AS BIGINT) AS n, CAST(sum(b.support) AS BIGINT) AS support FROM flows a JOIN flows b ON a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND a.strand1 * a.strand2 * b.strand1 * b.strand2 > 0 AND abs(a.pos1 - b.pos1) + abs(a.pos2 - b.pos2) < 700 GROUP BY ALL""")
def edge_similar(spark: SparkSession, d: str) -> DataFrame:
    """Edges with similar ones, counted; both chromosomes and cells of the first position are the join key."""
    a = flows(spark, d).withColumn("cell", F.floor(F.col("pos1") / 700))
    b = a.select(*[F.col(c).alias(f"b_{c}") for c in a.columns]).withColumn("cell", F.explode(F.sequence(F.col("b_cell") - 1, F.col("b_cell") + 1))).withColumnRenamed("cell", "near")
    six = lambda p: tuple(F.col(f"{p}{c}") for c in ("chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2"))
    return a.join(b, (F.col("cell") == F.col("near")) & E.similar(six(""), six("b_"), 700)).groupBy("v1", "v2").agg(F.count("*").alias("n"), F.sum("b_support").alias("support"))


@query("""SELECT v1, v2, strand1, CASE WHEN strand1 = 1 THEN (CASE WHEN strand2 = 1 THEN 1 ELSE -1 END) ELSE (CASE WHEN strand2 = 1 THEN 1 ELSE -1 END) END AS strand2, chrom2, pos2, CASE WHEN support % 2 = 0 THEN 'CG' ELSE '' END AS inserted FROM flows""")
def bnd_parse(spark: SparkSession, d: str) -> DataFrame:
    """Breakend notation written from the flows and parsed again."""
    f = flows(spark, d)
    more = F.when(F.col("support") % 2 == 0, "CG").otherwise("")
    place = F.concat("chrom2", F.lit(":"), F.col("pos2").cast("string"))
    mark = F.when(F.col("strand2") == 1, "]").otherwise("[")
    after, before = F.concat(F.lit("A"), more), F.concat(more, F.lit("A"))
    alt = F.when(F.col("strand1") == 1, F.concat(after, mark, place, mark)).otherwise(F.concat(mark, place, mark, before))
    parsed = f.select("v1", "v2", E.breakend(F.col("chrom1"), F.col("pos1"), F.lit("A"), alt).alias("e"))
    return parsed.select("v1", "v2", F.col("e.strand1").alias("strand1"), F.col("e.strand2").alias("strand2"), F.col("e.chrom2").alias("chrom2"), F.col("e.pos2").alias("pos2"), F.col("e.inserted").alias("inserted"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 100 AS INTEGER) WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 90 AS INTEGER) ELSE 0 END AS support FROM orders""")
def vcf_support(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    info = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("SVTYPE=BND;PE="), (F.col("o_custkey") % 100).cast("string"))).otherwise(F.lit("SVTYPE=BND"))
    form = F.when(F.col("o_orderstatus") == "O", "GT:PR").otherwise("GT")
    sample = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("0/1:7,"), (F.col("o_orderkey") % 90).cast("string"))).otherwise("0/1")
    return o.select(F.col("o_orderkey").alias("id"), E.sv_support(info, form, sample).alias("support"))


@query("""SELECT v1, v2, support FROM (SELECT *, row_number() OVER (PARTITION BY least(v1, v2), greatest(v1, v2) ORDER BY support DESC, v1, v2) AS n FROM flows) AS f WHERE n = 1""")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return P.distinct_edges(flows(spark, d)).select("v1", "v2", "support")


@query("""SELECT v1, v2, support FROM flows a WHERE EXISTS (SELECT 1 FROM flows b WHERE b.v1 = a.v2 AND b.v2 = a.v1)""")
def complementary_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.complementary(flows(spark, d)).select("v1", "v2", "support")


EXTERNAL_SQL = """SELECT chrom2 AS chrom1, pos2 + 30 AS pos1, strand2 AS strand1, chrom1 AS chrom2, pos1 - 30 AS pos2, strand1 AS strand2, support FROM flows"""


@query(f"""SELECT chrom1, pos1, strand1, chrom2, pos2, strand2, support, false AS "external" FROM flows UNION ALL SELECT *, true FROM ({EXTERNAL_SQL}) AS x WHERE NOT EXISTS (SELECT 1 FROM flows o WHERE o.chrom1 = x.chrom1 AND o.chrom2 = x.chrom2 AND o.strand1 * o.strand2 * x.strand1 * x.strand2 > 0 AND abs(o.pos1 - x.pos1) + abs(o.pos2 - x.pos2) < 100)""")
def external_merge(spark: SparkSession, d: str) -> DataFrame:
    """External calls (the flows turned round and shifted) added where no own edge is similar."""
    own = flows(spark, d).select("chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2", "support")
    outside = own.select(F.col("chrom2").alias("chrom1"), (F.col("pos2") + 30).alias("pos1"), F.col("strand2").alias("strand1"), F.col("chrom1").alias("chrom2"), (F.col("pos1") - 30).alias("pos2"), F.col("strand1").alias("strand2"), "support")
    return P.add_external(own, outside)


@query("""SELECT v1, v2, support, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY v1 ORDER BY support DESC, v2) AS n FROM flows) AS f WHERE n <= 10""")
def neighbor_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best supported neighbours of each vertex."""
    order = Window.partitionBy("v1").orderBy(F.desc("support"), "v2")
    return flows(spark, d).withColumn("place", F.row_number().over(order)).where("place <= 10").select("v1", "v2", "support", "place")


# --- interval algebra ---------------------------------------------------------------------------------

MEET = 'r.chrom = g.chrom AND r."start" <= g."end" AND g."start" <= r."end"'


@query(f"""SELECT g.gene, CAST(count(*) AS BIGINT) AS n, CAST(sum(least(r."end", g."end") - greatest(r."start", g."start") + 1) AS BIGINT) AS bases FROM reads r JOIN genes g ON {MEET} GROUP BY ALL""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    met = O.overlap_join(reads(spark, d), genes(spark, d))
    return met.groupBy(F.col("r_gene").alias("gene")).agg(F.count("*").alias("n"), F.sum(I.overlap_size(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("bases"))


@query("""SELECT gene, chrom, "start", "end" FROM genes g WHERE EXISTS (SELECT 1 FROM calls c WHERE c.chrom = g.chrom AND c.cn > 8 AND greatest(0, g."start" - 20) <= c."end" AND c."start" <= g."end" + 20)""")
def overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    high = calls(spark, d).where("cn > 8").select("chrom", "start", "end")
    return O.overlap_join(genes(spark, d).select("gene", "chrom", "start", "end"), high, extend=20, how="left_semi")


@query("""SELECT gene, chrom, "start", "end" FROM genes g WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.chrom = g.chrom AND c.cn > 8 AND greatest(0, g."start" - 20) <= c."end" AND c."start" <= g."end" + 20)""")
def overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    high = calls(spark, d).where("cn > 8").select("chrom", "start", "end")
    return O.overlap_join(genes(spark, d).select("gene", "chrom", "start", "end"), high, extend=20, how="left_anti")


@query("""SELECT g.gene, CAST(count(*) AS BIGINT) AS n FROM genes g JOIN reads r ON g.chrom = r.chrom AND g."start" <= r."start" AND r."end" <= g."end" GROUP BY ALL""")
def contains_join(spark: SparkSession, d: str) -> DataFrame:
    met = O.overlap_join(reads(spark, d), genes(spark, d)).where(I.contains(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end")))
    return met.groupBy(F.col("r_gene").alias("gene")).agg(F.count("*").alias("n"))


@query("""SELECT c.id, CAST(count(*) AS BIGINT) AS n, CAST(sum(g.gene) AS BIGINT) AS total FROM calls c JOIN genes g ON c.chrom = g.chrom AND c."start" BETWEEN g."start" AND g."end" GROUP BY ALL""")
def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    points = calls(spark, d).select("id", "chrom", F.col("start").alias("pos"))
    return O.point_join(points, genes(spark, d)).groupBy("id").agg(F.count("*").alias("n"), F.sum("r_gene").alias("total"))


@query("""SELECT c.chrom, c.id, array_to_string(list_sort(list_distinct(list(g.name))), ',') AS names FROM calls c JOIN genes g ON c.chrom = g.chrom AND c."start" <= g."end" AND g."start" <= c."end" WHERE c.cn > 8 GROUP BY ALL""")
def gene_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the genes that each high call touches."""
    met = O.overlap_join(calls(spark, d).where("cn > 8"), genes(spark, d))
    return met.groupBy("chrom", "id").agg(F.array_join(F.array_sort(F.collect_set("r_name")), ",").alias("names"))


def _merge_sql(source: str, extend: int) -> str:
    return f"""SELECT chrom, min("start") AS "start", max("end") AS "end", CAST(count(*) AS BIGINT) AS members FROM (
        SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY "start", "end" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM (
            SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {extend} THEN 0 ELSE 1 END AS opens FROM {source}) AS a) AS b GROUP BY chrom, cluster"""


@query(_merge_sql("genes", 0))
def merge_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_clusters(genes(spark, d))


@query(_merge_sql("calls", 25))
def merge_extend(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_clusters(calls(spark, d), extend=25)


STEP_SQL = """SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nxt, sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS depth FROM (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, "start" AS pos, 1 AS d FROM genes UNION ALL SELECT chrom, "end" + 1, -1 FROM genes) AS e GROUP BY ALL) AS s"""


@query(f"""SELECT chrom, CAST(min(pos) AS BIGINT) AS "start", CAST(max(nxt) - 1 AS BIGINT) AS "end" FROM (
    SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM (
        SELECT *, CASE WHEN pos = lag(nxt) OVER (PARTITION BY chrom ORDER BY pos) THEN 0 ELSE 1 END AS opens FROM ({STEP_SQL}) AS t WHERE depth >= 2 AND nxt IS NOT NULL) AS u) AS v GROUP BY chrom, island""")
def depth_regions(spark: SparkSession, d: str) -> DataFrame:
    return C.depth_regions(genes(spark, d).select("chrom", "start", "end"), 2)


@query("""SELECT chrom, pos AS "start", nxt - 1 AS "end", CAST(x AS BIGINT) AS n_first, CAST(y AS BIGINT) AS n_second FROM (
    SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nxt, sum(x) OVER (PARTITION BY chrom ORDER BY pos) AS x, sum(y) OVER (PARTITION BY chrom ORDER BY pos) AS y FROM (
        SELECT chrom, pos, sum(x) AS x, sum(y) AS y FROM (SELECT chrom, "start" AS pos, 1 AS x, 0 AS y FROM genes UNION ALL SELECT chrom, "end" + 1, -1, 0 FROM genes UNION ALL SELECT chrom, "start", 0, 1 FROM calls UNION ALL SELECT chrom, "end" + 1, 0, -1 FROM calls) AS e GROUP BY ALL) AS s) AS t
    WHERE nxt IS NOT NULL AND x + y > 0""")
def atomize(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda f: f.select("chrom", "start", "end")
    return C.atomize(cut(genes(spark, d)), cut(calls(spark, d)))


PAD = 10
MASK_SQL = f"""SELECT chrom, greatest(0, "start" - {PAD}) AS ms, "end" + {PAD} AS me FROM ({_merge_sql('(SELECT chrom, "start", "end" FROM genes WHERE size_class >= 45)', 2 * PAD)}) AS m"""


def _subtract_sql(source: str) -> str:
    """Gaps between padded masks: for each interval, from each mask's end (or the start) to the next mask's start (or the end)."""
    return f"""SELECT id, chrom, a AS "start", b AS "end", cn FROM (
        SELECT id, chrom, cn, a, lead(ms, 1, e) OVER (PARTITION BY id, chrom, cn ORDER BY ms, a) AS b FROM (
            SELECT id, chrom, cn, "end" AS e, "start" AS a, -1 AS ms FROM {source}
            UNION ALL SELECT c.id, c.chrom, c.cn, c."end", m.me, m.ms FROM {source} c JOIN ({MASK_SQL}) AS m ON c.chrom = m.chrom AND c."start" <= m.me AND m.ms <= c."end") AS x) AS y WHERE a < b"""


@query(_subtract_sql("calls"))
def subtract(spark: SparkSession, d: str) -> DataFrame:
    """Calls without the padded large genes."""
    return C.subtract(calls(spark, d), genes(spark, d).where("size_class >= 45").select("chrom", "start", "end"), PAD).select("id", "chrom", "start", "end", "cn")


# --- coverage -----------------------------------------------------------------------------------------


@query("SELECT chrom, win, n_reads, bases FROM win_cov")
def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d)


@query(f"""SELECT gene, chrom, "start", "end", CAST(count(*) AS BIGINT) AS n_windows, round(sum(coalesce(bases, 0))::DOUBLE / (count(*) * {WIN}), 6) AS depth FROM (
    SELECT g.*, w.bases FROM (SELECT gene, chrom, "start", "end", unnest(range("start" // {WIN}, "end" // {WIN} + 1)) AS win FROM genes) AS g LEFT JOIN win_cov w ON g.chrom = w.chrom AND g.win = w.win) AS x GROUP BY ALL""")
def base_coverage(spark: SparkSession, d: str) -> DataFrame:
    return V.interval_coverage(genes(spark, d).select("gene", "chrom", "start", "end"), windows(spark, d), WIN).withColumn("depth", F.round("depth", 6))


STATS_SQL = """SELECT chrom, CAST(count(*) AS BIGINT) AS n_windows, CAST(list_sort(list(bases))[count(*) // 2 + 1] AS BIGINT) AS median, round(avg(bases), 6) AS mean, round(stddev_pop(bases), 6) AS deviation
    FROM win_cov JOIN (SELECT chrom, median(bases) AS rough FROM win_cov GROUP BY chrom) AS m USING (chrom) WHERE bases > 0 AND bases < 5 * rough GROUP BY chrom"""


@query(STATS_SQL)
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the windows of each contig (an arm's median is the same query over arms)."""
    return V.coverage_stats(windows(spark, d), "bases", ["chrom"]).withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query("""SELECT CAST(count(*) AS BIGINT) AS n_reads, round(avg("end" - "start" + 1), 6) AS read_length, round(stddev_pop("end" - "start" + 1), 6) AS read_deviation, round(sum(proper::INTEGER)::DOUBLE / count(*), 6) AS share_proper FROM reads""")
def read_stats(spark: SparkSession, d: str) -> DataFrame:
    s = V.mean_insert_stats(reads(spark, d))
    return s.select("n_reads", *[F.round(c, 6).alias(c) for c in ("read_length", "read_deviation", "share_proper")])


@query("""SELECT CAST(least(9, floor(gc * 10)) AS BIGINT) AS gc_bin, CAST(count(*) AS BIGINT) AS n, round(avg(n_chars) / (SELECT avg(n_chars) FROM documents), 6) AS scale FROM (
    SELECT n_chars, CASE WHEN length(text) = 0 THEN 0.5 ELSE (length(text) - length(translate(text, 'GCgc', '')))::DOUBLE / length(text) END AS gc FROM documents) AS x GROUP BY ALL""")
def gc_scaling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("n_chars", S.gc_content(F.col("text")).alias("gc"))
    return V.gc_scaling(rows, "gc", "n_chars").withColumn("scale", F.round("scale", 6))


AMP_SQL = """CASE WHEN g.median < a.median THEN greatest(a.median + 3 * g.deviation * sqrt(a.median::DOUBLE / g.median), a.median + 1.5 * g.median) ELSE greatest(g.median + 3 * g.deviation, 2.5 * g.median) END"""
GENOME_SQL = """SELECT list_sort(list(bases))[count(*) // 2 + 1] AS median, stddev_pop(bases) AS deviation FROM win_cov, (SELECT median(bases) AS rough FROM win_cov) AS m WHERE bases > 0 AND bases < 5 * rough"""


@query(f"""SELECT w.chrom, w.win, w.bases FROM win_cov w JOIN ({STATS_SQL}) AS a USING (chrom), ({GENOME_SQL}) AS g WHERE w.bases > {AMP_SQL} * 0.8""")
def amplified_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows above four fifths of the amplification threshold of genome and contig."""
    w = windows(spark, d)
    arm = V.coverage_stats(w, "bases", ["chrom"]).select("chrom", F.col("median").alias("arm"))
    whole = V.coverage_stats(w, "bases", []).select("median", "deviation")
    limit = arm.crossJoin(F.broadcast(whole)).select("chrom", V.amplified_threshold(F.col("median"), F.col("deviation"), F.col("arm")).alias("limit"))  # one row against the contigs
    return w.join(limit, "chrom").where(F.col("bases") > F.col("limit") * 0.8).select("chrom", "win", "bases")


@query("""SELECT gene, chrom, round(coalesce(sum(o * CASE WHEN score = 0 THEN 5.0 ELSE 1 / score END) / sum(o), 1.0)::DOUBLE, 6) AS rep_content FROM (
    SELECT a.gene, a.chrom, b.score, least(a."end", b."end") - greatest(a."start", b."start") + 1 AS o FROM genes a LEFT JOIN genes b ON a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end") AS x GROUP BY ALL""")
def weighted_mappability(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d)
    return V.weighted_mappability(g.select("gene", "chrom", "start", "end"), g.select("chrom", "start", "end", "score")).select("gene", "chrom", F.round("rep_content", 6).alias("rep_content"))


@query("""SELECT id, round((any_value("end" - "start" + 1))::DOUBLE / (any_value("end" - "start" + 1) + coalesce(sum(o), 0)), 6) AS uniqueness FROM (
    SELECT c.*, CASE WHEN g.gene IS NOT NULL THEN least(c."end", g."end") - greatest(c."start", g."start") + 1 END AS o FROM calls c LEFT JOIN genes g ON c.chrom = g.chrom AND g.size_class <= 5 AND c."start" <= g."end" AND g."start" <= c."end") AS x GROUP BY id""")
def segdup_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    small = genes(spark, d).where("size_class <= 5").select("chrom", "start", "end")
    return V.segdup_uniqueness(calls(spark, d), small).select("id", F.round("uniqueness", 6).alias("uniqueness"))


@query("""SELECT chrom, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT qname) AS BIGINT) AS names FROM reads WHERE ('0x' || substr(md5(CAST(qname AS VARCHAR)), 1, 8))::BIGINT::DOUBLE / 4294967296 < 0.4 GROUP BY chrom""")
def hash_downsample(spark: SparkSession, d: str) -> DataFrame:
    """Two fifths of the pairs, both mates together (sampling is what the operator does)."""
    return V.keep_share(reads(spark, d), "qname", 0.4).groupBy("chrom").agg(F.count("*").alias("n"), F.count_distinct("qname").alias("names"))


@query(f"""SELECT c.id, c.chrom, c."start", c."end", c.cn FROM calls c JOIN ({STATS_SQL}) AS a USING (chrom), ({GENOME_SQL}) AS g
    WHERE a.median > 0 AND c.cn > 4.5 + 2 * greatest(1.0::DOUBLE, a.median::DOUBLE / g.median) - 2 AND (c."end" - c."start" + 1 < 10000000 OR c.cn > 6.75)""")
def arm_gain(spark: SparkSession, d: str) -> DataFrame:
    """Calls above the gain that their contig's median depth asks for."""
    w = windows(spark, d)
    arm = V.coverage_stats(w, "bases", ["chrom"]).select("chrom", F.col("median").alias("arm"))
    return V.arm_gained(calls(spark, d), arm, V.coverage_stats(w, "bases", []).select("median"), SEED_GAIN).select("id", "chrom", "start", "end", "cn")


@query("""SELECT chrom, CAST(list_sort(list(bases))[CASE WHEN count(*) < 20 THEN 1 ELSE count(*) - count(*) // 20 + 1 END] AS BIGINT) AS level FROM win_cov GROUP BY chrom""")
def high_level(spark: SparkSession, d: str) -> DataFrame:
    """The depth that a twentieth of each contig's windows reach."""
    return V.high_level(windows(spark, d), "bases", ["chrom"])


@query("""SELECT chrom, CAST(count(*) AS BIGINT) AS n_segments, CAST(sum("end" - "start" + 1) AS BIGINT) AS total_size, CAST(coalesce(sum(CASE WHEN cn >= 2.5 THEN "end" - "start" + 1 END), 0) AS BIGINT) AS amplified_size,
    round(sum(CASE WHEN cn >= 2.5 THEN ("end" - "start" + 1) * cn END) / sum(CASE WHEN cn >= 2.5 THEN "end" - "start" + 1 END), 6) AS average_cn, CAST(sum(CASE WHEN cn > 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_high FROM calls GROUP BY chrom""")
def amplicon_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.amplicon_summary(calls(spark, d), ["chrom"]).withColumn("average_cn", F.round("average_cn", 6))


@query("""SELECT chrom, strand, "start", n FROM (SELECT *, row_number() OVER (PARTITION BY chrom, strand ORDER BY n DESC, "start") AS place FROM (
    SELECT DISTINCT chrom, strand, "start", CAST(count(*) OVER (PARTITION BY chrom, strand ORDER BY "start" RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM reads WHERE NOT proper AND mapq > 5) AS a) AS b WHERE place = 1""")
def densest_window(spark: SparkSession, d: str) -> DataFrame:
    return P.densest_window(P.discordant(reads(spark, d)), 300)


@query("""SELECT g.chrom, g."start" AS pos, g.gene, CAST(count(p.qname) AS BIGINT) AS foldups FROM genes g LEFT JOIN (SELECT * FROM pair_rows WHERE chrom = m_chrom AND strand = m_strand AND abs("start" - m_start) <= 5000) AS p
    ON p.chrom = g.chrom AND p."start" BETWEEN g."start" - 500 AND g."start" + 500 GROUP BY ALL""")
def foldup_count(spark: SparkSession, d: str) -> DataFrame:
    """Pairs folded back near the start of each gene."""
    places = genes(spark, d).select("chrom", F.col("start").alias("pos"), "gene")
    return P.foldup_count(places, disc_pairs(spark, d), 500, 5000)


# --- segmentation -------------------------------------------------------------------------------------

HEIGHT, REFERENCE = 400.0, 600.0


def _series(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select("chrom", "win", F.col("bases").cast("double").alias("depth"))


SHIFT_SQL = f"""SELECT a.chrom, a.win, a.depth, sum((b.win - a.win) * exp(-((b.win - a.win) ^ 2) / 8.0) * exp(-((b.depth - a.depth) ^ 2) / (2 * a.h ^ 2))) AS shift FROM (
    SELECT chrom, win, bases::DOUBLE AS depth, CASE WHEN bases < {REFERENCE / 4} THEN {HEIGHT / 2} ELSE sqrt(bases / {REFERENCE}) * {HEIGHT} END AS h, row_number() OVER (PARTITION BY chrom ORDER BY win) AS k FROM win_cov) AS a JOIN (
    SELECT chrom, win, bases::DOUBLE AS depth, row_number() OVER (PARTITION BY chrom ORDER BY win) AS k FROM win_cov) AS b ON a.chrom = b.chrom AND b.k BETWEEN a.k - 5 AND a.k + 5 GROUP BY ALL"""


@query(f"SELECT chrom, win, round(shift, 4) AS shift FROM ({SHIFT_SQL}) AS s")
def meanshift_score(spark: SparkSession, d: str) -> DataFrame:
    return M.meanshift_scores(_series(spark, d), 5, 2.0, HEIGHT, REFERENCE).select("chrom", "win", F.round("shift", 4).alias("shift"))


SEG_SQL = f"""SELECT chrom, CAST(seg AS BIGINT) AS seg, min(win) AS start_win, max(win) AS end_win, CAST(count(*) AS BIGINT) AS n, avg(depth) AS mean, var_samp(depth) AS variance FROM (
    SELECT *, sum(turn) OVER (PARTITION BY chrom ORDER BY win) AS seg FROM (SELECT *, CASE WHEN round(shift, 9) > 0 AND lag(round(shift, 9)) OVER (PARTITION BY chrom ORDER BY win) <= 0 THEN 1 ELSE 0 END AS turn FROM ({SHIFT_SQL}) AS s) AS t) AS u GROUP BY chrom, seg"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    scores = M.meanshift_scores(_series(spark, d), 5, 2.0, HEIGHT, REFERENCE).withColumn("shift", F.round("shift", 9))
    return M.zero_cross_segments(scores)


@query(f"SELECT chrom, seg, start_win, end_win, n, round(mean, 6) AS mean FROM ({SEG_SQL}) AS x")
def zero_cross_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("chrom", "seg", "start_win", "end_win", "n", F.round("mean", 6).alias("mean"))


@query(f"""SELECT chrom, seg, round(CASE WHEN v > 0 THEN (mean - m2) / sqrt(v) END, 6) AS t FROM (
    SELECT *, lead(mean) OVER w AS m2, variance / n + lead(variance) OVER w / lead(n) OVER w AS v FROM ({SEG_SQL}) AS x WINDOW w AS (PARTITION BY chrom ORDER BY seg)) AS y""")
def segment_welch_t(spark: SparkSession, d: str) -> DataFrame:
    return M.welch_t(_segments(spark, d)).withColumn("t", F.round("t", 6))


@query(f"""SELECT chrom, seg, round(c2 - cn, 6) AS jump, CASE WHEN c2 < cn THEN '+' ELSE '-' END AS side FROM (SELECT chrom, seg, mean / 300 AS cn, lead(mean / 300) OVER (PARTITION BY chrom ORDER BY seg) AS c2 FROM ({SEG_SQL}) AS x) AS y
    WHERE c2 IS NOT NULL AND abs(c2 - cn) >= greatest(1.0, least(greatest(cn, c2) / 10, sqrt(greatest(cn, c2))))""")
def cn_jump(spark: SparkSession, d: str) -> DataFrame:
    """Steps between neighbouring segments that count as copy-number shifts, and the strand of their vertex."""
    order = Window.partitionBy("chrom").orderBy("seg")
    rows = _segments(spark, d).select("chrom", "seg", (F.col("mean") / 300).alias("cn")).withColumn("after", F.lead("cn").over(order))
    return rows.where(M.significant(F.col("cn"), F.col("after"))).select("chrom", "seg", F.round(F.col("after") - F.col("cn"), 6).alias("jump"), F.when(F.col("after") < F.col("cn"), "+").otherwise("-").alias("side"))


@query()
def meanshift_segments(spark: SparkSession, d: str) -> DataFrame:
    return M.meanshift_segments(_series(spark, d))


@query(f"""SELECT g.gene, (SELECT max_by(w.bases, w.win) FROM win_cov w WHERE w.chrom = g.chrom AND w.win * {WIN} <= g."start") AS bases FROM genes g""")
def asof_cn(spark: SparkSession, d: str) -> DataFrame:
    """The coverage level at each gene's start: the last window at or before it."""
    steps = windows(spark, d).select("chrom", (F.col("win") * WIN).alias("pos"), "bases")
    return O.asof_join(genes(spark, d).select("chrom", F.col("start").alias("pos"), "gene"), steps, "bases").select("gene", "bases")


@query("""SELECT id, gene, dist FROM (SELECT c.id, g.gene, abs(c."start" - g."start") AS dist, row_number() OVER (PARTITION BY c.id ORDER BY abs(c."start" - g."start"), g.gene) AS n FROM calls c JOIN genes g ON c.chrom = g.chrom AND abs(c."start" - g."start") <= 150) AS x WHERE n = 1""")
def band_match_top1(spark: SparkSession, d: str) -> DataFrame:
    left = calls(spark, d).select("id", "chrom", F.col("start").alias("pos"))
    right = genes(spark, d).select("gene", "chrom", F.col("start").alias("pos"))
    dist = F.abs(F.col("pos") - F.col("r_pos"))
    return O.band_top1(left, right, 150, [dist, F.col("r_gene")], ["id"]).select("id", F.col("r_gene").alias("gene"), dist.alias("dist"))


# --- seeds, pairs, graphs -----------------------------------------------------------------------------

SEED = {"gain": SEED_GAIN, "pad": PAD, "extend": 300, "least": 150}


@query(f"""SELECT chrom, min("start") AS "start", max("end") AS "end", round(sum(("end" - "start" + 1) * cn) / sum("end" - "start" + 1), 6) AS cn, CAST(count(*) AS BIGINT) AS members FROM (
    SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY "start", "end" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM (
        SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300 THEN 0 ELSE 1 END AS opens FROM (
            SELECT p.id, p.chrom, p."start", p."end", p.cn FROM ({_subtract_sql('(SELECT * FROM calls WHERE cn > 4.5)')}) AS p LEFT JOIN genes g ON p.chrom = g.chrom AND g.size_class <= 5 AND p."start" <= g."end" AND g."start" <= p."end"
            GROUP BY ALL HAVING p.cn * (p."end" - p."start" + 1)::DOUBLE / ((p."end" - p."start" + 1) + coalesce(sum(CASE WHEN g.gene IS NOT NULL THEN least(p."end", g."end") - greatest(p."start", g."start") + 1 END), 0)) > 4.5) AS u) AS a) AS b
    GROUP BY chrom, cluster HAVING sum("end" - "start" + 1) > 150""")
def seeds_pipeline(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d).select("chrom", "start", "end", "size_class")
    cut = lambda f: f.select("chrom", "start", "end")
    return prepare_seeds(calls(spark, d), cut(g.where("size_class >= 45")), cut(g.where("size_class <= 5")), width=256, **SEED).withColumn("cn", F.round("cn", 6))


@query("""SELECT chrom, strand, CAST(count(*) AS BIGINT) AS n, CAST(sum("start") AS BIGINT) AS total FROM reads WHERE NOT proper AND mapq > 5 GROUP BY ALL""")
def discordant_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.discordant(reads(spark, d)).groupBy("chrom", "strand").agg(F.count("*").alias("n"), F.sum("start").alias("total"))


@query("""SELECT chrom, m_chrom, CAST(count(*) AS BIGINT) AS n, CAST(sum(abs("start" - m_start)) AS BIGINT) AS span FROM pair_rows GROUP BY ALL""")
def mate_join(spark: SparkSession, d: str) -> DataFrame:
    return disc_pairs(spark, d).groupBy("chrom", "m_chrom").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("start") - F.col("m_start"))).alias("span"))


@query("""SELECT a.chrom, a.strand, CAST(count(*) AS BIGINT) AS n FROM (SELECT r.*, EXISTS (SELECT 1 FROM reads b WHERE b.qname = r.qname AND b.number <> r.number AND b.chrom = r.chrom AND abs(b."start" - r."start") <= 500) AS near FROM reads r WHERE NOT proper AND mapq > 5) AS a WHERE NOT near GROUP BY ALL""")
def crossing_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Discordant reads none of whose mates lies near them: arcs that leave the interval."""
    all_reads = reads(spark, d)
    mates = all_reads.select(F.col("qname").alias("b_q"), F.col("number").alias("b_n"), F.col("chrom").alias("b_c"), F.col("start").alias("b_s"))
    near = (F.col("qname") == F.col("b_q")) & (F.col("number") != F.col("b_n")) & (F.col("chrom") == F.col("b_c")) & (F.abs(F.col("start") - F.col("b_s")) <= 500)
    return P.discordant(all_reads).join(mates, near, "left_anti").groupBy("chrom", "strand").agg(F.count("*").alias("n"))


PAIR = ("qname", "number", "m_number", "chrom", "start", "end", "strand", "m_chrom", "m_start", "m_end", "m_strand")
PAIR_SQL = "SELECT DISTINCT concat_ws('/', " + ", ".join(f'"{c}"' for c in PAIR) + ") AS pair, " + ", ".join(f'"{c}"' for c in PAIR) + " FROM pair_rows"


SHARED["cluster_ends"] = f"""SELECT pair, side, chrom, strand, sum(CASE WHEN f IS NULL OR "start" > f + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS cl FROM (
        SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM (
        SELECT pair, 0 AS side, chrom, strand, "start", "end" FROM ({PAIR_SQL}) AS x UNION ALL SELECT pair, 1, m_chrom, m_strand, m_start, m_end FROM ({PAIR_SQL}) AS y) AS s) AS t"""


def _named_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs with a name made of all their values."""
    return disc_pairs(spark, d).select(F.concat_ws("/", *PAIR).alias("pair"), *PAIR).distinct()


EDGE_SQL = f"""SELECT chrom AS chrom1, CASE WHEN strand = 1 THEN max("end") ELSE min("start") END AS pos1, strand AS strand1, m_chrom AS chrom2, CASE WHEN m_strand = 1 THEN max(m_end) ELSE min(m_start) END AS pos2, m_strand AS strand2,
    CAST(count(*) AS BIGINT) AS support, CAST(count(DISTINCT ("start", "end")) AS BIGINT) AS spans1, CAST(count(DISTINCT (m_start, m_end)) AS BIGINT) AS spans2
    FROM (SELECT q.*, a.cl AS c1, b.cl AS c2 FROM ({PAIR_SQL}) AS q JOIN cluster_ends AS a ON a.pair = q.pair AND a.side = 0 JOIN cluster_ends AS b ON b.pair = q.pair AND b.side = 1) AS g
    GROUP BY chrom, strand, m_chrom, m_strand, c1, c2 HAVING count(*) >= CASE WHEN chrom = m_chrom AND strand = m_strand AND c1 = c2 THEN 4 ELSE 2 END AND count(DISTINCT ("start", "end")) >= 2 AND count(DISTINCT (m_start, m_end)) >= 2"""


@query(EDGE_SQL)
def pair_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Supported edges between clusters of read ends."""
    return P.pair_edges(_named_pairs(spark, d), 200, 2, WorkTables(spark))


@query(f"""SELECT * FROM (WITH RECURSIVE p AS ({PAIR_SQL}),
    u AS (SELECT a.pair AS a, b.pair AS b FROM p AS a JOIN p AS b ON a.chrom = b.chrom AND a.strand = b.strand AND a.m_chrom = b.m_chrom AND a.m_strand = b.m_strand AND abs(a."start" - b."start") < 200 AND abs(a.m_start - b.m_start) < 200),
    r(node, seen) AS (SELECT a, b FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen),
    m AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
    SELECT root, CAST(count(*) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS members FROM m GROUP BY root HAVING count(*) >= 2) AS z""")
def pair_components(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the groups of pairs near each other on both sides."""
    tables = WorkTables(spark)
    return P.pair_components(tables.save(_named_pairs(spark, d), "pairs"), 200, tables, least=2).groupBy("root", "size").agg(F.count("*").alias("members"))


@query("""SELECT chrom, m_chrom, span, n FROM (SELECT *, count(*) OVER (PARTITION BY chrom, m_chrom) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY chrom, m_chrom) AS most FROM (
    SELECT chrom, m_chrom, ("end" - "start") // 10 AS span, CAST(count(*) AS BIGINT) AS n FROM pair_rows GROUP BY ALL) AS a) AS b WHERE n = most) AS c WHERE ties = 1""")
def split_modal(spark: SparkSession, d: str) -> DataFrame:
    rows = disc_pairs(spark, d).withColumn("span", F.floor((F.col("end") - F.col("start")) / 10))
    return P.modal_split(rows, ["chrom", "m_chrom"], ["span"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey + 100 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45 AND l_discount >= 0.09 AND l_tax <= 0.01),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
    SELECT CAST(node AS BIGINT) AS node, CAST(min(seen) AS BIGINT) AS root FROM r GROUP BY node""")
def seed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Nations grouped by chains of large discounted flows, as seeds are grouped by shared intervals."""
    big = table(spark, d, "lineitem").where("l_quantity >= 45 and l_discount >= 0.09 and l_tax <= 0.01")
    rows = big.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return connected_components(rows.select(F.col("c_nationkey").cast("bigint").alias("a"), (F.col("s_nationkey") + 100).cast("bigint").alias("b")).distinct(), WorkTables(spark))


#: Cuts of each contig: the bounds of its merged genes.
CUT_SQL = f"""SELECT DISTINCT chrom, pos FROM (SELECT chrom, "start" - 1 AS pos FROM ({_merge_sql('genes', 0)}) AS m UNION ALL SELECT chrom, "end" FROM ({_merge_sql('genes', 0)}) AS m) AS c"""


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    merged = C.merge_clusters(genes(spark, d))
    return merged.select(F.col("chrom").alias("amplicon"), "chrom", F.explode(F.array(F.col("start") - 1, F.col("end"))).alias("pos"))


@query(f"""SELECT chrom, pos, sign FROM (SELECT chrom, pos, unnest(['+', '-']) AS sign FROM ({CUT_SQL}) AS c) AS v""")
def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).select("chrom", "pos").distinct().select("chrom", "pos", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("sign"))


TILE_SQL = f"""SELECT chrom, pos + 1 AS "start", lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS "end" FROM ({CUT_SQL}) AS c"""


@query(f"""SELECT 'sequence' AS kind, chrom, "start" AS pos1, "end" AS pos2 FROM ({TILE_SQL}) AS t WHERE "end" IS NOT NULL
    UNION ALL SELECT 'concordant', chrom, "end", nxt FROM (SELECT *, lead("start") OVER (PARTITION BY chrom ORDER BY "start") AS nxt FROM ({TILE_SQL}) AS t WHERE "end" IS NOT NULL) AS u WHERE nxt = "end" + 1""")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    tiles = G.sequence_edges(_cuts(spark, d))
    return tiles.select(F.lit("sequence").alias("kind"), "chrom", F.col("start").alias("pos1"), F.col("end").alias("pos2")).unionByName(G.concordant_edges(tiles).select(F.lit("concordant").alias("kind"), "chrom", "pos1", "pos2"))


def _order_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Each order's items as a cycle of oriented segments."""
    items = F.array_sort(F.collect_list(F.struct("number", "start", F.col("part").cast("string").alias("seg"), F.col("strand").alias("orient"))))
    return reads(spark, d).groupBy("qname").agg(items.alias("x")).select("qname", F.transform("x", lambda s: F.struct(s["seg"].alias("seg"), s["orient"].alias("orient"))).alias("segments"))


def _show(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat(s["seg"], F.when(s["orient"] == 1, "+").otherwise("-"))), ",")


ITEM_SQL = """SELECT qname, list(struct_pack(seg := CAST(part AS VARCHAR), orient := strand) ORDER BY number, "start", CAST(part AS VARCHAR), strand) AS s FROM reads GROUP BY qname"""
SHOW = "array_to_string(list_transform({x}, lambda t: t.seg || CASE WHEN t.orient * {f} = 1 THEN '+' ELSE '-' END), ',')"


@query(f"""SELECT qname, concat_ws(',', {SHOW.format(x='s[1:1]', f=1)}, {SHOW.format(x='list_reverse(s[2:3])', f=-1)}, CASE WHEN len(s) > 3 THEN {SHOW.format(x='s[4:]', f=1)} END) AS cycle FROM ({ITEM_SQL}) AS i WHERE len(s) >= 3""")
def cycle_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of at least three segments with the second and third turned round."""
    return _order_cycles(spark, d).where(F.size("segments") >= 3).select("qname", _show(G.pivot_cycle(F.col("segments"), 1, 3)).alias("cycle"))


@query(f"""SELECT qname, concat_ws(',', {SHOW.format(x='s[1:1]', f=1)}, CASE WHEN s[1].orient = s[1].orient THEN {SHOW.format(x='list_concat(s[2:], s[1:1])', f=1)} END, CASE WHEN len(s) > 1 THEN {SHOW.format(x='s[2:]', f=1)} END) AS cycle FROM ({ITEM_SQL}) AS i""")
def cycle_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each cycle with a copy of itself put in at the first segment."""
    c = F.col("segments")
    return _order_cycles(spark, d).select("qname", _show(G.merge_cycles(c, c, 1, 1)).alias("cycle"))


@query("""SELECT chrom, "start", "end", round(off / total, 6) AS x1, round((off + "end" - "start" + 1) / total, 6) AS x2, CASE WHEN lag(chrom) OVER (ORDER BY chrom, "start") = chrom THEN ':' ELSE '--' END AS style FROM (
    SELECT *, coalesce(sum("end" - "start" + 1) OVER (ORDER BY chrom, "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS off, (sum("end" - "start" + 1) OVER ())::DOUBLE AS total FROM (SELECT chrom, min("start") AS "start", max("end") AS "end" FROM genes GROUP BY chrom) AS g) AS h""")
def plot_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Proportional places of the contigs' spans on an axis, and the style of the break before each."""
    spans = genes(spark, d).groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    order = Window.orderBy("chrom", "start")  # one row per contig
    size = F.col("end") - F.col("start") + 1
    placed = spans.withColumn("off", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return placed.select("chrom", "start", "end", F.round(F.col("off") / F.col("total"), 6).alias("x1"), F.round((F.col("off") + size) / F.col("total"), 6).alias("x2"), F.when(F.lag("chrom").over(order) == F.col("chrom"), ":").otherwise("--").alias("style"))
