"""From intervals and edges to amplicons: growth of intervals, search along edges, the breakpoint graph, its cycles as segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import vertex_text
from ..functions.sequences import reverse_complement
from .arcs import crossing_arcs, outside_reads
from .breakpoints import concordant_support
from .clusters import label_clusters, merge_clusters
from .graph import concordant_edges, sequence_edges
from .overlap import overlap_join, point_join
from .pairs import distinct_edges
from .work import WorkTables

SOURCE = "0:-1-"


def _around(frame: DataFrame, hits: DataFrame, keys: list[str], windows: Column, width: int, *found: Column) -> DataFrame:
    """``frame`` grouped by ``keys`` with aggregates ``found`` over the ``hits`` (chrom, start, end, ...; prefixed ``r_``) that meet its windows.

    ``windows`` is an array of (side, low, high). Rows without a hit stay, so the frame is read once.
    """
    spread = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    r = hits.select(*[F.col(c).alias(f"r_{c}") for c in hits.columns]).withColumn("r_bin", spread(F.col("r_start"), F.col("r_end")))
    left = frame.withColumn("w", F.explode(windows)).withColumn("bin", spread(F.col("w.low"), F.col("w.high")))
    met = (F.col("chrom") == F.col("r_chrom")) & (F.col("bin") == F.col("r_bin")) & (F.col("w.low") <= F.col("r_end")) & (F.col("r_start") <= F.col("w.high"))
    return left.join(r, met, "left").groupBy(*keys).agg(*found)


def extend_intervals(intervals: DataFrame, amplified: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """``intervals`` (chrom, start, end, ...) grown over the amplified stretches that they touch.

    ``amplified`` are windows (chrom, start, end) of ``width``; stretches are windows at most four apart,
    so that more than a fifth of a stretch is amplified. A bound with an amplified window within two
    windows moves ten windows out, and one with an edge leading out within the next window moves two more.
    Starts stop at 0. Equal rows give equal rows.
    """
    keys = intervals.columns
    rest = [c for c in keys if c not in ("start", "end")]
    low, high = F.col("start"), F.col("end")
    window = lambda side, a, b: F.struct(F.lit(side).alias("side"), F.greatest(F.lit(0), a).cast("bigint").alias("low"), F.greatest(F.lit(0), b).cast("bigint").alias("high"))
    rows = intervals.groupBy(*keys).agg(F.count("*").alias("__n"))
    held = [*rest, "__n", "start", "end"]
    stretches = merge_clusters(amplified, 4 * width)
    # The first bounds tell rows apart that grow to the same ones.
    rows = rows.withColumn("__s", low).withColumn("__e", high)
    held += ["__s", "__e"]
    rows = _around(rows, stretches, held, F.array(window("all", low - width, high + width)), 8 * width, F.min("r_start").alias("low"), F.max("r_end").alias("high"))
    rows = rows.withColumn("start", F.least("start", "low")).withColumn("end", F.greatest("end", "high")).select(*held)

    def moved(frame: DataFrame, hits: DataFrame, by: int, windows: Column) -> DataFrame:
        on = lambda side: F.max((F.col("w.side") == side) & F.col("r_chrom").isNotNull() & F.coalesce(F.col("r_side") == side, F.lit(True))).alias(f"at_{side}")
        after = _around(frame, hits, held, windows, 8 * width, on("start"), on("end"))
        return after.withColumn("start", F.when(F.col("at_start"), F.greatest(F.lit(0), low - by)).otherwise(low)).withColumn("end", F.when(F.col("at_end"), high + by).otherwise(high)).select(*held)

    any_side = amplified.select("chrom", "start", "end", F.lit(None).cast("string").alias("side"))
    rows = moved(rows, any_side, 10 * width, F.array(window("start", low - 2 * width, low + 2 * width), window("end", high - 2 * width, high + 2 * width)))
    tips = edges.select(F.col("chrom1").alias("chrom"), F.col("pos1").alias("start"), F.col("pos1").alias("end"), F.when(F.col("strand1") == 1, "end").otherwise("start").alias("side"))
    rows = moved(rows, tips, 2 * width, F.array(window("start", low - width, low - 1), window("end", high + 1, high + width)))
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))).select(*keys)


def neighbors(spans: DataFrame, known: DataFrame, edges: DataFrame, amplified: DataFrame, width: int, max_insert: int, merge: int = 100_000, most: int = 10) -> DataFrame:
    """Where the edges of each seed's ``spans`` (seed, chrom, start, end) lead outside what the seed knows: ``seed, chrom, start, end, weight``.

    Far ends are widened by an insert length, grown, and merged within ``merge``; the weight is the support
    of all edges into a merged interval, and the ``most`` heaviest of each seed are returned.
    """
    starts = point_join(edges.select("edge", F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), "chrom2", "pos2", "support"), spans, width=8 * width)
    far = starts.select(F.col("r_seed").alias("seed"), F.col("chrom2").alias("chrom"), F.col("pos2").alias("pos"), "support").groupBy("seed", "chrom", "pos").agg(F.sum("support").alias("support"))
    inside = point_join(far, known, width=8 * width).where("seed = r_seed and pos > r_start and pos < r_end").select("seed", "chrom", "pos").distinct()
    fresh = far.join(inside, ["seed", "chrom", "pos"], "left_anti")
    around = fresh.select("seed", "support", "chrom", F.greatest(F.lit(0), F.col("pos") - max_insert).alias("start"), (F.col("pos") + max_insert).alias("end"))
    grown = extend_intervals(around, amplified, edges, width)
    merged = label_clusters(grown.withColumn("place", F.col("chrom")).withColumn("chrom", F.concat_ws("/", "seed", "chrom")), merge)
    merged = merged.groupBy("chrom", "cluster").agg(F.first("seed").alias("seed"), F.first("place").alias("place"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("support").alias("weight"))
    first = Window.partitionBy("seed").orderBy(F.desc("weight"), "place", "start")
    return merged.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("seed", F.col("place").alias("chrom"), "start", "end", "weight")


def foreign_expansion(seeds: DataFrame, edges: DataFrame, amplified: DataFrame, contigs: DataFrame, merge: int = 5_000_000, pad: int = 10_000) -> DataFrame:
    """Intervals that seeds of a second genome lead to: ``chrom, start, end``.

    Both ends of the edges that start in a seed (chrom, start, end) and the seeds themselves are merged within ``merge``;
    clusters that meet an amplified interval or a seed stay, widened by ``pad`` within their contig (chrom, length).
    """
    spans = seeds.select("chrom", "start", "end")
    found = point_join(edges.select("edge", F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), "chrom2", "pos2"), spans, width=4096).select("chrom", "pos", "chrom2", "pos2").distinct()
    ends = found.select("chrom", F.col("pos").alias("at")).unionByName(found.select(F.col("chrom2").alias("chrom"), F.col("pos2").alias("at")))
    every = ends.select("chrom", F.col("at").alias("start"), F.col("at").alias("end")).unionByName(spans)
    kept = overlap_join(merge_clusters(every, merge), amplified.select("chrom", "start", "end").unionByName(spans), width=4096, how="left_semi")
    return kept.join(contigs, "chrom").select("chrom", F.greatest(F.lit(0), F.col("start") - pad).alias("start"), F.least(F.col("end") + pad, "length").alias("end"))


def hops(seeds: DataFrame, edges: DataFrame, amplified: DataFrame, width: int, max_insert: int, merge: int = 100_000, rounds: int = 10) -> DataFrame:
    """Intervals reached from each seed (seed, chrom, start, end) along edges: ``seed, chrom, start, end``.

    Best first, all seeds at once: every round searches the heaviest interval that each seed has not
    searched yet, up to ``rounds``. New intervals that a known one holds are dropped, and those shorter
    than two windows with fewer than two edges. Touching results of a seed merge.
    """
    tables = WorkTables(seeds.sparkSession)
    own = extend_intervals(seeds.select("seed", "chrom", "start", "end").distinct(), amplified, edges, width).distinct()
    state = tables.save(own.select("*", F.lit(0).cast("bigint").alias("weight"), F.lit(False).alias("seen"), F.lit(True).alias("own")), "hops")
    place = ["seed", "chrom", "start", "end"]
    tips = edges.select(F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), "edge")
    for _ in range(rounds):
        first = Window.partitionBy("seed").orderBy(F.desc("weight"), "chrom", "start", "end")
        pick = tables.save(state.where("not seen").withColumn("n", F.row_number().over(first)).where("n = 1").select(*place), "pick")
        if pick.isEmpty():
            break
        found = tables.save(neighbors(pick, state.select(*place), edges, amplified, width, max_insert, merge), "found")
        held = overlap_join(found, state.select(*place), width=8 * width).where("seed = r_seed and r_start <= start and end <= r_end").select(*place).distinct()
        rich = point_join(tips, found, width=8 * width).groupBy("chrom", F.col("r_seed").alias("seed"), F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(F.count_distinct("edge").alias("n")).where("n >= 2").select(*place)
        fresh = found.join(held, place, "left_anti")
        fresh = fresh.where(F.col("end") - F.col("start") + 1 >= 2 * width).unionByName(fresh.where(F.col("end") - F.col("start") + 1 < 2 * width).join(rich, place, "left_semi"))
        marks = state.join(pick.withColumn("now", F.lit(True)), place, "left").withColumn("seen", F.col("seen") | F.coalesce("now", F.lit(False))).drop("now")
        after = tables.save(marks.unionByName(fresh.select("*", F.lit(False).alias("seen"), F.lit(False).alias("own"))), "hops")
        tables.keep(after)
        state = after
    kept = state.where("own or seen").withColumn("place", F.col("chrom")).withColumn("chrom", F.concat_ws("/", "seed", "chrom"))
    return label_clusters(kept, 1).groupBy("chrom", "cluster").agg(F.first("seed").alias("seed"), F.first("place").alias("place"), F.min("start").alias("start"), F.max("end").alias("end")).select("seed", F.col("place").alias("chrom"), "start", "end")


def amplicon_graph(
    intervals: DataFrame, edges: DataFrame, reads: DataFrame, proper_pairs: DataFrame, max_insert: int, read_length: int, depth: float, tables: WorkTables, shifts: DataFrame | None = None, mated: DataFrame | None = None
) -> DataFrame:
    """The breakpoint graph of every amplicon: ``amplicon, edge, kind, v1, v2, size, count, cost``.

    ``intervals`` (amplicon, chrom, start, end) are disjoint. They are cut where edges start or end; tiles
    are sequence edges with the reads over them, touching tiles are joined with the pairs spanning
    the cut, edges between two places of one amplicon are discordant edges. What leaves an amplicon hangs
    on the source: the interval bounds, and edges with one end outside. An edge given in both directions counts once.

    ``shifts`` (chrom, pos, strand; ``bare_shifts``) cut intervals too and hang on the source. With ``mated`` (reads with their
    mates' places) bounds and shifts have as count the reads on their strand whose mate is in no interval: within
    an insert length inside a bound, within two around a shift.
    """
    text = lambda k: vertex_text(F.col(f"chrom{k}"), F.col(f"pos{k}"), F.col(f"strand{k}"))
    once = distinct_edges(edges.select(*[f"{c}{k}" for k in (1, 2) for c in ("chrom", "pos", "strand")], "support").withColumn("v1", text(1)).withColumn("v2", text(2)))
    iv = intervals.select("amplicon", "chrom", "start", "end", F.concat_ws(":", "chrom", F.col("start").cast("string")).alias("span"))
    tip = lambda k: once.select("v1", "v2", F.lit(k).alias("side"), F.col(f"chrom{k}").alias("chrom"), F.col(f"pos{k}").alias("pos"), F.col(f"strand{k}").alias("strand"), "support")
    ends = point_join(tip(1).unionByName(tip(2)), iv, width=4096).select("v1", "v2", "side", "pos", "strand", "support", F.col("r_amplicon").alias("amplicon"), F.col("r_span").alias("span"))
    ends = tables.save(ends, "ends")
    sides = ends.groupBy("v1", "v2").agg(F.max("support").alias("support"), F.max(F.when(F.col("side") == 1, F.col("amplicon"))).alias("a1"), F.max(F.when(F.col("side") == 2, F.col("amplicon"))).alias("a2"))
    inner = F.coalesce(F.col("a1") == F.col("a2"), F.lit(False))
    cuts = ends.select("amplicon", F.col("span").alias("chrom"), F.when(F.col("strand") == 1, F.col("pos")).otherwise(F.col("pos") - 1).alias("pos"))
    cuts = cuts.unionByName(iv.select("amplicon", F.col("span").alias("chrom"), F.explode(F.array(F.col("start") - 1, F.col("end"))).alias("pos")))
    if shifts is not None:
        points = shifts.select(F.col("chrom"), "pos", "strand", F.when(F.col("strand") == 1, F.col("pos")).otherwise(F.col("pos") - 1).alias("cut"))
        inside = point_join(points, iv, width=4096).where("cut >= r_start and cut < r_end")
        shifts = tables.save(inside.select(F.col("r_amplicon").alias("amplicon"), F.col("r_span").alias("span"), "chrom", "pos", "strand", "cut"), "shifts")
        cuts = cuts.unionByName(shifts.select("amplicon", F.col("span").alias("chrom"), F.col("cut").alias("pos")))
    tiles = tables.save(sequence_edges(cuts), "tiles")
    chrom = F.regexp_extract("chrom", r"^(.*):", 1)
    zero = F.lit(0).cast("bigint")
    row = lambda f, kind, v1, v2, size, n: f.select("amplicon", F.lit(kind).alias("kind"), v1.alias("v1"), v2.alias("v2"), size.cast("bigint").alias("size"), n.cast("bigint").alias("count"))

    spans = reads.groupBy("chrom", "start", "end").agg(F.count("*").alias("k"))
    pieces = tiles.select("amplicon", chrom.alias("chrom"), "start", "end")
    over = overlap_join(pieces, spans, width=4096).groupBy("amplicon", "chrom", "start", "end").agg(F.sum("r_k").alias("n"))
    pieces = pieces.join(over, ["amplicon", "chrom", "start", "end"], "left")
    sequence = row(pieces, "sequence", vertex_text(F.col("chrom"), F.col("start"), F.lit(-1)), vertex_text(F.col("chrom"), F.col("end"), F.lit(1)), F.col("end") - F.col("start") + 1, F.coalesce("n", zero))

    joins = concordant_edges(tiles).select("amplicon", chrom.alias("chrom"), F.col("pos1").alias("pos"), F.lit(1).alias("strand"))
    joins = concordant_support(joins, proper_pairs, max_insert, read_length, 0)
    concordant = row(joins, "concordant", vertex_text(F.col("chrom"), F.col("pos"), F.lit(1)), vertex_text(F.col("chrom"), F.col("pos") + 1, F.lit(-1)), zero, F.col("n"))

    discordant = row(sides.where(inner).withColumnRenamed("a1", "amplicon"), "discordant", F.col("v1"), F.col("v2"), zero, F.col("support"))
    outer = sides.where(~inner)
    loose = outer.where("a1 is not null").select(F.col("a1").alias("amplicon"), F.col("v1").alias("at"), "support").unionByName(outer.where("a2 is not null").select(F.col("a2").alias("amplicon"), F.col("v2").alias("at"), "support"))
    low = lambda x: F.greatest(F.lit(0), x)
    spot = lambda at, strand, start, end: F.struct(vertex_text(F.col("chrom"), at, F.lit(strand)).alias("at"), F.lit(strand).alias("strand"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
    bounds = iv.select("amplicon", "chrom", F.explode(F.array(spot(F.col("start"), -1, F.col("start"), F.col("start") + max_insert), spot(F.col("end"), 1, low(F.col("end") - max_insert), F.col("end")))).alias("x")).select("amplicon", "chrom", "x.*")
    if shifts is not None:
        bounds = bounds.unionByName(shifts.select("amplicon", "chrom", vertex_text(F.col("chrom"), F.col("pos"), F.col("strand")).alias("at"), "strand", low(F.col("pos") - 2 * max_insert).alias("start"), (F.col("pos") + 2 * max_insert).alias("end")))
    if mated is None:
        bounds = bounds.select("amplicon", "at", zero.alias("support"))
    else:
        outside = tables.save(outside_reads(mated, iv), "outside")
        bounds = crossing_arcs(bounds, outside).select("amplicon", "at", F.col("arcs").alias("support"))
    source = row(loose.unionByName(bounds).groupBy("amplicon", "at").agg(F.sum("support").alias("support")), "source", F.lit(SOURCE), F.col("at"), zero, F.col("support"))

    haploid = depth / 2
    cost = F.when(F.col("kind") == "sequence", F.col("size") * haploid / read_length).otherwise(max_insert * haploid / 2 / read_length)
    every = sequence.unionByName(concordant).unionByName(discordant).unionByName(source)
    return every.withColumn("edge", F.concat(F.substring("kind", 1, 1), F.lit(":"), "v1", F.lit(">"), "v2")).withColumn("cost", cost)


def walk_segments(path: list[str], ends: dict[str, tuple[str, str, str]]) -> list[tuple[str, str]]:
    """Runs of sequence and concordant edges of a walk as (first vertex, last vertex), the longest first and forward; an edge at the source is a run of its own."""
    place = lambda v: int(v[v.rindex(":") + 1 : -1])
    _, a, b = ends[path[0]]
    at = a
    if len(path) > 1:
        after = ends[path[1]][1:]
        at = b if a in after and b not in after else a
    runs, open_run = [], False
    for edge in path:
        kind, v1, v2 = ends[edge]
        to = v2 if at == v1 else v1
        if kind == "sequence":
            if open_run:
                runs[-1] = (runs[-1][0], to)
            else:
                runs.append((at, to))
            open_run = True
        elif kind == "source":
            runs.append((at, to))
            open_run = False
        elif kind != "concordant":
            open_run = False
        at = to
    size = [-1 if SOURCE in r else abs(place(r[1]) - place(r[0])) for r in runs]
    top = size.index(max(size)) if size else 0
    if not runs or place(runs[top][0]) <= place(runs[top][1]):
        return runs[top:] + runs[:top]
    back = [(r[1], r[0]) for r in reversed(runs)]
    top = len(runs) - 1 - top
    return back[top:] + back[:top]


def cycle_segments(edges: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (amplicon, seg, chrom, start, end) and cycles (amplicon, cycle, cn, segments) of decomposed graphs.

    Segments are numbered by place in each amplicon; the source is segment 0, forward where a walk comes from it. One graph is one group.
    """

    def run(key: tuple, graph: pd.DataFrame, walks: pd.DataFrame) -> pd.DataFrame:
        ends = dict(zip(graph["edge"], zip(graph["kind"], graph["v1"], graph["v2"], strict=True), strict=True))
        out = []
        for cycle, cn, path in zip(walks["cycle"], walks["cn"], walks["path"], strict=True):
            for n, (a, b) in enumerate(walk_segments(path.split(","), ends)):
                (chrom, p), q = (a[: a.rindex(":")], int(a[a.rindex(":") + 1 : -1])), int(b[b.rindex(":") + 1 : -1])
                out.append((key[0], cycle, cn, n, chrom, min(p, q), max(p, q), 1 if (p, a[-1] == "+") <= (q, b[-1] == "+") else -1, SOURCE in (a, b)))
        return pd.DataFrame(out, columns=["amplicon", "cycle", "cn", "n", "chrom", "start", "end", "orient", "source"])

    steps = edges.groupBy("amplicon").cogroup(cycles.groupBy("amplicon")).applyInPandas(run, "amplicon string, cycle bigint, cn double, n bigint, chrom string, start bigint, end bigint, orient int, source boolean")
    order = Window.partitionBy("amplicon").orderBy("chrom", "start", "end")
    segments = steps.where("not source").select("amplicon", "chrom", "start", "end").distinct().withColumn("seg", F.row_number().over(order).cast("string"))
    named = steps.join(segments, ["amplicon", "chrom", "start", "end"], "left").withColumn("seg", F.coalesce("seg", F.lit("0")))
    listed = named.groupBy("amplicon", "cycle", "cn").agg(F.array_sort(F.collect_list(F.struct("n", "seg", "orient"))).alias("x"))
    return segments.select("amplicon", "seg", "chrom", "start", "end"), listed.select("amplicon", "cycle", "cn", F.transform("x", lambda s: F.struct(s["seg"].alias("seg"), s["orient"].alias("orient"))).alias("segments"))


def fetch_bases(requests: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """``requests`` (id, chrom, start, end, strand) with their ``bases``, turned round on strand -1; ``n`` for every base that no chunk holds.

    ``chunks`` (chrom, start, bases) cut each sequence into pieces of at most ``width``; places count from 0. A
    request meets only the chunks it overlaps.
    """
    held = chunks.select("chrom", "start", (F.col("start") + F.length("bases") - 1).alias("end"), "bases")
    met = overlap_join(requests, held, width=width)
    low, high = F.greatest("start", "r_start"), F.least("end", "r_end")
    piece = F.substring("r_bases", low - F.col("r_start") + 1, high - low + 1)
    parts = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(low.alias("low"), high.alias("high"), piece.alias("bases")))).alias("parts"))
    # Each piece goes behind the unknown bases between it and what is there.
    blank = F.struct(F.col("start").alias("next"), F.lit("").alias("text"))
    joined = F.aggregate("parts", blank, lambda a, p: F.struct((p["high"] + 1).alias("next"), F.concat(a["text"], F.repeat(F.lit("n"), (p["low"] - a["next"]).cast("int")), p["bases"]).alias("text")), lambda a: a["text"])
    text = F.rpad(F.coalesce(joined, F.lit("")), (F.col("end") - F.col("start") + 1).cast("int"), F.lit("n"))
    return requests.join(parts, "id", "left").select(*requests.columns, F.when(F.col("strand") == -1, reverse_complement(text)).otherwise(text).alias("bases"))


def compact_span(intervals: DataFrame, gap: int) -> DataFrame:
    """Total length per chromosome of the intervals once gaps shorter than ``gap`` are closed: ``chrom, pieces, span``."""
    merged = merge_clusters(intervals, gap - 1)
    return merged.groupBy("chrom").agg(F.count("*").alias("pieces"), F.sum(F.col("end") - F.col("start") + 1).alias("span"))
