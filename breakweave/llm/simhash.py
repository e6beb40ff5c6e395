"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a fingerprint between them that differs from each
in at most r. So every distinct fingerprint emits itself and all variants within half the radius; one
shuffle brings equal variants together. All fingerprints that meet on a variant lie within the full
radius of each other, so linking each to the smallest one there keeps the components and needs no pairs
within a group, and a group never holds more than one ball of distinct fingerprints.

The pipeline's stage takes similar texts, not near-identical ones: there, several short fingerprints a
text only find candidates, and an exact comparison of shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WorkTables, connected_components

SEED = 42
_STEP = 1 << 15
#: The stage's similarity; its short fingerprints per text; the share of their bits in which similar texts may differ
#: (0.15 is expected at 0.8, at most 0.19 for texts of a few shingles, and 0.25 is four deviations above that).
SIMILARITY, PRINTS, MOST_APART = 0.8, 20, 0.25
#: Fingerprints whose variants are shuffled at once.
PRINTS_AT_ONCE = 4
#: Texts of one fingerprint that are compared inside an array; larger classes are joined.
TEXTS_AT_ONCE = 64
#: Bits of a text's bitmap, in which every shingle sets one.
BITS = 1024


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of word shingles (A-Z lower-cased; no word: 0), as an unsigned number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    width = min(words, len(parts))
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _STEP):
        own, till = starts[at : at + _STEP], ends[at : at + _STEP]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(own, till, strict=True)), np.uint64, len(own))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(starts)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (fp: the fingerprint's bits as a signed long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((text_fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())]))


def _masks(radius: int) -> list[int]:
    """XOR masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a, b`` (a < b) between distinct fingerprints whose closure is that of all pairs within ``radius``."""
    if radius % 2 or radius > 4:
        raise ValueError("the radius must be 0, 2 or 4: each side emits half of it")
    variants = prints.select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in _masks(radius // 2)])).alias("variant"))
    met = variants.withColumn("head", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> head")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= radius).select(F.col("head").alias("a"), F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Defined cases: null and empty texts and texts without a word have fingerprint zero and link like any
    other; a null id keeps its row and is never a component's id unless all its ids are null; repeated
    rows appear as often as they came; very long texts are hashed whole, some shingles at a time; other columns are
    ignored, so their names can't clash; an empty table gives an empty result.
    """
    tables = WorkTables(docs.sparkSession)
    prints = tables.save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    roots = connected_components(fingerprint_links(prints, radius), tables)
    classes = tables.save(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes",
    )
    component = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = classes.join(component, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased; a shorter text is one shingle, one without a word none)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    width = min(words, len(parts))
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def short_fingerprints(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` independent 32-bit SimHashes of a set of hashes, each with its own number in the upper half, as signed longs."""
    wide = -(-count // 2)
    ones = np.zeros(64 * wide, np.int64)
    steps = (np.arange(1, wide + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(shingles), 255):  # sums of 255 bits fit a byte
        z = shingles[at : at + 255, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    prints = np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint32)[:count]
    return prints.astype(np.int64) | (np.arange(count, dtype=np.int64) << 32)


def _nodes(batches: Iterator[pa.RecordBatch], words: int, count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = [shingle_set(t.as_py(), words) for t in part.column(2)]
            nodes = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
            prints = np.concatenate([short_fingerprints(x, count) for x in sets])
            prints = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * count, pa.int32()), pa.array(prints))
            bits = np.zeros((len(sets), BITS), np.uint8)
            for k, x in enumerate(sets):
                bits[k, (x % np.uint64(BITS)).astype(np.int64)] = 1
            bits = pa.array(np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel())
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (BITS // 64), pa.int32()), bits)
            size = pa.array(list(map(len, sets)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), prints, bits, size], ["id", "mark", "node", "prints", "bits", "size"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _apart(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two rows of short fingerprints: for a first filter, never the verdict."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _meetings(classes: DataFrame) -> DataFrame:
    """``variant, key`` wherever keys (32-bit fingerprints) that differ in at most two bits meet."""
    # A variant travels with the place of the bit that was flipped (32: none), which is shorter than the key itself.
    flips = [*(1 << b for b in range(32)), 0]
    key = F.col("variant").bitwiseXOR(F.get(F.array(*[F.lit(m).cast("bigint") for m in flips]), F.col("bit").cast("int")))
    variants = classes.select(F.explode(F.array(*[F.struct(F.col("key").bitwiseXOR(F.lit(m)).alias("variant"), F.lit(b).cast("byte").alias("bit")) for b, m in enumerate(flips)])).alias("v")).select("v.*")
    # The keys of one variant are distinct, so a count over 1 is a meeting.
    return variants.withColumn("n", F.count("*").over(Window.partitionBy("variant"))).where("n > 1").select("variant", key.alias("key"))


def _able(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> Column:
    """Whether two sets of shingles can be similar: a bit that only one has stands for a shingle that the other lacks, so no similar pair is refused."""

    def held(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        return a("size") - F.aggregate(F.zip_with(a("bits"), b("bits"), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, z: n + z)

    return F.least(held(x, y), held(y, x)) * F.lit(1 + similarity) >= F.lit(similarity) * (x("size") + y("size")) - F.lit(1e-6)


def _similar(x: Callable[[str], Column], y: Callable[[str], Column], most: int, similarity: float) -> Column:
    """Whether two texts may be similar, by their bitmaps and by their fingerprints."""
    return _able(x, y, similarity) & (_apart(x("prints"), y("prints")) <= most)


def _meets(x: Column, y: Column) -> Column:
    """Whether x is the smaller one of two keys in a variant's ``ball``, and this the one of their two variants where they are compared."""
    apart = x["key"].bitwiseXOR(y["key"])
    # The other variant is the larger key with the lowest differing bit flipped.
    return (x["key"] < y["key"]) & (x["key"].bitwiseXOR(apart.bitwiseAND(-apart)) == F.col("variant"))


def _nearest_links(met: DataFrame, known: DataFrame, most: int, similarity: float) -> DataFrame:
    """For every key ``b`` that meets smaller ones the key ``a`` with the nearest text; keys of one text each only if they may be similar.

    ``known``: ``key, single, prints, bits, size``. A variant's keys are one ball of at most 33, so they fit one array and are compared there.
    """
    balls = met.join(known, "key").groupBy("variant").agg(F.collect_list(F.struct("key", "single", "prints", "bits", "size")).alias("ball"))

    def first(y: Column) -> Column:
        near = F.filter("ball", lambda x: _meets(x, y) & (~(x["single"] & y["single"]) | _similar(x.getField, y.getField, most, similarity)))
        return F.array_min(F.transform(near, lambda x: F.struct(_apart(x["prints"], y["prints"]).alias("apart"), x["key"].alias("a"))))

    firsts = F.filter(F.transform("ball", lambda y: F.struct(first(y).alias("first"), y["key"].alias("b"))), lambda p: p["first"].isNotNull())
    return balls.select(F.explode(firsts).alias("p")).groupBy("p.b").agg(F.min("p.first").alias("first")).select("first.a", "b")


def _open_pairs(met: DataFrame, state: DataFrame, most: int, similarity: float) -> DataFrame:
    """Texts ``u, v`` of keys that are equal or meet, in two components and perhaps similar; or (u and v null) keys ``a, b`` of which one has too many texts for an array.

    ``state``: ``key, root, members``: the component of all texts, if it is one; the texts (null: too many), with ``node, root, prints, bits, size``.
    """

    def pairs(x: Column, y: Column, ordered: Column | bool) -> Column:
        of = lambda u: F.filter(y["members"], lambda v: (u["root"] != v["root"]) & (F.lit(ordered) | (u["node"] < v["node"])) & _similar(u.getField, v.getField, most, similarity))
        texts = F.flatten(F.transform(x["members"], lambda u: F.transform(of(u), lambda v: F.struct(x["key"].alias("a"), y["key"].alias("b"), F.least(u["node"], v["node"]).alias("u"), F.greatest(u["node"], v["node"]).alias("v")))))
        none = F.lit(None).cast("bigint")
        return F.coalesce(texts, F.array(F.struct(x["key"].alias("a"), y["key"].alias("b"), none.alias("u"), none.alias("v"))))

    balls = met.join(state, "key").groupBy("variant").agg(F.collect_list(F.struct("key", "root", "members")).alias("ball"))
    others = lambda x: F.filter("ball", lambda y: _meets(x, y) & F.coalesce(x["root"] != y["root"], F.lit(True)))
    across = balls.select(F.explode(F.flatten(F.flatten(F.transform("ball", lambda x: F.transform(others(x), lambda y: pairs(x, y, True)))))).alias("p"))
    own = F.struct("key", "members")
    within = state.where("root is null").select(F.explode(pairs(own, own, False)).alias("p"))
    return across.union(within).select("p.*")


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY, count: int = PRINTS, most_apart: float = MOST_APART
) -> DataFrame:
    """``docs`` reduced to one text of each near-duplicate component, the one with the smallest id.

    Texts are linked whose sets of distinct word shingles have a Jaccard similarity of ``similarity`` or
    more. Candidates come from ball hashing over ``count`` short fingerprints of 32 bits: each emits itself
    and its 32 neighbours, so two texts meet where one of their fingerprints differs in at most two bits.
    Candidates that differ in more than ``most_apart`` of all fingerprint bits are left out (1: none is). Each
    fingerprint's nearest meeting is compared exactly on the sets first, then every other pair, unless its texts
    are in one component already or their bitmaps of ``BITS`` bits show that they can't be similar. With texts'
    number unrelated fingerprints of 32 bits meet more often, ``count`` times (33 n)^2 / 2^33 times in all;
    such meetings end inside a variant's array, which holds 33 keys at most.

    Defined cases: texts with the same set of shingles are alike, so are texts without a word; rows with
    the same id and text stay together; different texts under one id are told apart; a null id is larger
    than every other, and a null text the same as an empty one; texts of any length are read whole, a few
    at a time; columns of any type and name pass through; an empty table gives an empty result.
    """
    tables = WorkTables(docs.sparkSession)
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    rows = tables.save(source.mapInArrow(lambda b: _nodes(b, words, count), "id bigint, mark bigint, node bigint, prints array<bigint>, bits array<bigint>, size int"), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "mark")).alias("first")
    nodes = tables.save(rows.groupBy("node").agg(first, *[F.any_value(c).alias(c) for c in ("prints", "bits", "size")]), "nodes")

    most = int(most_apart * 32 * count)
    everyone = tables.save(nodes.select("node", F.explode("prints").alias("key")), "members")
    prints = nodes.select("node", "prints", "bits", "size")
    roots = None

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs ``u, v`` that are similar and not in one component yet."""
        if roots is not None:
            pairs = pairs.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
            pairs = pairs.where(F.coalesce(F.col("ru") != F.col("rv"), F.lit(True))).select("u", "v")
        pairs = tables.save(pairs, "pairs")
        asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        wanted = nodes.join(asked, "node").select("node", "first.id", "first.mark")
        texts = source.join(wanted, source["id"].eqNullSafe(wanted["id"]) & (source["mark"] == wanted["mark"])).select("node", "text")
        sets = tables.save(texts.mapInArrow(lambda b: _sets(b, words), "node bigint, shingles array<bigint>").dropDuplicates(["node"]), "sets")
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
        shared = F.size(F.array_intersect("su", "sv"))
        good = both.where(shared >= F.lit(similarity) * (F.size("su") + F.size("sv") - shared))
        good = tables.save(good.select(F.col("u").alias("a"), F.col("v").alias("b")), "verified")
        tables.drop(sets)
        return good

    def joined(frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    def of(frame: DataFrame, at: int) -> DataFrame:
        return frame.where(F.shiftright("key", 32).between(at, at + PRINTS_AT_ONCE - 1))

    parts, meetings, firsts = [], [], []
    for at in range(0, count, PRINTS_AT_ONCE):
        # Equal short fingerprints are one class, so that no group of copies emits its variants again and again.
        own = tables.save(of(everyone, at).groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("texts")), "classes")
        met = tables.save(_meetings(own), "met")
        known = met.select("key").distinct().join(own.select("key", "low", (F.col("low") == F.col("high")).alias("single")), "key")
        known = known.join(prints.withColumnRenamed("node", "low"), "low")
        firsts.append(tables.save(_nearest_links(met, known, most, similarity), "nearest"))
        parts, meetings = [*parts, own], [*meetings, met]
    classes = joined(parts)

    # First the ends of each class with those of the nearest one that it meets, and its texts with its ends: as many pairs as members. They join most of every component.
    ends = joined(firsts).join(classes.select(F.col("key").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high")), "a").join(classes.select(F.col("key").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high")), "b")
    ends = ends.select(F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"a_{x}").alias("u"), F.col(f"b_{y}").alias("v")) for x in ("low", "high") for y in ("low", "high")]))).alias("p")).select("p.u", "p.v")
    many = classes.where("low <> high")
    within = everyone.join(many, "key").select(F.explode(F.array_distinct(F.array(F.struct(F.col("low").alias("u"), F.col("node").alias("v")), F.struct(F.col("high").alias("u"), F.col("node").alias("v"))))).alias("p")).select("p.u", "p.v")
    edges = verified(ends.unionByName(within).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    roots = tables.save(connected_components(edges, tables), "roots")

    # Then every pair that met, is still in two components and may be similar: in arrays, but for classes of very many texts. These are matched
    # by the components in them first, so that texts which are in one component already, the bulk of a large group of copies, are never paired.
    keys = joined([m.select("key") for m in meetings]).union(many.select("key")).distinct().join(classes.select("key", "texts"), "key")
    placed = tables.save(everyone.join(keys, "key").join(roots, "node", "left").select("key", "node", "texts", F.coalesce("root", "node").alias("root")), "placed")
    one = F.when(F.min("root") == F.max("root"), F.min("root")).alias("root")
    found = []
    for k, met in enumerate(meetings):
        own = of(placed, k * PRINTS_AT_ONCE)
        listed = own.where(F.col("texts") <= TEXTS_AT_ONCE).join(prints, "node").groupBy("key").agg(one, F.collect_list(F.struct("node", "root", "prints", "bits", "size")).alias("members"))
        large = own.where(F.col("texts") > TEXTS_AT_ONCE).groupBy("key").agg(one).withColumn("members", F.lit(None).cast(listed.schema["members"].dataType))
        found.append(tables.save(_open_pairs(met, listed.union(large), most, similarity), "open"))
    found = joined(found)
    rest, near = found.where("u is not null").select("u", "v"), found.where("u is null").select("a", "b")
    if near.limit(1).count():
        near = tables.save(near.union(near.where("a <> b").select("b", "a")), "near")
        placed = tables.save(placed.join(near.select(F.col("a").alias("key")).distinct(), "key").join(prints, "node").drop("texts"), "wide")
        held = placed.select("key", "root").distinct()

        def side(frame: DataFrame, key: str, end: str) -> DataFrame:
            return frame.select(F.col("key").alias(key), *[F.col(c).alias(f"{c}_{end}") for c in frame.columns if c != "key"])

        met = near.join(side(held, "a", "u"), "a").join(side(held, "b", "v"), "b").where("root_u < root_v")
        wide = met.join(side(placed, "a", "u"), ["a", "root_u"]).join(side(placed, "b", "v"), ["b", "root_v"]).where(_similar(lambda c: F.col(f"{c}_u"), lambda c: F.col(f"{c}_v"), most, similarity))
        rest = rest.union(wide.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")))
    rest = tables.save(rest.distinct(), "rest")
    if rest.limit(1).count():
        good = verified(rest)
        if good.limit(1).count():
            roots = tables.save(connected_components(edges.unionByName(good), tables), "roots")

    kept = nodes.join(roots, "node").groupBy("root").agg(F.min("first").alias("kept"))
    dropped = rows.select("id", "mark", "node").join(nodes.select("node", "first"), "node").join(roots, "node", "left").join(kept, "root", "left")
    dropped = tables.save(dropped.where(F.struct(F.col("id").isNull(), "id", "mark") != F.coalesce("kept", "first")).select("id", "mark").distinct(), "dropped")
    tables.keep(dropped)
    # The row is one struct, so that none of its columns can clash with what is added here.
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("own"), mark.alias("own_mark"))
    return whole.join(dropped, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark")), "left_anti").select("row.*")
