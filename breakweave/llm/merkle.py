"""Merkle manifest of a dataset: content-addressed records, proofs by descent from the root.

Every row is a leaf, the leaves of a source form a tree of runs of three, and the sources' roots form
another tree above. The manifest stores one record per distinct inner node: its digest and its children.
Proofs are made by walking down from the root: a request knows the rank of its source and of its leaf,
whose digits to base three name the child to take at every level, and the children not taken are
collected on the way. Requests that share digits share the walk, so a level costs one join of as many rows
as it has requested nodes. A path collected from the root down is reversed to fold a leaf up.

Only DataFrame functions run. Levels are hashed many at a time inside blocks of consecutive leaves, and
ranks come from a range partitioning, so no task holds a source or a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WorkTables, fold

#: Children of a node, and how many levels are hashed inside one block (3 ** 7 = 2,187 nodes).
FAN, LEVELS_AT_ONCE = 3, 7
#: Fields of a row that go into its leaf, in this order (fixed by the format).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_code(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_code(v) for v in values]), 256)


def _ranked(rows: DataFrame, group: str, order: list[str], tables: WorkTables, name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within ``group``, in ascending order of ``order``.

    Rows are partitioned by range and numbered inside their partitions; a group's rows in earlier
    partitions are counted from one row per partition and group, so that no group is one task.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = tables.save(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), name)
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = runs.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    before = before.select(F.col(group).alias("g"), F.col("part").alias("p"), "first", "before")
    found = placed.join(before, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return found.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("rank"))


def _depth(nodes: Column) -> Column:
    """Levels above ``nodes`` nodes until one is left, exactly."""
    steps = F.sequence(F.lit(0), F.lit(40))
    return F.aggregate(steps, F.struct(nodes.cast("bigint").alias("n"), F.lit(0).alias("d")), lambda x, _: F.when(x["n"] <= 1, x).otherwise(F.struct(F.floor((x["n"] + (FAN - 1)) / FAN).alias("n"), (x["d"] + 1).alias("d"))))["d"]


def _grow(nodes: DataFrame, tables: WorkTables, name: str) -> tuple[DataFrame, DataFrame]:
    """From ``tree, rank, digest, depth`` (depth: levels of the tree): (``tree, digest`` of the roots, records ``digest, children``)."""

    def level(acc: Column, _: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(acc["row"]), F.lit(FAN)), lambda i: F.slice(acc["row"], i, F.lit(FAN)))
        made = F.transform(runs, lambda r: F.struct(F.sha2(F.concat_ws("", r), 256).alias("digest"), r.alias("children")))
        return F.struct(F.transform(made, lambda x: x["digest"]).alias("row"), F.concat(acc["made"], made).alias("made"))

    roots, records, turn = [], [], 0
    left = nodes.select("tree", "rank", "digest", F.col("depth").alias("left"))
    while True:
        roots.append(left.where("left = 0").select("tree", "digest"))
        left = left.where("left > 0")
        if left.limit(1).count() == 0:
            break
        size = FAN**LEVELS_AT_ONCE
        blocks = left.groupBy("tree", "left", F.floor(F.col("rank") / size).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("row"))
        empty = F.array().cast("array<struct<digest:string,children:array<string>>>")
        steps = F.least(F.col("left"), F.lit(LEVELS_AT_ONCE))
        grown = F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.col("row"), empty.alias("made")), level)
        blocks = tables.save(blocks.select("tree", "block", (F.col("left") - steps).alias("left"), grown.alias("grown")), f"{name}-{turn}")
        records.append(blocks.select(F.explode("grown.made").alias("m")).select("m.digest", "m.children"))
        # Whole blocks end as one node, so the block's number is the rank of that node.
        left = blocks.select("tree", F.col("block").alias("rank"), F.col("grown.row")[0].alias("digest"), "left")
        turn += 1

    def joined(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    none = nodes.sparkSession.createDataFrame([], "digest string, children array<string>")
    return joined(roots), joined([none, *records])


@dataclass
class Manifest:
    """``leaves``: tree, rank, leaf, source and the carried columns; ``sources``: tree, source, nodes, depth, subroot; ``records``: digest, children."""

    leaves: DataFrame
    sources: DataFrame
    records: DataFrame
    root: str | None
    top_depth: int
    tables: WorkTables


def build_manifest(leaves: DataFrame, tables: WorkTables | None = None, order: tuple[str, ...] = ("doc_id", "leaf")) -> Manifest:
    """The manifest of ``leaves`` (``source, leaf`` and the columns of ``order``; others are carried along).

    Leaves ascend by ``order`` within their source, null first; sources ascend by their UTF-8 bytes, null
    first. Equal subtrees are one record.
    """
    tables = tables or WorkTables(leaves.sparkSession)
    ranked = _ranked(leaves, "source", list(order), tables, "dealt")
    counted = ranked.groupBy("source").agg(F.count("*").alias("nodes"))
    counted = tables.save(counted.withColumn("depth", _depth(F.col("nodes"))).withColumn("one", F.lit(0)), "counted")
    sources = tables.save(_ranked(counted, "one", ["source"], tables, "dealt-sources").select("source", "nodes", "depth", F.col("rank").alias("tree")), "sources")
    here = sources.select(F.col("source").alias("own"), "tree", "depth")
    numbered = tables.save(ranked.join(here, F.col("source").eqNullSafe(F.col("own"))).drop("own"), "leaves")
    subroots, below = _grow(numbered.withColumnRenamed("leaf", "digest"), tables, "tree")
    subroots = tables.save(subroots.select("tree", F.col("digest").alias("subroot")), "subroots")
    total = subroots.count()
    top = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("rank"), F.col("subroot").alias("digest"), _depth(F.lit(total)).alias("depth"))
    roots, above = _grow(top, tables, "top")
    first = roots.first()
    depth = 0
    while FAN**depth < total:
        depth += 1
    records = tables.save(below.unionByName(above).groupBy("digest").agg(F.any_value("children").alias("children")), "records")
    return Manifest(numbered, tables.save(sources.join(subroots, "tree"), "source-roots"), records, first["digest"] if first else None, depth, tables)


def _fold(path: Column, leaf: Column) -> Column:
    """The root that a path (from the root down, ``before`` and ``after`` at each level) gives with a leaf."""
    return F.aggregate(F.reverse(path), leaf, lambda digest, at: F.sha2(F.concat(at["before"], digest, at["after"]), 256))


_PATH = "array<struct<before:string,after:string>>"


def _descended(front: DataFrame, records: DataFrame) -> DataFrame:
    """One level down: every child becomes a row; ``prefix`` grows by its digit, ``path`` by the children not taken."""
    met = front.join(records, "digest")
    kept = [c for c in front.columns if c not in ("digest", "prefix", "left", "path")]
    child = met.select(*kept, "left", "prefix", "path", "children", F.posexplode("children").alias("digit", "digest"))
    before = F.concat_ws("", F.slice("children", F.lit(1), F.col("digit")))
    after = F.concat_ws("", F.slice("children", F.col("digit") + 2, F.lit(FAN)))
    step = F.array(F.struct(before.alias("before"), after.alias("after")))
    return child.select(*kept, "digest", (F.col("prefix") * FAN + F.col("digit")).alias("prefix"), (F.col("left") - 1).alias("left"), F.concat("path", step).alias("path"))


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``requests`` (``tree, rank`` and carried columns; default: all leaves) with ``found, subroot, path``, found from the root down.

    ``found`` is the digest that the descent arrives at. A path's entries run from the root to the leaf and hold the
    digests left and right of the node taken; ``_fold`` reverses them.
    """
    spark, tables = manifest.leaves.sparkSession, manifest.tables
    wanted = None if requests is None else tables.save(requests.select("tree", "rank").distinct().join(manifest.sources.select("tree", "depth"), "tree"), "wanted")
    start = spark.createDataFrame([(manifest.root, 0, manifest.top_depth)] if manifest.root else [], "digest string, prefix bigint, left int")
    front = start.withColumn("path", F.array().cast(_PATH))
    for step in range(manifest.top_depth):
        front = _descended(front, manifest.records)
        if wanted is not None:
            heads = wanted.select(F.floor(F.col("tree") / FAN ** (manifest.top_depth - step - 1)).alias("prefix")).distinct()
            front = front.join(heads, "prefix", "left_semi")
    front = front.withColumnRenamed("prefix", "tree").join(manifest.sources.select("tree", "subroot", "depth"), "tree")
    front = tables.save(front.select("tree", "subroot", "digest", F.lit(0).cast("bigint").alias("prefix"), F.col("depth").alias("left"), "path"), "front-0")

    # The last digit is taken where requests meet their path, so that three leaves share one path until then.
    above = front.where("left <= 1")
    for step in range(1, manifest.sources.agg(F.max("depth")).first()[0] or 0):
        front = _descended(front.where("left > 1"), manifest.records)
        if wanted is not None:
            heads = wanted.select("tree", F.floor(F.col("rank") / F.pow(F.lit(FAN), F.greatest(F.col("depth") - step, F.lit(0)))).alias("prefix")).distinct()
            front = front.join(heads, ["tree", "prefix"], "left_semi")
        front = tables.save(front, f"front-{step}")
        above = above.unionByName(front.where("left <= 1"))
    parents = above.join(manifest.records, "digest", "left")  # a tree of one leaf has no record
    parents = parents.select("tree", "prefix", "subroot", "path", "left", F.when(F.col("left") > 0, F.col("children")).otherwise(F.array("digest")).alias("children"))
    met = (manifest.leaves if requests is None else requests).withColumn("prefix", F.floor(F.col("rank") / FAN)).join(parents, ["tree", "prefix"])
    digit = (F.col("rank") % FAN).cast("int")
    last = F.struct(F.concat_ws("", F.slice("children", F.lit(1), digit)).alias("before"), F.concat_ws("", F.slice("children", digit + 2, F.lit(FAN))).alias("after"))
    path = F.when(F.col("left") > 0, F.concat("path", F.array(last))).otherwise(F.col("path"))
    return met.withColumn("found", F.get("children", digit)).withColumn("path", path).drop("prefix", "left", "children")


def manifest_proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tampered``: the text that a reader holds where it differs from the one in the manifest (default: the
    same text). ``folded_root`` is what the reader's leaf gives with the proof, ``verified`` whether that is
    the root.

    Defined cases: nulls in any field are written ``-``, so a null text and an empty one have different
    leaves; a null id comes first in its source, a null source first of all; rows with the same id ascend by
    their leaf, and repeated rows are equal leaves side by side, each with its proof; one row is its own
    root with an empty proof; very long texts are hashed whole, where they are read; an empty table gives
    an empty result; other columns are ignored, so their names can't clash.
    """
    tables = WorkTables(docs.sparkSession)
    held = F.col("text") if tampered is None else tampered
    fields = [F.col(c) for c in FIELDS]
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", leaf_digest(*fields).alias("leaf"), leaf_digest(*fields[:-1], held).alias("held"))
    manifest = build_manifest(tables.save(source, "digests"), tables)
    proofs = prove(manifest)
    tables.keep(*[t for t in tables.held if t.work_path.endswith(("-leaves", "-records")) or "-front-" in t.work_path])
    siblings = F.concat_ws("", F.transform(F.reverse("path"), lambda x: F.concat(x["before"], x["after"])))
    found = proofs.select("doc_id", F.col("found").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), _fold(F.col("path"), F.col("held")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_breaks(docs_id: str = "doc_id", text: str = "text", every: int = 2) -> Column:
    """The tampering of the query: texts of rows whose id's crc32 is divisible by ``every`` lose their line breaks (null id: none)."""
    return F.when(fold(docs_id, every) == 0, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))
