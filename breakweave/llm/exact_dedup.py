"""Exact deduplication by deterministic block naming.

Every text is normalised and cut into blocks of a fixed number of characters. Equal blocks get one
integer name, distinct blocks distinct names; then adjacent names are paired and each distinct pair is
named in turn, until one name is left for a document. That name is its identity: two documents share
it exactly if their texts are equal.

Only DataFrame functions run. The text itself is shuffled once, as distinct blocks (copies collapse
before the shuffle). Block keys in the later joins are 128-bit keys that stand for a block only after
the grouping by content has shown that no two different blocks share one; if two did, the pass would be
repeated under another salt, so the names never rest on a hash being lucky.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, WorkTables


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of white space becomes one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}|^$"), F.lit(0))


def _key(block: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(f"a{salt}"), block).alias("h1"), F.xxhash64(F.lit(f"b{salt}"), block).alias("h2"))


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names for distinct rows: sorted within their shard, numbered from the shard's own range.

    Names are used within one call only: which rows share a name, and so the result, depends on contents
    alone; the numbers also depend on how many shards there are.
    """
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, tables: WorkTables | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Defined cases: a null text is an empty text, and empty texts are equal to each other. Of equal texts
    the row with the smallest id stays; a null id ranks after all others; of repeated rows with the same
    id and text exactly one stays; very long texts are compared whole, block by block. An empty table gives
    an empty result. Other columns are ignored, so their names can't clash.
    """
    tables = tables or WorkTables(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))

    salt = 0
    while True:
        distinct = (
            source.select(F.explode(_blocks(F.col("norm"), block_chars)).alias("block"))
            .select(_key(F.col("block"), salt).alias("k"), "block").select("k.h1", "k.h2", "block")
            .groupBy("h1", "h2", "block").agg(F.lit(1).alias("one")).select("h1", "h2")
        )
        names = tables.save(_named(distinct, ["h1", "h2"]), "block-names")
        if not names.groupBy("h1", "h2").count().where("count > 1").limit(1).collect():
            break
        tables.drop(names)
        salt += 1

    rows = tables.save(
        source.select(
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("norm"), block_chars), lambda b: _key(b, salt)).alias("keys"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "rows",
    )
    level = rows.select("rid", "doc_id", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k")).select("rid", "doc_id", "n", "pos", "k.h1", "k.h2")
    level = tables.save(level.join(names, ["h1", "h2"]).select("rid", "doc_id", "n", "pos", "name"), "level-0")
    most = level.agg(F.max("n")).first()[0] or 1

    identities = level.where("n = 1").select("rid", "doc_id", F.lit(0).alias("level"), "name")
    depth = 0
    while most > 1:
        depth += 1
        most = (most + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = level.where("n > 1").groupBy("rid", "doc_id", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = tables.save(pairs, f"pairs-{depth}")
        named = tables.save(_named(pairs.select("a", "b").distinct(), ["a", "b"]), f"names-{depth}")
        level = tables.save(pairs.join(named, ["a", "b"]).select("rid", "doc_id", "n", "pos", "name"), f"level-{depth}")
        tables.drop(pairs)
        tables.drop(named)
        identities = identities.unionByName(level.where("n = 1").select("rid", "doc_id", F.lit(depth).alias("level"), "name"))

    identities = tables.save(identities, "identities")
    groups = identities.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid")).alias("first"))
    # Written first: the adaptive planner splits a large group only where both sides of the join are plain tables.
    groups = tables.save(groups.where("group_size > 1"), "groups")
    tables.keep(rows, identities, groups)
    copies = identities.select("rid", "level", "name").join(groups, ["level", "name"]).select("rid", "group_size", "first")
    return rows.select("rid", "doc_id", "text_sha256").join(copies, "rid", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay, of any type and name.

    Defined cases: a null text is an empty one; a null id ranks after all others; kept rows are found
    again by id and text digest, so different texts under one id are told apart; repeated rows (same id,
    same text) differ in nothing but other columns, and the one whose columns, written as JSON, have the
    smallest hash stays; very long texts are compared whole; an empty table gives an empty result.
    """
    tables = WorkTables(docs.sparkSession)
    verdict = tables.save(exact_dedup(docs, id_col, text_col, tables=tables), "verdict")
    tables.keep(verdict)
    kept = verdict.where("kept").groupBy("doc_id", "text_sha256").agg(F.lit(True).alias("kept"))
    many = verdict.groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256", F.lit(True).alias("again"))
    keep = kept.join(many, kept["doc_id"].eqNullSafe(many["doc_id"]) & (kept["text_sha256"] == many["text_sha256"]), "left")
    keep = keep.select(kept["doc_id"].alias("id"), kept["text_sha256"].alias("sha"), F.coalesce("again", F.lit(False)).alias("again"))
    # The row is one struct, so that none of its columns can clash with what is added here.
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))
    found = whole.join(keep, F.col("own").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")))
    once = found.where("again").groupBy("id", "sha").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return found.where("not again").select("row").unionByName(once.select("row")).select("row.*")
