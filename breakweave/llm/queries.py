"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, exact_dedup, katz, language_id, merkle, mixing, packing, pii, quality, simhash, token_align, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    number, text = chat_format.PLANTED
    planted = spark.createDataFrame([(number, 0, "user", text), (number, 1, "assistant", text)], turns.schema)
    chats = chat_format.format_chats(turns.unionByName(planted))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("formatted"), F.col("spans"))
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), max_rate=float("inf"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables are synthetic; whoever holds real ones sets a secret of their own.
    return pii.pseudonymise_documents(_table(spark, sf_dir, "documents"), spark.conf.get("breakweave.pii.key", "open key for synthetic tables").encode())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_proofs(_table(spark, sf_dir, "documents"), tampered=merkle.without_breaks())


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.cross_alignment(_table(spark, sf_dir, "documents"), spark.conf.get("breakweave.tokenizers", "/opt/tokenizers"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_simhash, op4_chat_format, op5_language_id, op6_mixing, op7_ann, op8_packing, op9_quality, op10_pii, op11_merkle, op12_katz, op13_token_align)}


ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm
    """,
    # An escape is one character that becomes three. The template adds 15 characters to a user turn and to a
    # system turn, 9 to an assistant turn and 3 to a conversation.
    "op4_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), s AS (
            SELECT *, length(text) + 2 * (len(regexp_extract_all(text, '%(25|3C|5B|7C)')) + len(regexp_extract_all(text, '\[/?INST\]'))
                + len(regexp_extract_all(text, '</?s>|<</?SYS>>|<<A>>|<</?ROLE>>')))
                + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 9 END AS size
            FROM t
        )
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(3 + sum(size) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id
    """,
    "op11_merkle": r"""
        WITH RECURSIVE docs AS (
            SELECT *, CASE WHEN hash_even THEN replace(text, chr(10), '') ELSE text END AS held FROM (
                SELECT doc_id, source, lang, n_chars, text, coalesce(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) & 1 = 1, false) AS hash_even FROM documents)
        ), leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text::VARCHAR) || ':' || text::VARCHAR, '-')) AS leaf, sha256(head || coalesce(strlen(held::VARCHAR) || ':' || held::VARCHAR, '-')) AS held
            FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source::VARCHAR) || ':' || source::VARCHAR, '-') || coalesce(strlen(lang::VARCHAR) || ':' || lang::VARCHAR, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head FROM docs)
        ), ranked AS (
            SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n
            FROM leaves
        ), up AS (
            SELECT source, 0 AS lvl, rank AS idx, leaf AS digest, n FROM ranked
            UNION ALL
            SELECT source, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, lvl, idx // 3, n
        ), roots AS (
            SELECT source, lvl AS depth, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS n FROM up WHERE n = 1
        ), top AS (
            SELECT 0 AS lvl, s AS idx, subroot AS digest, n FROM roots
            UNION ALL
            SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n
        ), nodes AS (  -- all nodes above leaves and subroots, the latter continuing each source's levels
            SELECT s, lvl, idx, digest FROM up JOIN roots USING (source) WHERE up.source IS NOT NULL AND up.n > 1
            UNION ALL SELECT s, lvl, idx, digest FROM up JOIN roots ON up.source IS NULL AND roots.source IS NULL WHERE up.n > 1
            UNION ALL SELECT r.s, r.depth + t.lvl, t.idx, t.digest FROM roots r JOIN top t ON t.n > 1
        ), sides AS (
            SELECT a.s, a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
                coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
            FROM nodes a JOIN nodes b ON a.s = b.s AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 GROUP BY ALL
        ), climb AS (
            SELECT k.rid, r.s, r.depth, 0 AS lvl, CASE WHEN r.depth = 0 THEN r.s ELSE k.rank END AS idx, k.held AS digest, '' AS proof
            FROM ranked k JOIN roots r ON k.source IS NOT DISTINCT FROM r.source
            UNION ALL
            SELECT c.rid, c.s, c.depth, c.lvl + 1, CASE WHEN c.lvl + 1 = c.depth THEN c.s ELSE c.idx // 3 END, sha256(d.before || c.digest || d.after), c.proof || d.before || d.after
            FROM climb c JOIN sides d ON c.s = d.s AND c.lvl = d.lvl AND c.idx = d.idx
        ), ends AS (
            SELECT rid, arg_max(digest, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM climb GROUP BY rid
        )
        SELECT k.doc_id, k.leaf, r.subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
        FROM ranked k JOIN ends e USING (rid) JOIN roots r ON k.source IS NOT DISTINCT FROM r.source JOIN top t ON t.n = 1
    """,
}
