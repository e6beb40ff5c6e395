"""Alignment of two tokenizers' tokens over the same bytes, by skipping along diagonals.

Both encodings of a text are lists of byte ends. While tokens match one to one, token i of the first meets
token i + shift of the second, so whole stretches of the two lists of sizes are equal at the present shift.
Slices of doubling length are compared until one differs, and the lowest bit of their difference tells
where. There the tokens up to the next common end are one irregular group, after which the shift is another
one. Texts that are encoded in one call are walked as one: all of them begin and end together.

Tokens and groups stay with their document. What is counted over the corpus are the pairs of token ids
that end together: blocks of documents count their own pairs first, Spark adds them up, and each block
asks for its distinct pairs only.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables

#: Files of the two tokenizers, below the folder that is a parameter.
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded in one call, and that are one block; a longer text is one of its own. A row counts as some bytes more, so that rows without text are bounded too.
CALL_BYTES, BLOCK_BYTES, ROW_BYTES = 1 << 20, 8 << 20, 100


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: How a byte-level tokenizer's file cuts a text before merging (a fixed value).
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """The tokens' bytes by id of a byte-level tokenizer's file, and its encoder of texts without special tokens.

    A file whose ids follow the order of its merges is the same as ranks, which encode several times faster;
    any other one is read by the library that the file was made for.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    of, names = _byte_of_char(), [whole.id_to_token(k) for k in range(whole.get_vocab_size())]
    tokens = [bytes(of[c] for c in name) for name in names]
    with open(path, encoding="utf-8") as file:
        kept = json.load(file)
    vocabulary, merges, special = kept["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in kept["model"]["merges"]], {x["content"] for x in kept["added_tokens"]}
    by_rank = kept["normalizer"] is None and kept["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    by_rank = by_rank and all(vocabulary["".join(x)] == 256 + k for k, x in enumerate(merges))
    if not by_rank:
        return tokens, lambda texts: [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = tiktoken.Encoding("ranks", pat_str=CUTS, mergeable_ranks={tokens[k]: k for name, k in vocabulary.items() if name not in special}, special_tokens={})
    return tokens, lambda texts: [encoder.encode_ordinary(t) for t in texts]


def _objects(values: list[bytes]) -> np.ndarray:
    found = np.empty(len(values), object)
    found[:] = values
    return found


class Encoded(NamedTuple):
    """Ids of both for some texts, one text after the other; text k has those from ``at_x[k]`` up to ``at_x[k + 1]``."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray


class Pair:
    """Both tokenizers with the bytes of their tokens, and the decimal ids with the mark that follows them inside and at the end of a group."""

    def __init__(self, folder: str):
        import sentencepiece

        bytes_a, self.first = byte_level(f"{folder}/{FIRST}")
        self.second = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{SECOND}")
        names = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        bytes_b = [bytes([int(x[3:5], 16)]) if self.second.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.bytes_a, self.bytes_b = _objects(bytes_a), _objects(bytes_b)
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (bytes_a, bytes_b))
        digits = len(str(max(len(bytes_a), len(bytes_b))))
        self.marked_a, self.marked_b = (np.array([b"%d%b" % (k, mark) for mark in (b",", last) for k in range(len(x))], f"S{digits + 1}") for x, last in ((bytes_a, b"|"), (bytes_b, b";")))

    def encode(self, texts: list[str]) -> Encoded:
        """Ids of both, for blank + text; none where a text is empty or an encoding loses bytes."""
        firsts = self.first([" " + t for t in texts])
        seconds = self.second.encode(texts, num_threads=1)
        (a, many_a), (b, many_b) = (self._joined(x) for x in (firsts, seconds))
        (at_a, at_b), same = (_starts(many_a), _starts(many_b)), np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            whole = b" " + text.encode()
            same[k] = text != "" and all(b"".join(of[ids[at[k] : at[k + 1]]].tolist()) == whole for of, ids, at in ((self.bytes_a, a, at_a), (self.bytes_b, b, at_b)))
        return Encoded(a[np.repeat(same, many_a)], b[np.repeat(same, many_b)], _starts(many_a * same), _starts(many_b * same))

    @staticmethod
    def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        many = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, many.sum()), many


def _starts(many: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(many, dtype=np.int64)])


@lru_cache(maxsize=2)
def _pair(folder: str) -> Pair:
    return Pair(folder)


def common_ends(ends_a: np.ndarray | list[int], ends_b: np.ndarray | list[int]) -> Iterator[tuple[int, int, int, int]]:
    """``i, j, run, 0`` for stretches of ``run`` one-to-one tokens from i and j, ``i, j, m, n`` for an irregular group of m and n tokens.

    The lists ascend strictly and end alike.
    """
    most_i, most_j = len(ends_a), len(ends_b)
    if not most_i:
        return
    sizes = [np.diff(x, prepend=0) for x in (ends_a, ends_b)]
    kind = np.min_scalar_type(max(x.max() for x in sizes))
    width, (of_a, of_b) = kind.itemsize, (x.astype(kind.newbyteorder("<")).tobytes() for x in sizes)
    size_a, size_b = (x.tolist() for x in sizes)
    i, j = 0, 0
    while i < most_i:
        run, step, rest = 0, 32, min(most_i - i, most_j - j)
        while run < rest:
            till = min(run + step, rest)
            apart = int.from_bytes(of_a[(i + run) * width : (i + till) * width], "little") ^ int.from_bytes(of_b[(j + run) * width : (j + till) * width], "little")
            if apart:
                run += ((apart & -apart).bit_length() - 1) // (8 * width)
                break
            run, step = till, 2 * step
        if run:
            yield i, j, run, 0
            i, j = i + run, j + run
            if i == most_i:
                return
        a, b, ahead = i, j, size_a[i] - size_b[j]
        while ahead:
            if ahead < 0:
                a += 1
                ahead += size_a[a]
            else:
                b += 1
                ahead -= size_b[b]
        yield i, j, a + 1 - i, b + 1 - j
        i, j = a + 1, b + 1


def aligned(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of each group's last tokens."""
    walk = common_ends(np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b]))
    odd, last = np.fromiter(chain.from_iterable(x for x in walk if x[3]), np.int64).reshape(-1, 4), []
    for ids, at, many in ((a, odd[:, 0], odd[:, 2]), (b, odd[:, 1], odd[:, 3])):
        inner = np.zeros(len(ids), np.int8)  # 1 from a group's first token on, up to its last one
        inner[at] += 1
        inner[at + many - 1] -= 1
        last.append(np.flatnonzero(np.cumsum(inner) == 0))
    return last[0], last[1]


def _named(pair: Pair, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
    """All tokens in the order in which groups are written (``a1,a2|b1;a3|b2,b3;``), each with the mark behind it, filled up with zero bytes."""
    found = np.empty(len(a) + len(b), pair.marked_a.dtype)
    for ids, last, before, marked in ((a, last_a, np.concatenate([[0], last_b + 1]), pair.marked_a), (b, last_b, last_a + 1, pair.marked_b)):
        ends = np.zeros(len(ids), np.int64)
        ends[last] = 1
        found[np.arange(len(ids)) + before[np.cumsum(ends) - ends]] = marked[ids + ends * (len(marked) // 2)]
    return found


def _encoded(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[list[int | None], int, Encoded]]:
    """``doc_ids, bytes, ids of both`` of all rows, about ``CALL_BYTES`` at a time."""
    pair = _pair(folder)
    ids, texts, held = [], [], 0
    for batch in batches:
        for k, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            ids.append(k.as_py())
            texts.append(text)
            held += len(text) + ROW_BYTES
            if held >= CALL_BYTES:
                yield ids, held, pair.encode(texts)
                ids, texts, held = [], [], 0
    if ids:
        yield ids, held, pair.encode(texts)


def align_documents(docs: DataFrame, folder: str = "/opt/tokenizers", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the ids ``a`` and ``b``, and ``last_a, last_b``: places of each group's last tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(folder)
        for ids, _, (a, b, at_a, at_b) in _encoded(batches, folder):
            lists = [(a, at_a), (b, at_b)]
            for last, at in zip(aligned(pair, a, b), (at_a, at_b), strict=True):
                groups = np.searchsorted(last, at)
                lists.append((last - np.repeat(at[:-1], np.diff(groups)), groups))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x, at in lists]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "a", "b", "last_a", "last_b"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, a array<int>, b array<int>, last_a array<int>, last_b array<int>")


_BLOCK = "block bigint, keys array<bigint>, links array<bigint>, docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,groups_sha256:string,held:int>>, at array<int>, times array<int>"


def _counted(pair: Pair, a: np.ndarray, b: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the linked ids of texts that have ``groups`` links each: every text's distinct pairs (a << 32 | b), the links of each, and how many pairs each text has."""
    bits_a, bits_b = ((len(x) - 1).bit_length() for x in (pair.bytes_a, pair.bytes_b))
    links = np.sort(np.repeat(np.arange(len(groups)), groups) << bits_a + bits_b | a << bits_b | b)  # a call has at most CALL_BYTES texts
    first = np.flatnonzero(np.diff(links, prepend=-1))
    times, links = np.diff(first, append=len(links)), links[first]
    keys = (links >> bits_b & (1 << bits_a) - 1) << 32 | links & (1 << bits_b) - 1
    return keys, times, np.bincount(links >> bits_a + bits_b, minlength=len(groups))


def _blocks(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One row per block: its distinct id pairs (a << 32 | b), the links of each, its documents, and per document which pairs how often."""
    pair, schema = _pair(folder), pa.schema([
        ("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("held", pa.int32())]))),
        ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ])
    number, found, docs, size = 0, [], [], 0

    def row() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        times = np.concatenate([n for _, n in found])
        links = np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)
        block = TaskContext.get().partitionId() << 33 | number
        values = [[block], [keys], [links], [docs], [at.astype(np.int32)], [times.astype(np.int32)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    for ids, chars, (a, b, at_a, at_b) in _encoded(batches, folder):
        last_a, last_b = aligned(pair, a, b)
        groups = np.diff(np.searchsorted(last_a, at_a))
        keys, times, held = _counted(pair, a[last_a], b[last_b], groups)
        found.append((keys, times))
        named, at = _named(pair, a, b, last_a, last_b), (at_a + at_b).tolist()
        sha = [hashlib.sha256(named[x:y].tobytes().translate(None, b"\0")[:-1]).hexdigest() if y > x else "" for x, y in pairwise(at)]
        columns = (ids, np.diff(at_a).tolist(), np.diff(at_b).tolist(), groups.tolist(), sha, held.tolist())
        docs += [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "held"), x, strict=True)) for x in zip(*columns, strict=True)]
        size += chars
        if size >= BLOCK_BYTES:
            yield row()
            number, found, docs, size = number + 1, [], [], 0
    if docs:
        yield row()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for batch in batches:
        for docs, at, times, told in zip(*(batch.column(c) for c in ("docs", "at", "times", "told")), strict=True):
            docs = pa.Table.from_struct_array(docs.values)
            at, times = (np.asarray(x.values) for x in (at, times))
            count, best = (np.asarray(told.values.field(f)) if told.is_valid else np.zeros(0, np.int64) for f in ("count", "best"))
            ends = np.concatenate([[0], np.cumsum(np.asarray(docs["held"]))])

            def sums(x: np.ndarray, ends: np.ndarray = ends) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
                return total[ends[1:]] - total[ends[:-1]]

            links, good, whole = sums(times), sums(times * best[at]), sums(times * count[at])
            columns = [docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], links, good, whole, docs["groups_sha256"]]
            yield from pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], names).to_batches()


def cross_alignment(docs: DataFrame, folder: str = "/opt/tokenizers", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A link is a pair of tokens that end at the same byte; no token is empty, so every group has one. Its
    count is how often its ids are linked in all rows, and it is best if no other link of its second id
    counts more.

    Defined cases: null and empty texts, and texts whose bytes an encoding does not give back (a literal
    U+2581), have zeros and an empty ``groups_sha256``, and link nothing; strings of special tokens are plain
    text; a null id keeps its row; repeated rows count each; very long texts are encoded whole, as a block of
    their own; an empty table gives an empty result; other columns are ignored, so their names can't clash.
    """
    tables = WorkTables(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = tables.save(source.mapInArrow(lambda b: _blocks(b, folder), _BLOCK), "blocks")
    counted = blocks.select(F.explode(F.arrays_zip("keys", "links")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.links").alias("count"))
    counted = tables.save(counted.withColumn("b", F.col("key").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = counted.groupBy("b").agg(F.max("count").alias("most"))  # at most one row per id of the second vocabulary
    pairs = tables.save(counted.join(most, "b").select("key", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best")), "links")
    asked = blocks.select("block", F.posexplode("keys").alias("pos", "key")).join(pairs, "key")
    told = asked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "count", "best"))).alias("told"))
    tables.keep(blocks, pairs)
    return blocks.join(told, "block", "left").select("docs", "at", "times", "told").mapInArrow(
        _answers, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
