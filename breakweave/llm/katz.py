"""Katz backoff scores of whole texts, with Good-Turing discounts and exactly normalised backoff weights.

A block holds some documents as numbers into its own list of distinct words. Level by level, each block
sends its distinct n-grams with their counts to buckets, which add them up and answer with the counts in
the whole training corpus and with the sums that a context's backoff weight needs. Blocks then evaluate
their tokens by the recursion

    P(w | h) = d(c) c(h w) / c(h)   if h w was seen, else   a(h) P(w | h without its first word)

and the next level's contexts are weighed with these values, so that every a(h) leaves a probability of
exactly one over all words, the unknown one included. No task holds a level: buckets are many, contexts
that are longer than a bucket are dealt over several by their next word, and their parts are added up in
a second, small step.

Words are named by 64-bit hashes until the first level has numbered them, longer n-grams by the numbers of
their context and their last word. The lowest level is the smoothed unigram distribution
(c + 0.1) / (N + 0.1 (V + 1)), one unknown word included. Lists of numbers travel as compressed bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables, fold

#: Tokens of a block (a longer text is one of its own) and of a bucket; occurrences from which a context is dealt over several buckets.
BLOCK_TOKENS, BUCKET_TOKENS, SPREAD = 2_000_000, 1_000_000, 1_000_000
#: Counts up to this are discounted; added to every unigram count.
DISCOUNTED, ADDED = 5, 0.1
FOLDS, HELD_OUT = 10, 0
SEED = 42

_BLOCK = "block bigint, words binary, ranks binary, idx binary, docs array<struct<doc_id:bigint,held:boolean,size:int>>"
_ASK = "bucket bigint, block bigint, ctx binary, runs binary, keys binary, counts binary, lower binary"
_TELL = "kind string, bucket bigint, block bigint, keys binary, ids binary, counts binary, total binary, types binary, mass binary"
_LISTS = ("keys", "ids", "counts", "total", "types", "mass")
_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


#: No word has a line break.
END = word_hash(b"\n")
#: The number of the place before a text, in a block and in all.
START = (1 << 40) - 1


def packed(x: np.ndarray) -> bytes:
    """A list of numbers as bytes: whole numbers in as few bytes as the largest needs, the first bytes of all, then the second ones; of ascending ones the steps; others by their distinct values."""
    if x.dtype.kind == "f":
        values, codes = np.unique(x, return_inverse=True)
        head = packed(codes)
        return b"f" + len(head).to_bytes(8, "little") + head + pa.compress(values.tobytes(), "zstd", asbytes=True) + (8 * len(values)).to_bytes(8, "little")
    x = x.astype(np.int64, copy=False) if x.dtype != np.uint64 else x
    sorted_ = len(x) > 1 and bool((x[1:] >= x[:-1]).all())  # then the steps are stored
    low = int(x.min()) if len(x) else 0
    rest = np.diff(x, prepend=x[:1]).astype(np.uint64) if sorted_ else (x - x.dtype.type(low)).astype(np.uint64)
    width = max(1, -(-int(rest.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return (b"s" if sorted_ else b"i") + bytes([width]) + len(x).to_bytes(8, "little") + (low % (1 << 64)).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """What ``packed`` was given, whole numbers as 64 bits."""
    if data[:1] == b"f":
        size = int.from_bytes(data[1:9], "little")
        values = pa.decompress(data[9 + size : -8], int.from_bytes(data[-8:], "little"), "zstd", asbytes=True)
        return np.frombuffer(values, np.float64)[unpacked(data[9 : 9 + size])]
    width, n, low = data[1], int.from_bytes(data[2:10], "little"), np.uint64(int.from_bytes(data[10:18], "little"))
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[18:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    numbers = out.view(np.uint64).ravel()
    return ((np.cumsum(numbers, dtype=np.uint64) if data[:1] == b"s" else numbers) + low).view(np.int64)


def _mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of pairs of numbers, for dealing them to buckets."""
    z = np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def good_turing(having: list[int], most: int = DISCOUNTED) -> np.ndarray:
    """Discounts d[c] for c = 0 .. most, from the numbers of n-grams seen once, twice, .. ``most`` + 1 times.

    Katz's discounts up to the largest count for which all of them lie between 0 and 1; if there is none,
    one amount n1 / (n1 + 2 n2) is taken off every count up to ``most`` (a half where that is 0 or 1), and
    nothing at all where no n-gram was seen once.
    """
    n = [0, *having]
    d = np.ones(most + 1)
    for top in range(most, 0, -1):
        if not all(n[1 : top + 2]):
            continue
        common = (top + 1) * n[top + 1] / n[1]
        if common >= 1:
            continue
        found = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, top + 1)]
        if all(0 < x < 1 for x in found):
            d[1 : top + 1] = found
            return d
    if n[1]:
        off = n[1] / (n[1] + 2 * n[2])
        off = off if 0 < off < 1 else 0.5
        d[1:] = [(r - off) / r for r in range(1, most + 1)]
    return d


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Documents (``doc_id, held, text``) as blocks of token numbers; every text ends with one end token."""
    docs_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("held", pa.bool_()), ("size", pa.int32())]))
    number, known, idx, docs = 0, defaultdict(count().__next__), [], []

    def row() -> pa.RecordBatch:
        hashes = np.fromiter((END if w is None else word_hash(w) for w in known), np.uint64, len(known))
        words, place = np.unique(hashes, return_inverse=True)
        block = TaskContext.get().partitionId() << 33 | number
        at = place[np.array(idx, np.int64)]
        # The most frequent words have the smallest numbers, which take the least room; words of one frequency stay in order of hash.
        ranks = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        numbers = np.empty_like(ranks)
        numbers[ranks] = np.arange(len(ranks))
        return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([packed(x)]) for x in (words, ranks, numbers[at])), pa.array([docs], docs_type)], ["block", "words", "ranks", "idx", "docs"])

    for batch in batches:
        for key, held, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            parts = (text.as_py() or "").encode().lower().split()
            parts.append(None)
            idx.extend(map(known.__getitem__, parts))
            docs.append({"doc_id": key.as_py(), "held": held.as_py(), "size": len(parts)})
            if len(idx) >= most:
                yield row()
                number, known, idx, docs = number + 1, defaultdict(count().__next__), [], []
    if docs:
        yield row()


def _column(table: pa.Table, name: str) -> np.ndarray:
    """All numbers of a packed column, one row after the other (null: none)."""
    parts = [unpacked(x.as_py()) for x in table.column(name) if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Level:
    """The distinct n-grams of one length in a block, in the order in which they are sent and answered: by bucket, context and word."""

    def __init__(self, grams: np.ndarray, ctx: np.ndarray, word: np.ndarray, spread: np.ndarray, buckets: int):
        own, first, self.inverse = np.unique(grams, return_index=True, return_inverse=True)
        ctx, word, spread = ctx[first], word[first], spread[first]
        hot = spread > 1
        bucket = _mix(ctx, np.where(hot, 1 + _mix(word) % spread.astype(np.uint64), np.uint64(0))) % np.uint64(buckets)
        order = np.lexsort((word, ctx, bucket))
        self.order, self.first, self.ctx, self.word, self.bucket, self.hot = order, first[order], ctx[order], word[order], bucket[order], hot[order]
        changed = np.ones(len(order), bool)
        changed[1:] = (self.bucket[1:] != self.bucket[:-1]) | (self.ctx[1:] != self.ctx[:-1])
        self.run_starts = np.flatnonzero(changed)
        self.run_of = np.cumsum(changed) - 1

    def to_tokens(self, values: np.ndarray) -> np.ndarray:
        """Values of the n-grams as sent, for every token."""
        back = np.empty_like(values)
        back[self.order] = values
        return back[self.inverse]


def _first_asks(model: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks send their words with counts. Words are sorted by hash and buckets are ranges of hashes, so answers come back in the words' order."""
    buckets = model["buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, ranks, idx, docs in zip(*(batch.column(c) for c in ("block", "words", "ranks", "idx", "docs")), strict=True):
                words, idx = unpacked(words.as_py()).view(np.uint64), unpacked(ranks.as_py())[unpacked(idx.as_py())]
                docs = pa.Table.from_struct_array(docs.values)
                learned = np.repeat(~np.asarray(docs["held"].combine_chunks()), np.asarray(docs["size"]))
                own = np.bincount(idx[learned], minlength=len(words))
                bucket = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
                for k in np.flatnonzero(np.diff(cuts)):
                    a, b = cuts[k], cuts[k + 1]
                    yield _ask(int(k), block.as_py(), keys=words[a:b], counts=own[a:b])

    return run


class Block:
    """One block's tokens, and what the levels answered so far say about them."""

    def __init__(self, row: pa.Table, order: int, model: dict):
        idx = unpacked(row.column("idx")[0].as_py())
        self.docs = pa.Table.from_struct_array(row.column("docs")[0].values)
        sizes = np.asarray(self.docs["size"]).astype(np.int64)
        self.number, self.model, self.order = row.column("block")[0].as_py(), model, order
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.learned = ~np.asarray(self.docs["held"].combine_chunks())[doc]
        self.idx, self.words, self.ranks = idx, int(idx.max()) + 1, unpacked(row.column("ranks")[0].as_py())
        # One place before every text, whose n-grams are all the start.
        self.at = np.arange(len(idx)) + doc + 1
        self.size = len(idx) + len(sizes)
        self.counts, self.ids, self.grams, self.chance = [], [], [], []

    def _padded(self, values: np.ndarray, start: int) -> np.ndarray:
        """Values of all tokens, with ``start`` before every text, seen from the token after."""
        out = np.full(self.size, start, np.int64)
        out[self.at] = values
        return out[self.at - 1]

    def level(self, n: int) -> Level:
        """Level n > 1: contexts are the n-grams of the level before that end one token earlier."""
        before = self._padded(self.grams[n - 2], -1) + 1  # their numbers within the block; texts' starts share one
        self._local = before * self.words + self.idx
        seen = self._padded(self.counts[n - 2], self.model["texts"])  # before a text: as often as there are texts
        return Level(self._local, self._padded(self.ids[n - 2], START), self.ids[0], 1 + seen // self.model["spread"], self.model["buckets"])

    def read(self, n: int, told: pa.Table) -> None:
        """Take the answers of level ``n``: counts and probabilities of all tokens."""
        kinds, levels = told.column("kind").to_numpy(), told.column("level").to_numpy()
        answers = told.filter(pa.array((kinds == "count") & (levels == n))).sort_by("bucket")
        seen, ids = _column(answers, "counts"), _column(answers, "ids")
        if n == 1:
            self.counts.append(seen[self.ranks][self.idx])
            self.ids.append(ids[self.ranks][self.idx])
            self.grams.append(self.idx)
            self.chance.append((self.counts[0] + ADDED) / (self.model["tokens"] + ADDED * (self.model["words"] + 1)))
            return
        level = self.level(n)
        self.counts.append(level.to_tokens(seen))
        self.grams.append(level.inverse)
        if n < self.order:
            self.ids.append(level.to_tokens(ids))
        total, types, mass = (_column(answers, c) for c in ("total", "types", "mass"))
        types = types.reshape(-1, DISCOUNTED)
        hot = told.filter(pa.array((kinds == "hot-count") & (levels == n)))
        if len(hot):
            keys = _column(hot, "keys")
            by = np.argsort(keys)
            where = level.hot[level.run_starts]
            place = by[np.searchsorted(keys[by], level.ctx[level.run_starts][where])]
            total[where], mass[where], types[where] = _column(hot, "total")[place], _column(hot, "mass")[place], _column(hot, "types").reshape(-1, DISCOUNTED)[place]
        discount = self.model[f"discount{n}"]
        rest, size = backoff(total, types, discount)
        weight = np.where(total > 0, rest / np.maximum(1 - mass, 1e-15), 1.0)
        run = level.run_of
        kept = np.where(seen <= DISCOUNTED, discount[np.minimum(seen, DISCOUNTED)], 1.0) * seen / np.maximum(size[run], 1)
        self.chance.append(level.to_tokens(np.where(seen > 0, kept, weight[run] * self.chance[-1][level.first])))

    def asks(self, n: int) -> Iterator[pa.RecordBatch]:
        """Rows for the buckets: the distinct n-grams with counts of the texts learned from and their lower-order probability."""
        level = self.level(n)
        own = np.bincount(level.inverse, weights=self.learned, minlength=len(level.order)).astype(np.int64)[level.order]
        lower = self.chance[n - 2][level.first]
        ends = np.append(level.run_starts, len(own))
        runs = np.diff(ends) * np.where(level.hot[level.run_starts], -1, 1)
        ctx = level.ctx[level.run_starts]
        cuts = np.flatnonzero(np.append(True, level.bucket[1:] != level.bucket[:-1]))
        for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True):
            x, y = np.searchsorted(level.run_starts, [a, b])
            yield _ask(int(level.bucket[a]), self.number, ctx=ctx[x:y], runs=runs[x:y], keys=level.word[a:b], counts=own[a:b], lower=lower[a:b])
        hot = np.unique(ctx[runs < 0])
        home = _mix(hot) % np.uint64(self.model["buckets"])
        for bucket in np.unique(home):
            yield _ask(int(bucket), self.number, keys=hot[home == bucket])


def _ask(bucket: int, block: int, **lists: np.ndarray) -> pa.RecordBatch:
    names = ("ctx", "runs", "keys", "counts", "lower")
    arrays = [pa.array([packed(lists[c]) if c in lists else None], pa.binary()) for c in names]
    return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([block]), *arrays], ["bucket", "block", *names])


def backoff(total: np.ndarray, types: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability that contexts leave to unseen words, and the size by which their counts are divided.

    ``types``: of how many next words a context has seen each count up to DISCOUNTED. A context that
    discounts nothing counts one more, which goes to the unseen words.
    """
    off = types @ ((1 - discount[1:]) * np.arange(1, DISCOUNTED + 1))
    size = np.where(off > 0, total, total + 1)
    return np.where(off > 0, off, 1.0) / np.maximum(size, 1), size


def _tell(kind: str, bucket: int, block: int | None, **lists: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([packed(lists[c]) if c in lists else None], pa.binary()) for c in _LISTS]
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([bucket], pa.int64()), pa.array([block], pa.int64()), *arrays], ["kind", "bucket", "block", *_LISTS])


def _rows(rows: pa.Table) -> Iterator[tuple]:
    """Bucket's rows as (block, ctx, runs, keys, counts, lower), unpacked one by one."""
    for block, *lists in zip(*(rows.column(c) for c in ("block", "ctx", "runs", "keys", "counts", "lower")), strict=True):
        yield block.as_py(), *(unpacked(x.as_py()) if x.is_valid else None for x in lists)


def _having(total: np.ndarray) -> np.ndarray:
    return np.array([int(total.sum()), int((total > 0).sum()), *(int((total == r).sum()) for r in range(1, DISCOUNTED + 2))])


def _count_words(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """One bucket of words: add up their counts over all blocks, number them, and answer each block."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        asked = [(block, keys.view(np.uint64), counts) for block, _, _, keys, counts, _ in _rows(rows)]
        own, at = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([c for _, _, c in asked]), minlength=len(own)).astype(np.int64)
        out, a = [_tell("sums", bucket, None, counts=_having(total)), _tell("table", bucket, None, keys=own, counts=total)], 0
        for block, keys, _ in asked:
            mine = at[a : a + len(keys)]
            out.append(_tell("count", bucket, block, counts=total[mine], ids=mine * buckets + bucket))
            a += len(keys)
        return pa.Table.from_batches(out)

    return run


def _count(buckets: int, number: bool) -> Callable[[pa.Table], pa.Table]:
    """One bucket of longer n-grams: add them up over all blocks, and answer each block with counts and its contexts' sums."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, out, asked = rows.column("bucket")[0].as_py(), [], []
        for block, ctx, runs, keys, counts, lower in _rows(rows):
            if ctx is None:
                out.append(_tell("ask", bucket, block, keys=keys))
            else:
                asked.append((block, ctx, runs, keys, counts, lower))
        if not asked:
            return pa.Table.from_batches(out)
        joined = lambda k: np.concatenate([x[k] for x in asked])
        runs = joined(2)
        known, run = np.unique(joined(1), return_inverse=True)
        own, first, at = np.unique(np.repeat(run, np.abs(runs)) << 40 | joined(3), return_index=True, return_inverse=True)
        of, total, lower = own >> 40, np.bincount(at, weights=joined(4), minlength=len(own)).astype(np.int64), joined(5)[first]
        seen = total > 0
        size = np.bincount(of, weights=total, minlength=len(known)).astype(np.int64)
        types = np.stack([np.bincount(of[total == r], minlength=len(known)) for r in range(1, DISCOUNTED + 1)], axis=1)
        mass = np.bincount(of[seen], weights=lower[seen], minlength=len(known))
        out.append(_tell("sums", bucket, None, counts=_having(total)))
        out.append(_tell("table", bucket, None, keys=known[of[seen]], ids=own[seen] & START, counts=total[seen]))
        a = x = 0
        for block, ctx, _, keys, _, _ in asked:
            r, mine = run[x : x + len(ctx)], at[a : a + len(keys)]
            ids = {"ids": mine * buckets + bucket} if number else {}
            out.append(_tell("count", bucket, block, counts=total[mine], total=size[r], types=types[r].ravel(), mass=mass[r], **ids))
            a, x = a + len(keys), x + len(ctx)
        for k in np.unique(run[runs < 0]):  # this bucket's part of contexts that are dealt over several
            home = int((_mix(known[k : k + 1]) % np.uint64(buckets))[0])
            out.append(_tell("hot", home, None, keys=known[k : k + 1], total=size[k : k + 1], types=types[k], mass=mass[k : k + 1]))
        return pa.Table.from_batches(out)

    return run


def _hot(rows: pa.Table) -> pa.Table:
    """Add up the parts of contexts that were dealt over several buckets, and answer the blocks that asked."""
    kinds = rows.column("kind").to_numpy()
    parts, asked = rows.filter(pa.array(kinds == "hot")), rows.filter(pa.array(kinds == "ask"))
    known, at = np.unique(_column(parts, "keys"), return_inverse=True)
    total = np.bincount(at, weights=_column(parts, "total"), minlength=len(known)).astype(np.int64)
    mass = np.bincount(at, weights=_column(parts, "mass"), minlength=len(known))
    each = _column(parts, "types").reshape(-1, DISCOUNTED)
    types = np.stack([np.bincount(at, weights=each[:, r], minlength=len(known)) for r in range(DISCOUNTED)], axis=1).astype(np.int64)
    out = []
    for block, bucket, keys in zip(asked.column("block"), asked.column("bucket"), asked.column("keys"), strict=True):
        keys = unpacked(keys.as_py())
        x = np.searchsorted(known, keys)
        out.append(_tell("hot-count", bucket.as_py(), block.as_py(), keys=keys, total=total[x], types=types[x].ravel(), mass=mass[x]))
    return pa.Table.from_batches(out) if out else _tell("none", 0, None).schema.empty_table()


def _scores(block: Block, order: int) -> Iterator[pa.RecordBatch]:
    def sums(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, block.starts[:-1])  # every text has its end token

    base, score, known = sums(np.log10(block.chance[0])), sums(np.log10(block.chance[order - 1])), sums((block.counts[0] > 0).astype(np.int64))
    docs, n = block.docs, len(block.docs)
    columns = [docs["doc_id"], docs["held"], np.diff(block.starts), known, np.full(n, block.model["tokens"]), base, score]
    yield from pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).to_batches()


def _summed(rows: DataFrame) -> list[int]:
    """Element-wise sums of the buckets' counts: tokens, n-grams seen, and how many were seen once, twice and so on."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(range(DISCOUNTED + 3), pa.int32()), pa.array(unpacked(x.as_py()), pa.int64())], ["k", "n"])

    found = {r["k"]: r["n"] for r in rows.select("counts").mapInArrow(spread, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return [found.get(k, 0) for k in range(DISCOUNTED + 3)]


def _read(row: pa.Table, answers: pa.Table, order: int, model: dict, upto: int) -> Block:
    block = Block(row, order, model)
    for n in range(1, upto + 1):
        block.read(n, answers)
    return block


def _next_asks(order: int, model: dict, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    model = dict(model)
    return lambda row, answers: pa.Table.from_batches(_read(row, answers, order, model, n - 1).asks(n))


def _last(order: int, model: dict) -> Callable[[pa.Table, pa.Table], pa.Table]:
    model = dict(model)
    return lambda row, answers: pa.Table.from_batches(_scores(_read(row, answers, order, model, order), order))


def katz_scores(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, spread: int = SPREAD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Counts come from all rows that are not held out, scores are log10 probabilities of whole texts with
    their end. ``order`` is the length of the longest n-gram.

    Defined cases: a null text is an empty one, which is its end token; a null id is learned from and not
    held out; repeated rows count each; words that were not learned share the unknown word's probability;
    where nothing was learned every word has the probability of the unknown one; a very long text is one
    block of its own; an empty table gives an empty result; other columns are ignored, so their names can't
    clash.
    """
    tables = WorkTables(docs.sparkSession)
    held = F.coalesce(fold(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    blocks = tables.save(source.mapInArrow(lambda b: _blocks(b, block_tokens), _BLOCK), "blocks", codec="uncompressed")
    size = blocks.select(F.explode("docs").alias("d")).agg(F.sum("d.size").alias("tokens"), F.count_if(~F.col("d.held")).alias("texts")).first()
    model = {"buckets": max(1, -(-(size["tokens"] or 0) // bucket_tokens)), "texts": size["texts"], "spread": spread, "tokens": 0, "words": 0}
    told = None

    buckets, numbers = model["buckets"], blocks.drop("words")

    for n in range(1, order + 1):
        if told is None:
            asked = blocks.mapInArrow(_first_asks(model), _ASK)
            counted = asked.groupBy("bucket").applyInArrow(_count_words(buckets), _TELL)
        else:
            asked = numbers.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_next_asks(order, model, n), _ASK)
            counted = asked.groupBy("bucket").applyInArrow(_count(buckets, n < order), _TELL)
        # The kinds are folders of their own, so that each reader opens only its part of the level.
        counted = tables.save(counted, f"level-{n}", partition_by=("kind",), codec="uncompressed")
        sums = _summed(counted.where("kind = 'sums'"))
        if n == 1:
            model |= {"tokens": sums[0], "words": sums[1]}
        model[f"discount{n}"] = good_turing(sums[2:])
        answers = counted.where("kind = 'count'")
        if n > 1:
            parts = counted.where("kind IN ('hot', 'ask')")
            answers = answers.unionByName(tables.save(parts.groupBy("bucket").applyInArrow(_hot, _TELL), f"hot-{n}").where("kind = 'hot-count'"))
        answers = answers.withColumn("level", F.lit(n))
        told = answers if told is None else told.unionByName(answers)

    return numbers.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_last(order, model), _SCORES)
