"""Katz backoff against plain dictionaries, with the defined edge cases and exact normalisation."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from breakweave.llm import katz

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, words string, held int"


def model_of(texts, order):
    """Counts of n-grams with their contexts, from lists of words."""
    grams = [Counter() for _ in range(order + 1)]
    for words in texts:
        run = ["<"] * (order - 1) + words
        for k in range(order - 1, len(run)):
            for n in range(1, order + 1):
                grams[n][tuple(run[k - n + 1 : k + 1])] += 1
    return grams


class Plain:
    def __init__(self, texts, order):
        self.order, self.grams = order, model_of(texts, order)
        self.total, self.size = sum(self.grams[1].values()), len(self.grams[1])
        self.discount = {n: katz.good_turing([sum(c == r for c in self.grams[n].values()) for r in range(1, 7)]) for n in range(2, order + 1)}
        self.after = [{} for _ in range(order + 1)]
        for n in range(2, order + 1):
            for g, c in self.grams[n].items():
                self.after[n].setdefault(g[:-1], {})[g[-1]] = c

    def chance(self, word, context):
        if not context:
            return (self.grams[1][(word,)] + 0.1) / (self.total + 0.1 * (self.size + 1))
        n = len(context) + 1
        seen = self.after[n].get(context)
        if not seen:
            return self.chance(word, context[1:])
        d = self.discount[n]
        off = sum((1 - d[c]) * c for c in seen.values() if c <= 5)
        size = sum(seen.values()) + (off == 0)
        if word in seen:
            c = seen[word]
            return (d[c] if c <= 5 else 1) * c / size
        rest = (off or 1) / size / (1 - sum(self.chance(w, context[1:]) for w in seen))
        return rest * self.chance(word, context[1:])

    def score(self, words, order):
        run = ["<"] * (order - 1) + words
        return sum(math.log10(self.chance(run[k], tuple(run[k - order + 1 : k]))) for k in range(order - 1, len(run)))


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in lower.replace("\n", " ").replace("\t", " ").split(" ") if w] + ["\n"]


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 10 == 0


def expected(rows, order):
    learned = [words(t) for k, t in rows if not held(k)]
    plain, base = Plain(learned, order), Plain(learned, 1)
    out = []
    for k, t in rows:
        w = words(t)
        out.append((k, held(k), len(w), sum(plain.grams[1][(x,)] > 0 for x in w), plain.total, base.score(w, 1), plain.score(w, order)))
    return out


def same(frame, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in frame.collect()), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, order):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # Small blocks and buckets, so that contexts are dealt over several of them.
    same(katz.katz_scores(docs.repartition(3), order, block_tokens=500, bucket_tokens=700, spread=20), expected(rows, order))


def test_edges(spark):
    texts = [None, "", " \t\n ", "A b a B a b", "a b", "a b", "x" * 2000, "été 😀 été", "word " * 5000, "a c a d a e a f"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b z"), (3, "A b a B a b")]
    frame = spark.createDataFrame([(k, t, None, "s", 1, 7, "x", 3) for k, t in rows], DOC)
    for order in (2, 3):
        same(katz.katz_scores(frame, order), expected(rows, order))
    assert katz.katz_scores(spark.createDataFrame([], DOC)).count() == 0
    only_held = [k for k in range(200) if held(k)][:3]
    same(katz.katz_scores(spark.createDataFrame([(k, "a b") for k in only_held], "doc_id bigint, text string")), expected([(k, "a b") for k in only_held], 2))


def test_sums_to_one():
    texts = [words(t) for t in ("a b a c a b", "b a b b c", "c c c c c c c c c", "d a", "a b c d", "a b a b a b a b a b a b")]
    plain = Plain(texts, 3)
    unknown = 0.1 / (plain.total + 0.1 * (plain.size + 1))
    for n in (2, 3):
        for context in plain.after[n]:
            whole = sum(plain.chance(w, context) for (w,) in plain.grams[1]) + plain.chance("never", context)
            assert math.isclose(whole, 1, rel_tol=1e-9), (context, whole, unknown)


def test_discounts():
    d = katz.good_turing([100, 40, 20, 12, 8, 5])
    assert d[0] == 1 and all(0 < x < 1 for x in d[1:])
    assert list(katz.good_turing([0, 3, 1, 0, 0, 0])) == [1] * 6
    assert all(0 < x < 1 for x in katz.good_turing([3, 0, 0, 9, 0, 0])[1:])


@pytest.mark.parametrize("x", [[], [5], [5, 5, 5], [3, 1, 2], [0, 1, 1 << 62], [-7, 3, -9], [1.5, -2.25, 1.5], [True, False]])
def test_packed_round_trip(x):
    x = np.array(x, dtype=None if x else np.int64)
    assert katz.unpacked(katz.packed(x)).tolist() == x.tolist()
    big = np.array([1 << 63, (1 << 64) - 1, 7], np.uint64)
    for y in (big, np.sort(big)):
        assert katz.unpacked(katz.packed(y)).view(np.uint64).tolist() == y.tolist()
