"""Token alignment against a plain two-pointer walk and plain counting, with the defined edge cases."""

import hashlib
import random
from collections import Counter

import pytest

from breakweave.llm import token_align

FOLDER = "/opt/tokenizers"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, keys string, docs int"
TEXTS = ["", None, " ", "a  b\t\nc", "the cat sat on the mat", "the cat sat on the mat", "</s> <s><|endoftext|> end", "▁x", "été 😀　日本語のテキスト", "x" * 3000, "word naïve " * 5000, "1234567890 3.14159 --- !!!"]


def plain(texts):
    """Expected rows, by two pointers over byte ends."""
    from tokenizers import Tokenizer

    pair = token_align._pair(FOLDER)
    first = Tokenizer.from_file(f"{FOLDER}/{token_align.FIRST}")
    first.encode_special_tokens = True
    rows, counts = [], Counter()
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.second.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(pair.bytes_a[x] for x in a) != whole or b"".join(pair.bytes_b[x] for x in b) != whole:
            a, b = [], []
        ends = []
        for ids, of in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, own = 0, []
            for x in ids:
                at += len(of[x])
                own.append(at)
            ends.append(own)
        groups, links, left_a, left_b = [], [], [], []
        common = set(ends[0]) & set(ends[1])
        cut_a = [(e, x) for e, x in zip(ends[0], a, strict=True)]
        cut_b = [(e, x) for e, x in zip(ends[1], b, strict=True)]
        j = 0
        for e, x in cut_a:
            left_a.append(x)
            if e in common:
                while True:
                    f, y = cut_b[j]
                    j += 1
                    left_b.append(y)
                    if f == e:
                        break
                groups.append(",".join(map(str, left_a)) + "|" + ",".join(map(str, left_b)))
                links.append((x, y))
                left_a, left_b = [], []
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(na, nb, ng, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha) for na, nb, ng, links, sha in rows]


def found(frame):
    return {r["doc_id"]: tuple(r)[1:] for r in frame.collect()}


def test_edges(spark, monkeypatch):
    rows = [(k, t, None, "s", 1, 7, "x", 3) for k, t in enumerate(TEXTS)]
    want = dict(enumerate(plain(TEXTS)))
    assert found(token_align.cross_alignment(spark.createDataFrame(rows, DOC).repartition(3))) == want
    none = spark.createDataFrame([], DOC)
    assert token_align.cross_alignment(none).count() == 0 and token_align.align_documents(none).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(None, "the cat", None, "s", 1, 7, "x", 3)] * 2 + [(1, "the cat", None, "s", 1, 7, "x", 3)] * 3
    got = sorted(tuple(r)[1:] for r in token_align.cross_alignment(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted(plain(["the cat"] * 5))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found(token_align.cross_alignment(docs)) == dict(zip(texts, plain(list(texts.values())), strict=True))


def test_groups_are_given(spark):
    row = token_align.align_documents(spark.createDataFrame([(1, "the naïve cat")], "doc_id bigint, text string")).first()
    assert row["last_a"][-1] == len(row["a"]) - 1 and row["last_b"][-1] == len(row["b"]) - 1 and len(row["last_a"]) == len(row["last_b"])


@pytest.mark.parametrize("seed", range(20))
def test_diagonal_walk(seed):
    rng = random.Random(seed)
    ends = [sorted(rng.sample(range(1, 400), rng.randint(1, 300))) + [400] for _ in range(2)]
    if seed % 2:  # long one-to-one stretches
        ends[1] = [e for e in ends[0] if e == 400 or rng.random() < 0.97]
    got = []
    for i, j, m, n in token_align.common_ends(*ends):
        got += [ends[0][i + m - 1]] if n else ends[0][i : i + m]
        assert not n or ends[0][i + m - 1] == ends[1][j + n - 1]
        assert n or ends[0][i : i + m] == ends[1][j : j + m]
    assert got == sorted(set(ends[0]) & set(ends[1]))
