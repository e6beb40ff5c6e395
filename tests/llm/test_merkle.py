"""The Merkle manifest against plain recursion, with the defined edge cases, requests for some leaves, and tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from breakweave.llm import merkle
from breakweave.llm.shared import WorkTables

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, rank int, digest string, path string, held string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Levels of a tree, from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows):
    """Expected results of (doc_id, text, lang, source, n_chars) rows."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r, leaf(r[0], r[3], r[2], r[4], r[1])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = climb([x[1] for x in by[s]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for n, (r, own) in enumerate(by[s]):
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node, proof = leaf(r[0], s, r[2], r[4], text), ""
            for levels, at in ((trees[s], n), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    here = at % 3
                    proof += "".join(run[:here] + run[here + 1 :])
                    node = sha(*run[:here], node, *run[here + 1 :])
                    at //= 3
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in rows], DOC)


def found(docs):
    return sorted((tuple(r) for r in merkle.manifest_proofs(docs, merkle.without_breaks()).collect()), key=str)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, rng.choice(["a\nb", "", None, "été 😀", "line\n"]), rng.choice(["en", None]), source, rng.choice([1, None])))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"s": 1}, {None: 1, "": 2}, {"a": 10, None: 3, "é": 4, "b": 1, "Z": 28}, {f"s{k}": 1 + k % 3 for k in range(11)}])
def test_against_recursion(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS_AT_ONCE", 2)  # several blocks and rounds on few rows
    rows = rows_of(sizes)
    assert found(frame(spark, rows).repartition(3)) == plain(rows)


def test_edges(spark):
    long = "word " * 50_000
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "other", "en", "s", 5), (None, "a\nb", "en", "s", 3), (2, long, "en", "s", 1)]
    assert found(frame(spark, rows)) == plain(rows)
    assert merkle.manifest_proofs(frame(spark, [])).count() == 0
    same = [(5, "copy\n", "en", "s", 5)] * 40  # one digest in every place
    assert found(frame(spark, same)) == plain(same)


def test_requests_walk_alone(spark):
    rows = rows_of({"a": 30, "b": 7})
    docs = frame(spark, rows).select("doc_id", "source", merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    manifest = merkle.build_manifest(docs, WorkTables(spark))
    asked = manifest.leaves.where("doc_id % 9 = 0").select("tree", "rank", "leaf")
    proofs = merkle.prove(manifest, asked).withColumn("root", merkle._fold(F.col("path"), F.col("found"))).collect()
    assert len(proofs) == asked.count() > 0
    assert all(r["found"] == r["leaf"] and r["root"] == manifest.root for r in proofs)
