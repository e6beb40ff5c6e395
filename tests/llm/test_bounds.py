"""Memory that ties can take in the search, and what a mixture says about targets out of reach."""

import tracemalloc

import numpy as np

from breakweave.llm import ann, mixing


def test_ties_in_bounded_memory():
    rng = np.random.default_rng(1)
    line = rng.normal(size=64)
    vectors = rng.uniform(0.5, 2, 4096)[:, None] * line
    asked = rng.uniform(0.5, 2, 2048)[:, None] * line
    tracemalloc.start()
    i, j, score = ann.best_of(asked, vectors, np.arange(4096)[::-1].copy(), 6)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6 and len(i) == 6 * 2048 and np.allclose(score, 1)
    # Equal to one exact pass over some of the queries.
    for q in (0, 1000, 2047):
        exact = ann.cosine(np.repeat(asked[q : q + 1], 4096, axis=0), vectors)
        best = np.lexsort((np.arange(4096)[::-1], -exact))[:6]
        assert j[i == q].tolist() == best.tolist()


def test_empty_search():
    assert [len(x) for x in ann.best_of(np.zeros((0, 3)), np.ones((2, 3)), np.arange(2), 5)] == [0, 0, 0]


def test_mixture_says_what_is_out_of_reach(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = mixing.mixing_rates(docs, labels, max_rate=float("inf")).toPandas()
    one = rows.iloc[0]
    apart = [abs(one[f"fitted_{d}"] - one[f"wanted_{d}"]) / one[f"wanted_{d}"] for d in mixing.TARGETS]
    assert bool(one["met"]) == (max(apart) <= mixing.TOLERANCE)
    for d, share in mixing.TARGETS.items():
        assert np.isclose(one[f"least_{d}"], rows.loc[rows["tokens"] > 0, f"p_{d}"].min())
        if not one["met"] and one[f"least_{d}"] > share:
            assert one[f"fitted_{d}"] > one[f"wanted_{d}"]


def test_clashing_columns(spark):
    """Columns named like the operators' own ones change nothing."""
    from breakweave.llm import exact_dedup, packing, pii, simhash

    rows = [(1, "a b c", "x"), (2, "a b c", "x"), (3, "d e", "x")]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    own = ("fp", "norm", "keys", "rid", "key", "node", "prints", "mark", "shard", "bin", "length", "found", "kinds", "kept", "row", "id")
    clash = spark.createDataFrame([(*r[:2], *["x"] * len(own)) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in own))
    for run in (simhash.near_duplicates, exact_dedup.exact_dedup, packing.pack_documents, lambda d: pii.pseudonymise_documents(d, b"k")):
        assert sorted(map(str, run(plain).collect())) == sorted(map(str, run(clash).collect()))
