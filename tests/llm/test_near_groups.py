"""The near-duplicate stage on one large group of near copies, most of which are too far apart from each other."""

import random

from breakweave.llm import simhash


def near_copies(n, seed):
    """Texts of 150 words, of which 0 to 7 are changed: those with 4 or more are similar to hardly any other."""
    rng, texts = random.Random(seed), []
    for k in range(n):
        words = [f"w{i}" for i in range(150)]
        for at in rng.sample(range(150), k % 8):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    return texts


def brute_force(texts):
    """The smallest number of every component of similar texts."""
    sets, root = [set(simhash.shingle_set(t).tolist()) for t in texts], list(range(len(texts)))
    for v in range(len(texts)):
        for u in range(v):
            if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]):
                a, b = root[u], root[v]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root)


def test_pairs_of_a_group_that_cannot_be_similar_are_not_joined(spark, monkeypatch):
    n, texts = 120, near_copies(120, 5)
    joined, save = [], simhash.WorkTables.save

    def watched(self, frame, name, *rest, **more):
        saved = save(self, frame, name, *rest, **more)
        if name == "pairs":
            joined.append(saved.count())
        return saved

    monkeypatch.setattr(simhash.WorkTables, "save", watched)
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert kept == brute_force(texts)
    assert sum(joined) < 10 * n  # 2,000 pairs and more meet


def test_classes_too_large_for_an_array(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TEXTS_AT_ONCE", 1)
    texts = near_copies(60, 6)
    got = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == brute_force(texts)


def test_bitmaps_refuse_no_similar_pair(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(7), []
    for k in range(400):
        size = rng.choice([1, 3, 40, 150, 900])
        words = [rng.random() for _ in range(size)]
        other = [w if rng.random() > rng.choice([0, 0.01, 0.05]) else rng.random() for w in words]
        rows.append((k, " ".join(map(str, words)), " ".join(map(str, other))))
    pairs = spark.createDataFrame(rows, "doc_id bigint, x string, y string")
    sides = []
    for c in "xy":
        nodes = pairs.select("doc_id", F.lit(0).cast("bigint").alias("mark"), c).mapInArrow(lambda b: simhash._nodes(b, 5, 20), "id bigint, mark bigint, node bigint, prints array<bigint>, bits array<bigint>, size int")
        sides.append(nodes.select("id", F.col("bits").alias(f"bits_{c}"), F.col("size").alias(f"size_{c}")))
    able = {r.id for r in sides[0].join(sides[1], "id").where(simhash._able(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"), 0.8)).select("id").collect()}
    similar = set()
    for k, x, y in rows:
        a, b = (set(simhash.shingle_set(t).tolist()) for t in (x, y))
        if len(a & b) >= 0.8 * len(a | b):
            similar.add(k)
    assert similar and similar <= able and len(able) < len(rows)
