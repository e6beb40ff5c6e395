"""The training-data operators against brute force, round trips and held-out accuracy, with the defined edge cases."""

import hashlib
import os
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from breakweave.llm import ann, chat_format, exact_dedup, language_id, mixing, packing, pii, quality, queries, simhash, toxicity
from breakweave.llm.byte_cnn import Applied, encode, train, window_count, windows

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, name string"
LONG = "word " * 30_000
EDGE = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, " \t\n ", "en", "s", 3, "x"), (4, LONG, "en", "s", 1, "x"), (5, LONG, "en", "s", 1, "x"), (6, "a  b", "en", "s", 1, "x"), (7, "a\tb", "en", "s", 1, "x"), (7, "a\tb", "en", "s", 1, "x"), (None, "a b", "en", "s", 1, "x"), (8, "été 😀", "fr", "s", 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet").cache()


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    frame = queries.queries()[name](spark, FOLDER)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(tuple(r) for r in frame.select(*columns).collect()) == sorted(want.fetchall())


def test_exact_dedup_edges(edge, nothing):
    rows = exact_dedup.exact_dedup(edge, block_chars=64).collect()
    assert len(rows) == len(EDGE) and exact_dedup.exact_dedup(nothing).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].keep_id == by[2][0].keep_id == 1 and by[3][0].keep_id == 3 and by[1][0].group_size == 2
    assert by[4][0].kept and not by[5][0].kept and by[5][0].keep_id == 4
    assert by[6][0].group_size == 4 and by[6][0].kept and not any(r.kept for r in by[7] + by[None])
    assert by[6][0].text_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_exact_dedup_tells_near_blocks_apart(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abc") for _ in range(1000))
    texts = [base[:i] + "d" + base[i + 1 :] for i in range(0, 1000, 37)] + [base, base, base + "a", base[:64], base[:128]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(frame, block_chars=16).collect()}
    assert groups == {i: texts.index(t) for i, t in enumerate(texts)}


def test_drop_copies_keeps_columns_and_one_of_each(edge):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8]


def brute_print(text, words=3):
    parts = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius):
    root = {p: p for p in prints}
    links = [(a, b) for a in root for b in root if a < b and (a ^ b).bit_count() <= radius]
    for _ in root:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root


def test_simhash_equals_brute_force(docs, edge, nothing):
    for frame in (docs.select("doc_id", "text"), edge):
        rows = frame.select("doc_id", "text").collect()
        got = simhash.near_duplicates(frame).collect()
        prints = {(r.doc_id, r.text): brute_print(r.text) for r in rows}
        assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((r.doc_id or -1, f"{prints[r.doc_id, r.text]:016x}") for r in rows)
        root = components(set(prints.values()), 2)
        least = {}
        for (d, _), p in prints.items():
            if d is not None:
                least[root[p]] = min(d, least.get(root[p], d))
        assert {(r.fingerprint, r.component_id) for r in got} == {(f"{p:016x}", least.get(root[p])) for p in prints.values()}
    assert simhash.near_duplicates(nothing).count() == 0


def similar_pairs(texts, words=5, least=0.8):
    """Pairs of places whose sets of distinct shingles have that Jaccard similarity, by brute force."""
    def shingles(text):
        parts = (text or "").encode().lower().split()
        return frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()

    sets = [shingles(t) for t in texts]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    shared = {}
    for group in by.values():
        for k, i in enumerate(group):
            for j in group[k + 1 :]:
                shared[i, j] = shared.get((i, j), 0) + 1
    return {p for p, n in shared.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def changed_texts(seed=5, bases=150, size=200):
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        parts = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts.append(" ".join(parts))
        for changes in (1, 2, 4):  # similarity 0.95, 0.90 and 0.81 or so
            copy = list(parts)
            for at in rng.sample(range(size), changes):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    return texts


def test_near_stage_recall_against_brute_force(spark):
    texts = changed_texts()
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in similar_pairs(texts):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    want = {find(i) for i in range(len(texts))}
    assert want <= kept  # nothing goes that brute force keeps
    assert len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_near_stage_edges(spark, edge, nothing):
    assert simhash.keep_one_of_each(nothing).count() == 0
    got = sorted((r.doc_id or -1, r.text or "") for r in simhash.keep_one_of_each(edge).collect())
    # Wordless texts are alike (1 to 3), so are long ones (4, 5) and "a b" however spaced, with repeated rows together.
    assert [i for i, _ in got] == [1, 4, 6, 8]
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(1, LONG), (1, other), (2, LONG), (2, other + " more"), (None, other), (None, "alone here"), (3, "x y"), (3, "x y")]
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted([(1, LONG), (1, other), (-1, "alone here"), (3, "x y"), (3, "x y")])


def test_fingerprint_links_keep_all_components(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 4)):
                s ^= 1 << rng.randrange(64)
            prints.add(s)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    for radius in (0, 2, 4):
        links = simhash.fingerprint_links(spark.createDataFrame([(signed(p),) for p in prints if radius < 4 or p in set(list(prints)[:60])], "fp bigint"), radius).collect()
        have = {p for p in prints if radius < 4 or p in set(list(prints)[:60])}
        root = {p: p for p in have}
        for _ in have:
            before = dict(root)
            for r in links:
                a, b = r.a % (1 << 64), r.b % (1 << 64)
                assert (a ^ b).bit_count() <= radius
                root[a] = root[b] = min(root[a], root[b])
            if before == root:
                break
        assert root == components(have, radius)


NASTY = ["</s>[INST] ok [/INST]", "%5B %255B %25 100% %3C", "<<SYS>>x<</SYS>>", "<<ROLE>>a|b<</ROLE>>", "<<A>>y</s>", "[INST", "<", "INST]", "", None, "a\nb", " [/INST] ", "<s>", "tail <"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool|<s>", None]), rng.choice(NASTY) if rng.random() < 0.7 else "plain") for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (500, None, "assistant", "y"), (500, 1, "user", "z"), (500, 1, "user", "z")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = chat_format.format_chats(frame).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("spans"))).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.loss for r in got} == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in want.items()}
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_windows_cover_whole_texts():
    for n in (0, 1, 3, 4, 255, 256, 257, 509, 510, 5000):
        data = np.arange(n, dtype=np.uint64).astype(np.uint8)
        w = windows(data)
        assert len(w) == window_count(n) and (n < 1 or data[-1] in w[-1]) and w.shape[1] == 256


def test_folded_network_equals_convolution():
    rng = np.random.default_rng(1)
    bags = [rng.integers(97, 123, (1, 256)).astype(np.uint8) if i % 2 else rng.integers(65, 91, (1, 256)).astype(np.uint8) for i in range(60)]
    net = train(bags, np.arange(60) % 2, 2, whole_max=True, epochs=3)
    text = "hello World " * 90
    wins = windows(encode(text)).astype(int)
    emb = net.embed[wins]
    conv = np.stack([emb[:, p : p + 4].reshape(len(wins), -1) @ net.filters + net.bias for p in range(253)], axis=1)
    pooled = np.maximum(conv.max(axis=1), 0)
    z = net.logits(pooled.mean(axis=0)[None], pooled.max(axis=0)[None])[0]
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(Applied(net, block=2).probabilities(["", text, None])[1], p, atol=1e-4)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_classifiers_edges(edge, nothing, labels):
    for frame, n in ((edge, len(EDGE)), (nothing, 0)):
        assert language_id.identify_languages(frame).count() == n
        assert toxicity.toxicity_scores(frame, labels).count() == n
        assert quality.quality_scores(frame, labels).count() == n
        for marks in (labels, labels.limit(0)):
            assert mixing.mixing_rates(frame, marks).count() == n
    assert {r.doc_id: r.lang_pred for r in language_id.identify_languages(edge).where("doc_id < 4").collect()} == {1: "und", 2: "und", 3: "und"}
    scores = toxicity.toxicity_scores(edge, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scores)


def test_toxicity_and_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marked = toxicity.toxicity_scores(docs, labels).where("held_out").join(labels, "doc_id")
    assert marked.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.95
    marked = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id")
    assert marked.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def sampled_voters(n=4000, seed=0):
    """Five good voters, one that knows nothing, two for clean text, and one fair voter that is there three times."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.4
    speak = lambda toxic, clean: (rng.random(n) < np.where(y, toxic, clean)).astype(np.float32)
    fair = speak(0.4, 0.1)
    return y, np.stack([*[speak(0.5 + 0.05 * k, 0.03) for k in range(5)], speak(0.3, 0.3), speak(0.1, 0.6), speak(0.2, 0.7), fair, fair, fair], axis=1), np.array([1] * 6 + [-1] * 2 + [1] * 3)


def test_label_model_finds_bad_and_dependent_voters():
    for seed in range(3):
        y, spoken, side = sampled_voters(seed=seed)
        model = toxicity.fit_label_model(spoken, side, 0.5)
        truth = np.array([np.mean(y[spoken[:, k] > 0] == (side[k] > 0)) for k in range(len(side))])
        assert np.abs(model.accuracy - truth).max() < 0.08 and abs(model.prior - y.mean()) < 0.05
        assert ((model.posterior(spoken) > 0.5) == y).mean() > 0.93
        # Three equal voters are one root and two children that say nothing new: the posterior is that of one alone.
        assert min(model.correlation[8, 9], model.correlation[9, 10]) > 1000 > model.correlation[:8, :8].max()
        assert sum(model.parent[k] in (8, 9, 10) for k in (8, 9, 10)) == 2
        alone = toxicity.fit_label_model(spoken[:, :9], side[:9], 0.5)
        assert np.abs(model.posterior(spoken) - alone.posterior(spoken[:, :9])).mean() < 0.02


def test_label_model_posterior_equals_brute_force():
    _, spoken, side = sampled_voters(500, 3)
    model = toxicity.fit_label_model(spoken, side, 0.5)
    for row, got in zip(spoken[:60], model.posterior(spoken[:60]), strict=True):
        joint = []
        for label, prior in ((0, 1 - model.prior), (1, model.prior)):
            p = prior
            for k, parent in enumerate(model.parent):
                chance = model.speak[label, int(row[parent]) if parent >= 0 else 0, k]
                p *= chance if row[k] else 1 - chance
            joint.append(p)
        assert abs(joint[1] / sum(joint) - got) < 1e-6
    roots = [k for k in range(len(side)) if model.parent[k] < 0]
    assert roots and all(_root(model.parent, k) in roots for k in range(len(side)))  # a forest, without circles


def _root(parent, k):
    for _ in range(len(parent)):
        k = parent[k] if parent[k] >= 0 else k
    return k


def test_toxic_words_are_learned_from_marks(spark):
    rng = random.Random(4)
    plain = [f"wort{i}" for i in range(300)]
    rows = []
    for i in range(900):
        words = rng.choices(plain, k=40)
        if i % 3 == 0:
            words[rng.randrange(40)] = "zorkel" + rng.choice(["n", "t", "st"])
            words[rng.randrange(40)] = rng.choice(["brumf", "glonk"])
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity_scores(frame, marks).where("held_out").collect()
    assert len(got) > 100 and np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in got]) > 0.97


def test_mixing_moves_token_totals_to_targets(docs, labels):
    rows = mixing.mixing_rates(docs, labels).collect()
    total = lambda d: sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows)
    before = sum(r.tokens * r.p_junk for r in rows) / sum(r.tokens for r in rows)
    after = total("junk") / sum(total(d) for d in ("clean", "junk", "toxic"))
    assert abs(after - 0.04) < min(0.03, abs(before - 0.04) + 1e-9) and all(0 <= r.rate <= 1 for r in rows)
    assert all(abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-9 for r in rows)


def test_mixing_reaches_a_scarce_domain(spark):
    rows = [(i, "you stupid idiot moron loser fool " * 3 if i < 4 else "@#! $%^ &*( " * 6 if i < 60 else "plain words about a quiet town by the sea " * 4) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i >= 60 or i < 4), int(i < 4)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    for top in (float("inf"), 1.0):
        got = mixing.mixing_rates(frame, marks, max_rate=top).collect()
        total = {d: sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) for d in mixing.TARGETS}
        for d, share in mixing.TARGETS.items():
            assert abs(total[d] / sum(total.values()) - share) < 0.003 * share + 1e-9
            assert abs(got[0][f"fitted_{d}"] - total[d]) < 1e-6 * total[d] and abs(got[0][f"wanted_{d}"] - total[d]) <= 1.01e-3 * total[d]
        assert max(r.rate for r in got) > 1 if top > 1 else max(r.rate for r in got) <= 1


def brute_rates(mass, g, wanted, top, steps=20_000):
    """Plain projected gradient descent over all documents, by numpy."""
    rate = np.full(len(g), min(1.0, top))
    inverse = np.linalg.inv((mass.T @ g + g.T @ mass) / 2 + 1e-9 * np.eye(len(wanted)))
    for _ in range(steps):
        rate = np.clip(rate + g @ (inverse @ (wanted - mass.T @ rate)), 0, top)
    return rate


def test_mixing_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(8)
    g = np.round(rng.dirichlet([0.4, 0.3, 0.3], 200) * mixing.GRID) / mixing.GRID
    mass = g * rng.integers(1, 500, 200)[:, None]
    for shares, top in (([0.5, 0.3, 0.2], float("inf")), ([0.6, 0.3, 0.1], 1.0), ([0.98, 0.01, 0.01], float("inf"))):
        cells = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(g, mass, strict=True)], "g array<double>, mass array<double>")
        rate, wanted, fitted = mixing.fit_rates(cells, np.array(shares), top)
        own = np.array([r.rate for r in cells.withColumn("rate", rate).select("rate").collect()])
        plain = brute_rates(mass, g, wanted, top)
        assert own.min() >= 0 and own.max() <= top
        inverse = np.linalg.inv((mass.T @ g + g.T @ mass) / 2)
        squares = lambda r: (mass.T @ r - wanted) @ inverse @ (mass.T @ r - wanted)
        assert squares(own) <= squares(plain) + 1e-5 * mass.sum()  # as near to the targets as the plain method comes
        assert np.allclose(fitted, mass.T @ own, rtol=1e-6)


def test_mixing_hits_targets_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for top in (float("inf"), 1.0):
        rows = mixing.mixing_rates(docs, labels, max_rate=top).collect()
        total = {d: sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS}
        assert all(abs(total[d] / sum(total.values()) - share) < 0.01 * share for d, share in mixing.TARGETS.items())
    # The classifier against the marks themselves.
    best = {r.doc_id: max(mixing.TARGETS, key=lambda d: r[f"p_{d}"]) for r in rows}
    marks = [(best[r.doc_id], "toxic" if r.toxic else "clean" if r.quality else "junk") for r in labels.collect()]
    assert np.mean([a == b for a, b in marks]) > 0.9


def test_packing_keeps_every_token_once(docs, edge, nothing):
    assert packing.pack_documents(nothing).count() == 0
    for frame in (docs, edge):
        rows = packing.pack_documents(frame, lengths=(64, 256), shard_pieces=50).collect()
        want = sorted(((r.doc_id or -1), len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in frame.select("doc_id", "text").collect())
        assert sum(r.n_tokens for r in rows) == sum(n for _, n in want)
        bins = {}
        for r in rows:
            assert (r.bin is None) == (r.n_tokens == 0)
            if r.bin is not None:
                bins.setdefault((r.shard, r.bin), []).append(r)
        for own in bins.values():
            own.sort(key=lambda r: r.bin_offset)
            used = 0
            for r in own:
                assert r.bin_offset == used
                used += r.n_tokens
            assert own[0].bin_length == min(x for x in (64, 256) if x >= used)


def plain_best_fit(sizes, length):
    """Tokens of sequences of one length that plain best fit decreasing opens."""
    free = []
    for size in sorted(sizes, reverse=True):
        room = [f for f in free if f >= size]
        if room:
            free.remove(min(room))
            free.append(min(room) - size)
        else:
            free.append(length - size)
    return len(free)


def test_packing_costs_less_than_one_length(spark):
    rng = random.Random(6)
    sizes = [min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)]
    order = np.array(sorted(sizes, reverse=True))
    bins, offsets, final = packing.pack_shard(order)
    cost = sum(length + packing.OVERHEAD for length in {b: f for b, f in zip(bins, final, strict=True)}.values())
    for length in packing.LENGTHS:
        pieces = [min(length, size - at) for size in sizes for at in range(0, size, length)]
        assert cost < 1.005 * plain_best_fit(pieces, length) * (length + packing.OVERHEAD)
    assert sum(sizes) / sum({b: f for b, f in zip(bins, final, strict=True)}.values()) > 0.99  # fill rate
    # Every bin holds its pieces in one row without overlap.
    for b in set(bins.tolist()):
        own = sorted((o, z) for o, z, x in zip(offsets, order, bins, strict=True) if x == b)
        assert [o for o, _ in own] == list(np.r_[0, np.cumsum([z for _, z in own])[:-1]])


def test_packing_splits_rows_without_id(spark):
    frame = spark.createDataFrame([(None, "w " * (1 + i % 7)) for i in range(3000)], "doc_id bigint, text string")
    shards = [r["count"] for r in packing.pack_documents(frame, lengths=(16,), shard_pieces=200).groupBy("shard").count().collect()]
    assert len(shards) == 15 and max(shards) < 300


def brute_nearest(rows, k, asks):
    fine = [(i, np.array(v, float)) for i, v in {(i, tuple(v) if v else None) for i, v in rows} if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, a in fine:
        if asks(i):
            near = sorted(((-float(ann.cosine(a[None], b[None])[0]), j) for j, b in {(j, tuple(b)): (b) for j, b in fine}.items() for j in [j[0]] if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def test_nearest_on_small_tables_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(90)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 130)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 2.0, 3.0]), (204, [float("inf"), 1.0, 1.0, 1.0]), (205, [1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0]), (110, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 10 == 0).collect())
    want = brute_nearest(rows, 5, lambda i: i % 10 == 0)
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _, _ in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert ann.nearest(frame.where("vec_id in (1, 2)"), F.col("vec_id") > 0).count() == 2


def test_nearest_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = v @ v[q]
        s[q] = -9
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-s)[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_nearest_recall_holds_as_the_table_grows(spark):
    v = np.random.default_rng(3).normal(size=(30_000, 64)).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 150 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = []
    for q in range(0, len(v), 150):
        s = v @ v[q]
        s[q] = -9
        hits.append(len(got[q] & set(np.argsort(-s)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.9


def test_nearest_orders_ties_by_id_over_many_blocks(spark):
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(1, 9001), "embedding": [[float(i), 0.0] for i in range(1, 9001)]}), "vec_id bigint, embedding array<float>")
    got = ann.nearest(frame, F.col("vec_id").isin(8500, 3)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(3, k, [1, 2, 4, 5, 6][k - 1]) for k in range(1, 6)] + [(8500, k, k) for k in range(1, 6)]
    assert all(r.score == 1.0 for r in got)


def test_nearest_is_exact_where_all_lists_are_read(spark):
    v = np.random.default_rng(4).normal(size=(4000, 16)).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(frame, F.col("vec_id") % 100 == 0, read_ratio=float("inf")).collect())
    want = []
    for q in range(0, len(v), 100):
        s = ann.cosine(np.repeat(v[q : q + 1].astype(float), len(v), axis=0), v.astype(float))
        s[q] = -9
        want += [(q, k + 1, int(j)) for k, j in enumerate(np.argsort(-s, kind="stable")[:5])]
    assert got == want


KEY = b"key of the tests"


def test_pseudonyms(edge, nothing):
    text = "mail a.b34@mail7.example.com card 4111111111111111 and 4111-1111-1111-1111 call +1 (212) 555-0147 from 10.0.0.7 on 2024-02-29 or 29.02.2024, ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00 key d0a1b2c3d4e5f60718293a4b5c6d7e8f90a1b2c3 bad 999.1.1.1 2023-02-30 1700000000000"
    new, spans = pii.pseudonymise(text, KEY)
    assert [k for k, _, _ in spans] == ["email", "account", "account", "phone", "ip", "date", "date", "social", "iban", "secret"]
    found = [new[a : a + n] for _, a, n in spans]
    for old in ("a.b34@", "4111111111111111", "4111-1111", "555-0147", "10.0.0.7", "2024-02-29", "29.02.2024", "123-45-6789", "3704 0044"):
        assert old not in new
    assert pii.luhn(found[1]) and found[2].replace("-", "") == found[1] and "999.1.1.1 2023-02-30 1700000000000" in new
    assert pii.pseudonymise(new, KEY, undo=True)[0] == text
    assert pii.pseudonymise(text, KEY)[0] == new != pii.pseudonymise(text, b"other")[0]
    rows = {r.doc_id: r for r in pii.pseudonymise_documents(edge, KEY).collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[4].text == LONG and pii.pseudonymise_documents(nothing, KEY).count() == 0


def test_pseudonyms_link_equal_numbers_and_keep_country_codes():
    digits = lambda text: re.sub(r"\D", "", pii.pseudonymise(text, KEY)[0])
    assert digits("(212) 555-0147") == digits("212-555-0147") == digits("+1 (212) 555-0147")[1:] == digits("+1-212-555-0147")[1:]
    assert digits("+351 912 345 678").startswith("351") and digits("+49 30 1234567").startswith("49") and digits("+351 912 345 678") == digits("+351912345678")
    for text in ("x.é.Ñu@example.com", "a" * 300 + "@example.com", "müller@dö.com", "A.B@x-y.co.uk,"):
        new, spans = pii.pseudonymise(text, KEY)
        assert len(spans) == 1 and len(new) == len(text) and pii.pseudonymise(new, KEY, undo=True)[0] == text
        assert not set("éñÑü") & set(new) or new != text


def brute_kinds(word):
    """What a single blank-free word is, decided without the operator's patterns."""
    if word.count("@") == 1:
        local, _, domain = word.partition("@")
        labels = domain.split(".")
        return "email" if local and len(labels) > 1 and all(labels) and labels[-1].isalpha() and len(labels[-1]) > 1 else None
    parts = word.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts):
        return "ip" if all(int(p) < 256 for p in parts) else None
    parts = word.split("-")
    if [len(p) for p in parts] == [4, 2, 2] and all(p.isdigit() for p in parts):
        days = {2: 29 if int(parts[0]) % 4 == 0 and (int(parts[0]) % 100 or int(parts[0]) % 400 == 0) else 28, 4: 30, 6: 30, 9: 30, 11: 30}
        return "date" if 1900 <= int(parts[0]) < 2100 and 1 <= int(parts[1]) <= 12 and 1 <= int(parts[2]) <= days.get(int(parts[1]), 31) else None
    if [len(p) for p in parts] == [3, 2, 4] and all(p.isdigit() for p in parts):
        return "social" if parts[0] not in ("000", "666") and parts[0][0] != "9" and parts[1] != "00" and parts[2] != "0000" else None
    if word.isdigit() and 13 <= len(word) <= 19:
        return "account" if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(word))) % 10 == 0 else None
    if set(word) <= set("0123456789abcdef") and 32 <= len(word) <= 64:
        return "secret"
    return None


def test_pseudonyms_find_what_brute_force_finds():
    rng = random.Random(9)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [
        lambda: f"{rng.choice(['ann', 'b.c', 'x9'])}@{rng.choice(['mail.example.com', 'a.org', 'localhost', 'b.c1'])}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        lambda: f"{rng.randrange(1850, 2150)}-{rng.randrange(14):02d}-{rng.randrange(33):02d}", lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: number(rng.randrange(11, 21)),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 32, 40, 64, 65]))), lambda: "word",
    ]
    for _ in range(300):
        words = [rng.choice(makers)() for _ in range(12)]
        want = [(w, brute_kinds(w)) for w in words if brute_kinds(w)]
        text = " ; ".join(words)
        new, spans = pii.pseudonymise(text, KEY)
        assert [k for k, _, _ in spans] == [k for _, k in want]
        assert [old for old, now in zip(words, new.split(" ; "), strict=True) if brute_kinds(old) is None and old != now] == []


def test_pseudonyms_take_linear_time():
    for text in ("a" * 300_000 + " 1", "x@" + "a." * 150_000 + "1", "1" * 300_000, "2024-01-01" * 30_000, "+1 " * 100_000, "a" * 300_000 + "@example.com", "f" * 300_000 + "1"):
        began = time.perf_counter()
        pii.pseudonymise(text, KEY)
        assert time.perf_counter() - began < 15


def test_feistel_is_a_permutation():
    for n in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(i, n, b"k", "t") for i in range(n)) == list(range(n))
        assert all(pii.permute(pii.permute(i, n, b"k", "t"), n, b"k", "t", undo=True) == i for i in range(n))


CLASH = ("id", "row", "own", "mark", "sha", "again", "digest", "own_mark", "node", "p", "g", "tokens", "kept", "letters", "key", "label", "rate")


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_edge_tables(spark, edge, nothing, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    last = stage == 4
    odd = edge.select("*", F.create_map(F.lit("k"), "name").alias("attributes"), *[F.col("name").alias(c) for c in CLASH])
    rows = run(spark, odd, FOLDER)
    got = rows.collect()
    if not last:
        assert rows.columns == odd.columns and rows.schema["attributes"].dataType == odd.schema["attributes"].dataType
        plain = sorted((r.doc_id or -1, r.text or "") for r in run(spark, edge, FOLDER).collect())
        assert sorted((r.doc_id or -1, r.text or "") for r in got) == plain
    if name in ("exact_dedup", "simhash_near_dedup"):
        assert [r.doc_id for r in sorted(got, key=lambda r: r.doc_id)] == ([1, 3, 4, 6, 8] if name == "exact_dedup" else [1, 4, 6, 8])
    if last:
        assert sum(r.n_tokens for r in got) == 2 * 30_000 + 2 * 4 + 2
    assert run(spark, nothing, FOLDER).count() == 0 and set(run(spark, nothing, FOLDER).columns) == set(run(spark, edge, FOLDER).columns)


def test_stages_decide_by_row_not_by_id(spark):
    import corpus_pipeline

    other = " ".join(f"Satz{i} der die das und" for i in range(60))
    rows = [(1, LONG), (7, LONG), (7, other), (None, other + " mehr davon"), (None, LONG), (9, ""), (9, other.upper())]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("de").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    assert sorted((r.doc_id or -1, r.text) for r in stages["exact_dedup"](spark, frame, FOLDER).collect()) == sorted((i or -1, t) for i, t in rows if (i, t) not in ((7, LONG), (None, LONG)))
    kept = {(r.doc_id, r.text) for r in stages["language_id"](spark, frame, FOLDER).collect()}
    assert (7, other) in kept and (None, other + " mehr davon") in kept and not any(t == "" for _, t in kept)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, FOLDER)
        assert after.columns == docs.columns and after.exceptAll(frame).count() == 0
        frame = after
    whole = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in frame.collect()}
