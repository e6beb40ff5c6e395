"""Toxicity by weak supervision.

Many voters speak on a document or stay silent: entries of a lexicon (whole words), patterns (word
beginnings), and voters for clean text (no entry, no pattern, words typical of clean text). Marked
documents only propose entries, as a lexicographer would collect them; how far a voter can be trusted is
never read from a mark. That is estimated by a generative label model on other documents, by expectation
maximisation from the same neutral start for all voters: how often each voter speaks on toxic and on
clean documents, and which voters depend on each other given the label. The dependences are part of the
model's likelihood: voters form a forest in which each speaks with a chance that depends on the label
and on its parent's vote. A linear classifier on words and word beginnings is trained on the model's
posterior labels and then scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables, bounded_rows, class_sample, fold

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Bound of the training sample: documents per label, read whole.
PER_LABEL = 2500
#: Voters of each side, and further frequent traits that the classifier may weigh.
MOST_VOTERS, MOST_CLEAN, MOST_TRAITS = 400, 40, 1000
#: Lengths of the word beginnings that serve as patterns.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Seed lexicon (fixed values): common English insults. Further entries are proposed by marked documents.
SEED_LEXICON = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "loser", "moron", "pathetic", "scum", "shut", "stupid", "trash", "ugly", "worthless")
#: Every voter's accuracy before anything is estimated, and how many votes that belief is worth.
NEUTRAL, BELIEF = 0.7, 4.0
#: Two voters depend on each other if their association given the label passes this likelihood-ratio statistic.
DEPENDENT = 15.0
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return {m.group() for m in WORD.finditer((text or "").lower())}


def traits_of(words: set[str]) -> set[str]:
    """Words, and beginnings (marked by a star) of longer words."""
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class LabelModel:
    """P(voter speaks | label, parent speaks): ``speak[label, parent's vote, voter]``; ``parent`` is -1 at a root.

    ``side`` is 1 for voters that say toxic and -1 for those that say clean. ``accuracy`` is the chance
    that a vote is right; ``correlation`` holds the association of each pair given the label.
    """

    prior: float
    side: np.ndarray
    speak: np.ndarray
    parent: np.ndarray
    accuracy: np.ndarray
    correlation: np.ndarray

    def posterior(self, spoken: np.ndarray) -> np.ndarray:
        """Chance of toxic, from a matrix of 1 (spoken) and 0 (silent)."""
        above = np.where(self.parent >= 0, self.parent, 0)
        given = np.where(self.parent >= 0, spoken[:, above], 0).astype(bool)
        logit = np.full(len(spoken), np.log(self.prior / (1 - self.prior)))
        for label, sign in ((1, 1), (0, -1)):
            p = np.where(given, self.speak[label, 1], self.speak[label, 0])
            logit += sign * np.where(spoken > 0, np.log(p), np.log1p(-p)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _association(spoken: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of every pair's dependence given the label, summed over labels."""
    out = np.zeros((spoken.shape[1],) * 2)
    for weight in (q, 1 - q):
        n = max(float(weight.sum()), 1e-9)
        one = weight @ spoken
        both = (spoken * weight[:, None].astype(np.float32)).T @ spoken
        for cell, a, b in ((both, one[:, None], one[None]), (one[:, None] - both, one[:, None], n - one[None]), (one[None] - both, n - one[:, None], one[None]), (n - one[:, None] - one[None] + both, n - one[:, None], n - one[None])):
            cell = np.maximum(cell, 0)
            out += np.where(cell > 1e-6, 2 * cell * np.log(np.maximum(cell, 1e-6) * n / np.maximum(a * b, 1e-9)), 0)
    np.fill_diagonal(out, 0)
    return out


def _forest(weight: np.ndarray, least: float) -> np.ndarray:
    """Parents in a maximum spanning forest of the pairs whose weight is over ``least`` (-1: root)."""
    n = len(weight)
    parent, best, done = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, bool)
    for _ in range(n):
        k = int(np.argmax(np.where(done, -np.inf, best))) if (best[~done] > least).any() else int(np.flatnonzero(~done)[0])
        if best[k] <= least:
            parent[k] = -1
        done[k] = True
        closer = ~done & (weight[k] > best)
        best[closer], parent[closer] = weight[k][closer], k
    return parent


def fit_label_model(spoken: np.ndarray, side: np.ndarray, prior: float, rounds: int = 15) -> LabelModel:
    """Expectation maximisation from the neutral start; every third round the dependences are estimated anew."""
    spoken = spoken.astype(np.float32)
    n = spoken.shape[1]
    rate = np.clip(spoken.mean(axis=0), 1e-4, 0.9)
    base = np.stack([np.clip(rate * 2 * np.where(side < 0, NEUTRAL, 1 - NEUTRAL), 1e-4, 0.95), np.clip(rate * 2 * np.where(side > 0, NEUTRAL, 1 - NEUTRAL), 1e-4, 0.95)])
    model = LabelModel(prior, side, np.stack([base, base], axis=1), np.full(n, -1), np.full(n, NEUTRAL), np.zeros((n, n)))
    for k in range(rounds):
        q = model.posterior(spoken)
        corr, parent = model.correlation, model.parent
        if k % 3 == 0:
            corr = _association(spoken, q)
            parent = _forest(corr, DEPENDENT)
        above = np.where(parent >= 0, parent, 0)
        given = np.where(parent >= 0, spoken[:, above], 0)
        speak = np.zeros_like(model.speak)
        for label, weight in ((1, q), (0, 1 - q)):
            start = base[label]  # the neutral belief, worth a few documents
            alone = (weight @ spoken + BELIEF * start) / (weight.sum() + BELIEF)
            for vote, mask in ((1, given), (0, 1 - given)):
                seen = weight @ mask
                speak[label, vote] = np.clip((weight @ (mask * spoken) + BELIEF * alone) / (seen + BELIEF), 1e-5, 1 - 1e-5)
        toxic, total = q @ spoken, spoken.sum(axis=0)
        right = np.where(side > 0, toxic, total - toxic)
        accuracy = (right + BELIEF * NEUTRAL) / (total + BELIEF)
        model = LabelModel(float(np.clip(q.mean(), 0.02, 0.98)), side, speak, parent, accuracy, corr)
    return model


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    voters: list[str]

    def logit(self, text: str | None) -> float:
        get, total = self.weights.get, self.bias
        for w in words_of(text):
            total += get(w, 0.0)
            for n in BEGINNINGS:
                if len(w) > n:
                    total += get(w[:n] + "*", 0.0)
                else:
                    break
        return total


def _train_classifier(x: np.ndarray, q: np.ndarray, importance: np.ndarray, penalty: np.ndarray, start: float) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam: weights and bias."""
    w, b = np.zeros(x.shape[1], np.float32), start
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, 201):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        err = (importance * (p - q) / len(x)).astype(np.float32)
        g, gb = err @ x + penalty * w, float(err.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        lr = 0.1 * (1 - 0.9 * k / 200)
        w -= lr * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        b -= lr * (mb / (1 - 0.9**k)) / (np.sqrt(sb / (1 - 0.99**k)) + 1e-8)
    return w, b


def fit(spoken: np.ndarray, traits: list[str], side: np.ndarray, marks: np.ndarray, share: float) -> ToxicityModel:
    """Label model and classifier from the traits found in documents that proposed no entry.

    ``side`` of a trait is 1 or -1 for a voter and 0 for a trait that only the classifier sees. The marks
    say which share of the table a row stands for, since the sample holds both labels evenly; they are
    no input of the label model.
    """
    toxic, clean = np.flatnonzero(side > 0), np.flatnonzero(side < 0)
    words = np.array([k for k in toxic if not traits[k].endswith("*")], int)
    stems = np.array([k for k in toxic if traits[k].endswith("*")], int)
    # Two more voters say clean where no entry of the lexicon, or no pattern, is found.
    silent = np.stack([(spoken[:, own].sum(axis=1) == 0) if len(own) else np.zeros(len(spoken), bool) for own in (words, stems)], axis=1)
    votes = np.hstack([spoken[:, toxic], spoken[:, clean], silent]).astype(np.float32)
    model = fit_label_model(votes, np.r_[np.ones(len(toxic)), -np.ones(len(clean) + 2)], 0.5)
    q = model.posterior(votes)
    even = marks.mean() if len(marks) else 0.5
    importance = np.where(marks == 1, share / max(even, 1e-9), (1 - share) / max(1 - even, 1e-9))
    penalty = np.where(side > 0, 1e-5, 1e-2).astype(np.float32)
    w, b = _train_classifier(spoken.astype(np.float32), q, importance, penalty, float(np.log(share / (1 - share))))
    return ToxicityModel(float(b), {t: float(v) for t, v in zip(traits, w, strict=True) if abs(v) > 1e-3}, [traits[k] for k in toxic])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each trait by mark, summed over bounded runs of documents."""
    for batch in batches:
        counts: Counter = Counter()
        for mark, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.update((t, mark) for t in traits_of(words_of(text.as_py())))
            if len(counts) > 200_000:
                yield _counts(counts)
                counts.clear()
        yield _counts(counts)


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([m for _, m in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["trait", "label", "n"])


def propose_traits(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Traits that speak for one label beyond chance, the seed lexicon, and other frequent traits; with their sides.

    All counting is done by Spark. There are very many candidates, so a trait must pass a likelihood-ratio
    test that chance alone would hardly pass anywhere.
    """
    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return list(SEED_LEXICON), np.ones(len(SEED_LEXICON))
    counts = rows.select("label", "text").mapInArrow(_counted, "trait string, label int, n bigint").groupBy("trait")
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    counts = counts.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")).where(toxic + clean >= 5)
    even = (toxic + clean) / float(n1 + n0)
    part = lambda c, n: F.when(c > 0, 2 * c * F.log(c / n / even)).otherwise(0.0)
    odds = F.log((toxic + 0.5) / (n1 + 1.0)) - F.log((clean + 0.5) / (n0 + 1.0))
    counts = counts.select("trait", (toxic + clean).alias("both"), odds.alias("odds"), (part(toxic, float(n1)) + part(clean, float(n0))).alias("gain"))

    def most(rule: Column, order: str, limit: int) -> list[str]:
        return [r["trait"] for r in counts.where(rule).orderBy(F.desc(order), "trait").limit(limit).collect()]

    voters = most((F.col("odds") > 1.5) & (F.col("gain") > 22), "gain", MOST_VOTERS)
    voters += [t for t in SEED_LEXICON if t not in voters]
    against = most((F.col("odds") < -1.5) & (F.col("gain") > 22), "gain", MOST_CLEAN)
    often = [t for t in most(F.col("both") >= 10, "both", MOST_TRAITS + len(voters)) if t not in set(voters) | set(against)][:MOST_TRAITS]
    return voters + against + often, np.r_[np.ones(len(voters)), -np.ones(len(against)), np.zeros(len(often))]


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> ToxicityModel:
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    share = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    sample = class_sample(marked, "label", "doc_id", per_label)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id")
    rows = WorkTables(docs.sparkSession).save(bounded_rows(rows.select(F.col("doc_id").alias("key"), "label", "text"), per_label), "sample")
    # One half of the sample proposes entries; the label model and the classifier learn from the other half.
    half = F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2))
    traits, side = propose_traits(rows.where(half == 0))
    number = {t: k for k, t in enumerate(traits)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(number[t] for t in traits_of(words_of(text.as_py())) if t in number) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], ["key", "label", "traits"])

    found = rows.where(half == 1).select("key", "label", "text").mapInArrow(run, "key bigint, label int, traits array<int>").toPandas()
    found = found.assign(order=[tuple(t) for t in found["traits"]]).sort_values(["key", "label", "order"], kind="stable")
    marks = found["label"].to_numpy(np.int64)
    if not len(marks) or marks.min() == marks.max():  # nothing to contrast: the seed lexicon decides, as neutral voters do
        strength = float(len(SEED_LEXICON) ** 0.5 * np.log(NEUTRAL / (1 - NEUTRAL)))
        return ToxicityModel(-strength / 2, dict.fromkeys(SEED_LEXICON, strength), list(SEED_LEXICON))
    spoken = np.zeros((len(marks), len(traits)), np.float32)
    for i, own in enumerate(found["traits"]):
        spoken[i, np.asarray(own, int)] = 1
    return fit(spoken, traits, side, marks, (share.get(1, 0) + 1) / (sum(share.values()) + 2))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``; learned from labels outside the held-out fold.

    Defined cases: null and empty texts have no words and get the classifier's base score; label rows
    with a null id or mark are left out; without marks of both kinds the seed lexicon alone decides, its
    entries as neutral voters; very long texts are read whole; repeated rows are scored each (and learned
    from once); held_out is null where the id is; other columns are ignored; an empty table gives an
    empty result.
    """
    model = train_toxicity(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.fromiter((model.logit(t.as_py()) for t in batch.column(1)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    scores = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return scores.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
