"""Mixing documents to target weights over soft domains.

A naive-Bayes classifier made from a table of labelled documents (telling words and two surface features)
gives every document a posterior over domains. Nonnegative document rates are then fitted by projected
gradient descent on the least squares between expected token totals per domain and their targets. A step
adds the same small vector, weighted by its posterior (rounded to ``1 / GRID``), to every document's rate
and cuts at the bounds, so a rate is a fixed expression of the rounded posterior and the vectors so far.
Spark sums tokens times exact posteriors once for all documents of one rounded posterior and then the
totals for each step; only one number per domain and the matrix that scales the gradient reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables, class_sample, word_count

#: Domains of the labels table, and the shares of tokens that the mixture should have.
TARGETS = {"clean": 0.93, "junk": 0.04, "toxic": 0.03}
#: Every domain's expected total shall come this near to its target (relative).
TOLERANCE = 1e-3
#: Steps of a posterior's coordinates that rates can tell apart; the totals are summed from exact posteriors.
GRID = 64
#: Labelled documents per domain that the classifier is fitted on; words that it may weigh, the most significant ones.
PER_DOMAIN, WORDS = 4000, 2000
#: A word counts if its frequencies differ between the domains by more than chance (likelihood-ratio statistic), and only for
#: a domain in which it is this much more frequent than in the others together (log-ratio).
SIGNIFICANT, TELLING = 30.0, 4.0


def surface(text: Column) -> list[Column]:
    """Two small numbers that describe a text: the shares of marks and of capitals (0 to 15 each)."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern, scale: F.least(F.lit(15), F.floor(F.lit(scale) * (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / size)).cast("int")
    return [share(r"[!-+\-/:-@\[-`{-~]+", 60), share(r"[A-Z]+", 30)]


def words_of(text: Column) -> Column:
    """Distinct words of a text (runs of letters, lower-cased)."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def label_domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "junk").when(quality == 1, "clean")


def _numbers(values: np.ndarray) -> Column:
    """A constant array column."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


class Domains:
    """Naive Bayes over small features: marks, capitals, and for each domain how many of its telling words occur (0 to 3)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, domains: list[str], per_domain: int = PER_DOMAIN):
        marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), label_domain(F.col("quality"), F.col("toxic")).alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
        share = {r["domain"]: r["count"] for r in marked.groupBy("domain").count().collect()}
        self.prior = np.array([math.log((share.get(d, 0) + 0.5) / (sum(share.values()) + 0.5 * len(domains))) for d in domains])
        known = docs.select("doc_id", "text").join(class_sample(marked, "domain", "doc_id", per_domain), "doc_id")
        n = np.zeros(len(domains))
        for r in known.groupBy("domain").count().collect():
            n[domains.index(r["domain"])] = r["count"]
        # Documents with each word, by domain; words that don't tell domains apart stay in Spark.
        counts = [F.count(F.when(F.col("domain") == d, 1)).alias(f"c{k}") for k, d in enumerate(domains)]
        table = known.select("domain", F.explode(words_of(F.coalesce("text", F.lit("")))).alias("w")).groupBy("w").agg(*counts)
        count = [F.col(f"c{k}").cast("double") for k in range(len(domains))]
        every = sum(count, F.lit(0.0))
        ratio = [F.log((c + 0.5) / F.lit(float(x) + 1)) - F.log((every - c + 0.5) / F.lit(float(n.sum() - x) + 1)) for c, x in zip(count, n, strict=True)]
        gain = sum((F.when(c > 0, 2 * c * F.log(c / (F.lit(max(1.0, float(x))) * every / max(1.0, float(n.sum()))))).otherwise(0.0) for c, x in zip(count, n, strict=True)), F.lit(0.0))
        telling = table.select("w", gain.alias("gain"), F.array(*ratio).alias("ratio")).where((F.col("gain") > SIGNIFICANT) & (F.array_max("ratio") > TELLING))
        found = telling.orderBy(F.desc("gain"), "w").limit(WORDS).select("w", F.array_position("ratio", F.array_max("ratio")).alias("k")).collect()
        self.words = [[r["w"] for r in found if r["k"] == k + 1] for k in range(len(domains))]
        # Documents with each feature value, by domain.
        seen = np.zeros((len(domains), 32 + 4 * len(domains)))
        for r in known.select("domain", F.explode(self.features(F.col("text"))).alias("f")).groupBy("domain", "f").count().collect():
            seen[domains.index(r["domain"]), r["f"]] = r["count"]
        values = np.r_[np.full(32, 16), np.full(4 * len(domains), 4)]
        self.table = np.log((seen + 0.5) / (n[:, None] + 0.5 * values))

    def features(self, text: Column) -> Column:
        """Numbers of the feature values that hold for a text."""
        text = F.coalesce(text, F.lit(""))
        marks, capitals = surface(text)
        words = F.filter(words_of(text), lambda w: w.isin([x for own in self.words for x in own]))  # a look-up in a constant set
        found = lambda w: F.array(*[F.lit(32 + 4 * k) + F.least(F.size(F.filter(w, lambda x: x.isin(own))), F.lit(3)) for k, own in enumerate(self.words)])
        return F.concat(F.array(marks, capitals + 16), F.transform(F.array(words), found)[0])

    def posterior(self, text: Column) -> Column:
        """Array of the domains' posteriors."""
        plus = lambda table: lambda a, f: a + F.get(table, f)
        logs = lambda x: F.array(*[F.aggregate(x, F.lit(float(p)), plus(_numbers(self.table[k]))) for k, p in enumerate(self.prior)])
        # Lambdas bind each intermediate result once.
        bind = lambda value, then: F.transform(F.array(value), then)[0]
        softmax = lambda s: bind(F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
        return bind(bind(self.features(text), logs), softmax)


class Rates:
    """Rates as an expression of the rounded posterior ``g``: from 1, one vector after the other is added and cut at the bounds."""

    def __init__(self, cells: DataFrame, n_domains: int, top: float):
        """``cells`` has g and, summed over its documents, ``mass``: tokens times posterior of each domain."""
        self.cells, self.n, self.top, self.steps = cells, n_domains, top, []

    def column(self, steps: list[np.ndarray] | None = None) -> Column:
        steps = self.steps if steps is None else steps
        start = F.lit(float(min(1.0, self.top)))
        if not steps:
            return start
        # The vectors are data, not code, so that no step compiles the expression anew.
        vectors = F.transform(F.split(F.lit(";".join(",".join(repr(float(x)) for x in v) for v in steps)), ";"), lambda v: F.split(v, ",").cast("array<double>"))

        def move(rate: Column, v: Column) -> Column:
            moved = F.greatest(rate + sum((F.get("g", F.lit(k)) * F.get(v, F.lit(k)) for k in range(self.n)), F.lit(0.0)), F.lit(0.0))
            return moved if math.isinf(self.top) else F.least(moved, F.lit(float(self.top)))

        return F.aggregate(vectors, start, move)

    def totals(self, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Domains' expected totals, the gradient's matrix over documents with free rates, and over all."""
        of = lambda name, k: F.get(name, F.lit(k))
        free = (F.col("rate") > 0) & (F.col("rate") < F.lit(float(self.top)))
        sums = [F.sum(of("mass", k) * F.col("rate")) for k in range(self.n)]
        for kept in (free, F.lit(True)):
            sums += [F.sum(F.when(kept, of("mass", k) * of("g", j))) for k in range(self.n) for j in range(self.n)]
        row = self.cells.withColumn("rate", self.column(steps)).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        got = np.array([x or 0.0 for x in row], float)
        return got[: self.n], got[self.n : self.n + self.n**2].reshape(self.n, self.n), got[self.n + self.n**2 :].reshape(self.n, self.n)

    def fit(self, wanted: np.ndarray, most: int = 25) -> tuple[np.ndarray, float]:
        """Step until the totals are within ``TOLERANCE`` of ``wanted`` or the squares hardly fall; the totals and the largest relative residual.

        The squares are weighted by the inverse of the matrix over all documents, for which a gradient step
        of length 1 never fails to lower them; first a bolder step is tried, scaled by the free rates alone.
        """
        error = lambda t: float(np.max(np.abs(t - wanted) / np.maximum(wanted, 1.0), initial=0.0))
        total, free, every = self.totals(self.steps)
        ridge = np.diag(np.diag(every)) * 1e-6 + 1e-9 * np.eye(self.n)
        squares = lambda t: float((t - wanted) @ np.linalg.solve((every + every.T) / 2 + ridge, t - wanted))
        for _ in range(most):
            if error(total) <= TOLERANCE / 2:
                break
            before = squares(total)
            for matrix, gain in ((free + 1e-3 * every, 0.7), (every, 0.98)):
                trial = [*self.steps, np.linalg.solve(matrix + ridge, wanted - total)]
                after = self.totals(trial)
                if squares(after[0]) < gain * before:
                    break
            else:
                break
            self.steps, (total, free, _) = trial, after
        return total, error(total)


def fit_rates(cells: DataFrame, shares: np.ndarray, top: float) -> tuple[Column, np.ndarray, np.ndarray]:
    """The rate of each rounded posterior ``g``, and each domain's totals wanted and fitted.

    Without a bound on rates the corpus keeps its size; with one, the size is the largest that every
    domain can fill, found by lowering it from what the scarcest domain holds. Where no size will do, the
    one stays at which the sum of relative residuals is least, and the residual shows.
    """
    rates = Rates(cells, len(shares), top)
    mass = rates.totals([])[0] / min(1.0, top)
    fillable = (mass > 1e-6 * mass.sum()) & (shares > 0)
    if not fillable.any():
        return rates.column(), 0 * shares, mass * min(1.0, top)
    size = mass.sum() if math.isinf(top) else min(top * float(np.min(mass[fillable] / shares[fillable])), top * mass.sum())
    best, least = None, math.inf
    for _ in range(1 if math.isinf(top) or not fillable[shares > 0].all() else 20):
        total, error = rates.fit(size * shares)
        # All domains count: one that can't be met must not hide what a smaller size brings to the others.
        apart = float(np.sum(np.abs(total - size * shares) / np.maximum(size * shares, 1.0)))
        if error <= TOLERANCE or apart > 0.97 * least:  # met, or a smaller size no longer helps
            return (rates.column(), size * shares, total) if error <= TOLERANCE or apart < least else best
        best, least = (rates.column(), size * shares, total), apart
        size *= 0.95  # soft posteriors: part of a scarce domain lies in documents that others must drop
    return best


def _soft(docs: DataFrame, labels: DataFrame, targets: dict[str, float], max_rate: float, keep: Column, tables: WorkTables) -> tuple[DataFrame, Column, list[Column]]:
    """Rows with ``keep``, tokens and posteriors, written; the rate; the columns of totals."""
    domains = sorted(targets)
    model = Domains(docs, labels, domains)
    mark = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit("mix"))
    soft = tables.save(docs.select(keep.alias("kept"), word_count(F.col("text")).alias("tokens"), model.posterior(F.col("text")).alias("p"), mark.alias("mark")), "posteriors")
    soft = soft.withColumn("g", F.transform("p", lambda x: F.round(x * GRID) / GRID))
    cells = soft.groupBy("g").agg(F.array(*[F.sum(F.col("tokens") * F.col("p")[k]) for k in range(len(domains))]).alias("mass"))
    rate, wanted, fitted = fit_rates(tables.save(cells, "cells"), np.array([targets[d] for d in domains], float), max_rate)
    apart = np.abs(fitted - wanted) / np.maximum(wanted, 1.0)
    least = soft.where("tokens > 0").agg(*[F.min(F.col("p")[k]) for k in range(len(domains))]).first()
    totals = [F.lit(float(x[k])).alias(f"{n}_{d}") for n, x in (("wanted", wanted), ("fitted", fitted)) for k, d in enumerate(domains)]
    return soft, rate, [*totals, F.lit(bool((apart <= TOLERANCE).all())).alias("met"), *[F.lit(x).cast("double").alias(f"least_{d}") for x, d in zip(least, domains, strict=True)]]


def _copies(rate: Column) -> Column:
    draw = F.pmod(F.col("mark"), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, tokens, p_<domain> ..., rate, copies, wanted_<domain> ..., fitted_<domain> ..., met, least_<domain> ...``.

    Targets are shares of tokens. Without a bound (``max_rate`` infinite) the total is that of the corpus
    and scarce domains are repeated; with one, it is the most at which every domain can hold its share.
    ``wanted_`` and ``fitted_`` are the domains' totals aimed at and expected, the same in every row: their
    difference is the residual, and ``met`` says whether all of them are within ``TOLERANCE``. ``least_`` is the smallest
    posterior of any document with tokens: a target share below it is out of reach whatever the rates, since
    every token then holds more of the domain. ``copies`` rounds the rate by a hash of id and text.

    Defined cases: a null text has no tokens and the features of an empty one; a null or repeated id is
    handled like any other row (its labels join only where the id is known); labels with null marks are
    left out; without any usable label all posteriors are alike and targets out of reach; a domain
    without tokens bounds nothing and keeps its residual; very long texts count whole; an empty table
    gives an empty result. Other columns are ignored.
    """
    targets = targets or TARGETS
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    soft, rate, totals = _soft(rows, labels, targets, max_rate, F.col("doc_id"), WorkTables(docs.sparkSession))
    each = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(sorted(targets))]
    return soft.withColumn("rate", rate).select(F.col("kept").alias("doc_id"), "tokens", *each, "rate", _copies(F.col("rate")).alias("copies"), *totals)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the fitted rates (at most 1 here) leave out.

    Every row is decided by its own id and text and keeps all its columns, of any type and name.

    Defined cases: as for ``mixing_rates``; equal rows stay or go together; rows without tokens weigh
    nothing and follow the rate of their posterior; an empty table gives an empty result.
    """
    # The row is one struct, so that none of its columns can clash with what is added here.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    soft, rate, _ = _soft(rows, labels, targets or TARGETS, 1.0, F.col("row"), WorkTables(docs.sparkSession))
    return soft.withColumn("rate", rate).where(_copies(F.col("rate")) > 0).select("kept.*")
