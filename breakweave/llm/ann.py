"""Approximate nearest neighbours by balanced posting lists.

Their number grows with the square root of the table, without a cap. Centroids are trained on a sample of
a fixed number of vectors per list, by k-means with a penalty on full clusters (in two levels where there
are many). Every distinct
vector is written to the list of its nearest centroid, and a vector near a boundary to the lists of
further centroids that are hardly farther. Centroids are found through an in-memory neighbour graph,
searched best-first for a whole batch of vectors at once. A query reads every list whose centroid's
distance is within a ratio of the nearest one's; the ratio is measured on the table itself: the one at
which a bounded sample of queries, compared with all vectors, finds the wanted share of its neighbours. An infinite ratio reads every list, which is the exact
search. Neighbouring lists share a part, parts are cut into blocks of bounded size, so a large list is many
tasks' work, and each list of a block is compared with its queries by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WorkTables

#: Lists per square root of the table's distinct vectors (but none smaller than LEAST on average); vectors per list to train on.
LISTS, LEAST, SAMPLE_EACH = 4, 32, 24
#: Above this number of clusters, k-means works in two levels.
FLAT = 1024
DEGREE = 24
#: A vector is replicated up to this distance ratio.
COPY_RATIO, COPIES = 1.03, 3
#: Share of true neighbours that the measured reading ratio must reach on the sampled queries; how many are sampled; the beam to start with.
RECALL, PROBES, BEAM = 0.96, 256, 64
#: Vectors in a block; vectors that a part should hold.
BLOCK, PART = 4096, 1024


@dataclass
class Centroids:
    """Unit centroids, each one's nearest others, and well-spread places to start from."""

    points: np.ndarray
    near: np.ndarray
    entries: np.ndarray

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search for unit vectors: centroid numbers and distances, nearest first, ``beam`` at most.

        Only the beam of each vector is held, so that memory does not grow with the number of centroids.
        """
        n, beam = len(vectors), min(beam, len(self.points))
        place = np.tile(self.entries, (n, 1))
        score, opened = vectors @ self.points[self.entries].T, np.zeros((n, len(self.entries)), bool)
        while True:
            if place.shape[1] > beam:  # opened ones first among equal scores: else equal ones would take turns for ever
                best = np.lexsort((~opened, -score), axis=1)[:, :beam]
                place, score, opened = (np.take_along_axis(x, best, axis=1) for x in (place, score, opened))
            waiting = np.where(opened, -np.inf, score)
            take = np.argsort(-waiting, axis=1)[:, :8]
            alive = np.isfinite(np.take_along_axis(waiting, take, axis=1))
            if not alive.any():
                break
            np.put_along_axis(opened, take, True, axis=1)
            others = self.near[np.take_along_axis(place, take, axis=1)].reshape(n, -1)
            like = np.einsum("nd,nmd->nm", vectors, self.points[others])
            like[~np.repeat(alive, self.near.shape[1], axis=1)] = -np.inf
            place, score, opened = np.hstack([place, others]), np.hstack([score, like]), np.hstack([opened, np.zeros(others.shape, bool)])
            # Of a centroid that was met before, the entry stays that knows so.
            order = np.argsort(place * 2 + ~opened, axis=1, kind="stable")
            place, score, opened = (np.take_along_axis(x, order, axis=1) for x in (place, score, opened))
            again = np.zeros(place.shape, bool)
            again[:, 1:] = place[:, 1:] == place[:, :-1]
            score[again], opened[again] = -np.inf, True
        order = np.argsort(-score, axis=1, kind="stable")
        place, score = np.take_along_axis(place, order, axis=1), np.take_along_axis(score, order, axis=1)
        return place, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(score, -1)))

    def within(self, vectors: np.ndarray, ratio: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """All centroids up to ``ratio`` times the nearest one's distance, nearest first: the beam grows until it holds a farther one."""
        k = len(self.points)
        while beam < k // 2:
            place, distance = self.search(vectors, beam)
            if (distance[:, -1] > distance[:, 0] * ratio + 1e-6).all():
                return place, distance
            beam *= 2
        like = vectors @ self.points.T  # most centroids are in reach: no graph is needed
        place = np.argsort(-like, axis=1, kind="stable")
        return place, np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(like, place, axis=1)))


def _clusters(sample: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Balanced k-means on unit vectors: centroids and the label of each vector."""
    k = max(1, min(k, len(sample)))
    points = sample[rng.choice(len(sample), k, replace=False)].astype(np.float32)
    load, even = np.ones(k, np.float32), len(sample) / k
    label = np.zeros(len(sample), int)
    for _ in range(rounds):
        label = np.concatenate([np.argmax(part @ points.T - 0.03 * np.minimum(load / even - 1, 4), axis=1) for part in np.array_split(sample, -(-len(sample) // 4096))])
        load = np.bincount(label, minlength=k).astype(np.float32)
        total = np.zeros_like(points)
        np.add.at(total, label, sample)
        empty = load == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        points = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return points, label


def train_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> Centroids:
    """Centroids (neighbouring ones have neighbouring numbers where there are two levels), then their exact neighbour graph."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    if lists <= FLAT:
        points = _clusters(sample, lists, rng, rounds)[0]
        order = _clusters(points, int(lists**0.5), rng, rounds)[1].argsort(kind="stable")
        points = points[order]
    else:
        _, label = _clusters(sample, int(lists**0.5), rng, rounds)
        parts = [sample[label == k] for k in range(label.max() + 1)]
        points = np.concatenate([_clusters(own, max(1, round(lists * len(own) / len(sample))), rng, rounds)[0] for own in parts if len(own)])
    lists, near = len(points), []
    for at in range(0, lists, 1024):
        like = points[at : at + 1024] @ points.T
        like[np.arange(len(like)), at + np.arange(len(like))] = -np.inf
        near.append(np.argpartition(-like, min(DEGREE, lists - 1) - 1, axis=1)[:, : max(1, min(DEGREE, lists - 1))] if lists > 1 else np.zeros((1, 1), int))
    # Far links join regions that neighbours alone would leave apart.
    return Centroids(points, np.concatenate([np.concatenate(near), rng.integers(0, lists, (lists, 4))], axis=1), np.unique(rng.choice(lists, min(lists, 32), replace=False)))


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


#: Pairs of vectors that one task compares at once, and pairs that may tie whose exact cosines it takes at once.
PAIRS, TIED = 1 << 18, 1 << 14


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", read_ratio: float | None = None, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest rows by cosine of each row that ``queries`` marks: ``query_id, rank, vec_id, score``.

    Every usable row is in the index. Equal vectors are indexed once, with their k + 1 smallest ids,
    which is all that a result can show of them; that keeps groups of copies small and loses nothing.
    Without a ``read_ratio`` it is measured (``reading_ratio``); ``float("inf")`` makes the search exact.

    Defined cases: rows with a null id and vectors that are null, empty, zero or hold null or non-finite
    components take no part, as do vectors of another dimension than the most common one (the smallest
    such, if tied); repeated rows with one id count once, and rows with the query's own id are never its
    neighbours; equal scores are ordered by id, in bounded memory however many tie; other columns are ignored, so
    their names can't clash; a table with fewer candidates returns all of them, and an
    empty one nothing.
    """
    spark = vectors.sparkSession
    tables = WorkTables(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if width is None:
        return spark.createDataFrame([], out)
    width = width["d"]
    rows = rows.where(F.size("v") == width)

    few = Window.partitionBy("v").orderBy("vec_id")
    classes = rows.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    classes = classes.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id())
    classes = tables.save(classes, "classes")
    n = classes.count()
    lists = max(1, min(n // LEAST, int(LISTS * n**0.5)))
    span = 1 << 30
    largest = F.array_max(F.transform("v", F.abs))
    scaled = F.transform(F.array(largest), lambda m: F.transform("v", lambda x: (x / m).cast("float")))[0]
    wanted = SAMPLE_EACH * lists
    chosen = classes.where(F.pmod(F.xxhash64("v", F.lit("train")), F.lit(span)) <= int(min(1.0, wanted / max(1, n)) * span)).orderBy(F.xxhash64("v")).limit(2 * wanted).select(scaled.alias("v")).toArrow()
    centroids = train_centroids(_unit(_matrix(chosen.column("v"), width)), lists) if chosen.num_rows else Centroids(np.eye(1, width, dtype=np.float32), np.zeros((1, 1), int), np.zeros(1, int))
    held = spark.sparkContext.broadcast(centroids)  # LISTS * sqrt(n) centroids: for 100 million vectors of 64 numbers, 20 MB

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                unit = _unit(_matrix(part.column(1), width))
                place, distance = held.value.search(unit, 16)
                close = distance[:, :COPIES] <= distance[:, :1] * COPY_RATIO + 1e-6
                close[:, 0] = True
                who, j = np.nonzero(close)
                yield pa.RecordBatch.from_arrays([pa.array(place[who, j], pa.int64()), part.column(0).take(pa.array(who))], ["list", "cid"])

    posted = tables.save(classes.select("cid", "v").mapInArrow(post, "list bigint, cid bigint"), "postings")
    sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
    size_of = np.array([sizes.get(i, 0) for i in range(len(centroids.points))])
    # Parts of consecutive lists; blocks of each part.
    together = max(1, round(PART * len(size_of) / max(1, n)))
    blocks = np.maximum(1, -(-np.add.reduceat(size_of, np.arange(0, len(size_of), together)) // BLOCK))

    # Equal query vectors are searched once.
    asked = rows.where("asks").select("vec_id", "v").distinct()
    asking = tables.save(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "queries")
    if read_ratio is None:
        read_ratio, in_reach = reading_ratio(asking, classes, posted, centroids, k, width)
        beam = max(beam, int(1.5 * in_reach))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                place, distance = held.value.within(_unit(_matrix(part.column(1), width)), read_ratio, beam)
                reach = distance <= distance[:, :1] * read_ratio + 1e-6 if np.isfinite(read_ratio) else np.ones(place.shape, bool)
                before = np.cumsum(size_of[place], axis=1) - size_of[place]
                reach |= before < 8 * (k + 1)  # lists enough for a whole answer
                who, j = np.nonzero(reach)
                number = place[who, j]
                order = np.lexsort((number, number // together, who))
                who, number = who[order], number[order]
                own = number // together
                first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (own[1:] != own[:-1])])
                listed = pa.ListArray.from_arrays(pa.array(np.r_[first, len(own)], pa.int32()), pa.array(number, pa.int64()))
                who, own = who[first], own[first]
                again = np.repeat(np.arange(len(own)), blocks[own])
                block = np.arange(len(again)) - np.repeat(np.cumsum(blocks[own]) - blocks[own], blocks[own])
                rows = pa.array(who[again])
                yield pa.RecordBatch.from_arrays([pa.array(own[again], pa.int64()), pa.array(block, pa.int64()), listed.take(pa.array(again)), part.column(0).take(rows), part.column(1).take(rows)], ["part", "block", "lists", "qid", "q"])

    routed = tables.save(asking.select("qid", "v").mapInArrow(route, "part bigint, block bigint, lists array<bigint>, qid bigint, q array<double>"), "routed")
    # Queries of one block are dealt over several groups where there are many.
    many = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    deals = np.array([max(1, -(-many.get(i, 0) // int(blocks[i]) // 2048)) for i in range(len(blocks))])
    plan = spark.createDataFrame(pd.DataFrame({"part": np.arange(len(blocks)), "blocks": blocks.astype(np.int64), "deals": deals.astype(np.int64)}), "part bigint, blocks bigint, deals bigint")
    left = routed.join(plan, "part").withColumn("deal", F.pmod(F.xxhash64("qid"), F.col("deals"))).select("part", "block", "deal", "lists", "qid", "q")
    right = (
        posted.withColumn("part", F.floor(F.col("list") / together)).join(plan, "part").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)))
        .select("part", "block", "deal", "list", "cid").join(classes.select("cid", "v", F.col("ids")[0].alias("least")), "cid")
    )

    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"qid": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "least": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(q) or not len(p):
            return nothing
        vectors, asked_lists = np.stack(q["q"].to_numpy()), q["lists"].to_numpy()
        at, listed = np.repeat(np.arange(len(q)), [len(x) for x in asked_lists]), np.concatenate(asked_lists)
        parts = []
        for number, own in p.groupby("list"):
            rows = at[listed == number]
            if len(rows):
                least = own["least"].to_numpy()
                i, j, score = best_of(vectors[rows], np.stack(own["v"].to_numpy()), least, k + 1)
                parts.append(pd.DataFrame({"qid": q["qid"].to_numpy()[rows[i]], "cid": own["cid"].to_numpy()[j], "least": least[j], "score": score}))
        if not parts:
            return nothing
        found = pd.concat(parts).drop_duplicates(["qid", "cid"])  # copies in several lists
        return found.sort_values(["qid", "score", "least"], ascending=[True, False, True]).groupby("qid").head(k + 1)

    group = ["part", "block", "deal"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(compare, "qid bigint, cid bigint, least bigint, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "least")
    found = found.groupBy("qid", "cid", "least").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * (k + 1)).drop("least")
    found = found.join(classes.select("cid", "ids"), "cid")
    # Back to the single queries of each vector, and to the single rows of each neighbour.
    each = asked.withColumnRenamed("vec_id", "query_id").join(asking, "v").select("query_id", "qid")
    pairs = each.join(found, "qid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(a: np.ndarray, b: np.ndarray, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, rows of ``b`` and cosines: the ``top`` best of each row of ``a`` by (score, smallest id)."""
    top = min(top, len(b))
    unit_a, unit_b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    rows, out = max(1, PAIRS // len(b)), []
    for at in range(0, len(a), rows):
        like = unit_a[at : at + rows] @ unit_b.T
        last = np.partition(like, len(b) - top, axis=1)[:, len(b) - top]
        i, j = np.nonzero(like >= last[:, None] - 1e-9)  # with all that may tie with the last
        # Many may tie, so their vectors are taken some at a time.
        score = np.concatenate([cosine(a[at + i[x : x + TIED]], b[j[x : x + TIED]]) for x in range(0, len(i), TIED)])
        order = np.lexsort((least[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < top
        out.append((at + i[keep], j[keep], score[keep]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def reading_ratio(asking: DataFrame, classes: DataFrame, posted: DataFrame, centroids: Centroids, k: int, width: int) -> tuple[float, float]:
    """The distance ratio at which a bounded sample of queries reaches ``RECALL`` of its true neighbours.

    With it, the number of lists within that ratio of a query. The sample is compared with every vector of
    the table. A neighbour is found once the nearest of its
    lists is in reach, so the ratio is a quantile of (distance of that list / distance of the nearest).
    """
    span = 1 << 30
    share = int(min(1.0, PROBES / max(1, asking.count())) * span)
    rule = F.pmod(F.xxhash64("v", F.lit("probe")), F.lit(span)) <= share
    probes = asking.where(rule).orderBy(F.xxhash64("v")).limit(2 * PROBES).select("qid", "v").toArrow()
    if not probes.num_rows:
        return 1.0, 1.0
    ids, vectors = probes.column("qid").to_numpy(), _matrix(probes.column("v"), width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                i, j, score = best_of(vectors, _matrix(part.column(2), width), least := part.column(1).to_numpy(), k + 1)
                both = [np.concatenate(x) for x in zip(held, (i, part.column(0).to_numpy()[j], least[j], score), strict=True)]
                order = np.lexsort((both[2], -both[3], both[0]))
                who = both[0][order]
                order = order[np.arange(len(who)) - np.searchsorted(who, who) <= k]
                held = tuple(x[order] for x in both)
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), *map(pa.array, held[1:])], ["probe", "cid", "least", "score"])

    near = classes.select("cid", F.col("ids")[0].alias("least"), "v").mapInArrow(scan, "probe bigint, cid bigint, least bigint, score double")
    best = Window.partitionBy("probe").orderBy(F.desc("score"), "least")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    asks = asking.sparkSession.createDataFrame(pd.DataFrame({"probe": np.arange(len(ids)), "qid": ids}), "probe bigint, qid bigint")
    near = near.join(F.broadcast(asks), "probe").where("least <> qid").select("probe", "cid")
    at = posted.join(F.broadcast(near), "cid").select("probe", "cid", "list").toPandas()  # 2 * PROBES * (k + 1) * COPIES rows at most
    if not len(at):
        return 1.0, 1.0
    unit = _unit(vectors)
    distance = np.sqrt(np.maximum(0, 2 - 2 * unit @ centroids.points.T))
    at["ratio"] = distance[at["probe"], at["list"]] / np.maximum(distance.min(axis=1)[at["probe"]], 1e-6)
    ratio = max(1.0, float(np.quantile(at.groupby(["probe", "cid"])["ratio"].min(), RECALL, method="higher")))
    return ratio, float((distance <= distance.min(axis=1, keepdims=True) * ratio + 1e-6).sum(axis=1).mean())


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, the same for a pair wherever it is computed."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
