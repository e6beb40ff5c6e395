"""Large single graphs: copy numbers and cycles."""

import heapq
import random
import time

import numpy as np
import pandas as pd
import pytest

from breakweave.operators import amplicons, graph


def ring(n, more, seed):
    """A ring of n segments with further edges between random vertices: rows of (edge, kind, v1, v2, cost, count)."""
    rng = random.Random(seed)
    vertices = [f"{i}{s}" for i in range(n) for s in "-+"]
    rows = [(f"s:{i:05d}", "sequence", f"{i}-", f"{i}+", rng.uniform(1, 40)) for i in range(n)]
    rows += [(f"c:{i:05d}", "concordant", f"{i}+", f"{(i + 1) % n}-", 0.5) for i in range(n)]
    rows += [(f"d:{i:05d}", "discordant", *rng.choices(vertices, k=2), 0.5) for i in range(more)]
    return [(*row, rng.choice((0, 0, 1, 3)) if row[1] == "discordant" else int(row[4] * rng.uniform(3, 6))) for row in rows]


def test_copy_numbers_of_a_large_graph(spark):
    """A dense matrix of this graph took minutes a step. The minimum is where flows balance and cn x slack is the count."""
    rows = ring(1000, 400, 3)
    start = time.monotonic()
    got = dict(graph.copy_numbers(spark.createDataFrame([("a", *row) for row in rows], "amplicon string, edge string, kind string, v1 string, v2 string, cost double, count bigint")).select("edge", "cn").collect())
    assert time.monotonic() - start < 60
    flow = {}
    for edge, kind, v1, v2, *_ in rows:
        for v in (v1, v2):
            flow[v] = flow.get(v, 0) + (got[edge] if kind == "sequence" else -got[edge])
    assert max(map(abs, flow.values())) < 1e-5
    place = {v: k for k, v in enumerate(flow)}
    matrix = np.zeros((len(flow), len(rows)))
    for j, (_, kind, v1, v2, *_) in enumerate(rows):
        for v in (v1, v2):
            matrix[place[v], j] += 1 if kind == "sequence" else -1
    cost, count = np.array([r[4] for r in rows]), np.array([r[5] for r in rows], float)
    x = graph.solve_flow(cost, count, matrix)
    slack = np.maximum(count, 1e-4) / x
    nu = np.linalg.lstsq(matrix @ matrix.T, matrix @ (slack - cost), rcond=1e-12)[0]
    assert abs(matrix.T @ nu - slack + cost).max() < 1e-6 * slack.max()


def plain_walk(start, weight, breaks, spans):
    """The widest closed walk, searched through the whole graph."""
    heap, best, n = [(-float("inf"), 0, start, ())], {}, 0
    while heap:
        width, _, at, path = heapq.heappop(heap)
        width = -width
        if path and at == start:
            return width, path
        if best.get(at, -1) >= width:
            continue
        best[at] = width
        for edge, other in breaks.get(at, ()):
            through, after = min(width, weight[edge] / (1 + path.count(edge))), (*path, edge)
            if other in spans:
                span, other = spans[other]
                if span in path:
                    through = min(through, weight[span] / (1 + path.count(span)))
                after = (*after, span)
            if through > 0:
                n += 1
                heapq.heappush(heap, (-through, n, other, after))
    return 0.0, ()


def plain_cycles(frame, least=0.1, enough=0.9):
    """Cycles by searching from every vertex after each of them."""
    frame = frame.sort_values("edge")
    weight, size = dict(zip(frame["edge"], frame["cn"])), dict(zip(frame["edge"], frame["size"]))
    breaks, spans = graph._steps(frame)
    total, covered, found = sum(weight[e] * s for e, s in size.items()), 0.0, []
    while covered <= total:
        walks = [plain_walk(v, weight, breaks, spans) for v in sorted({v for e, v in zip(frame["edge"], frame["v1"]) if weight[e] >= least} & set(breaks))]
        cn, path = max(walks, key=lambda w: (w[0], [-ord(c) for c in "".join(w[1])]), default=(0.0, ()))
        if cn <= least or found and covered > enough * total and cn <= 0.2 * found[0][0]:
            break
        for e in path:
            weight[e] -= cn
        weight = {e: max(0.0, w) for e, w in weight.items()}
        covered += cn * sum(size[e] for e in path)
        found.append((cn, ",".join(path)))
    return [(k + 1, round(cn, 6), path) for k, (cn, path) in enumerate(found)]


def weighted(rows, weigh, seed):
    rng = random.Random(seed)
    ends = [("o:" + v, "source", "source", v) for v in sorted({r[2] for r in rows})[:3]]
    return pd.DataFrame([("a", *r[:4], weigh(rng), float(rng.randint(1, 50)) if r[1] == "sequence" else 0.0) for r in [*rows, *ends]], columns=["amplicon", "edge", "kind", "v1", "v2", "cn", "size"])


@pytest.mark.parametrize("whole", [True, False])
def test_cycles_equal_a_search_from_every_vertex(whole):
    """Ties included, and walks that pass an edge twice."""
    twice = 0
    for seed in range(150):
        frame = weighted(ring(2 + seed % 9, seed % 11, seed), lambda rng: float(rng.randint(0, 6)) if whole else rng.uniform(0.05, 8), seed)
        expected = plain_cycles(frame)
        assert list(graph.peel_cycles(frame)[["cycle", "cn", "path"]].itertuples(index=False, name=None)) == expected
        twice += sum(len(set(path.split(","))) < len(path.split(",")) for _, _, path in expected)
    assert twice >= 10


def test_cycles_of_a_large_graph():
    """Searching from each of 1,600 vertices for each cycle took minutes."""
    frame = weighted(ring(800, 300, 5), lambda rng: rng.uniform(0.05, 8), 5)
    start = time.monotonic()
    found = graph.peel_cycles(frame)
    assert time.monotonic() - start < 30
    assert len(found) > 40
    left = dict(zip(frame["edge"], frame["cn"]))
    for cn, path in zip(found["cn"], found["path"]):
        for edge in path.split(","):
            left[edge] -= cn
    assert all(w > -1e-3 for e, w in left.items() if not e.startswith("s:"))


def test_segments_of_a_large_graph(spark):
    """From edges to numbered segments: each step of a cycle stands for the sequence edges of its walk."""
    place = lambda v: f"a:{int(v[:-1]) * 100 + (1 if v[-1] == '-' else 100)}{v[-1]}"
    frame = weighted([(e, kind, place(v1), place(v2)) for e, kind, v1, v2, *_ in ring(800, 300, 6)], lambda rng: rng.uniform(0.05, 8), 6)
    frame = frame[frame["kind"] != "source"]
    frame.loc[frame["edge"] == "c:00799", "kind"] = "discordant"  # from the end to the beginning
    start = time.monotonic()
    edges = spark.createDataFrame(frame)
    walks = graph.decompose(edges).collect()
    segments, cycles = amplicons.cycle_segments(edges, spark.createDataFrame(walks))
    length = {r.seg: r.end - r.start + 1 for r in segments.collect()}
    shown = {r.cycle: sum(length[s.seg] for s in r.segments) for r in cycles.collect()}
    assert time.monotonic() - start < 90
    assert len(walks) > 30
    assert shown == {w.cycle: 100 * sum(e.startswith("s:") for e in w.path.split(",")) for w in walks}
