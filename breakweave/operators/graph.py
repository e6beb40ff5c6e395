"""Breakpoint graphs: construction, copy numbers, cycles."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_edges(cuts: DataFrame) -> DataFrame:
    """Tiles between cuts: from ``cuts`` (amplicon, chrom, pos = last base before a cut) to ``amplicon, chrom, start, end``."""
    order = Window.partitionBy("amplicon", "chrom").orderBy("pos")
    points = cuts.select("amplicon", "chrom", "pos").distinct()
    return points.select("amplicon", "chrom", (F.col("pos") + 1).alias("start"), F.lead("pos").over(order).alias("end")).where("end is not null")


def concordant_edges(tiles: DataFrame) -> DataFrame:
    """Between each tile and the next one touching it: ``amplicon, chrom, pos1 (+), pos2 (-)``."""
    order = Window.partitionBy("amplicon", "chrom").orderBy("start")
    return tiles.select("amplicon", "chrom", F.col("end").alias("pos1"), F.lead("start").over(order).alias("pos2")).where("pos2 = pos1 + 1")


def flow_constraints(edges: DataFrame) -> DataFrame:
    """Non-zero entries of the flow matrix: per sequence-edge end +1 for the sequence edge and -1 per incident other edge end.

    ``edges`` (amplicon, edge, kind, v1, v2): both ends of a loop count. Result ``amplicon, vertex, edge, value``.
    """
    ends = edges.select("amplicon", "edge", "kind", F.explode(F.array("v1", "v2")).alias("vertex"))
    entries = ends.groupBy("amplicon", "vertex", "edge").agg(F.sum(F.when(F.col("kind") == "sequence", 1).otherwise(-1)).cast("bigint").alias("value"))
    held = ends.where("kind = 'sequence'").select("amplicon", "vertex").distinct()
    return entries.join(held, ["amplicon", "vertex"], "left_semi")


class _Elimination:
    """The order in which the unknowns of a sparse symmetric system are eliminated, found once for all its values.

    ``pairs`` (i < j, distinct) are the places off the diagonal. Unknowns with few neighbours go first,
    in rounds of unknowns that are no neighbours of each other, so a round is a handful of array
    operations; where few unknowns or only well connected ones are left, the rest is a dense system.
    """

    def __init__(self, n: int, pairs: list[tuple[int, int]], small: int = 64):
        self.slots = {p: k for k, p in enumerate(pairs)}
        near = [set() for _ in range(n)]
        for i, j in pairs:
            near[i].add(j)
            near[j].add(i)
        alive, self.rounds = set(range(n)), []
        while len(alive) > small:
            order = sorted(alive, key=lambda v: (len(near[v]), v))
            most = max(2, len(near[order[0]]) + 1)
            if most > len(alive) // 3:
                break
            chosen, shut = [], set()
            for v in order:
                if len(near[v]) > most:
                    break
                if v not in shut:
                    chosen.append(v)
                    shut |= near[v]
            at, arms, owner, a, b, into, by = [], [], [], [], [], [], []
            for k, v in enumerate(chosen):
                alive.discard(v)
                around, first = sorted(near[v]), len(arms)
                at += [self.slots[min(v, u), max(v, u)] for u in around]
                arms += around
                owner += [k] * len(around)
                for x, u in enumerate(around):
                    near[u].discard(v)
                    for y in range(x + 1, len(around)):
                        w = around[y]
                        near[u].add(w)
                        near[w].add(u)
                        a.append(first + x)
                        b.append(first + y)
                        by.append(k)
                        into.append(self.slots.setdefault((u, w), len(self.slots)))
            self.rounds.append(tuple(np.array(x, np.int64) for x in (chosen, at, arms, owner, a, b, into, by)))
        self.rest = np.array(sorted(alive), np.int64)
        place = {v: k for k, v in enumerate(self.rest.tolist())}
        kept = [(place[i], place[j], k) for (i, j), k in self.slots.items() if i in place and j in place]
        self.kept = np.array(kept, np.int64).reshape(-1, 3)

    def solve(self, diagonal: np.ndarray, off: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The solution for the values of the diagonal and of ``pairs``, which must make no negative matrix."""
        d = diagonal * (1 + 1e-13) + 1e-300  # a singular system with a solution gets one
        value = np.zeros(len(self.slots))
        value[: len(off)] = off
        y, arms_of = right.astype(float), []
        for chosen, at, arms, owner, a, b, into, by in self.rounds:
            pivot = d[chosen]
            arm = value[at]
            share = arm / pivot[owner]
            np.subtract.at(d, arms, arm * share)
            np.subtract.at(value, into, arm[a] * arm[b] / pivot[by])
            np.subtract.at(y, arms, share * y[chosen][owner])
            arms_of.append((pivot, share))
        x = np.zeros(len(d))
        if len(self.rest):
            dense = np.diag(d[self.rest])
            i, j, k = self.kept.T
            dense[i, j] = value[k]
            dense[j, i] = value[k]
            scale = 1 / np.sqrt(np.maximum(np.diag(dense), 1e-300))
            x[self.rest] = scale * np.linalg.lstsq(dense * scale[:, None] * scale, scale * y[self.rest], rcond=1e-13)[0]
        for (chosen, _, arms, owner, *_), (pivot, share) in zip(reversed(self.rounds), reversed(arms_of), strict=True):
            x[chosen] = y[chosen] / pivot - np.bincount(owner, share * x[arms], len(chosen))
        return x


def _unforced(n: int, m: int, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of the ``n`` edges may be above zero: a vertex whose entries all have one sign forces its edges to zero, which may force others."""
    free = np.ones(n, bool)
    of_row, of_column = [[] for _ in range(m)], [[] for _ in range(n)]
    plus, minus = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i, j, x in zip(row.tolist(), column.tolist(), value.tolist(), strict=True):
        of_row[i].append(j)
        of_column[j].append((i, x > 0))
        if x > 0:
            plus[i] += 1
        else:
            minus[i] += 1
    todo = [i for i in range(m) if not (plus[i] and minus[i])]
    while todo:
        for j in of_row[todo.pop()]:
            if free[j]:
                free[j] = False
                for i, up in of_column[j]:
                    if up:
                        plus[i] -= 1
                    else:
                        minus[i] -= 1
                    if not (plus[i] and minus[i]):
                        todo.append(i)
    return free


def solve_flow(cost: np.ndarray, count: np.ndarray, matrix: np.ndarray, rounds: int = 200) -> np.ndarray:
    """``solve_sparse_flow`` for a matrix with all its zeros."""
    row, column = np.nonzero(matrix)
    return solve_sparse_flow(cost, count, row, column, matrix[row, column], rounds)


def solve_sparse_flow(cost: np.ndarray, count: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Copy numbers that minimise cost . x - count . log x with matrix x = 0, by primal-dual Newton steps.

    ``row, column, value`` are the matrix's entries other than zero, each place once. A zero count is
    floored; an edge that the constraints force to zero gets zero. A step's system has a row per vertex and entries
    where two vertices share an edge; it is solved by elimination in an order that keeps it sparse.
    """
    x = np.zeros(len(cost))
    free = _unforced(len(cost), int(row.max()) + 1 if len(row) else 0, row, column, value)
    if not free.any():
        return x
    held = free[column]
    c, k = cost[free].astype(float), np.maximum(count[free], 1e-4).astype(float)
    vertices, i = np.unique(row[held], return_inverse=True)
    j, v = (np.cumsum(free) - 1)[column[held]], value[held].astype(float)
    n = len(vertices)
    # Products of two entries of one edge: with itself they add to the diagonal, with another vertex's off it.
    of_edge = defaultdict(list)
    for e, edge in enumerate(j.tolist()):
        of_edge[edge].append(e)
    two = np.array([(e, f) if i[e] < i[f] else (f, e) for entries in of_edge.values() for p, e in enumerate(entries) for f in entries[p + 1 :]], np.int64).reshape(-1, 2)
    places, place = np.unique(i[two[:, 0]] * n + i[two[:, 1]], return_inverse=True)
    order = _Elimination(n, [(p // n, p % n) for p in places.tolist()])
    up = lambda nu: np.bincount(j, v * nu[i], len(c))
    down = lambda x: np.bincount(i, v * x[j], n)
    reach = lambda a, d: min(1.0, 0.99 / max((-d / a).max(), 1e-300))
    # Counts begin at the largest one and are let down to their own step by step; at once, steps would end at their bounds.
    slack, wanted = c, k.max()
    y = np.maximum(k, wanted) / slack
    for _ in range(rounds if n else 0):
        goal, weight = np.maximum(k, wanted), y / slack
        along = up(order.solve(np.bincount(i, v * v * weight[j], n), np.bincount(place, v[two[:, 0]] * v[two[:, 1]] * weight[j[two[:, 0]]], len(places)), down(goal / slack)))
        change = goal / slack - y - weight * along
        t, u = reach(y, change), reach(slack, along)
        y, slack = y + t * change, slack + u * along
        if wanted <= k.min() and abs(y * slack / k - 1).max() < 1e-9 and abs(down(y)).max() <= 1e-9 * max(1.0, y.max()):
            break
        if min(t, u) > 0.3:
            wanted *= 0.1 if min(t, u) > 0.9 else 0.5
    x[free] = y
    return x


def copy_numbers(edges: DataFrame) -> DataFrame:
    """``edges`` (amplicon, edge, kind, v1, v2, cost, count) with fitted ``cn``: ``amplicon, edge, cn``. One graph is one group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("edge")
        rows = defaultdict(lambda: len(rows))
        held = {v for v1, v2, kind in zip(frame["v1"], frame["v2"], frame["kind"], strict=True) if kind == "sequence" for v in (v1, v2)}
        entries = defaultdict(int)
        for j, (v1, v2, kind) in enumerate(zip(frame["v1"], frame["v2"], frame["kind"], strict=True)):
            for v in (v1, v2):
                if v in held:
                    entries[rows[v], j] += 1 if kind == "sequence" else -1
        row, column = np.array(list(entries), np.int64).reshape(-1, 2).T
        x = solve_sparse_flow(frame["cost"].to_numpy(float), frame["count"].to_numpy(float), row, column, np.array(list(entries.values()), float))
        return pd.DataFrame({"amplicon": frame["amplicon"], "edge": frame["edge"], "cn": np.round(x, 6)})

    return edges.groupBy("amplicon").applyInPandas(run, "amplicon string, edge string, cn double")


def _steps(frame: pd.DataFrame) -> tuple[dict, dict]:
    """For each vertex its breakpoint edges (edge, other end), and its sequence edge (edge, other end)."""
    breaks, spans = defaultdict(list), {}
    for edge, kind, v1, v2 in zip(frame["edge"], frame["kind"], frame["v1"], frame["v2"], strict=True):
        if kind == "sequence":
            spans[v1], spans[v2] = (edge, v2), (edge, v1)
        else:
            breaks[v1].append((edge, v2))
            if v1 != v2:
                breaks[v2].append((edge, v1))
    return breaks, spans


def _arcs(frame: pd.DataFrame) -> tuple[dict, list[list[tuple[int, int, int]]]]:
    """Numbers of the vertices, and for each its arcs (breakpoint edge, sequence edge behind it or -1, vertex at the far end); edges are places in the frame."""
    number = defaultdict(lambda: len(number))
    breaks, spans = defaultdict(list), {}
    for edge, (kind, v1, v2) in enumerate(zip(frame["kind"], frame["v1"], frame["v2"], strict=True)):
        a, b = number[v1], number[v2]
        if kind == "sequence":
            spans[a], spans[b] = (edge, b), (edge, a)
        else:
            breaks[a].append((edge, b))
            if a != b:
                breaks[b].append((edge, a))
    return dict(number), [[(edge, *spans.get(other, (-1, other))) for edge, other in breaks.get(v, ())] for v in range(len(number))]


def widest_walk(start: int, weight: list[float], arcs: list, floor: float = 0.0, inside: dict | None = None) -> tuple[float, tuple[int, ...]]:
    """The closed walk through ``start`` (alternately breakpoint and sequence edges) with the largest bottleneck; an edge used twice counts half.

    Walks below ``floor`` are not looked for. ``inside`` holds, for the vertices on closed walks of edges of at least ``floor``, the group that such walks stay in.
    """
    heap, best, n = [(-float("inf"), 0, start, ())], {}, 0
    while heap:
        width, _, at, path = heapq.heappop(heap)
        width = -width
        if path and at == start:
            return width, path
        if best.get(at, -1) >= width:
            continue
        best[at] = width
        for edge, span, other in arcs[at]:
            if weight[edge] < floor or (inside is not None and inside.get(other) != inside[start]):
                continue
            through = min(width, weight[edge] / (1 + path.count(edge)))
            after = (*path, edge) if span < 0 else (*path, edge, span)
            if span in path:
                through = min(through, weight[span] / (1 + path.count(span)))
            if through > 0 and through >= floor:
                n += 1
                heapq.heappush(heap, (-through, n, other, after))
    return 0.0, ()


def _rings(least: float, weight: list[float], arcs: list, among: dict | None = None) -> dict[int, int]:
    """The vertices on closed walks of edges of at least ``least``, each with its strongly connected group, by an iterative depth-first search."""
    index, low, stack, on, group = {}, {}, [], set(), {}
    for root in range(len(arcs)) if among is None else among:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        todo = [(root, iter(arcs[root]))]
        while todo:
            at, rest = todo[-1]
            for edge, _, other in rest:
                if weight[edge] < least or (among is not None and other not in among):
                    continue
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    on.add(other)
                    todo.append((other, iter(arcs[other])))
                    break
                if other in on:
                    low[at] = min(low[at], index[other])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[at])
                if low[at] == index[at]:
                    members = []
                    while not members or members[-1] != at:
                        members.append(stack.pop())
                    on.difference_update(members)
                    if len(members) > 1 or any(other == at and weight[edge] >= least for edge, _, other in arcs[at]):
                        group.update(dict.fromkeys(members, at))
    return group


def _heaviest(weight: list[float], arcs: list, levels: list[float], starts: set[int], names: list[str]) -> tuple[float, float, tuple[int, ...]]:
    """Width and edges of the widest closed walk through any of ``starts`` that reaches the last of the falling ``levels`` (0 and none: no walk does); of equally wide ones the first by name.

    A walk of width w stays in a strongly connected group of the edges of at least w. So such groups are
    sought at falling levels, and walks are searched from the vertices in them only, along edges of the group. The
    first value returned is the level of the first groups: no walk is wider, now or when weights have fallen.
    """
    done, step, highest = 0, 4, None
    while done < len(levels):
        last = min(done + step, len(levels)) - 1
        groups = _rings(levels[last], weight, arcs)
        if groups and highest is None:
            while done < last:  # the first level with groups lies between
                middle = (done + last) // 2
                inner = _rings(levels[middle], weight, arcs, groups)
                if inner:
                    last, groups = middle, inner
                else:
                    done = middle + 1
            highest, step = levels[last], 2
        best, top = None, levels[last]
        # The least first name of a walk from each vertex; no walk is wider than the highest level, so behind one that reaches it only better names count.
        names_of = {v: min((names[edge] for edge, _, other in arcs[v] if weight[edge] >= top and groups.get(other) == groups[v]), default="") for v in starts & groups.keys()}
        for v in sorted(names_of, key=lambda v: (names_of[v], v)):
            if best and top >= highest and best[2][: len(names_of[v])] < names_of[v][: len(best[2])]:
                break
            width, path = widest_walk(v, weight, arcs, top, groups)
            if path:
                text = "".join(names[e] for e in path)
                key = (width, [-ord(c) for c in text])
                if best is None or key > best[0]:
                    best, top = (key, path, text), width
        if best:
            return highest, best[0][0], best[1]
        done, step = last + 1, 2 * step
    return 0.0, 0.0, ()


def peel_cycles(frame: pd.DataFrame, least: float = 0.1, enough: float = 0.9) -> pd.DataFrame:
    """Cycles of one graph, heaviest first, until what is left is light or the content is covered."""
    frame = frame.sort_values("edge")
    names, weight, size = frame["edge"].tolist(), frame["cn"].astype(float).tolist(), frame["size"].astype(float).tolist()
    number, arcs = _arcs(frame)
    leads = [number[v] for v in frame["v1"]]
    total, covered, first, bound = sum(w * s for w, s in zip(weight, size, strict=True)), 0.0, None, float("inf")
    found = []
    while covered <= total:
        starts = {v for v, w in zip(leads, weight, strict=True) if w >= least and arcs[v]}
        levels = sorted({weight[edge] for steps in arcs for edge, _, _ in steps if least < weight[edge] <= bound}, reverse=True) + [math.nextafter(least, math.inf)]
        bound, cn, path = _heaviest(weight, arcs, levels, starts, names)
        if not path:
            break
        first = first or cn
        content = sum(size[e] for e in path)
        for e in path:
            weight[e] -= cn
        for e in path:
            weight[e] = max(0.0, weight[e])
        if covered <= enough * total or cn > 0.2 * first:
            covered += cn * content
            found.append((frame["amplicon"].iloc[0], len(found) + 1, round(cn, 6), ",".join(names[e] for e in path)))
        else:
            break
    return pd.DataFrame(found, columns=["amplicon", "cycle", "cn", "path"])


def decompose(edges: DataFrame) -> DataFrame:
    """Weighted cycles of every graph in ``edges`` (amplicon, edge, kind, v1, v2, cn, size). One graph is one group."""
    return edges.groupBy("amplicon").applyInPandas(lambda frame: peel_cycles(frame), "amplicon string, cycle bigint, cn double, path string")


def shortest_paths(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Genomic length of the shortest walk from each graph's first vertex to every vertex: ``amplicon, vertex, distance``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["cn"] >= least].sort_values("edge")
        size = dict(zip(frame["edge"], frame["size"].astype(float), strict=True))
        breaks, spans = _steps(frame)
        out = []
        if len(spans):
            start = min(spans)
            seen, heap = {}, [(0.0, start)]
            while heap:
                d, v = heapq.heappop(heap)
                if v in seen:
                    continue
                seen[v] = d
                for _, other in breaks.get(v, ()):
                    heapq.heappush(heap, (d, other))
                    if other in spans:
                        e, far = spans[other]
                        heapq.heappush(heap, (d + size[e], far))
            out = [(frame["amplicon"].iloc[0], v, d) for v, d in sorted(seen.items())]
        return pd.DataFrame(out, columns=["amplicon", "vertex", "distance"])

    return edges.groupBy("amplicon").applyInPandas(run, "amplicon string, vertex string, distance double")


def pivot_cycle(segments: Column, i: int | Column, j: int | Column) -> Column:
    """A cycle (array of seg, orient) with the part after place i up to place j (from 1) turned round."""
    turned = F.transform(F.reverse(F.slice(segments, F.lit(i) + 1, F.lit(j) - F.lit(i))), lambda s: F.struct(s["seg"].alias("seg"), (-s["orient"]).alias("orient")))
    return F.concat(F.slice(segments, F.lit(1), F.lit(i)), turned, F.slice(segments, F.lit(j) + 1, F.greatest(F.lit(0), F.size(segments) - F.lit(j))))


def merge_cycles(first: Column, second: Column, i: int | Column, j: int | Column) -> Column:
    """The second cycle, opened at place j, put into the first after place i (places from 1); turned round if the two meet in opposite directions."""
    around = F.concat(F.slice(second, F.lit(j) + 1, F.greatest(F.lit(0), F.size(second) - F.lit(j))), F.slice(second, F.lit(1), F.lit(j)))
    turned = F.transform(F.reverse(around), lambda s: F.struct(s["seg"].alias("seg"), (-s["orient"]).alias("orient")))
    same = F.element_at(first, F.lit(i))["orient"] == F.element_at(second, F.lit(j))["orient"]
    return F.concat(F.slice(first, F.lit(1), F.lit(i)), F.when(same, around).otherwise(turned), F.slice(first, F.lit(i) + 1, F.greatest(F.lit(0), F.size(first) - F.lit(i))))


def merge_copies(first: Column, cn1: Column, second: Column, cn2: Column, i: int | Column, j: int | Column) -> Column:
    """Two cycles merged at places i and j (from 1): ``segments, cn`` with as many copies as both have, and what is left of each (``first_rest, second_rest``).

    Null if the segments at the two places differ, or if both cycles pass the source (segment 0).
    """
    passes = lambda c: F.exists(c, lambda s: s["seg"] == "0")
    same = F.element_at(first, F.lit(i))["seg"] == F.element_at(second, F.lit(j))["seg"]
    both = F.least(cn1, cn2)
    return F.when(same & ~(passes(first) & passes(second)), F.struct(merge_cycles(first, second, i, j).alias("segments"), both.alias("cn"), (cn1 - both).alias("first_rest"), (cn2 - both).alias("second_rest")))


def pivot_copies(segments: Column, cn: Column, i: int, j: int) -> Column:
    """A cycle with what lies between two opposite passes of one segment (places i < j) turned round: ``segments, cn`` with all its copies, none left (``rest``).

    Null if the places hold different segments or pass one the same way.
    """
    a, b = F.element_at(segments, i), F.element_at(segments, j)
    return F.when((a["seg"] == b["seg"]) & (a["orient"] == -b["orient"]), F.struct(pivot_cycle(segments, i, j - 1).alias("segments"), cn.alias("cn"), F.lit(0.0).alias("rest")))
