"""Copy-number segmentation of a coverage series by mean shift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meanshift_scores(series: DataFrame, n: int, bandwidth: float, height: float, reference: float) -> DataFrame:
    """``series`` (chrom, win, depth) with ``shift``: where a window's mean shift points, over ``n`` neighbours each side.

    The kernel falls off with distance (``bandwidth``) and with difference in depth; a low depth uses half
    the ``height``, others its square-root scaling by ``reference``.
    """
    order = Window.partitionBy("chrom").orderBy("win")
    around = order.rowsBetween(-n, n)
    width = F.when(F.col("depth") < reference / 4, F.lit(height / 2)).otherwise(F.sqrt(F.col("depth") / reference) * height)
    near = F.collect_list(F.struct("win", "depth")).over(around)
    pull = F.aggregate(
        "near", F.lit(0.0),
        lambda a, x: a + (x["win"] - F.col("win")) * F.exp(-((x["win"] - F.col("win")) ** 2) / (2 * bandwidth**2)) * F.exp(-((x["depth"] - F.col("depth")) ** 2) / (2 * F.col("h") ** 2)),
    )
    return series.withColumn("near", near).withColumn("h", width).withColumn("shift", pull).drop("near", "h")


def zero_cross_segments(scores: DataFrame, order_col: str = "win") -> DataFrame:
    """Segments between places where the shift turns from not positive to positive: ``chrom, seg, start_win, end_win, n, mean``."""
    order = Window.partitionBy("chrom").orderBy(order_col)
    turns = ((F.col("shift") > 0) & (F.lag("shift").over(order) <= 0)).cast("bigint")
    rows = scores.withColumn("seg", F.sum(F.coalesce(turns, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("chrom", "seg").agg(F.min("win").alias("start_win"), F.max("win").alias("end_win"), F.count("*").alias("n"), F.avg("depth").alias("mean"), F.var_samp("depth").alias("variance"))


def welch_t(segments: DataFrame) -> DataFrame:
    """Welch's t between each segment and the next one of its chromosome; null where a side has one window or no spread."""
    order = Window.partitionBy("chrom").orderBy("seg")
    after = lambda c: F.lead(c).over(order)
    spread = F.col("variance") / F.col("n") + after("variance") / after("n")
    return segments.select("chrom", "seg", F.when(spread > 0, (F.col("mean") - after("mean")) / F.sqrt(spread)).alias("t"))


def significant(left: Column, right: Column) -> Column:
    """A copy-number step that counts: at least 1, or a tenth or the root of the larger side, whichever is less."""
    top = F.greatest(left, right)
    return F.abs(left - right) >= F.greatest(F.lit(1.0), F.least(top / 10, F.sqrt(top)))


def beta_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    if x <= 0:
        return 1.0 if flip else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        step = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / max(1 + step * d, 1e-300)
        c = max(1 + step / c, 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    value = front * (f - 1)
    return min(1.0, max(0.0, 1 - value if flip else value))


def step_p(left: np.ndarray, right: np.ndarray) -> float:
    """p of a step between two runs of windows: Welch, or a normal tail where one side is a single window."""
    if min(len(left), len(right)) == 0 or max(len(left), len(right)) < 2:
        return 1.0
    if min(len(left), len(right)) == 1:
        one, many = (left, right) if len(left) == 1 else (right, left)
        sd = many.std(ddof=1)
        return 1.0 if sd == 0 else math.erfc(abs(one[0] - many.mean()) / sd / math.sqrt(2))
    va, vb = left.var(ddof=1) / len(left), right.var(ddof=1) / len(right)
    if va + vb == 0:
        return 0.0 if left.mean() != right.mean() else 1.0
    df = (va + vb) ** 2 / (va**2 / (len(left) - 1) + vb**2 / (len(right) - 1))
    return beta_tail((left.mean() - right.mean()) / math.sqrt(va + vb), df)


def _bounds(depth: np.ndarray, bandwidth: int, height: float, reference: float, frozen: set[int]) -> list[int]:
    n = min(len(depth), 3 * bandwidth)
    h = np.where(depth < reference / 4, height / 2, np.sqrt(np.maximum(depth, 0) / reference) * height)
    pull = np.zeros(len(depth))
    for j in range(1, n):
        w = j * math.exp(-(j**2) / (2 * bandwidth**2))
        for a, b in ((slice(None, -j), slice(j, None)), (slice(j, None), slice(None, -j))):
            sign = 1 if a == slice(None, -j) else -1
            pull[a] += sign * w * np.exp(-((depth[b] - depth[a]) ** 2) / (2 * np.maximum(h[a], 1e-9) ** 2))
    turns = {i for i in range(1, len(depth)) if pull[i] > 0 >= pull[i - 1]}
    return sorted(turns | frozen)


def segment_series(depth: np.ndarray, alpha: float = 0.01, bandwidths: tuple[int, ...] = (2, 5, 10, 50, 100)) -> list[int]:
    """Starts of segments: finer to coarser bandwidths, significant bounds freezing, then insignificant steps merged until none is left."""
    reference = float(np.median(depth[depth > 0])) if (depth > 0).any() else 1.0
    height = float(np.std(depth[depth < 5 * reference])) or 1.0
    smooth, frozen = depth.astype(float), set()
    bounds: list[int] = []
    for hb in bandwidths:
        bounds = _bounds(smooth, hb, height, reference, frozen)
        parts = np.split(depth, bounds)
        smooth = np.concatenate([np.full(len(p), p.mean()) for p in parts if len(p)])
        for i, at in enumerate(bounds):
            left, right = parts[i], parts[i + 1]
            big = abs(left.mean() - right.mean()) > 3 * math.sqrt(max(left.mean(), right.mean()) / reference) * height
            if (min(len(left), len(right)) < 15 and big) or step_p(left, right) < alpha:
                frozen.add(at)
    bounds = sorted(frozen)
    while bounds:
        parts = np.split(depth, bounds)
        worst = max(range(len(bounds)), key=lambda i: step_p(parts[i], parts[i + 1]))
        if step_p(parts[worst], parts[worst + 1]) <= alpha:
            break
        bounds.pop(worst)
    # Only steps that count as copy-number shifts stay, the least one going first.
    while bounds:
        level = [2 * float(p.mean()) / reference for p in np.split(depth, bounds)]
        need = [max(1.0, min(max(a, b) / 10, math.sqrt(max(a, b, 0)))) for a, b in zip(level, level[1:], strict=False)]
        short = [abs(a - b) - n for a, b, n in zip(level, level[1:], need, strict=False)]
        if min(short) >= 0:
            break
        bounds.pop(int(np.argmin(short)))
    return [0, *bounds]


def meanshift_segments(series: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Copy-number segments per chromosome of ``series`` (chrom, win, depth): ``chrom, seg, start_win, end_win, copy_number``.

    The walk over bandwidths is sequential along one chromosome's windows, so a chromosome is one group;
    its windows are what is left of all reads after aggregation.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("win")
        depth = frame["depth"].to_numpy(float)
        starts = segment_series(depth, alpha)
        ends = [*starts[1:], len(depth)]
        middle = float(np.sort(depth)[len(depth) // 2]) or 1.0
        win = frame["win"].to_numpy()
        return pd.DataFrame({"chrom": frame["chrom"].iloc[0], "seg": range(len(starts)), "start_win": win[starts], "end_win": win[np.array(ends) - 1], "copy_number": [round(2 * float(depth[a:b].mean()) / middle, 6) for a, b in zip(starts, ends, strict=True)]})

    return series.select("chrom", "win", "depth").groupBy("chrom").applyInPandas(run, "chrom string, seg bigint, start_win bigint, end_win bigint, copy_number double")


def refined_segments(coarse: DataFrame, fine: DataFrame, ratio: int, reach: int = 3) -> DataFrame:
    """Segments of the ``coarse`` series with their bounds moved to bounds of the ``fine`` one: ``chrom, start, end, copy_number, start_refined, end_refined``.

    Both are (chrom, win, depth); ``ratio`` fine windows make a coarse one, and places are in fine windows.
    Fine windows are segmented only within ``reach`` coarse windows of a coarse bound, each run of such
    windows by itself. A bound moves to the nearest fine bound that steps the same way and lies at most
    two coarse windows away (ties: the first); without one it stays.
    """
    order = Window.partitionBy("chrom").orderBy("start_win")
    rough = meanshift_segments(coarse, 0.0027).withColumn("before", F.lag("copy_number").over(order))
    bounds = rough.where("before is not null").select("chrom", (F.col("start_win") * ratio).alias("pos"), F.signum(F.col("copy_number") - F.col("before")).alias("way"))
    # A fine window is near a bound if its coarse window is; runs of near windows are series of their own.
    near = bounds.select("chrom", F.explode(F.sequence(F.floor(F.col("pos") / ratio) - reach, F.floor(F.col("pos") / ratio) + reach - 1)).alias("k")).distinct()
    runs = near.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("chrom").orderBy("k")))
    series = fine.withColumn("k", F.floor(F.col("win") / ratio)).join(runs, ["chrom", "k"]).select(F.concat_ws("/", "chrom", "run").alias("chrom"), "win", "depth")
    parts = meanshift_segments(series, 0.05).withColumn("before", F.lag("copy_number").over(order)).where("before is not null")
    exact = parts.select(F.regexp_extract("chrom", "^(.*)/", 1).alias("chrom"), F.col("start_win").alias("at"), F.signum(F.col("copy_number") - F.col("before")).alias("way"))
    met = bounds.join(exact, ["chrom", "way"]).where(F.abs(F.col("pos") - F.col("at")) <= 2 * ratio)
    best = met.groupBy("chrom", "pos").agg(F.min(F.struct(F.abs(F.col("pos") - F.col("at")), "at"))["at"].alias("at"))
    placed = rough.select("chrom", "copy_number", (F.col("start_win") * ratio).alias("pos"), ((F.col("end_win") + 1) * ratio).alias("stop")).join(best, ["chrom", "pos"], "left")
    along = Window.partitionBy("chrom").orderBy("pos")
    start = F.coalesce("at", "pos")
    return placed.select("chrom", start.alias("start"), (F.coalesce(F.lead(start).over(along), "stop") - 1).alias("end"), "copy_number", F.col("at").isNotNull().alias("start_refined"), F.coalesce(F.lead("at").over(along).isNotNull(), F.lit(False)).alias("end_refined"))
