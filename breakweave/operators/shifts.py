"""Merging of copy-number shifts that are no steps, by Welch tests over trimmed runs of windows.

A run between two bounds, whole or without its first or last window, is a difference of two rows of a table
of running counts, sums and sums of squares. So each bound carries what that table says around it,
and every test of every round is arithmetic on a bound and its two neighbours.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runs import BIN, running_sums, with_neighbours
from .segmentation import beta_tail
from .work import WorkTables


def prefix_table(series: DataFrame, value: str, bin_width: int = BIN) -> DataFrame:
    """``series`` (chrom, win, value) with ``n, s, q``: windows, sum and sum of squares up to each window and with it."""
    v = F.col(value).cast("double")
    return running_sums(series.select("chrom", "win", value), "chrom", "win", {"n": F.lit(1).cast("bigint"), "s": v, "q": v * v}, bin_width)


def placed_bounds(series: DataFrame, bounds: DataFrame, value: str, tables: WorkTables, bin_width: int = BIN) -> DataFrame:
    """``bounds`` (chrom, win: a run's first window) as ``chrom, at, win, least, own, most, fixed``.

    ``at`` counts the windows before the bound; ``least``, ``own`` and ``most`` are the sums (s, q) over all but one of
    them, over them, and over one more. The ends of a chromosome are fixed bounds, ``win`` null behind the last.
    """
    table = tables.save(prefix_table(series, value, bin_width), "prefix")
    v = F.col(value).cast("double")
    sums = lambda s, q: F.struct(s.alias("s"), q.alias("q"))
    rows = with_neighbours(table, "chrom", "win", [value], bin_width)
    last = F.coalesce(F.col(f"before.{value}").cast("double"), F.lit(0.0))
    here = rows.join(bounds.select("chrom", "win").distinct(), ["chrom", "win"]).where("n > 1")
    first = F.col("s") - v, F.col("q") - v * v
    inner = here.select("chrom", (F.col("n") - 1).alias("at"), "win", sums(first[0] - last, first[1] - last * last).alias("least"), sums(*first).alias("own"), sums(F.col("s"), F.col("q")).alias("most"), F.lit(False).alias("fixed"))
    zero = sums(F.lit(0.0), F.lit(0.0))
    start = table.where("n = 1").select("chrom", F.lit(0).cast("bigint").alias("at"), "win", zero.alias("least"), zero.alias("own"), sums(F.col("s"), F.col("q")).alias("most"), F.lit(True).alias("fixed"))
    top = F.struct("n", "s", "q", F.col(value).cast("double").alias("v"))
    ends = table.groupBy("chrom").agg(F.max(top).alias("x")).select("chrom", "x.*")
    end = ends.select("chrom", F.col("n").alias("at"), F.lit(None).cast("bigint").alias("win"), sums(F.col("s") - F.col("v"), F.col("q") - F.col("v") * F.col("v")).alias("least"), sums(F.col("s"), F.col("q")).alias("own"), sums(F.col("s"), F.col("q")).alias("most"), F.lit(True).alias("fixed"))
    return inner.unionByName(start).unionByName(end)


def _run(low: Column, low_sums: Column, high: Column, high_sums: Column) -> Column:
    return F.struct((high - low).alias("n"), (high_sums["s"] - low_sums["s"]).alias("s"), (high_sums["q"] - low_sums["q"]).alias("q"))


def _variants(a: Column, b: Column) -> list[Column]:
    """The run between two bounds, whole and without its first, its last, and both of these windows."""
    low, high = ((a["at"], a["own"]), (a["at"] + 1, a["most"])), ((b["at"], b["own"]), (b["at"] - 1, b["least"]))
    return [_run(*x, *y) for x in low for y in high]


def _test(x: Column, y: Column) -> Column:
    """Statistic and degrees of freedom of a step between two runs: Welch's t, or the distance of a single window from all (df 0); null if neither applies."""
    mean = lambda r: r["s"] / r["n"]
    spread = lambda r: F.greatest(F.lit(0.0), (r["q"] - r["s"] * r["s"] / r["n"]) / (r["n"] - 1)) / r["n"]
    both = spread(x) + spread(y)
    apart = F.abs(mean(x) - mean(y))
    df = both * both / (spread(x) * spread(x) / (x["n"] - 1) + spread(y) * spread(y) / (y["n"] - 1))
    welch = F.when(both > 0, F.struct((apart / F.sqrt(both)).alias("t"), df.alias("df"))).when(apart > 0, F.struct(F.lit(math.inf).alias("t"), F.lit(1.0).alias("df")))
    n, s, q = x["n"] + y["n"], x["s"] + y["s"], x["q"] + y["q"]
    deviation = F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n)))
    single = F.when(x["n"] == 1, x["s"]).otherwise(y["s"])
    alone = F.when(deviation > 0, F.struct((F.abs(single - s / n) / deviation).alias("t"), F.lit(0.0).alias("df")))
    return F.when((x["n"] > 1) & (y["n"] > 1), welch).when((F.least(x["n"], y["n"]) == 1) & (F.greatest(x["n"], y["n"]) > 1), alone)


def tested(bounds: DataFrame) -> DataFrame:
    """``bounds`` with ``tests``: (t, df) of every pair of trimmed runs on their two sides; none for fixed ones."""
    rows = with_neighbours(bounds, "chrom", "at", ["at", "least", "own", "most"])
    here = F.struct("at", "least", "own", "most")
    rows = rows.withColumn("left", F.array(*_variants(F.col("before"), here))).withColumn("right", F.array(*_variants(here, F.col("after"))))
    # Lambdas over the two lists, so that a test is one small expression and not sixteen.
    pairs = F.flatten(F.transform("left", lambda x: F.transform("right", lambda y: _test(x, y))))
    tests = F.when(F.col("fixed"), F.array().cast("array<struct<t:double,df:double>>")).otherwise(F.filter(pairs, lambda t: t.isNotNull()))
    return rows.withColumn("tests", tests).drop("left", "right")


@F.pandas_udf(T.DoubleType())
def least_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Smallest p of a list of tests, 1 for an empty one; df 0 stands for one tail of the normal distribution, others for both tails of Student's t."""
    one = lambda x, d: math.erfc(x / math.sqrt(2)) / 2 if d == 0 else 0.0 if math.isinf(x) else beta_tail(x, d)
    return pd.Series([min([1.0, *(one(x, d) for x, d in zip(a, b, strict=True))]) for a, b in zip(t, df, strict=True)])


def merge_shifts(series: DataFrame, bounds: DataFrame, value: str, alpha: float, tables: WorkTables) -> DataFrame:
    """``bounds`` (chrom, win) that stay: ``chrom, win, at, left, right`` (mean values between a bound and the next ones).

    In each round all bounds go whose smallest p over the trimmed runs on both sides exceeds ``alpha``; the
    runs beside those that stay grow, and rounds end when none goes.
    """
    now = tables.save(placed_bounds(series, bounds, value, tables), "bounds")
    while True:
        p = least_p(F.col("tests.t"), F.col("tests.df"))
        judged = tables.save(tested(now).select(*now.columns, F.when(~F.col("fixed"), p).alias("p")), "judged")
        if judged.where(F.col("p") > alpha).limit(1).count() == 0:
            break
        now = judged.where(F.col("fixed") | (F.col("p") <= alpha)).drop("p")
    rows = with_neighbours(now, "chrom", "at", ["at", "own"]).where("not fixed")
    mean = lambda a, b: (b["own"]["s"] - a["own"]["s"]) / (b["at"] - a["at"])
    here = F.struct("at", "own")
    return rows.select("chrom", "win", "at", mean(F.col("before"), here).alias("left"), mean(here, F.col("after")).alias("right"))
