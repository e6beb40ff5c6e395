"""Coverage and insert statistics of a read set, measured on windows drawn by a hash, and the table that keeps them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .coverage import coverage_stats
from .overlap import overlap_join

#: The values of a row of statistics, in the order of the format.
VALUES = (
    "coarse_median", "coarse_mean", "coarse_deviation", "fine_median", "fine_mean", "fine_deviation", "read_length", "insert_size", "insert_deviation", "min_insert", "max_insert", "pair_support", "share_proper", "deviations", "size",
)
#: How a row scales with the share of reads that is kept: in proportion, by its root, or not at all.
_LINEAR, _ROOT = ("coarse_median", "coarse_mean", "fine_median", "fine_mean"), ("coarse_deviation", "fine_deviation")


def drawn_windows(contigs: DataFrame, masks: DataFrame, width: int, count: int, seed: str = "0") -> DataFrame:
    """``count`` windows (chrom, start, end) of ``width`` of the contigs (chrom, length), drawn by a hash of their place.

    Windows lie on a grid, at least one width from either end of a contig and from every mask. The same
    contigs, masks and seed always give the same windows.
    """
    places = F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("length") / width) - 2)
    grid = contigs.where(F.col("length") >= 3 * width).select("chrom", F.explode(places).alias("k"))
    grid = grid.select("chrom", (F.col("k") * width).alias("start"), (F.col("k") * width + width - 1).alias("end"))
    free = overlap_join(grid, masks.select("chrom", "start", "end"), extend=width, width=max(256, width), how="left_anti")
    draw = F.md5(F.concat_ws(":", F.lit(seed), "chrom", F.col("start").cast("string"), F.lit(str(width))))
    return free.orderBy(draw, "chrom", "start").limit(count)  # a sample of stated size is what is asked for


def window_depths(windows: DataFrame, reads: DataFrame, width: int) -> DataFrame:
    """``windows`` with ``depth``: mean number of reads over their places, 0 without any."""
    spans = reads.groupBy("chrom", "start", "end").agg(F.count("*").alias("k"))
    met = overlap_join(windows, spans, width=max(256, width))
    shared = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
    sums = met.groupBy("chrom", "start", "end").agg((F.sum(shared * F.col("r_k")) / width).alias("depth"))
    return windows.join(sums, ["chrom", "start", "end"], "left").select("chrom", "start", "end", F.coalesce("depth", F.lit(0.0)).alias("depth"))


def sample_statistics(reads: DataFrame, contigs: DataFrame, masks: DataFrame, size: Column, coarse: int = 10_000, fine: int = 300, count: int = 1000, deviations: float = 3.0, least_support: int = 2, longest: int = 10_000) -> DataFrame:
    """One row of the fifteen ``VALUES`` for ``reads`` (chrom, start, end, strand, proper, template).

    Depths are medians, means and deviations over drawn windows without outliers; read and insert lengths come
    from the reads that meet the coarse windows, inserts from proper forward reads with a template between 0
    and ``longest``. ``size`` is what the row is later recognised by.
    """
    depth = lambda width, name: coverage_stats(window_depths(drawn_windows(contigs, masks, width, count), reads, width), "depth", []).select(F.col("median").alias(f"{name}_median"), F.col("mean").alias(f"{name}_mean"), F.col("deviation").alias(f"{name}_deviation"))
    near = overlap_join(drawn_windows(contigs, masks, coarse, count), reads, width=max(256, coarse))
    good = F.col("r_proper") & (F.col("r_strand") == 1) & (F.col("r_template") > 0) & (F.col("r_template") < longest)
    lengths = near.agg(F.count("*").alias("n"), F.avg(F.col("r_end") - F.col("r_start") + 1).alias("read_length"), F.count_if(good).alias("inserts"), F.avg(F.when(good, F.col("r_template"))).alias("insert_size"), F.stddev_pop(F.when(good, F.col("r_template"))).alias("insert_deviation"))
    row = depth(coarse, "coarse").join(depth(fine, "fine")).join(lengths)  # one row each
    spread = deviations * F.col("insert_deviation")
    row = row.withColumn("share_proper", 2 * F.col("inserts") / F.col("n")).withColumn("min_insert", F.greatest(F.lit(0.0), F.col("insert_size") - spread)).withColumn("max_insert", F.col("insert_size") + spread)
    support = F.col("fine_mean") / 10 * ((F.col("insert_size") - F.col("read_length")) / 2 / F.col("read_length")) * F.col("share_proper")
    row = row.withColumn("pair_support", F.greatest(F.round(support), F.lit(float(least_support)))).withColumn("deviations", F.lit(float(deviations))).withColumn("size", size.cast("double"))
    return row.select(*[F.col(v).cast("double").alias(v) for v in VALUES])


def fingerprint(spark: SparkSession, path: str) -> tuple[str, int]:
    """Name and size that a data set is known by: a hash over the paths and lengths of its files, and their total length. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    row = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")))), "\n"), 256).alias("name"), F.sum("length").alias("size")).first()
    return row["name"], row["size"] or 0


def accepted(kept: DataFrame, name: str, size: int, deviations: float, least_support: int) -> DataFrame:
    """Rows of the table that may be used again: of this data set, complete and numbers, of the same size and deviations, and with enough support."""
    whole = F.lit(True)
    for v in VALUES:
        whole = whole & F.col(v).isNotNull() & ~F.isnan(v)
    return kept.where((F.col("name") == name) & whole & (F.col("size") == float(size)) & (F.col("deviations") == float(deviations)) & (F.round("pair_support") >= least_support))


def kept_statistics(spark: SparkSession, table: str, name: str, size: int, measure: Callable[[], DataFrame], deviations: float = 3.0, least_support: int = 2) -> DataFrame:
    """The statistics of a data set: the latest accepted row of ``table`` (a folder), or else measured now and appended to it.

    ``measure`` is called only where no row is accepted, so a second call reads no reads.
    """
    try:
        found = accepted(spark.read.parquet(table), name, size, deviations, least_support).orderBy(F.desc("written")).limit(1).collect()
    except AnalysisException:  # no table yet
        found = []
    if not found:
        fresh = measure().select(F.lit(name).alias("name"), *VALUES, F.current_timestamp().alias("written"))
        fresh.write.mode("append").parquet(table)
        found = spark.read.parquet(table).where(F.col("name") == name).orderBy(F.desc("written")).limit(1).collect()
    return spark.createDataFrame([[found[0][v] for v in VALUES]], ", ".join(f"{v} double" for v in VALUES))


def scaled(statistics: DataFrame, target: float = 0.0, usual: float = 10.0) -> DataFrame:
    """``ratio`` of the reads to keep for a coarse median of ``target`` (0: ``usual``; negative: all), never above 1, and the statistics that this share has."""
    wanted = usual if target == 0 else target
    ratio = F.lit(1.0) if target < 0 else F.when(F.col("coarse_median") > wanted, wanted / F.col("coarse_median")).otherwise(1.0)
    rows = statistics.withColumn("ratio", ratio)
    rows = rows.withColumns({v: F.col(v) * F.col("ratio") for v in _LINEAR} | {v: F.col(v) * F.sqrt("ratio") for v in _ROOT})
    support = F.greatest(F.col("fine_mean") / 10 * ((F.col("insert_size") - F.col("read_length")) / 2 / F.col("read_length")) * F.col("share_proper"), F.lit(2.0))
    return rows.withColumn("pair_support", F.when(F.col("ratio") < 1, support).otherwise(F.col("pair_support"))).select("ratio", *VALUES)
