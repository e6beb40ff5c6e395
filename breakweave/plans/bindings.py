"""The operators' inputs as projections of the given tables: whole tables, nothing sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIGS = 25


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _chrom(key: str) -> Column:
    return F.concat(F.lit("chr"), (F.col(key) % CONTIGS + 1).cast("string"))


def _day(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1992-01-01")).cast("bigint") * 10


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as aligned reads; an order is a read name."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), _chrom("l_suppkey").alias("chrom"),
        (_day("l_shipdate") + F.col("l_linenumber")).alias("start"), (_day("l_shipdate") + F.col("l_linenumber") + F.col("l_quantity").cast("bigint")).alias("end"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("strand"), (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"), (F.col("l_returnflag") != "R").alias("proper"),
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as copy-number calls."""
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), _chrom("o_custkey").alias("chrom"), _day("o_orderdate").alias("start"), (_day("o_orderdate") + 100).alias("end"), (F.col("o_totalprice") / 50000).alias("cn"))


def genes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as annotated intervals."""
    start = (F.col("p_partkey") * 17) % 25000
    return table(spark, folder, "part").select(F.col("p_partkey").alias("gene"), _chrom("p_partkey").alias("chrom"), start.alias("start"), (start + F.col("p_size") * 5).alias("end"), F.col("p_name").alias("name"), F.col("p_size").alias("size_class"), ((F.col("p_partkey") % 10) / 10.0).alias("score"))


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Order flows between nations as breakpoint edges: ``v1, v2, support`` and their parts."""
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    pairs = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    edges = pairs.groupBy(
        F.concat(F.lit("chr"), (F.col("c_nationkey") % 5).cast("string")).alias("chrom1"), (F.col("c_nationkey") * 100).cast("bigint").alias("pos1"), F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("strand1"),
        F.concat(F.lit("chr"), (F.col("s_nationkey") % 5).cast("string")).alias("chrom2"), (F.col("s_nationkey") * 100).cast("bigint").alias("pos2"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand2"),
    ).agg(F.count("*").alias("support"))
    sign = lambda c: F.when(F.col(c) == 1, "+").otherwise("-")
    return edges.withColumn("v1", F.concat("chrom1", F.lit(":"), F.col("pos1").cast("string"), sign("strand1"))).withColumn("v2", F.concat("chrom2", F.lit(":"), F.col("pos2").cast("string"), sign("strand2")))


#: The same projections for DuckDB.
SQL = {
    "reads": """SELECT l_orderkey AS qname, l_linenumber AS number, l_partkey AS part, 'chr' || CAST(l_suppkey % 25 + 1 AS VARCHAR) AS chrom,
        CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 10 + l_linenumber AS "start",
        CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 10 + l_linenumber + CAST(floor(l_quantity) AS BIGINT) AS "end",
        CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS strand, CAST(round(l_discount * 100) AS INTEGER) * 6 AS mapq, l_returnflag <> 'R' AS proper FROM lineitem""",
    "calls": """SELECT o_orderkey AS id, 'chr' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS chrom, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 10 AS "start",
        CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 10 + 100 AS "end", o_totalprice / 50000 AS cn FROM orders""",
    "genes": """SELECT p_partkey AS gene, 'chr' || CAST(p_partkey % 25 + 1 AS VARCHAR) AS chrom, (p_partkey * 17) % 25000 AS "start", (p_partkey * 17) % 25000 + p_size * 5 AS "end",
        p_name AS name, p_size AS size_class, (p_partkey % 10) / 10.0::DOUBLE AS score FROM part""",
    "flows": """SELECT *, chrom1 || ':' || CAST(pos1 AS VARCHAR) || CASE WHEN strand1 = 1 THEN '+' ELSE '-' END AS v1, chrom2 || ':' || CAST(pos2 AS VARCHAR) || CASE WHEN strand2 = 1 THEN '+' ELSE '-' END AS v2 FROM (
        SELECT 'chr' || CAST(c_nationkey % 5 AS VARCHAR) AS chrom1, CAST(c_nationkey * 100 AS BIGINT) AS pos1, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS strand1,
            'chr' || CAST(s_nationkey % 5 AS VARCHAR) AS chrom2, CAST(s_nationkey * 100 AS BIGINT) AS pos2, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand2, CAST(count(*) AS BIGINT) AS support
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) AS f""",
}
