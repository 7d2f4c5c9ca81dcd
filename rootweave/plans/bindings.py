"""The driver's tables seen as the engine's own: customers' orders as axes, their
lines as segments, supplier and part as raster coordinates, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = axis, market segment = item, nation = plant; urgent and high orders are
    of the first order, others of the second."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    level = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(2)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("item_key"), F.col("o_orderkey").alias("axe_id"), F.col("c_nationkey").cast("bigint").alias("plant"), level.alias("ord")
    )


AXES_SQL = """axes AS (SELECT c_mktsegment AS item_key, o_orderkey AS axe_id, CAST(c_nationkey AS BIGINT) AS plant,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 2 END AS ord FROM orders JOIN customer ON o_custkey = c_custkey)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line number of an order = segment, its quantity = length."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("axe_id"), F.col("l_linenumber").alias("pos"))
    return rows.agg(F.sum("l_quantity").alias("length")).select(
        F.lit("all").alias("item_key"), "axe_id", "pos", (F.col("axe_id") * 10 + F.col("pos")).alias("seg_id"), "length"
    )


SEGMENTS_SQL = """seg AS (SELECT l_orderkey AS axe_id, l_linenumber AS pos, sum(l_quantity) AS length FROM lineitem GROUP BY 1, 2)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = supplier, x = part, v = quantity sold."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("y"), F.col("l_partkey").cast("int").alias("x"))
    return rows.agg(F.sum("l_quantity").alias("v")).select(F.lit("all").alias("item_key"), "y", "x", "v")


RASTER_SQL = """raster AS (SELECT CAST(l_suppkey AS INTEGER) AS y, CAST(l_partkey AS INTEGER) AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part = word, order = image, box from quantity and line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("img"),
        F.col("l_partkey").alias("word"),
        F.col("l_quantity").alias("xmin"),
        F.col("l_linenumber").cast("double").alias("ymin"),
        (F.col("l_quantity") + 10).alias("xmax"),
        (F.col("l_linenumber") + 3.0).alias("ymax"),
    )


WORDS_SQL = """words AS (SELECT l_orderkey AS img, l_partkey AS word, l_quantity AS xmin, CAST(l_linenumber AS DOUBLE) AS ymin,
 l_quantity + 10 AS xmax, l_linenumber + 3.0 AS ymax FROM lineitem)"""
