"""Exchange formats: root systems as XML, clusters stored by their inflation value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_root_xml(axes: DataFrame, points: DataFrame, path: str) -> None:
    """Plants with their roots and polylines, a ``plant`` element each, by Spark's XML writer.

    ``axes(item_key, axe_id, plant, ord, parent)``, ``points(item_key, axe_id, pos, x, y)``.
    A plant's roots are gathered, so they must fit into a row."""
    line = points.groupBy("item_key", "axe_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    place = F.transform("p", lambda q: F.struct(q["x"].alias("_x"), q["y"].alias("_y")))
    root = F.struct(F.col("axe_id").alias("_ID"), F.col("ord").alias("_order"), F.col("parent").alias("_parent"), F.struct(F.struct(place.alias("point")).alias("polyline")).alias("geometry"))
    plants = axes.join(line, ["item_key", "axe_id"], "left").groupBy(F.col("item_key").alias("_item"), F.col("plant").alias("_ID")).agg(F.array_sort(F.collect_list(root)).alias("root"))
    plants.write.mode("overwrite").format("xml").option("rootTag", "scene").option("rowTag", "plant").save(path)


def read_root_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``axes`` and ``points`` of such files."""
    point = "array<struct<_x:double,_y:double>>"
    kind = f"_item string, _ID bigint, root array<struct<_ID:bigint,_order:int,_parent:bigint,geometry:struct<polyline:struct<point:{point}>>>>"
    rows = spark.read.format("xml").option("rowTag", "plant").schema(kind).load(path)
    roots = rows.select(F.col("_item").alias("item_key"), F.col("_ID").alias("plant"), F.explode("root").alias("r"))
    axes = roots.select("item_key", F.col("r._ID").alias("axe_id"), "plant", F.col("r._order").alias("ord"), F.col("r._parent").alias("parent"))
    points = roots.select("item_key", F.col("r._ID").alias("axe_id"), F.posexplode("r.geometry.polyline.point").alias("pos", "p"))
    return axes, points.select("item_key", "axe_id", "pos", F.col("p._x").alias("x"), F.col("p._y").alias("y"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    """``clusters(inflation, node_id, cluster)`` in a folder for each inflation value."""
    clusters.write.mode("overwrite").partitionBy("inflation").parquet(path)


def read_clusters(spark: SparkSession, path: str, inflation: float | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if inflation is None else rows.where(F.col("inflation") == inflation)


def list_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``inflation``: the values stored."""
    return spark.read.parquet(path).select("inflation").distinct()
