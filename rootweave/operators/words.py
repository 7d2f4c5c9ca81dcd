"""Visual words: item sets, inversion, box matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_sets(words: DataFrame, by: str = "img", item: str = "word") -> DataFrame:
    """``by, items``: sorted distinct items of each transaction."""
    return words.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("items"))


def item_set_lines(sets: DataFrame, by: str) -> DataFrame:
    """``by, line`` for every id from 0 to the largest; empty for missing ones."""
    top = sets.agg(F.max(by)).first()[0]
    ids = sets.sparkSession.range(0, (top if top is not None else -1) + 1).select(F.col("id").cast(sets.schema[by].dataType).alias(by))
    return ids.join(sets, by, "left").select(by, F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), " "), F.lit("")).alias("line"))


def invert(nested: DataFrame, outer: str, groups: str, inner: str) -> DataFrame:
    """Swap the levels of a map of maps: ``inner, map(outer -> value)``."""
    flat = nested.select(outer, F.explode(groups).alias(inner, "v"))
    return flat.groupBy(inner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(outer, "v")))).alias("groups"))


def box_table(words: DataFrame) -> DataFrame:
    """``word, img, n, box``: the first box of every word in every image."""
    box = F.struct("xmin", "ymin", "xmax", "ymax")
    return words.groupBy("word", "img").agg(F.count("*").alias("n"), F.min(box).alias("box"))


def description(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, sum, least, largest and whole mean of a feature."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.floor(F.sum(v) / F.count(v)).alias("mean"))
