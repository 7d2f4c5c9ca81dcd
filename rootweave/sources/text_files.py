"""Text formats: traced roots, word results, key-value lists, scale and score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.functions import text as tx


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, value, line``: the lines of text files, numbered from 0 in each file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("t"))
    return whole.select("file", F.posexplode(F.split("t", "\r?\n")).alias("line", "value"))


def parse_tracings(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traced roots of ``lines(file, line, value)``: ``tracings(file, tracing_id, type,
    cluster, label)`` and ``points(file, tracing_id, segment_no, pos, x, y)``.

    A block starts at ``// Tracing``; its next four lines are id, type, cluster and
    label; coordinates follow ``// Segment``, one a line, x then y."""
    w = Window.partitionBy("file").orderBy("line")
    rows = lines.withColumn("value", F.trim("value"))
    rows = rows.withColumn("block", F.sum(F.when(F.col("value").startswith("// Tracing"), 1).otherwise(0)).over(w))
    inner = Window.partitionBy("file", "block").orderBy("line")
    rows = rows.where("block > 0").withColumn("segment_no", F.sum(F.when(F.col("value").startswith("// Segment"), 1).otherwise(0)).over(inner))
    rows = rows.withColumn("ended", F.max(F.when(F.col("value").startswith("// End"), 1).otherwise(0)).over(inner))
    plain = rows.where((F.col("ended") == 0) & ~F.col("value").startswith("//") & (F.col("value") != ""))
    head = plain.where("segment_no = 0").withColumn("k", F.row_number().over(inner))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    tracings = head.groupBy("file", "block").agg(at(1).cast("int").alias("tracing_id"), at(2).cast("int").alias("type"), at(3).cast("int").alias("cluster"), at(4).alias("label"))
    each = Window.partitionBy("file", "block", "segment_no").orderBy("line")
    coords = plain.where("segment_no > 0").withColumn("k", F.row_number().over(each) - 1).withColumn("y", F.lead("value").over(each).cast("int"))
    points = coords.where("k % 2 = 0").select("file", "block", "segment_no", F.floor(F.col("k") / 2).cast("int").alias("pos"), F.col("value").cast("int").alias("x"), "y")
    named = points.join(tracings.select("file", "block", "tracing_id"), ["file", "block"])
    return tracings.drop("block"), named.select("file", "tracing_id", "segment_no", "pos", "x", "y")


def fix_tracings(tracings: DataFrame) -> DataFrame:
    """``tracings`` with ``plant``, ``ord`` and ``fixed``: a missing plant (cluster below 1)
    is the one before it, a missing order (type - 2 below 1) the file's largest."""
    order = Window.partitionBy("file").orderBy("tracing_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("cluster") >= 1, F.col("cluster"))
    level = F.when(F.col("type") - 2 >= 1, F.col("type") - 2)
    plant = F.coalesce(F.last(own, ignorenulls=True).over(order), F.lit(1))
    top = F.coalesce(F.max(level).over(Window.partitionBy("file")), F.lit(1))
    return tracings.withColumns({"plant": plant, "ord": F.coalesce(level, top), "fixed": own.isNull() | level.isNull()})


def parse_word_rows(lines: DataFrame) -> DataFrame:
    """Words of ``lines(file, value)``: lines that start with a digit are ``fid img
    match_num ... xmin ymin xmax ymax``; the word id is the last number of the file's
    name.  Header lines ``key=value`` are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    last = lambda k: F.try_element_at(F.col("p"), F.lit(k)).try_cast("double")
    rows = lines.where(F.trim("value").rlike(r"^\d")).select(tx.last_number(F.regexp_replace("file", r"\.[^.]*$", "")).alias("word_id"), parts.alias("p"))
    first = lambda k: F.try_element_at(F.col("p"), F.lit(k)).try_cast("bigint")
    return rows.select("word_id", first(1).alias("fid"), first(2).alias("img"), first(3).alias("match_num"), last(-4).alias("xmin"), last(-3).alias("ymin"), last(-2).alias("xmax"), last(-1).alias("ymax"))


def parse_key_values(lines: DataFrame) -> DataFrame:
    """``kv``: a map of the tab-separated ``key=value`` cells of each line."""
    return lines.where(F.trim("value") != "").select(F.str_to_map("value", F.lit("\t"), F.lit("=")).alias("kv"))


def split_image_list(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header rows (without ``img``) and content rows of an image list."""
    has = F.map_contains_key("kv", "img")
    return kv.where(~has), kv.where(has)


def image_ids(content: DataFrame, folder: str) -> DataFrame:
    """``img_id, path`` of the content rows, below the header's folder."""
    return content.select(F.col("kv")["img"].try_cast("bigint").alias("img_id"), tx.absolute(F.col("kv")["path"], folder).alias("path"))


def parse_scales(lines: DataFrame) -> tuple[int, DataFrame]:
    """Number of path parts of a key, and ``key, scale`` rows, from ``lines(line, value)``."""
    first = lines.where("line = 0").first()
    rows = lines.where("line > 0 and value like '%=%'").select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.substring_index("value", "=", -1)).try_cast("double").alias("scale"))
    return (int(first["value"]) if first else 0), rows


def set_scales(items: DataFrame, scales: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Items with their ``scale``, and the items without."""
    words = F.split("item_key", "/")
    key = F.array_join(F.slice(words, F.greatest(F.size(words) - parts + 1, F.lit(1)), F.lit(max(parts, 1))), "/")
    joined = items.withColumn("key", key).join(scales, "key", "left").drop("key")
    return joined.where("scale is not null"), joined.where("scale is null").drop("scale")


def parse_scores(lines: DataFrame) -> DataFrame:
    """``key, plant, geometry, topology`` of blank-separated rows."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.select(p.alias("p")).where(F.size("p") >= 4)
    return rows.select(F.col("p")[0].alias("key"), F.col("p")[1].try_cast("bigint").alias("plant"), F.col("p")[2].try_cast("double").alias("geometry"), F.col("p")[3].try_cast("double").alias("topology"))


def reference_items(items: DataFrame, traced: DataFrame) -> DataFrame:
    """Items with a traced-roots file of the same key; ``traced(filename)``."""
    keys = traced.select(tx.item_key(F.col("filename")).alias("item_key"))
    return items.join(keys, "item_key", "left_semi")


def time_lapse(files: DataFrame, box: str = "Boite", sequence: str = "Sequence") -> DataFrame:
    """``files(filename)`` with ``box``, ``sequence`` and ``frame`` from 0 in time order."""
    rows = files.withColumns({"box": tx.numbered(F.col("filename"), box), "sequence": tx.numbered(F.col("filename"), sequence)}).where("box is not null")
    return rows.withColumn("frame", F.row_number().over(Window.partitionBy("box").orderBy("sequence", "filename")) - 1)
