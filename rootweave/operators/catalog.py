"""Catalogue of items: typed metadata from file paths, layered defaults, filters,
sorting and grouping."""

from __future__ import annotations

import configparser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.functions import text as tx
from rootweave.iterate import settle


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``filename`` of every file below a folder whose name fits ``glob``; only the
    listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("filename"))


def parse_paths(files: DataFrame, pattern: str, base: str = "", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """``files(filename)`` with ``item_key``, ``metadata`` (a struct, a typed field for
    every field of the pattern) and ``valid``: it matches and every field casts."""
    regex, fields = tx.path_pattern(pattern)
    own = F.when(F.col("filename").startswith(base), F.ltrim(F.col("filename").substr(F.lit(len(base) + 1), F.length("filename")), F.lit("/"))).otherwise(F.col("filename"))
    values = [tx.field(own, regex, i, kind, date_format).alias(name) for i, (name, kind) in enumerate(fields, 1)]
    good = own.rlike(regex)
    for v in values:
        good = good & v.isNotNull()
    return files.withColumns({"item_key": tx.item_key(F.col("filename"), base), "metadata": F.struct(*values), "valid": F.coalesce(good, F.lit(False))})


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items, and the rejected files with the reason."""
    regex_fails = F.forall(F.array(*[F.col(f"metadata.{f.name}").isNull() for f in parsed.schema["metadata"].dataType.fields]), lambda x: x)
    reason = F.when(regex_fails, F.lit("no match")).otherwise(F.lit("no cast"))
    return parsed.where("valid").drop("valid"), parsed.where("not valid").select("filename", reason.alias("error"))


def positional_group(items: DataFrame, groups: dict[int, str]) -> DataFrame:
    """``items`` with ``group``: the label with the largest start at or before the
    file's position in its folder."""
    folder = F.regexp_replace("filename", r"[^/]*$", "")
    at = F.row_number().over(Window.partitionBy(folder).orderBy("filename")) - 1
    label = F.lit(None).cast("string")
    for start, name in sorted(groups.items()):
        label = F.when(F.col("__at") >= start, F.lit(name)).otherwise(label)
    return items.withColumn("__at", at).withColumn("group", label).drop("__at")


def layered(items: DataFrame, defaults: dict[str, str], sections: DataFrame, section: Column) -> DataFrame:
    """``items`` with ``extra``, a map: defaults, then the item's section of
    ``sections(section, key, value)``; later layers win."""
    maps = sections.groupBy("section").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("__own"))
    base = F.create_map(*[F.lit(x) for kv in sorted(defaults.items()) for x in kv]) if defaults else F.create_map().cast("map<string,string>")
    joined = items.withColumn("__section", section).join(maps.withColumnRenamed("section", "__section"), "__section", "left")
    own = F.coalesce("__own", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return joined.withColumn("extra", F.map_concat(kept, own)).drop("__own", "__section")


def read_sections(spark: SparkSession, text: str) -> DataFrame:
    """``section, key, value`` of an ini text; ``[child:parent]`` starts from a copy of an
    earlier section."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(text)
    held: dict[str, dict[str, str]] = {}
    for name in parser.sections():
        child, _, parent = name.partition(":")
        held[child.strip()] = {**held.get(parent.strip(), {}), **dict(parser[name])}
    rows = [(s, k, v) for s, options in held.items() for k, v in options.items()]
    return spark.createDataFrame(rows, "section string, key string, value string")


def single_item(spark: SparkSession, filename: str, pattern: str, base: str = "") -> DataFrame:
    return parse_paths(spark.createDataFrame([(filename,)], "filename string"), pattern, base)


# projections and filters -----------------------------------------------------------


def dotted(df: DataFrame, path: str, default=None) -> Column:
    """A nested column, or ``default`` where it is null or not in the schema."""
    kind = df.schema
    for name in path.split("."):
        fields = getattr(kind, "fields", None)
        found = [f for f in fields or () if f.name == name]
        if not found:
            return F.lit(default)
        kind = found[0].dataType
    return F.col(path) if default is None else F.coalesce(F.col(path), F.lit(default))


def key_value(map_col: Column, key: str, default=None) -> Column:
    return F.coalesce(F.try_element_at(map_col, F.lit(key)), F.lit(default))


def equal_filter(df: DataFrame, key: str, value, prefix: str = "metadata.") -> DataFrame:
    """Rows whose nested key has a value; an empty key or value filters nothing."""
    return df if key in ("", None) or value in ("", None) else df.where(dotted(df, prefix + key) == F.lit(value))


def metadata_keys(df: DataFrame, map_col: str) -> DataFrame:
    """``key``: all keys in use over all items, without those that start with ``_``."""
    return df.select(F.explode(F.map_keys(map_col)).alias("key")).where(~F.col("key").startswith("_")).distinct()


def merge_maps(a: Column, b: Column, overwrite: bool = True) -> Column:
    first, second = (a, b) if overwrite else (b, a)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def assign(struct: str, path: str, value: Column) -> Column:
    return F.col(struct).withField(path, value)


def slice_rows(df: DataFrame, order: list, start: int, stop: int) -> DataFrame:
    """Rows ``start`` .. ``stop`` in an order, as ``offset`` and ``limit``."""
    return df.orderBy(*order).offset(start).limit(stop - start)


# sorting and grouping ---------------------------------------------------------------


def sort_by(df: DataFrame, keys: list[str], item_key: str) -> DataFrame:
    return df.orderBy(*keys, item_key)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Sorted ``rows`` with their place from 1 as ``name``: rows are numbered within each
    sorted part, and the sizes of the parts before are added."""
    placed = settle(rows.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.col("__id").bitwiseAND((1 << 33) - 1)
    return placed.join(sizes, "__part").select(*rows.columns, (own + F.col("__before") + 1).alias(name))


def first_with(df: DataFrame, key: str, value, order: str) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).orderBy(order).limit(1)


def index_of(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``index`` from 0 in each partition."""
    return df.withColumn("index", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def group_items(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``keys, n, members``: items of each group, by key; null is a group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("members"))


def group_nested(df: DataFrame, outer: str, inner: str, item: str) -> DataFrame:
    """``outer, groups``: a map from the inner key to its items."""
    one = df.groupBy(outer, inner).agg(F.array_sort(F.collect_list(item)).alias("m"))
    return one.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "m")))).alias("groups"))


def flatten_nested(df: DataFrame, outer: str, inner: str, item: str) -> DataFrame:
    """Rows ``outer, inner, item`` of a nested grouping."""
    return df.select(outer, F.explode("groups").alias(inner, "m")).select(outer, inner, F.explode("m").alias(item))


def support_filter(words: DataFrame, images: DataFrame, regex: str, support: float | str) -> tuple[DataFrame, DataFrame]:
    """Words that stand in at least ``support`` of the images whose name fits ``regex``
    (a count from 1, a share below 1, or ``"all"``), and these images.

    ``words(word, img)``, ``images(img, name)``."""
    chosen = images.where(F.col("name").rlike(regex)).select("img").distinct()
    counts = words.join(chosen, "img", "left_semi").groupBy("word").agg(F.countDistinct("img").alias("n_img"))
    if support == "all" or support < 1:
        total = chosen.count()
        least = total if support == "all" else support * total
    else:
        least = support
    return counts.where(F.col("n_img") >= F.lit(least)), chosen


def induced_subgraph(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges ``(item_key, a, b)`` with both ends kept, renumbered from 0 in
    each item."""
    live = nodes.join(kept, ["item_key", "node_id"], "left_semi").withColumn(
        "new_id", F.row_number().over(Window.partitionBy("item_key").orderBy("node_id")) - 1
    )
    name = lambda c: live.select("item_key", F.col("node_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    inside = edges.join(name("a"), ["item_key", "a"]).join(name("b"), ["item_key", "b"])
    return live, inside.select("item_key", F.col("new_a").alias("a"), F.col("new_b").alias("b"))


def crop(raster: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    inside = F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)
    return raster.where(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def drop_temporary(df: DataFrame, prefix: str = "_") -> DataFrame:
    """``df`` without the columns whose name starts with ``prefix``."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def equal_records(a: Column, b: Column, fields: list[str]) -> Column:
    """Whether two records agree in every field; null equals null only."""
    same = F.lit(True)
    for f in fields:
        same = same & a[f].eqNullSafe(b[f])
    return same


def key_mask(rows: DataFrame, keys: list[str], mask: DataFrame) -> DataFrame:
    """Rows whose keys are in ``mask``."""
    return rows.join(mask.select(*keys).distinct(), keys, "left_semi")


def valid_segments(segments: DataFrame, dummy: int = 0) -> DataFrame:
    """Segments with both ends known: neither null nor the dummy node."""
    return segments.where((F.col("n0") != dummy) & (F.col("n1") != dummy))


def words_by(words: DataFrame, ids: list[int] | None = None, regex: str | None = None) -> DataFrame:
    """Words with an id of ``ids`` or from a file whose name fits ``regex``."""
    wanted = F.lit(False)
    if ids is not None:
        wanted = wanted | F.col("word").isin(ids)
    if regex is not None:
        wanted = wanted | F.col("file").rlike(regex)
    return words.where(wanted)


def append_reference(items: DataFrame, reference: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``items`` with the reference's ``tree`` as column ``name``, and the items without one.
    Of several reference rows with equal keys the greatest counts."""
    one = reference.groupBy(*keys).agg(F.max("tree").alias(name))
    joined = items.join(one, keys, "left")
    return joined, items.join(one.where(F.col(name).isNotNull()).select(*keys), keys, "left_anti")


def complete_pairs(items: DataFrame, first: str, second: str) -> DataFrame:
    """Items that hold both trees."""
    return items.where(F.col(first).isNotNull() & F.col(second).isNotNull())


def is_grouped(df: DataFrame) -> bool:
    return "members" in df.columns


def members(df: DataFrame, item: str) -> DataFrame:
    """The items of all groups of ``group_items``, one row each, with their keys; a table
    that is not grouped is returned as it is."""
    return df.select(*[c for c in df.columns if c not in ("n", "members")], F.explode("members").alias(item)) if is_grouped(df) else df


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that stand in both tables."""
    return a.intersect(b)


def unmatched_ids(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Distinct ids of each table that the other lacks."""
    one, two = a.select(key).distinct(), b.select(key).distinct()
    return one.join(two, key, "left_anti"), two.join(one, key, "left_anti")


def unique_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def numeric_order(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``df`` with ``place`` from 0 by the last number in ``name``, then by ``order``; names
    without a number come last."""
    from rootweave.functions import text as tx

    number = tx.last_number(F.col(name))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*order[:1]).orderBy(F.asc_nulls_last(number), *order[1:])) - 1)


def make_items(paths: DataFrame, ini: str, base: str = "") -> tuple[DataFrame, DataFrame]:
    """Items of ``paths(filename)`` as an ini text describes them, and the rejected rows.

    Its section ``[PATTERN]`` has ``pattern`` and ``group``, a list such as ``0:A, 1:B``;
    ``[metadata]`` has the defaults; other sections hold what a group adds."""
    spark = paths.sparkSession
    import configparser

    told = configparser.ConfigParser(delimiters=("=",))
    told.read_string(ini)
    groups = {int(k): v.strip() for k, v in (x.split(":") for x in told.get("PATTERN", "group", fallback="").split(",") if x.strip())}
    defaults = dict(told["metadata"]) if told.has_section("metadata") else {}
    good, bad = split_valid(parse_paths(paths, told.get("PATTERN", "pattern"), base))
    rows = positional_group(good, groups) if groups else good.withColumn("group", F.lit(None).cast("string"))
    sections = read_sections(spark, ini).where(~F.col("section").isin("PATTERN", "metadata"))
    return layered(rows, defaults, sections, F.col("group")), bad
