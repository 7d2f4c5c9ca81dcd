"""Reference against computed: plants and roots of two trees matched, and their
measures set side by side.  All pairs of all items are compared in one job.

A pair of trees is ``item_key``.  Seeds are ``(item_key, plant, x, y)``; roots are
``(item_key, root_id, plant, ord, length, position, parent_length)`` and root points
``(item_key, root_id, pos, x, y)``.  Rows with a null key match nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.iterate import settle
from rootweave.operators import match

ITEM = "item_key"


def plant_match(reference: DataFrame, computed: DataFrame, most: float | None = None, squared: bool = False, digits: int | None = None) -> DataFrame:
    """``item_key, i, j, d``: plants ``i`` of the reference and ``j`` of the computed tree
    paired greedily by the distance of their seeds, at most ``most``; ``d`` is ``squared``
    or not, and equal to ``digits`` goes by i, then j."""
    a, b = reference.select(ITEM, F.col("plant").alias("i"), "x", "y"), computed.select(ITEM, F.col("plant").alias("j"), "x", "y")
    return match.greedy_points(a, b, [ITEM], most, squared, digits)


def seed_match(first: DataFrame, second: DataFrame, digits: int | None = None) -> DataFrame:
    """As ``plant_match`` with squared distances."""
    return plant_match(first, second, squared=True, digits=digits)


def resample_roots(points: DataFrame, samples: int = 16) -> DataFrame:
    """``item_key, root_id, k, x, y``: ``samples`` points of every root, evenly spaced by
    arc length, its ends among them.  A root of one point or of no length gives that
    point for all."""
    w = Window.partitionBy(ITEM, "root_id").orderBy("pos")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    rows = points.withColumn("step", step)
    rows = rows.withColumn("arc", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("step").over(Window.partitionBy(ITEM, "root_id")))
    rows = rows.select(ITEM, "root_id", "x", "y", "all", "arc", *[F.lag(c).over(w).alias(f"{c}0") for c in ("arc", "x", "y")])
    last = F.lit(samples - 1)
    place = lambda c: F.when(F.col("all") > 0, F.col(c) / F.col("all") * last).otherwise(F.lit(0.0))
    # a stretch owns the samples after its start up to its end; the first point owns sample 0
    first = F.when(F.col("arc0").isNull(), F.lit(0)).otherwise(F.floor(place("arc0") + 1e-9) + 1)
    final = F.when(F.col("arc0").isNull(), F.when(F.col("all") > 0, 0).otherwise(last)).otherwise(F.floor(place("arc") + 1e-9))
    owned = rows.withColumns({"first": first.cast("int"), "final": final.cast("int")}).where("first <= final")
    each = owned.withColumn("k", F.explode(F.sequence("first", "final")))
    t = F.when(F.col("arc0").isNull() | (F.col("arc") == F.col("arc0")), F.lit(1.0)).otherwise((F.col("k") / last * F.col("all") - F.col("arc0")) / (F.col("arc") - F.col("arc0")))
    at = lambda c: F.coalesce(F.col(f"{c}0"), F.col(c)) + (F.col(c) - F.coalesce(F.col(f"{c}0"), F.col(c))) * t
    return each.select(ITEM, "root_id", "k", at("x").alias("x"), at("y").alias("y")).dropDuplicates([ITEM, "root_id", "k"])


def root_distance(pairs: DataFrame, reference: DataFrame, computed: DataFrame, samples: int = 16) -> DataFrame:
    """``item_key, i, j, d``: mean distance of equally placed points of the roots of
    ``pairs(item_key, i, j)``."""
    a = resample_roots(reference, samples).select(ITEM, F.col("root_id").alias("i"), "k", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = resample_roots(computed, samples).select(ITEM, F.col("root_id").alias("j"), "k", F.col("x").alias("bx"), F.col("y").alias("by"))
    rows = pairs.select(ITEM, "i", "j").join(a, [ITEM, "i"]).join(b, [ITEM, "j", "k"])
    return rows.groupBy(ITEM, "i", "j").agg(F.avg(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).alias("d"))


def matched_roots(plants: DataFrame, reference: DataFrame, computed: DataFrame, order: int | None = None) -> DataFrame:
    """``item_key, plant_ref, plant_cmp, side, ...root``: the roots of matched plants, of one
    order if given; ``side`` is ``ref`` or ``cmp``."""
    named = plants.select(ITEM, F.col("i").alias("plant_ref"), F.col("j").alias("plant_cmp"))
    parts = []
    for side, roots in (("ref", reference), ("cmp", computed)):
        own = roots if order is None else roots.where(F.col("ord") == order)
        parts.append(named.join(own.withColumnRenamed("plant", f"plant_{side}"), [ITEM, f"plant_{side}"]).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1])


def match_trees(seeds: tuple[DataFrame, DataFrame], roots: tuple[DataFrame, DataFrame], points: tuple[DataFrame, DataFrame], most_plant: float | None = None, most_root: float | None = None, samples: int = 16) -> dict[str, DataFrame]:
    """Plants by their seeds, then roots of equal order within matched plants by their
    shape: tables ``plants`` and ``roots`` ``(item_key, i, j, d)``, and the unmatched ids
    of both sides, ``plants_ref, plants_cmp, roots_ref, roots_cmp``."""
    plants = settle(plant_match(*seeds, most_plant))
    side = lambda k, name: roots[k].select(ITEM, F.col("root_id").alias("ij"[k]), F.col("plant").alias(name), "ord")
    named = plants.select(ITEM, F.col("i").alias("pi"), F.col("j").alias("pj"))
    pairs = named.join(side(0, "pi"), [ITEM, "pi"]).join(side(1, "pj"), [ITEM, "pj", "ord"])
    found = settle(match.greedy_match(root_distance(pairs, *points, samples), [ITEM], most_root))
    lone = lambda ids, m, k: match.unmatched(ids, m, [ITEM], k)
    return {
        "plants": plants,
        "roots": found,
        "plants_ref": lone(seeds[0].select(ITEM, F.col("plant").alias("i")), plants, "i"),
        "plants_cmp": lone(seeds[1].select(ITEM, F.col("plant").alias("j")), plants, "j"),
        "roots_ref": lone(roots[0].select(ITEM, F.col("root_id").alias("i")), found, "i"),
        "roots_cmp": lone(roots[1].select(ITEM, F.col("root_id").alias("j")), found, "j"),
    }


def match_counters(found: dict[str, DataFrame], what: str = "plants") -> DataFrame:
    """One row over all pairs: how many are matched, missed and added."""
    part = lambda df, name: df.select(F.lit(name).alias("n"))
    rows = part(found[what], "matched").union(part(found[f"{what}_ref"], "missed")).union(part(found[f"{what}_cmp"], "added"))
    return rows.agg(*[F.count_if(F.col("n") == name).alias(name) for name in ("matched", "missed", "added")])


def total_lengths(plants: DataFrame, reference: DataFrame, computed: DataFrame) -> DataFrame:
    """``item_key, plant_ref, plant_cmp`` and, for each side, the length of all roots, of
    order 1 and of order 2; 0 for a plant without any."""
    rows = matched_roots(plants, reference, computed)
    sums = []
    for side in ("ref", "cmp"):
        for name, cond in (("all", F.lit(True)), ("ord1", F.col("ord") == 1), ("ord2", F.col("ord") == 2)):
            sums.append(F.coalesce(F.sum(F.when((F.col("side") == side) & cond, F.col("length"))), F.lit(0.0)).alias(f"{side}_{name}"))
    named = plants.select(ITEM, F.col("i").alias("plant_ref"), F.col("j").alias("plant_cmp"))
    keys = [ITEM, "plant_ref", "plant_cmp"]
    total = rows.groupBy(*keys).agg(*sums)
    return named.join(total, keys, "left").na.fill(0.0)


def branching(plants: DataFrame, reference: DataFrame, computed: DataFrame) -> DataFrame:
    """``item_key, plant_ref, plant_cmp, side, n, branches``: number of order-2 roots of every
    matched plant, and the list of ``(position, parent_length, length)`` by position."""
    rows = matched_roots(plants, reference, computed, 2)
    each = F.array_sort(F.collect_list(F.struct("position", "parent_length", "length")))
    return rows.groupBy(ITEM, "plant_ref", "plant_cmp", "side").agg(F.count("*").alias("n"), each.alias("branches"))


def matched_measures(roots: DataFrame, reference: DataFrame, computed: DataFrame, columns: list[str]) -> DataFrame:
    """``item_key, i, j`` of matched roots with each column of both, as ``c_ref, c_cmp``."""
    side = lambda df, k, name: df.select(ITEM, F.col("root_id").alias(k), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    return roots.select(ITEM, "i", "j").join(side(reference, "i", "ref"), [ITEM, "i"]).join(side(computed, "j", "cmp"), [ITEM, "j"])


def measurement_histogram(lengths: DataFrame, labels: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``label, bin, w``: histogram of computed over reference values of ``total_lengths``
    by a label of the item, each label weighing 1; references of 0 don't count."""
    from rootweave.operators import stats

    ratio = F.when(F.col(f"ref_{column}") > 0, F.col(f"cmp_{column}") / F.col(f"ref_{column}"))
    return stats.label_histogram(lengths.withColumn("ratio", ratio).join(labels, ITEM), "label", "ratio", low, high, bins)


def for_pairs(pairs: DataFrame, path: str, method: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a method over the trees of all pairs at once and store what it returns."""
    method(pairs).write.mode("overwrite").parquet(path)
    return pairs.sparkSession.read.parquet(path)
