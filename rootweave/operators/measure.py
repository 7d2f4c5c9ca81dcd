"""Measures of root trees: lengths, positions, orders and per-plant statistics.

Tables: ``segments(item_key, seg_id, length)``, ``axe_segments(item_key, axe_id, pos,
seg_id)`` and ``axes(item_key, axe_id, plant, ord, parent, parent_segment)``; a
missing parent is null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from rootweave.iterate import ship

ITEM = "item_key"


def segment_lengths(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``segments`` with ``length`` and ``direction`` from their end nodes; a length
    that is already there wins."""
    from rootweave.functions import geometry as g

    ends = segments
    for n in ("n0", "n1"):
        ends = ends.join(nodes.select(ITEM, F.col("node_id").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}")), [ITEM, n], "left")
    xy = [F.col(c) for c in ("x_n0", "y_n0", "x_n1", "y_n1")]
    known = F.col("length") if "length" in segments.columns else None
    return ends.withColumn("length", g.length(*xy, known)).withColumn("direction", g.direction(*xy)).drop("x_n0", "y_n0", "x_n1", "y_n1")


def axe_length(axe_segments: DataFrame, segments: DataFrame) -> DataFrame:
    """``item_key, axe_id, length, n_segments``."""
    rows = axe_segments.join(segments.select(ITEM, "seg_id", "length"), [ITEM, "seg_id"])
    return rows.groupBy(ITEM, "axe_id").agg(F.sum("length").alias("length"), F.count("*").alias("n_segments"))


def arc_length(axe_segments: DataFrame, segments: DataFrame) -> DataFrame:
    """``item_key, axe_id, pos, seg_id, arc``: length up to the end of each segment."""
    rows = axe_segments.join(segments.select(ITEM, "seg_id", "length"), [ITEM, "seg_id"])
    order = Window.partitionBy(ITEM, "axe_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(ITEM, "axe_id", "pos", "seg_id", F.sum("length").over(order).alias("arc"))


def position_on_parent(axes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``item_key, axe_id, position``: arc length on the parent where the axis starts,
    0 without a parent."""
    on = arcs.select(ITEM, F.col("axe_id").alias("parent"), F.col("seg_id").alias("parent_segment"), "arc")
    rows = axes.join(on, [ITEM, "parent", "parent_segment"], "left")
    return rows.select(ITEM, "axe_id", F.coalesce("arc", F.lit(0.0)).alias("position"))


def first_segment(axe_segments: DataFrame) -> DataFrame:
    return axe_segments.groupBy(ITEM, "axe_id").agg(F.min_by("seg_id", "pos").alias("seg_id"))


def partial_order(axes: DataFrame, positions: DataFrame) -> DataFrame:
    """``item_key, axe_id, rank``: axes by order, then position on parent, then id."""
    rows = axes.join(positions, [ITEM, "axe_id"])
    order = Window.partitionBy(ITEM).orderBy("ord", "position", "axe_id")
    return rows.select(ITEM, "axe_id", F.row_number().over(order).alias("rank"))


def main_axe(axe_segments: DataFrame, ranks: DataFrame) -> DataFrame:
    """``item_key, seg_id, axe_id``: the first axis in partial order of each segment."""
    return axe_segments.join(ranks, [ITEM, "axe_id"]).groupBy(ITEM, "seg_id").agg(F.min_by("axe_id", "rank").alias("axe_id"))


def parent_segment(axe_segments: DataFrame, segments: DataFrame) -> DataFrame:
    """``item_key, axe_id, parent_segment``: the parent of an axis' first segment."""
    return (
        first_segment(axe_segments)
        .join(segments.select(ITEM, "seg_id", F.col("parent").alias("parent_segment")), [ITEM, "seg_id"], "left")
        .select(ITEM, "axe_id", "parent_segment")
    )


def parent_axe(axe_segments: DataFrame, parents: DataFrame) -> DataFrame:
    """``item_key, axe_id, parent``: the first axis that holds the parent segment."""
    holder = axe_segments.groupBy(ITEM, F.col("seg_id").alias("parent_segment")).agg(F.min("axe_id").alias("parent"))
    return parents.join(holder, [ITEM, "parent_segment"], "left").select(ITEM, "axe_id", "parent", "parent_segment")


def insertion_angle(axe_segments: DataFrame, parents: DataFrame, segments: DataFrame) -> DataFrame:
    """``item_key, axe_id, angle`` between an axis' first segment and its parent
    segment; ``segments`` needs ``direction, n0, n1``."""
    from rootweave.functions import geometry as g

    ends = segments.select(ITEM, "seg_id", "direction", "n0", "n1")
    one = ends.select(ITEM, F.col("seg_id"), *[F.col(c).alias(f"a_{c}") for c in ("direction", "n0", "n1")])
    two = ends.select(ITEM, F.col("seg_id").alias("parent_segment"), *[F.col(c).alias(f"b_{c}") for c in ("direction", "n0", "n1")])
    rows = first_segment(axe_segments).join(parents.select(ITEM, "axe_id", "parent_segment"), [ITEM, "axe_id"])
    rows = rows.join(one, [ITEM, "seg_id"]).join(two, [ITEM, "parent_segment"])
    same = (F.col("a_n0") == F.col("b_n0")) | (F.col("a_n1") == F.col("b_n1"))
    return rows.select(ITEM, "axe_id", g.direction_difference(F.col("a_direction"), F.col("b_direction"), same).alias("angle"))


def axe_nodes(axe_segments: DataFrame, segments: DataFrame, parents: DataFrame) -> DataFrame:
    """``item_key, axe_id, rank, node_id, sure``: an axis' nodes in order.

    A segment's end that it shares with the next segment comes second; a last segment
    starts where it meets the one before.  A single segment starts at the node it
    shares with the parent segment; without one its order is the stored one and
    ``sure`` is false."""
    seg = segments.select(ITEM, "seg_id", "n0", "n1")
    par = seg.select(ITEM, F.col("seg_id").alias("parent_segment"), F.array("n0", "n1").alias("pn"))
    w = Window.partitionBy(ITEM, "axe_id").orderBy("pos")
    rows = axe_segments.join(seg, [ITEM, "seg_id"]).join(parents.select(ITEM, "axe_id", "parent_segment"), [ITEM, "axe_id"], "left").join(par, [ITEM, "parent_segment"], "left")
    ends = F.array("n0", "n1")
    rows = rows.withColumn("after", F.lead(ends).over(w)).withColumn("before", F.coalesce(F.lag(ends).over(w), F.col("pn")))
    turn = F.when(F.col("after").isNotNull(), F.array_contains("after", F.col("n0"))).otherwise(
        F.coalesce(F.array_contains("before", F.col("n1")) & ~F.array_contains("before", F.col("n0")), F.lit(False))
    )
    sure = F.col("after").isNotNull() | F.col("before").isNotNull()
    rows = rows.withColumn("start", F.when(turn, F.col("n1")).otherwise(F.col("n0"))).withColumn("end", F.when(turn, F.col("n0")).otherwise(F.col("n1")))
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("sure", sure)
    first = rows.where("k = 1").select(ITEM, "axe_id", F.lit(0).alias("rank"), F.col("start").alias("node_id"), "sure")
    return first.union(rows.select(ITEM, "axe_id", F.col("k").alias("rank"), F.col("end").alias("node_id"), "sure"))


def terminal_nodes(segments: DataFrame) -> DataFrame:
    """``item_key, node_id, degree, terminal``."""
    ends = segments.select(ITEM, F.explode(F.array("n0", "n1")).alias("node_id"))
    return ends.groupBy(ITEM, "node_id").agg(F.count("*").alias("degree")).withColumn("terminal", F.col("degree") == 1)


def terminal_segments(segments: DataFrame) -> DataFrame:
    flags = terminal_nodes(segments)
    ends = segments.select(ITEM, "seg_id", F.explode(F.array("n0", "n1")).alias("node_id")).join(flags, [ITEM, "node_id"])
    return ends.groupBy(ITEM, "seg_id").agg(F.bool_or("terminal").alias("terminal"))


# per-plant statistics -------------------------------------------------------------

Statistic = Callable[[], Column]

#: Name of a statistic: aggregate over the axes of a plant, with columns ``axe_id, ord,
#: length, position`` (null for a plant without axes).
STATISTICS: dict[str, Statistic] = {}


def statistic(fn: Statistic) -> Statistic:
    """Register an aggregate under the function's name."""
    STATISTICS[fn.__name__] = fn
    return fn


def _order(k: int) -> Column:
    return F.col("ord") == k


@statistic
def axe1_length() -> Column:
    return F.coalesce(F.min_by(F.when(_order(1), F.col("length")), F.when(_order(1), F.col("axe_id"))), F.lit(0.0))


@statistic
def axe2_length() -> Column:
    pairs = F.array_sort(F.collect_list(F.when(_order(2), F.struct("axe_id", "length"))))
    return F.transform(pairs, lambda p: p["length"])


@statistic
def axe2_length_total() -> Column:
    return F.coalesce(F.sum(F.when(_order(2), F.col("length"))), F.lit(0.0))


@statistic
def axe2_length_mean() -> Column:
    return F.coalesce(F.avg(F.when(_order(2), F.col("length"))), F.lit(0.0))


@statistic
def total_length() -> Column:
    return F.coalesce(F.sum("length"), F.lit(0.0))


@statistic
def axe2_number() -> Column:
    return F.count_if(F.coalesce(_order(2), F.lit(False)))


@statistic
def ramification_length() -> Column:
    return F.coalesce(F.max(F.when(_order(2), F.col("position"))), F.lit(0.0))


@statistic
def ramification_percent() -> Column:
    primary = axe1_length()
    return F.when(primary > 0, ramification_length() / primary).otherwise(F.lit(0.0))


def plant_statistics(plants: DataFrame, axes: DataFrame, names: list[str] | None = None, mask: Column | None = None, scale: float = 1.0) -> DataFrame:
    """One row for every ``(item_key, plant)`` of ``plants``, with the named statistics
    (all by default) over ``axes(item_key, plant, axe_id, ord, length, position)``.
    ``mask`` filters axes; plants without any are kept.  One aggregation for all."""
    rows = axes if mask is None else axes.where(mask)
    for c in ("length", "position"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.col(c) * F.lit(scale))
    if "position" not in rows.columns:
        rows = rows.withColumn("position", F.lit(None).cast("double"))
    joined = plants.select(ITEM, "plant").distinct().join(rows.select(ITEM, "plant", "axe_id", "ord", "length", "position"), [ITEM, "plant"], "left")
    return joined.groupBy(ITEM, "plant").agg(*[STATISTICS[n]().alias(n) for n in names or STATISTICS])


def long_statistics(table: DataFrame, names: list[str]) -> DataFrame:
    """``item_key, plant, stat, value`` from a table with a column for each statistic."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names])).alias("p")
    return table.select(ITEM, "plant", pairs).select(ITEM, "plant", "p.stat", "p.value")


def axes_property(plants: DataFrame, axes: DataFrame, name: str, mask: Column | None = None, order: int | None = None, scale: float = 1.0) -> DataFrame:
    """``item_key, plant, values``: a property of every plant's axes, by axis id."""
    rows = axes if mask is None else axes.where(mask)
    rows = rows if order is None else rows.where(F.col("ord") == order)
    pairs = F.array_sort(F.collect_list(F.when(F.col("axe_id").isNotNull(), F.struct("axe_id", (F.col(name) * F.lit(scale)).alias("v")))))
    joined = plants.select(ITEM, "plant").distinct().join(rows.select(ITEM, "plant", "axe_id", name), [ITEM, "plant"], "left")
    return joined.groupBy(ITEM, "plant").agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


#: Points of one part of a group whose hull is taken at once, about.
HULL_PART = 50_000


def convex_chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the convex hull's corners, counter-clockwise from the leftmost lowest
    point; of fewer than three distinct points, all of them."""
    order = np.lexsort((y, x))
    order = order[np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])] if len(order) else order
    if len(order) < 3:
        return order

    def half(points):
        chain: list[int] = []
        for p in points:
            while len(chain) > 1:
                a, b = chain[-2:]
                if (x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a]) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(order.tolist()) + half(order[::-1].tolist()))


def hull(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, hull``: the convex hull of each group's points ``x, y``, counter-clockwise
    from the leftmost lowest; fewer than three points give themselves.  Points with a
    null coordinate don't count.

    A point inside the hull of some of the points is inside the whole one, so a large
    group is dealt into parts, and only the corners of the parts' hulls meet."""
    ship(points.sparkSession)
    rows = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null").distinct()
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(HULL_PART)).cast("int").alias("parts"))
    dealt = rows.join(parts, keys).select(*keys, F.pmod(F.xxhash64("x", "y"), F.col("parts")).alias("part"), "x", "y")

    def corners(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[convex_chain(group["x"].to_numpy(), group["y"].to_numpy())]

    def ring(group: pd.DataFrame) -> pd.DataFrame:
        found = corners(group)
        head = {k: [group[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "hull": [[{"x": a, "y": b} for a, b in zip(found["x"].tolist(), found["y"].tolist())]]})

    some = dealt.groupBy(*keys, "part").applyInPandas(corners, dealt.schema)
    schema = T.StructType([dealt.schema[k] for k in keys] + [T.StructField("hull", T.ArrayType(T.StructType([dealt.schema["x"], dealt.schema["y"]])))])
    return some.groupBy(*keys).applyInPandas(ring, schema)


def polygon_area(ring: Column) -> Column:
    """Shoelace area of an array of ``struct(x, y)``; 0 for fewer than three."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.get(ring, F.pmod(i + 1, n))["y"] - p["y"] * F.get(ring, F.pmod(i + 1, n))["x"])
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(F.lit(0.0))


def hull_area(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, area``: convex hull area; 0 when fewer than three points."""
    return hull(points, keys).select(*keys, polygon_area(F.col("hull")).alias("area"))


def pixel_size(area: Column, plate_size: Column | float, shape: str = "square", true_circle: bool = False) -> Column:
    """Real size of a pixel from a plate's area in pixels and its real size."""
    if shape == "square":
        width = F.sqrt(area)
    else:
        width = 2 * F.sqrt(area / F.pi()) if true_circle else F.sqrt(area) / F.pi()
    return F.lit(plate_size) / width if not isinstance(plate_size, Column) else plate_size / width


def axis_turns(axe_segments: DataFrame, segments: DataFrame) -> DataFrame:
    """``item_key, axe_id, pos, turn, length``: change of direction from the segment before
    (0 for the first) and length of every segment of an axis; ``segments`` needs
    ``direction, length``."""
    from rootweave.functions import geometry as g

    rows = axe_segments.join(segments.select(ITEM, "seg_id", "direction", "length"), [ITEM, "seg_id"])
    before = F.lag("direction").over(Window.partitionBy(ITEM, "axe_id").orderBy("pos"))
    return rows.select(ITEM, "axe_id", "pos", F.coalesce(g.turn_angle(before, F.col("direction")), F.lit(0.0)).alias("turn"), "length")


def segment_size(segments: DataFrame) -> DataFrame:
    """``segments`` with ``radius``: half the area over the length, which is 1 at least."""
    return segments.withColumn("radius", 0.5 * F.col("area") / F.greatest("length", F.lit(1.0)))


def run_length(runs: DataFrame, lengths: DataFrame) -> DataFrame:
    """``item_key, run, length, n``: total length of unbranched runs ``(item_key, seg_id, run)``."""
    return runs.join(lengths.select(ITEM, "seg_id", "length"), [ITEM, "seg_id"]).groupBy(ITEM, "run").agg(F.sum("length").alias("length"), F.count("*").alias("n"))


def crossing_descriptor(ends: DataFrame, bins: int = 8) -> DataFrame:
    """``item_key, node_id, histogram``: lengths by direction (from -pi, ``bins`` sectors) of
    the runs that meet at a node; ``ends(item_key, node_id, direction, length)``."""
    at = F.least(F.floor((F.col("direction") + F.pi()) / (2 * F.pi()) * bins), F.lit(bins - 1)).cast("int")
    cells = [F.coalesce(F.sum(F.when(F.col("bin") == k, F.col("length"))), F.lit(0.0)) for k in range(bins)]
    return ends.withColumn("bin", at).groupBy(ITEM, "node_id").agg(F.array(*cells).alias("histogram"))
