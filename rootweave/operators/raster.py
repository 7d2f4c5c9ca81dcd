"""Raster operators on tables of cells ``(item_key, y, x, v)``: stencils, filters,
distance transform, labels, thinning, resampling.

Masks and labels hold only cells that are set.  Separable filters run as two window
passes; other footprints as joins with a broadcast table of offsets.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.iterate import rounds, settle, ship
from rootweave.operators import graph

ITEM = "item_key"
CELL = [ITEM, "y", "x"]
N4 = [(-1, 0), (0, -1), (0, 1), (1, 0)]
N8 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


# kernels ---------------------------------------------------------------------------


def ellipse(ry: float, rx: float) -> list[tuple[int, int]]:
    """Offsets inside an ellipse, the centre too."""
    return [
        (y, x) for y in range(-math.floor(ry), math.floor(ry) + 1) for x in range(-math.floor(rx), math.floor(rx) + 1) if (y / max(ry, 1e-9)) ** 2 + (x / max(rx, 1e-9)) ** 2 <= 1 + 1e-9
    ]


def square(radius: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of offsets -k .. k, k = 3 sigma rounded up, adding up to 1."""
    k = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-k, k + 1)]
    return [x / sum(w) for x in w]


# stencils --------------------------------------------------------------------------


def moved(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every cell once for each offset, at the place it reaches, with ``k``, the offset."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(offsets)])).alias("o")
    rows = cells.select("*", o)
    return rows.withColumns({"y": F.col("y") + F.col("o.dy"), "x": F.col("x") + F.col("o.dx"), "k": F.col("o.k")}).drop("o")


def count_around(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """``item_key, y, x, n``: set cells in the footprint of every reached cell."""
    return moved(mask.select(*CELL), [(-dy, -dx) for dy, dx in offsets]).groupBy(*CELL).agg(F.count("*").alias("n"))


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], inside: DataFrame | None = None, times: int = 1) -> DataFrame:
    for _ in range(times):
        mask = moved(mask.select(*CELL), offsets).select(*CELL).distinct()
        if inside is not None:
            mask = mask.join(inside.select(*CELL), CELL, "left_semi")
        mask = settle(mask) if times > 1 else mask
    return mask


def erode(mask: DataFrame, offsets: list[tuple[int, int]], times: int = 1) -> DataFrame:
    """Cells whose whole footprint is set; outside the raster nothing is."""
    for _ in range(times):
        mask = count_around(mask, offsets).where(F.col("n") == len(offsets)).select(*CELL)
        mask = settle(mask) if times > 1 else mask
    return mask


def closing(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return erode(dilate(mask, offsets), offsets)


def opening(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(mask, offsets), offsets)


def window_filter(raster: DataFrame, radius: int, how: str) -> DataFrame:
    """Sliding ``avg``, ``max`` or ``min`` over a square, as a pass along x and one along y."""
    fn = {"avg": F.avg, "max": F.max, "min": F.min}[how]
    if how == "avg":  # sums and counts first, so a border counts its own cells only
        w = Window.partitionBy(ITEM, "y").orderBy("x").rangeBetween(-radius, radius)
        rows = raster.select(*CELL, F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"))
        w = Window.partitionBy(ITEM, "x").orderBy("y").rangeBetween(-radius, radius)
        return rows.select(*CELL, (F.sum("s").over(w) / F.sum("n").over(w)).alias("v"))
    for a, b in (("y", "x"), ("x", "y")):
        raster = raster.select(*CELL, fn("v").over(Window.partitionBy(ITEM, a).orderBy(b).rangeBetween(-radius, radius)).alias("v"))
    return raster


def grey_opening(raster: DataFrame, radius: int) -> DataFrame:
    return window_filter(window_filter(raster, radius, "min"), radius, "max")


def grey_closing(raster: DataFrame, radius: int) -> DataFrame:
    return window_filter(window_filter(raster, radius, "max"), radius, "min")


def footprint_filter(raster: DataFrame, offsets: list[tuple[int, int]], fn) -> DataFrame:
    """``fn`` (an aggregate of column ``v``) over any footprint."""
    reached = moved(raster, [(-dy, -dx) for dy, dx in offsets]).groupBy(*CELL).agg(fn("v").alias("v"))
    return reached.join(raster.select(*CELL), CELL, "left_semi")


def smoothed(rows: DataFrame, value: str, sigma: float) -> DataFrame:
    """``rows`` with ``value`` smoothed along x and then y.  A cell finds those up to k before
    and after among the k rows before and after it, so rows are sorted, not multiplied."""
    weights = gaussian_kernel(sigma)
    k = len(weights) // 2
    for a, b in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(ITEM, a).orderBy(b)
        around = [(F.col(b), F.col(value))]
        around += [(f(b, n).over(w), f(value, n).over(w)) for n in range(1, k + 1) for f in (F.lag, F.lead)]
        names = [(f"__p{n}", f"__v{n}") for n in range(len(around))]
        rows = rows.select("*", *[c.alias(n) for pair, name in zip(around, names) for c, n in zip(pair, name)])
        kernel = F.array(*[F.lit(x) for x in weights[k:]])
        part = zero = F.lit(0.0)
        held = F.lit(False)
        for p, v in names:
            far = F.abs(F.col(p) - F.col(b))
            weight = F.when(far <= k, F.get(kernel, far.cast("int"))).otherwise(zero)
            weight = F.coalesce(weight, zero)
            part = part + F.coalesce(F.col(v) * weight, zero)
            held = held | (F.col(v).isNotNull() & (weight > 0))
        total = zero
        for p, _ in names:
            far = F.abs(F.col(p) - F.col(b))
            total = total + F.coalesce(F.when(far <= k, F.get(kernel, far.cast("int"))), zero)
        rows = rows.withColumn(value, F.when(held, part / total)).drop(*[n for pair in names for n in pair])
    return rows


def smooth(raster: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing in two passes; at borders and holes the weights present count."""
    return smoothed(raster.select(*CELL, F.col("v").cast("double").alias("v")), "v", sigma)


def gradient(raster: DataFrame) -> DataFrame:
    """``gy, gx, norm``: central differences, one-sided at borders and holes."""
    def along(a: str, b: str) -> Column:
        w = Window.partitionBy(ITEM, a).orderBy(b)
        after = F.when(F.lead(b).over(w) == F.col(b) + 1, F.lead("v").over(w))
        before = F.when(F.lag(b).over(w) == F.col(b) - 1, F.lag("v").over(w))
        both = after.isNotNull() & before.isNotNull()
        return F.when(both, (after - before) / 2).otherwise(F.coalesce(after - F.col("v"), F.col("v") - before, F.lit(0.0)))

    rows = raster.withColumns({"gy": along("x", "y"), "gx": along("y", "x")})
    return rows.withColumn("norm", F.hypot("gy", "gx"))


def adaptive(raster: DataFrame, radius: int) -> DataFrame:
    """Value less the mean around."""
    mean = window_filter(raster, radius, "avg").withColumnRenamed("v", "m")
    return raster.join(mean, CELL).select(*CELL, (F.col("v") - F.col("m")).alias("v"))


def adaptive_threshold(raster: DataFrame, radius: int, threshold: float) -> DataFrame:
    mean = window_filter(raster, radius, "avg").withColumnRenamed("v", "m")
    return raster.join(mean, CELL).where(F.col("v") >= F.col("m") * (1 + threshold)).select(*CELL, "v")


def remove_background(raster: DataFrame, distance: int, sigma: float) -> DataFrame:
    """Value less the smoothed local minimum.

    Cells are dealt once, to square parts of the raster with a border as wide as the filters
    reach; all passes are within a part, and the value goes along, so nothing is joined."""
    reach = distance + len(gaussian_kernel(sigma)) // 2
    side = max(512, 32 * reach)
    part = lambda c: F.sequence(F.floor((F.col(c) - reach) / side).cast("int"), F.floor((F.col(c) + reach) / side).cast("int"))
    rows = raster.select(*CELL, "v").withColumn("py", F.explode(part("y"))).withColumn("px", F.explode(part("x")))
    rows = rows.select(F.struct(ITEM, "py", "px").alias(ITEM), "y", "x", "v").repartition(ITEM)
    rows = rows.withColumn("m", F.col("v"))
    for a, b in (("y", "x"), ("x", "y")):
        rows = rows.withColumn("m", F.min("m").over(Window.partitionBy(ITEM, a).orderBy(b).rangeBetween(-distance, distance)))
    rows = smoothed(rows.withColumn("m", F.col("m").cast("double")), "m", sigma)
    own = (F.floor(F.col("y") / side) == F.col(f"{ITEM}.py")) & (F.floor(F.col("x") / side) == F.col(f"{ITEM}.px"))
    return rows.where(own).select(F.col(f"{ITEM}.{ITEM}").alias(ITEM), "y", "x", (F.col("v") - F.col("m")).alias("v"))


def local_minima(raster: DataFrame, radius: int, strict: bool = False) -> DataFrame:
    """Cells that are the minimum of their square; ``strict`` keeps the first of equal
    ones by (v, y, x)."""
    if not strict:
        low = window_filter(raster, radius, "min").withColumnRenamed("v", "m")
        return raster.join(low, CELL).where("v = m").drop("m")
    ranked = raster.withColumn("r", F.struct("v", "y", "x"))
    for a, b in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(ITEM, a).orderBy(b).rangeBetween(-radius, radius)
        ranked = ranked.withColumn("r", F.min("r").over(w))
    return ranked.where("r.y = y and r.x = x").drop("r")


#: Columns of a raster that one group of the distance transform holds.
BLOCK = 32


def nearest_in_rows(ys: np.ndarray, xs: np.ndarray, x: int) -> tuple[np.ndarray, np.ndarray]:
    """Of points sorted by (y, x): in every row the x nearest to ``x``, ties to the smaller,
    and its distance."""
    first = np.flatnonzero(np.diff(ys, prepend=ys[0] - 1))
    key = (np.abs(xs - x) << 1) | (xs > x)
    least = np.minimum.reduceat(key, first)
    far = least >> 1
    return np.where(least & 1, x + far, x - far), far


def envelope(rows: np.ndarray, far: np.ndarray, metric: str) -> tuple[list[int], list[int]]:
    """The rows that are nearest somewhere in a column and the first y where each one is,
    both ascending; ``far`` is a row's distance along the row.  Ties go to the upper row."""
    keep, start = [], []
    for k, (u, g) in enumerate(zip(rows.tolist(), far.tolist())):
        begin = None
        while keep:
            i, h, t = int(rows[keep[-1]]), int(far[keep[-1]]), start[-1]
            # where the lower row is strictly nearer from on
            if metric == "euclidean":
                begin = (u * u - i * i + g * g - h * h) // (2 * (u - i)) + 1
            elif metric == "taxicab":
                begin = None if g >= h + u - i else -(1 << 62) if h > g + u - i else (g - h + u + i) // 2 + 1
            else:
                begin = max(i + g, (i + u) // 2) + 1 if h <= g else min(u - h, (i + u) // 2) + 1
            if begin is None or begin > t:
                break
            keep.pop()
            start.pop()
        if not keep:
            keep, start = [k], [-(1 << 62)]
        elif begin is not None:
            keep.append(k)
            start.append(begin)
    return keep, start


def block_distances(cells: pd.DataFrame, points: pd.DataFrame, metric: str) -> pd.DataFrame:
    """Nearest point of every cell of a block of columns."""
    points = points.sort_values(["y", "x"], kind="stable")
    ys, xs = points["y"].to_numpy(np.int64), points["x"].to_numpy(np.int64)
    rows, out = np.unique(ys), []
    if len(rows):
        for x, column in cells.groupby("x", sort=False):
            near, far = nearest_in_rows(ys, xs, int(x))
            keep, start = envelope(rows, far, metric)
            y = column["y"].to_numpy(np.int64)
            best = np.array(keep)[np.searchsorted(np.array(start), y, side="right") - 1]
            steps, along = np.abs(y - rows[best]), far[best]
            d = np.sqrt((steps * steps + along * along).astype(float)) if metric == "euclidean" else (steps + along if metric == "taxicab" else np.maximum(steps, along)).astype(float)
            out.append(pd.DataFrame({"item_key": column["item_key"], "y": y.astype(np.int32), "x": np.int32(x), "d": d, "fy": rows[best].astype(np.int32), "fx": near[best].astype(np.int32)}))
    return pd.concat(out) if out else pd.DataFrame({"item_key": cells["item_key"][:0], **{c: pd.Series(dtype=t) for c, t in (("y", "int32"), ("x", "int32"), ("d", "float64"), ("fy", "int32"), ("fx", "int32"))}})


def distance_transform(raster: DataFrame, features: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``item_key, y, x, d, fy, fx``: distance of every raster cell to the nearest feature
    cell, and that cell.  ``metric``: ``euclidean``, ``chessboard`` or ``taxicab``.

    The raster may have gaps, and features may stand where it has no cell.  A block of
    columns is one group: it holds the features in it and, of every row, the nearest ones
    on either side, so no row is gathered.  In a column the rows' distances form a lower
    envelope, found in one pass.  Work: the cells, and of every item its feature rows once
    a column that has cells.

    Items without features have no row, nor have cells with null places; repeated cells
    have one each, repeated features count once, an empty table gives no row."""
    if metric not in ("euclidean", "chessboard", "taxicab"):
        raise ValueError(f"unknown metric {metric}")
    ship(raster.sparkSession)
    place = lambda t: t.select(ITEM, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.floor(F.col("x") / BLOCK).cast("int").alias("block")).where("y is not null and x is not null")
    cells, points = place(raster), place(features).distinct()
    blocks = cells.groupBy(ITEM, "block").agg(F.lit(1).alias("one")).drop("one")
    ends = blocks.groupBy(ITEM).agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    # the features at either end of a block's part of a row serve the blocks up to the next part
    parts = points.groupBy(ITEM, "y", "block").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    w = Window.partitionBy(ITEM, "y").orderBy("block")
    parts = parts.select("*", F.lag("block").over(w).alias("before"), F.lead("block").over(w).alias("after")).join(ends, ITEM)
    up_to = F.explode(F.when(F.least("hi", F.coalesce("after", "hi")) > F.col("block"), F.sequence(F.greatest("lo", F.col("block") + 1), F.least("hi", F.coalesce("after", "hi")))))
    down_to = F.explode(F.when(F.greatest("lo", F.coalesce("before", "lo")) < F.col("block"), F.sequence(F.greatest("lo", F.coalesce("before", "lo")), F.least("hi", F.col("block") - 1))))
    right = parts.where(F.greatest("lo", F.col("block") + 1) <= F.least("hi", F.coalesce("after", "hi"))).select(ITEM, "y", F.col("x1").alias("x"), up_to.alias("block"))
    left = parts.where(F.greatest("lo", F.coalesce("before", "lo")) <= F.least("hi", F.col("block") - 1)).select(ITEM, "y", F.col("x0").alias("x"), down_to.alias("block"))
    near = points.unionByName(left).unionByName(right).join(blocks, [ITEM, "block"], "left_semi")
    near = near.select(*[F.col(c).alias(c) for c in near.columns])  # own columns, where features are part of the raster
    item = cells.schema[ITEM].dataType.simpleString()
    key = [ITEM, "block"]
    work = lambda a, b: block_distances(a, b, metric)
    return cells.groupBy(*key).cogroup(near.groupBy(*key)).applyInPandas(work, f"item_key {item}, y int, x int, d double, fy int, fx int")


def fill_nearest(raster: DataFrame, invalid: DataFrame, most: float | None = None) -> DataFrame:
    """Invalid cells get the value of the nearest valid one, at most ``most`` away."""
    valid = raster.join(invalid.select(*CELL), CELL, "left_anti")
    near = distance_transform(raster, valid).join(invalid.select(*CELL), CELL, "left_semi")
    near = near if most is None else near.where(F.col("d") <= most)
    value = valid.select(ITEM, F.col("y").alias("fy"), F.col("x").alias("fx"), "v")
    return valid.select(*CELL, "v").unionByName(near.join(value, [ITEM, "fy", "fx"]).select(*CELL, "v"))


# labels ----------------------------------------------------------------------------


def cell_id(y: Column, x: Column) -> Column:
    return y.cast("long") * (1 << 31) + x


#: Side of the tiles into which the ways of a large raster are dealt.
TILE = 256


def tile(node: Column) -> Column:
    """The tile of a cell's number."""
    y = F.shiftright(node + (1 << 30), 31)
    x = node - y * (1 << 31)
    return F.concat_ws(":", F.floor(y / TILE), F.floor(x / TILE))


def label_components(mask: DataFrame, neighbours: list[tuple[int, int]] = N8) -> DataFrame:
    """``item_key, y, x, label``: connected cells share their least cell's number."""
    nodes = mask.select(*CELL, cell_id(F.col("y"), F.col("x")).alias("node_id"))
    half = [o for o in neighbours if o > (0, 0)]
    reach = moved(nodes.select(*CELL, F.col("node_id").alias("a")), half)
    edges = reach.join(nodes.withColumnRenamed("node_id", "b"), CELL).select(ITEM, "a", "b")
    label = graph.components(nodes, edges)
    return nodes.join(label, [ITEM, "node_id"]).select(*CELL, F.col("component").alias("label"))


def label_table(labels: DataFrame) -> DataFrame:
    """``item_key, label``, cells, bounding box and centre."""
    return labels.groupBy(ITEM, "label").agg(
        F.count("*").alias("cells"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx")
    )


def label_statistics(labels: DataFrame, raster: DataFrame) -> DataFrame:
    rows = labels.join(raster.select(*CELL, "v"), CELL)
    weight = F.sum("v")
    return rows.groupBy(ITEM, "label").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.stddev_pop("v").alias("std"),
        (F.sum(F.col("v") * F.col("y")) / weight).alias("my"), (F.sum(F.col("v") * F.col("x")) / weight).alias("mx"),
    )


def relabel(labels: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Labels from 1 by the given columns of ``label_table``, then by label."""
    table = label_table(labels)
    rank = F.row_number().over(Window.partitionBy(ITEM).orderBy(*(order or []), "label"))
    return labels.join(table.select(ITEM, "label", rank.alias("new")), [ITEM, "label"]).select(*CELL, F.col("new").alias("label"))


def clean_labels(labels: DataFrame, least_cells: int = 1, least_side: int = 1) -> DataFrame:
    """Labels with enough cells and one side of the box at least ``least_side``, renumbered."""
    side = F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) + 1
    good = label_table(labels).where((F.col("cells") >= least_cells) & (side >= least_side)).select(ITEM, "label")
    return relabel(labels.join(good, [ITEM, "label"], "left_semi"))


def biggest(labels: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` labels with most cells of each item."""
    rank = F.row_number().over(Window.partitionBy(ITEM).orderBy(F.desc("cells"), "label"))
    top = label_table(labels).withColumn("r", rank).where(F.col("r") <= n).select(ITEM, "label")
    return labels.join(top, [ITEM, "label"], "left_semi")


def fill_holes(mask: DataFrame, shape: DataFrame) -> DataFrame:
    """``mask`` with the background components that don't touch the border;
    ``shape(item_key, height, width)``."""
    grid = shape.select(ITEM, "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select(ITEM, "height", "width", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    back = label_components(grid.join(mask.select(*CELL), CELL, "left_anti"), N4)
    edge = back.join(shape, ITEM).where("y = 0 or x = 0 or y = height - 1 or x = width - 1").select(ITEM, "label").distinct()
    return mask.select(*CELL).union(back.join(edge, [ITEM, "label"], "left_anti").select(*CELL))


def fill_label_holes(labels: DataFrame, shape: DataFrame) -> DataFrame:
    """Holes around which only one label stands get that label."""
    filled = fill_holes(labels, shape)
    hole = label_components(filled.join(labels.select(*CELL), CELL, "left_anti"), N4).withColumnRenamed("label", "hole")
    around = moved(hole, N8).select(ITEM, "y", "x", "hole").join(labels, CELL).groupBy(ITEM, "hole").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    inside = hole.join(around.where("label = other").select(ITEM, "hole", "label"), [ITEM, "hole"]).select(*CELL, "label")
    return labels.select(*CELL, "label").union(inside)


def label_dilation(labels: DataFrame, raster: DataFrame, radius: float) -> DataFrame:
    near = distance_transform(raster, labels).where(F.col("d") <= radius)
    own = labels.select(ITEM, F.col("y").alias("fy"), F.col("x").alias("fx"), "label")
    return near.join(own, [ITEM, "fy", "fx"]).select(*CELL, "label")


def label_erosion(labels: DataFrame, raster: DataFrame, radius: float) -> DataFrame:
    outside = raster.select(*CELL).join(labels.select(*CELL), CELL, "left_anti")
    far = distance_transform(raster, outside).where(F.col("d") > radius).select(*CELL)
    return labels.join(far, CELL, "left_semi")


def hysteresis(raster: DataFrame, high: float, low: float) -> DataFrame:
    """Cells above ``low`` that are connected to one above ``high``."""
    weak = raster.where(F.col("v") > low)
    labels = label_components(weak)
    strong = labels.join(weak.where(F.col("v") > high).select(*CELL), CELL, "left_semi").select(ITEM, "label").distinct()
    return labels.join(strong, [ITEM, "label"], "left_semi").select(*CELL)


def watershed(raster: DataFrame, seeds: DataFrame, neighbours: list[tuple[int, int]] = N8) -> DataFrame:
    """``item_key, y, x, label``: the seed reached over the lowest pass."""
    edges = _cell_edges(raster, neighbours, lambda a, b, d: F.greatest(a, b))
    return _spread(raster, seeds, edges, "max")


def gradient_clusters(raster: DataFrame, seeds: DataFrame, geometric: bool = True, neighbours: list[tuple[int, int]] = N8) -> DataFrame:
    """The seed with the cheapest path: changes of value, with the way's length."""
    value = (lambda a, b, d: F.abs(a - b) + d * 1e-3) if geometric else (lambda a, b, d: F.abs(a - b))
    return _spread(raster, seeds, _cell_edges(raster, neighbours, value), "sum")


def nearest_clusters(raster: DataFrame, seeds: DataFrame) -> DataFrame:
    own = seeds.select(ITEM, F.col("y").alias("fy"), F.col("x").alias("fx"), "label")
    return distance_transform(raster, seeds).join(own, [ITEM, "fy", "fx"]).select(*CELL, "label")


def _cell_edges(raster, neighbours, value):
    e = graph.grid_edges(raster, neighbours, value)
    return settle(e.select(ITEM, cell_id(F.col("ya"), F.col("xa")).alias("a"), cell_id(F.col("yb"), F.col("xb")).alias("b"), "cost"))


def _spread(raster, seeds, edges, combine):
    start = seeds.select(*CELL, "label", cell_id(F.col("y"), F.col("x")).alias("node_id"))
    # a way costs nothing at its start; the largest of its edges may be below 0
    nothing = 0.0 if combine == "sum" else -sys.float_info.max
    found = graph.shortest_paths(edges, start.select(ITEM, "node_id", F.lit(nothing).alias("dist")), combine=combine, place=tile)
    named = found.join(start.select(ITEM, F.col("node_id").alias("source"), "label"), [ITEM, "source"])
    cells = raster.select(*CELL, cell_id(F.col("y"), F.col("x")).alias("node_id"))
    return cells.join(named, [ITEM, "node_id"]).select(*CELL, "label")


def blobs(mask: DataFrame, raster: DataFrame, least: int = 1) -> DataFrame:
    """Blobs of a mask: watershed of its distance map from the map's maxima."""
    outside = raster.select(*CELL).join(mask.select(*CELL), CELL, "left_anti")
    depth = settle(distance_transform(raster, outside).join(mask.select(*CELL), CELL, "left_semi").select(*CELL, F.negate("d").alias("v")))
    peaks = label_components(local_minima(depth, max(1, least)))
    return watershed(depth, peaks)


# thinning --------------------------------------------------------------------------

RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def ring_code(mask: DataFrame) -> DataFrame:
    """``item_key, y, x, p``: the eight neighbours of each set cell, clockwise from above."""
    around = moved(mask.select(*CELL), [(-dy, -dx) for dy, dx in RING]).groupBy(*CELL).agg(F.sum(F.pow(F.lit(2), F.col("k"))).cast("int").alias("c"))
    rows = mask.select(*CELL).join(around, CELL, "left").select(*CELL, F.coalesce("c", F.lit(0)).alias("c"))
    return rows.select(*CELL, F.array(*[F.shiftright("c", i).bitwiseAND(F.lit(1)) for i in range(8)]).alias("p"))


def thin(mask: DataFrame, most: int | None = None) -> DataFrame:
    """Skeleton by Zhang and Suen's two sub-steps, all items at once."""
    mask = settle(mask.select(*CELL))
    for _ in rounds(most):
        before = mask.count()
        for step in (0, 1):
            rows = ring_code(mask)
            p = F.col("p")
            n = F.aggregate(p, F.lit(0), lambda a, v: a + v)
            turns = sum((F.when((p[i] == 0) & (p[(i + 1) % 8] == 1), 1).otherwise(0) for i in range(8)), F.lit(0))
            if step == 0:
                rule = (p[0] * p[2] * p[4] == 0) & (p[2] * p[4] * p[6] == 0)
            else:
                rule = (p[0] * p[2] * p[6] == 0) & (p[0] * p[4] * p[6] == 0)
            mask = settle(rows.where(~(n.between(2, 6) & (turns == 1) & rule)).select(*CELL))
        if mask.count() == before:
            break
    return mask


def skeleton_parts(skeleton: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(segments, nodes)`` as labels: cells with at most two neighbours, and others."""
    n = count_around(skeleton, N8)
    rows = settle(skeleton.join(n, CELL, "left").select(*CELL, F.coalesce("n", F.lit(0)).alias("n")))
    return label_components(rows.where("n <= 2").select(*CELL)), label_components(rows.where("n > 2").select(*CELL))


def image_graph(segments: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(item_key, node_id, x, y)`` at box centres, and ``segments(item_key, seg_id, n0,
    n1, cells)`` of the skeleton labels that touch two nodes or more (their least two)."""
    box = label_table(nodes)
    points = box.select(ITEM, F.col("label").alias("node_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    touch = moved(segments.withColumnRenamed("label", "seg_id"), N8).select(*CELL, "seg_id").join(nodes, CELL).select(ITEM, "seg_id", "label").distinct()
    ends = touch.groupBy(ITEM, "seg_id").agg(F.array_sort(F.collect_list("label")).alias("e")).where("size(e) >= 2")
    size = segments.groupBy(ITEM, F.col("label").alias("seg_id")).agg(F.count("*").alias("cells"))
    return points, ends.select(ITEM, "seg_id", F.col("e")[0].alias("n0"), F.col("e")[1].alias("n1")).join(size, [ITEM, "seg_id"])


def curve_order(curve: DataFrame) -> DataFrame:
    """``item_key, label, y, x, rank``: cells of every labelled curve from one end (the
    least cell of a closed one)."""
    own = curve.select(*CELL, "label", cell_id(F.col("y"), F.col("x")).alias("node_id"))
    reach = moved(own.select(*CELL, "label", F.col("node_id").alias("a")), N8)
    edges = settle(reach.join(own.withColumnRenamed("node_id", "b"), [*CELL, "label"]).select(ITEM, "label", "a", "b", F.lit(1.0).alias("cost")))
    degree = edges.groupBy(ITEM, F.col("a").alias("node_id")).agg(F.count("*").alias("k"))
    start = own.join(degree, [ITEM, "node_id"], "left").groupBy(ITEM, "label").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "node_id")).alias("s"))
    hops = graph.shortest_paths(edges.select(ITEM, "a", "b", "cost"), start.select(ITEM, F.col("s.node_id").alias("node_id"), F.lit(0.0).alias("dist")))
    rows = own.join(hops.select(ITEM, "node_id", "dist"), [ITEM, "node_id"])
    return rows.select(ITEM, "label", "y", "x", F.row_number().over(Window.partitionBy(ITEM, "label").orderBy("dist", "node_id")).alias("rank"))


def curve_length(curve: DataFrame) -> DataFrame:
    """``item_key, label, length`` by counting steps and corners: 0.98 for a straight
    step, 1.406 for a diagonal one, less 0.091 for every corner but one."""
    order = curve_order(curve)
    w = Window.partitionBy(ITEM, "label").orderBy("rank")
    step = order.select("*", (F.col("y") - F.lag("y").over(w)).alias("dy"), (F.col("x") - F.lag("x").over(w)).alias("dx"))
    step = step.withColumn("turn", (F.lag("dy").over(w) != F.col("dy")) | (F.lag("dx").over(w) != F.col("dx")))
    straight, diagonal = F.abs(F.col("dy")) + F.abs(F.col("dx")) == 1, F.abs(F.col("dy")) + F.abs(F.col("dx")) >= 2
    corners = F.count_if(F.coalesce("turn", F.lit(False)))
    return step.groupBy(ITEM, "label").agg((0.98 * F.count_if(straight) + 1.406 * F.count_if(diagonal) - 0.091 * F.greatest(corners - 1, F.lit(0))).alias("length"))


def polyline(order: DataFrame, every: int) -> DataFrame:
    """Every k-th cell of an ordered curve and its ends, paired to short segments."""
    w = Window.partitionBy(ITEM, "label")
    kept = order.withColumn("last", F.max("rank").over(w)).where((F.col("rank") % every == 1) | (F.col("rank") == F.col("last")) | F.lit(every == 1))
    after = lambda c: F.lead(c).over(w.orderBy("rank"))
    return kept.select(ITEM, "label", "rank", F.col("y").alias("y0"), F.col("x").alias("x0"), after("y").alias("y1"), after("x").alias("x1")).where("y1 is not null")


def resample(raster: DataFrame, inverse: list[float], height: int, width: int, linear: bool = False, outside: float | None = None) -> DataFrame:
    """Raster on a new grid: target (x, y) takes the source at ``inverse`` times (x, y, 1)."""
    grid = raster.select(ITEM).distinct().select(ITEM, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select(ITEM, "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    a, b, c, d, e, f, g, h, i = (F.lit(float(v)) for v in inverse)
    w = g * F.col("x") + h * F.col("y") + i
    grid = grid.withColumns({"sx": (a * F.col("x") + b * F.col("y") + c) / w, "sy": (d * F.col("x") + e * F.col("y") + f) / w})
    src = raster.select(ITEM, F.col("y").alias("iy"), F.col("x").alias("ix"), "v")
    if not linear:
        found = grid.withColumns({"iy": F.round("sy").cast("int"), "ix": F.round("sx").cast("int")}).join(src, [ITEM, "iy", "ix"], "left")
    else:
        corners = F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("t")) for u in (0, 1) for v in (0, 1)])).alias("o")
        near = grid.select("*", corners).withColumns({"iy": (F.floor("sy") + F.col("o.u")).cast("int"), "ix": (F.floor("sx") + F.col("o.t")).cast("int")})
        weight = (1 - F.abs(F.col("sy") - F.col("iy"))) * (1 - F.abs(F.col("sx") - F.col("ix")))
        found = near.withColumn("w", weight).where("w > 0").join(src, [ITEM, "iy", "ix"], "left").groupBy(*CELL).agg(F.sum(F.coalesce("v", F.lit(outside)) * F.col("w")).alias("v"))
    return found.select(*CELL, F.coalesce("v", F.lit(outside)).alias("v"))


def stitch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rasters in one frame; the first wins."""
    return a.select(*CELL, "v").join(b.select(*CELL, F.col("v").alias("v2")), CELL, "full").select(*CELL, F.coalesce("v", "v2").alias("v"))


def fill_polygon(polygons: DataFrame) -> DataFrame:
    """``item_key, y, x``: cells whose centre lies inside a polygon (even-odd rule), from
    ``polygons(item_key, ring)``, an array of ``struct(x, y)``."""
    lo = lambda c: F.ceil(F.array_min(F.transform("ring", lambda p: p[c]))).cast("int")
    hi = lambda c: F.floor(F.array_max(F.transform("ring", lambda p: p[c]))).cast("int")
    grid = polygons.select(ITEM, "ring", F.explode(F.sequence(lo("y"), hi("y"))).alias("y")).select(ITEM, "ring", "y", F.explode(F.sequence(lo("x"), hi("x"))).alias("x"))

    def crossing(p, i):
        q = F.get(F.col("ring"), F.pmod(i + 1, F.size("ring")))
        up = (p["y"] > F.col("y")) != (q["y"] > F.col("y"))
        at = p["x"] + (F.col("y") - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"])
        return F.when(up & (F.col("x") < at), 1).otherwise(0)

    count = F.aggregate(F.transform("ring", crossing), F.lit(0), lambda a, v: a + v)
    return grid.where(count % 2 == 1).select(*CELL)


def line_cells(segments: DataFrame) -> DataFrame:
    """``item_key, seg_id, y, x``: cells on a straight line between rounded ends."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))).cast("int")
    rows = segments.select(ITEM, "seg_id", "x0", "y0", "x1", "y1", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).alias("k"))
    at = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.greatest("n", F.lit(1))).cast("int")
    return rows.select(ITEM, "seg_id", at("y0", "y1").alias("y"), at("x0", "x1").alias("x")).distinct()


# more filters ------------------------------------------------------------------------


def threshold(raster: DataFrame, value: float | None = None) -> DataFrame:
    """Cells above ``value``, by default above each item's Otsu threshold."""
    from rootweave.operators import stats

    if value is not None:
        return raster.where(F.col("v") > value).select(*CELL)
    cut = stats.otsu(raster, [ITEM], "v").select(ITEM, "threshold")
    return raster.join(cut, ITEM).where("v > threshold").select(*CELL)


def median_filter(raster: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Median over a footprint; a place holds at most as many values as the footprint."""
    return footprint_filter(raster, offsets, F.median)


def second_derivatives(raster: DataFrame) -> DataFrame:
    """``yy, yx, xx``: second differences; missing neighbours count as the cell itself."""
    def moved_by(dy, dx, name):
        return raster.select(ITEM, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("v").alias(name))

    rows = raster.select(*CELL, "v")
    for name, (dy, dx) in {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}.items():
        rows = rows.join(moved_by(dy, dx, name), CELL, "left")
    c = lambda k: F.coalesce(k, "v")
    cross = (c("se") - c("sw") - c("ne") + c("nw")) / 4
    return rows.select(*CELL, (c("n") + c("s") - 2 * F.col("v")).alias("yy"), cross.alias("yx"), (c("w") + c("e") - 2 * F.col("v")).alias("xx"))


def vesselness(raster: DataFrame, sigmas: list[float], beta: float = 0.5, c: float = 15.0) -> DataFrame:
    """``item_key, y, x, v, ridge``: the largest vesselness over the scales, and whether any
    scale sees a ridge."""
    from rootweave.functions import numbers as nb

    found = None
    for s in sigmas:
        h = second_derivatives(smooth(raster, s))
        e = nb.eigenvalues(F.col("yy"), F.col("yx"), F.col("xx"))
        one = h.select(*CELL, e.alias("e")).select(*CELL, (nb.vesselness(F.col("e.l1"), F.col("e.l2"), beta, c) * s * s).alias("v"), nb.ridge(F.col("e.l1"), F.col("e.l2")).alias("ridge"))
        found = one if found is None else found.union(one)
    return found.groupBy(*CELL).agg(F.max("v").alias("v"), F.bool_or("ridge").alias("ridge"))


def normalise_image(raster: DataFrame) -> DataFrame:
    """Values mapped to [0, 1] in every item, inverted where the mean is above a half."""
    from rootweave.operators import stats

    flat = stats.normalise(raster, [ITEM], "v")
    mean = flat.groupBy(ITEM).agg(F.avg("v").alias("mean"))
    return flat.join(mean, ITEM).select(*CELL, F.when(F.col("mean") > 0.5, 1 - F.col("v")).otherwise(F.col("v")).alias("v"))


def pad(raster: DataFrame, shape: DataFrame, width: int, value: float | None = None) -> DataFrame:
    """The raster with a border of ``width`` cells on every side, moved so that it starts at
    0, filled with ``value`` or else with the nearest border cell;
    ``shape(item_key, height, width)``."""
    size = shape.select(ITEM, "height", F.col("width").alias("w"))
    grid = size.select(ITEM, "height", "w", F.explode(F.sequence(F.lit(0), F.col("height") + 2 * width - 1)).alias("y"))
    grid = grid.select(ITEM, "height", "w", "y", F.explode(F.sequence(F.lit(0), F.col("w") + 2 * width - 1)).alias("x"))
    clamp = lambda c, top: F.least(F.greatest(F.col(c) - width, F.lit(0)), F.col(top) - 1)
    src = raster.select(ITEM, F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    found = grid.withColumns({"sy": clamp("y", "height"), "sx": clamp("x", "w")}).join(src, [ITEM, "sy", "sx"], "left")
    if value is not None:
        inside = (F.col("y") - width == F.col("sy")) & (F.col("x") - width == F.col("sx"))
        return found.select(*CELL, F.when(inside, F.col("v")).otherwise(F.lit(float(value))).alias("v"))
    return found.select(*CELL, "v")


def box_seeds(labels: DataFrame, box: tuple[float, float, float, float], shape: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest labels of each item whose centre lies in a relative box ``(x0, y0,
    x1, y1)``, numbered from 1 from left to right."""
    table = label_table(labels).join(shape, ITEM)
    x, y = F.col("cx") / F.col("width"), F.col("cy") / F.col("height")
    inside = table.where(x.between(box[0], box[2]) & y.between(box[1], box[3]))
    rank = F.row_number().over(Window.partitionBy(ITEM).orderBy(F.desc("cells"), "label"))
    top = inside.withColumn("r", rank).where(F.col("r") <= n)
    new = F.row_number().over(Window.partitionBy(ITEM).orderBy("x0", "label"))
    return labels.join(top.select(ITEM, "label", new.alias("new")), [ITEM, "label"]).select(*CELL, F.col("new").alias("label"))


def best_circles(labels: DataFrame, raster: DataFrame, n: int, least: float | None = None) -> DataFrame:
    """``item_key, label, cy, cx, radius, quality``: the ``n`` labels of an item that hold the
    most of a disc: ``2 * pi * rmax ** 2 - area``, largest first, with ``rmax`` the largest
    distance to the outside; only those above ``least``, if given."""
    outside = raster.select(*CELL).join(labels.select(*CELL), CELL, "left_anti")
    depth = distance_transform(raster, outside).join(labels, CELL).groupBy(ITEM, "label").agg(F.max("d").alias("radius"), F.max_by("y", "d").alias("cy"), F.max_by("x", "d").alias("cx"), F.count("*").alias("area"))
    rows = depth.withColumn("quality", 2 * F.pi() * F.col("radius") ** 2 - F.col("area"))
    rows = rows if least is None else rows.where(F.col("quality") > least)
    rank = F.row_number().over(Window.partitionBy(ITEM).orderBy(F.desc("quality"), "label"))
    return rows.withColumn("r", rank).where(F.col("r") <= n).select(ITEM, "label", "cy", "cx", "radius", "quality")
