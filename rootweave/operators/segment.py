"""From images to root graphs and trees: foreground, plates, root masks, leaves and
seeds, linear decomposition, graphs of polylines.

Images are rasters ``(item_key, y, x, v)`` with a cell for every pixel, masks and labels
hold set cells only, ``shape(item_key, height, width)`` gives the sizes.  All items run
in one job; an item without the object looked for has no rows in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.iterate import settle
from rootweave.operators import graph, measure, stats, trees
from rootweave.operators import raster as ra

ITEM, CELL = "item_key", ra.CELL
CROSS = [(0, 0), *ra.N4]


def root_mask(image: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Cells in the upper of two classes of values; what is not above the least value of
    the lower class is background, too.  ``mask`` restricts what is looked at."""
    rows = image if mask is None else image.join(mask.select(*CELL), CELL, "left_semi")
    rows = settle(rows.select(*CELL, "v"))
    classed = settle(stats.cluster_values(rows, [ITEM], "v", stats.gaussian_mixture(rows, [ITEM], "v")))
    low = classed.groupBy(ITEM).agg(F.min(F.when(F.col("class") == 0, F.col("v"))).alias("low"))
    return classed.join(low, ITEM).where("class > 0 and (low is null or v > low)").select(*CELL)


def find_seeds(image: DataFrame, method: str = "local_min", min_distance: int = 1) -> DataFrame:
    """``item_key, y, x, label``: seed cells, connected ones with one label.

    ``local_min``: minima of the image; ``extremum``: minima of the norm of its second
    derivatives; ``dist2border``: cells farthest from where the gradient is strong (above
    its Otsu threshold)."""
    if method == "extremum":
        d = ra.second_derivatives(image)
        height = d.select(*CELL, F.sqrt(F.col("yy") ** 2 + 2 * F.col("yx") ** 2 + F.col("xx") ** 2).alias("v"))
    elif method == "dist2border":
        norm = settle(ra.gradient(image).select(*CELL, F.col("norm").alias("v")))
        height = ra.distance_transform(norm, ra.threshold(norm)).select(*CELL, F.negate("d").alias("v"))
    elif method == "local_min":
        height = image.select(*CELL, "v")
    else:
        raise ValueError(f"unknown method {method}")
    return ra.label_components(ra.local_minima(settle(height), min_distance))


def foreground(image: DataFrame, shape: DataFrame, smooth: float = 5, classes: tuple[int, int] = (2, 1)) -> DataFrame:
    """What a wall of strong gradient encloses: the gradient's norm in ``classes[0]`` classes,
    of which the lowest ``classes[1]`` are no wall, and the holes filled."""
    soft = ra.smooth(image, smooth) if smooth else image
    norm = settle(ra.gradient(soft).select(*CELL, F.col("norm").alias("v")))
    params = stats.gaussian_mixture(norm, [ITEM], "v", classes=classes[0])
    wall = settle(stats.cluster_values(norm, [ITEM], "v", params).where(F.col("class") >= classes[1]).select(*CELL))
    return ra.fill_holes(wall, shape)


def shrunk(mask: DataFrame, image: DataFrame, steps: int | DataFrame) -> DataFrame:
    """Cells of a mask more than ``steps`` taxicab steps inside, a number or one of each item
    ``(item_key, steps)``; the image's edge is outside."""
    far = ra.distance_transform(image, image.select(*CELL).join(mask.select(*CELL), CELL, "left_anti"), "taxicab")
    edge = image.groupBy(ITEM).agg(F.max("y").alias("h"), F.max("x").alias("w"))
    edge = edge.join(steps, ITEM) if isinstance(steps, DataFrame) else edge.withColumn("steps", F.lit(steps))
    rows = mask.select(*CELL).join(far.select(*CELL, "d"), CELL, "left").join(edge, ITEM)
    rim = F.least(F.col("y"), F.col("x"), F.col("h") - F.col("y"), F.col("w") - F.col("x")) + 1
    return rows.where(F.least(F.coalesce("d", F.lit(float("inf"))), rim) > F.col("steps")).select(*CELL)


def plate(mask: DataFrame, image: DataFrame, border: float, size: float, form: str = "square") -> dict[str, DataFrame]:
    """The largest component of a foreground mask as a plate: ``cells`` with ``zone`` 1 for its
    border and 2 inside, ``scale`` (size of a pixel) and ``hull``.

    ``border`` is in pixels, or below 1 a share of the diameter of each item's own plate, so
    an item's result does not depend on the others.  Items without a mask have no rows."""
    big = settle(ra.biggest(ra.label_components(mask, ra.N4)).select(*CELL))
    area = settle(big.groupBy(ITEM).agg(F.count("*").alias("area")))
    scale = area.select(ITEM, measure.pixel_size(F.col("area"), size, form).alias("scale"))
    width = F.lit(float(border)) if border >= 1 else border * F.sqrt("area")
    steps = settle(area.select(ITEM, F.floor(width).cast("int").alias("steps"), F.floor(width / 2**0.5).cast("int").alias("corner")))
    core = shrunk(big, image, steps.select(ITEM, "steps"))
    near = ra.distance_transform(image, core, "taxicab").join(steps, ITEM).where("d <= steps")
    big = settle(near.select(*CELL).join(big, CELL, "left_semi"))
    outside = image.select(*CELL).join(big, CELL, "left_anti")
    # an image that is all plate has nothing outside
    wide = image.select(*CELL).join(ra.distance_transform(image, outside, "chessboard").select(*CELL, "d"), CELL, "left").join(steps, ITEM).where("d is null or d > corner").select(*CELL)
    inside = shrunk(big, image, steps.select(ITEM, "steps")).join(wide, CELL, "left_semi").withColumn("in", F.lit(True))
    cells = big.join(inside, CELL, "left").select(*CELL, F.when(F.col("in"), 2).otherwise(1).alias("zone"))
    return {"cells": settle(cells), "scale": scale, "hull": measure.hull(big, [ITEM])}


def marked_plate(image: DataFrame, value: float | None, least: int, marker_size: float) -> dict[str, DataFrame]:
    """A plate given by bright marks: cells above a value (by default Otsu's), marks with a
    side of at least ``least``, and the hull around them filled.  ``scale`` comes from the
    largest mark, a square of ``marker_size``."""
    marks = settle(ra.clean_labels(ra.label_components(ra.threshold(image, value)), least_side=least))
    hull = settle(measure.hull(marks, [ITEM]))
    top = ra.label_table(marks).groupBy(ITEM).agg(F.max("cells").alias("area"))
    return {
        "cells": ra.fill_polygon(hull.withColumnRenamed("hull", "ring")).withColumn("zone", F.lit(2)),
        "scale": top.select(ITEM, measure.pixel_size(F.col("area"), marker_size).alias("scale")),
        "hull": hull,
    }


def whole_image(image: DataFrame, scale: float) -> dict[str, DataFrame]:
    """No plate: every cell is inside."""
    return {"cells": image.select(*CELL, F.lit(2).alias("zone")), "scale": image.select(ITEM).distinct().select(ITEM, F.lit(scale).alias("scale")), "hull": measure.hull(image, [ITEM])}


def circle_frame(labels: DataFrame, image: DataFrame, distance: float, n: int = 4) -> DataFrame:
    """``item_key, scale, m``: size of a pixel and rotation from the two uppermost of the
    ``n`` best circles, whose centres are ``distance`` apart in reality; the matrix turns the
    line between them level and puts the left one at the origin."""
    discs = settle(ra.best_circles(labels, image, n))
    w = Window.partitionBy(ITEM)
    two = discs.withColumn("r", F.row_number().over(w.orderBy("cy", "cx"))).where("r <= 2")
    ends = two.groupBy(ITEM).agg(F.array_sort(F.collect_list(F.struct("cx", "cy"))).alias("p")).where("size(p) = 2")
    dx, dy = F.col("p")[1]["cx"] - F.col("p")[0]["cx"], F.col("p")[1]["cy"] - F.col("p")[0]["cy"]
    a = F.atan2(dy, dx)
    x0, y0 = F.col("p")[0]["cx"], F.col("p")[0]["cy"]
    c, s = F.cos(a), F.sin(a)
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(c, s, -(c * x0 + s * y0), -s, c, s * x0 - c * y0, zero, zero, one)
    return ends.select(ITEM, (F.lit(distance) / F.hypot(dx, dy)).alias("scale"), m.alias("m"))


def square_frame(mask: DataFrame, image: DataFrame, share: float = 0.9, rim: float = 1.0) -> DataFrame:
    """Cells of a mask inside a square frame: components whose box is larger than ``share``
    of the largest are the frame; what lies between its parts on all four sides, farther
    than ``rim`` from it, is inside."""
    labels = settle(ra.label_components(mask))
    box = ra.label_table(labels).withColumn("side", F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) + 1)
    top = box.groupBy(ITEM).agg(F.max("side").alias("top"))
    frame = settle(labels.join(box.join(top, ITEM).where(F.col("side") > share * F.col("top")).select(ITEM, "label"), [ITEM, "label"], "left_semi").select(*CELL))
    marked = image.select(*CELL).join(frame.withColumn("f", F.lit(1)), CELL, "left").select(*CELL, F.coalesce("f", F.lit(0)).alias("f"))
    seen = []
    for a, b in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(ITEM, a).orderBy(b)
        seen += [F.max("f").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("f").over(w.rowsBetween(0, Window.unboundedFollowing))]
    inside = marked.select(*CELL, "f", F.least(*seen).alias("all")).where("all = 1 and f = 0").select(*CELL)
    far = ra.distance_transform(image, frame).where(F.col("d") > rim).select(*CELL)
    return mask.select(*CELL).join(inside, CELL, "left_semi").join(far, CELL, "left_semi")


def item_mask(image: DataFrame, zones: DataFrame | None, root_radius: int, least_side: int = 50, smooth: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``(mask, corner)``: roots inside a plate, cut to its box; ``corner(item_key, y0, x0)``.

    Values are smoothed within the plate, the background is taken off at ``root_radius``,
    two classes are told apart, gaps of a cell are closed, and parts with no side of
    ``least_side`` go."""
    inside = image.select(*CELL) if zones is None else zones.where("zone = 2").select(*CELL)
    corner = settle(inside.groupBy(ITEM).agg(F.min("y").alias("y0"), F.min("x").alias("x0")))
    moved = lambda df: df.join(corner, ITEM).withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).drop("y0", "x0")
    area = settle(moved(inside))
    own = settle(moved(image.join(inside, CELL, "left_semi").select(*CELL, "v")))
    soft = settle(ra.remove_background(ra.smooth(own, smooth) if smooth else own, root_radius, 1.0))
    core = shrunk(area, soft, root_radius) if zones is not None else area
    flat = settle(soft.join(core.withColumn("in", F.lit(True)), CELL, "left").select(*CELL, F.when(F.col("in"), F.col("v")).otherwise(0.0).alias("v")))
    closed = ra.closing(root_mask(flat), ra.square(1)).join(area, CELL, "left_semi")
    labels = settle(ra.label_components(settle(closed), ra.N4))
    return ra.clean_labels(labels, least_side=least_side).select(*CELL), corner


def masked_closing(part: DataFrame, mask: DataFrame, steps: int) -> DataFrame:
    grown = ra.dilate(part, CROSS, inside=mask, times=steps) if steps else part
    rest = settle(mask.select(*CELL).join(grown, CELL, "left_anti"))
    back = ra.dilate(rest, CROSS, inside=mask, times=steps) if steps else rest
    return mask.select(*CELL).join(back, CELL, "left_anti")


def leaves(mask: DataFrame, image: DataFrame, shape: DataFrame, n: int, root_radius: int, box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """``item_key, y, x, label``: the ``n`` largest leaves from left to right: blobs of the mask
    whose brightest cell is of the brighter of two classes, closed within the mask."""
    blobs = settle(ra.blobs(mask, image))
    inside = settle(image.join(mask.select(*CELL), CELL, "left_semi").select(*CELL, "v"))
    params = stats.gaussian_mixture(inside, [ITEM], "v")
    bright = blobs.join(inside, CELL).groupBy(ITEM, "label").agg(F.max("v").alias("v"))
    good = stats.cluster_values(bright, [ITEM], "v", params).where("class > 0").select(ITEM, "label")
    leaf = settle(blobs.join(good, [ITEM, "label"], "left_semi").select(*CELL))
    return ra.box_seeds(settle(ra.label_components(settle(masked_closing(leaf, mask, root_radius)), ra.N4)), box, shape, n)


def seed_blobs(mask: DataFrame, image: DataFrame, shape: DataFrame, n: int, radius: float, box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """``item_key, y, x, label``: the ``n`` largest blobs of the mask thicker than ``radius``."""
    blobs = settle(ra.blobs(mask, image))
    outside = image.select(*CELL).join(mask.select(*CELL), CELL, "left_anti")
    depth = ra.distance_transform(image, outside)
    thick = blobs.join(depth, CELL).groupBy(ITEM, "label").agg(F.max("d").alias("d")).where(F.col("d") > radius).select(ITEM, "label")
    seeds = settle(blobs.join(thick, [ITEM, "label"], "left_semi").select(*CELL))
    return ra.box_seeds(settle(ra.label_components(seeds, ra.N4)), box, shape, n)


def kmeans_leaves(mask: DataFrame, n: int) -> DataFrame:
    """``item_key, y, x, label``: the cells of every item's mask in ``n`` clusters, numbered from
    left to right: Lloyd's rounds for all items together, from evenly spaced cells in order
    of x, until the cells are dealt as in an earlier round.  Items with fewer cells than
    ``n`` have as many clusters as cells."""
    w = Window.partitionBy(ITEM)
    ranked = mask.select(*CELL, F.row_number().over(w.orderBy("x", "y")).alias("r"), F.count("*").over(w).alias("c"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    spots = ranked.select(ITEM, "c", k).distinct().withColumn("r", F.floor((F.col("k") + 0.5) / n * F.col("c")) + 1)
    centres = settle(ranked.join(spots, [ITEM, "c", "r"]).select(ITEM, "k", F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy")))
    cells, seen = mask.select(*CELL), set()
    while True:
        d = F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))
        at = settle(cells.join(centres, ITEM).groupBy(*CELL).agg(F.min_by("k", F.struct(d, "k")).alias("k")))
        new = settle(at.groupBy(ITEM, "k").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
        dealt = tuple(at.agg(F.count("*"), F.bit_xor(F.xxhash64(*CELL, "k"))).first())
        if dealt in seen:
            break
        seen.add(dealt)
        centres = new
    order = centres.select(ITEM, "k", F.row_number().over(w.orderBy("cx", "k")).alias("label"))
    return at.join(order, [ITEM, "k"]).select(*CELL, "label")


# masks to graphs -------------------------------------------------------------------------


def linear_labels(mask: DataFrame, seeds: DataFrame | None = None) -> dict[str, DataFrame]:
    """A mask as lines: ``segments`` and ``nodes`` (labels on its skeleton), ``areas`` (every
    cell of the mask with the nearest segment), and, given ``seeds(item_key, y, x, label)``,
    ``contacts(item_key, node, seed)``: where the skeleton meets a seed's area, which itself
    is taken out, its cell becomes a node; ``centres(item_key, seed, x, y)``."""
    skeleton = settle(ra.thin(mask))
    none = skeleton.select(*CELL, F.lit(None).cast("int").alias("seed")).limit(0)
    touch = none
    if seeds is not None:
        area = seeds.select(*CELL, F.col("label").cast("int").alias("seed"))
        skeleton = settle(skeleton.join(area.select(*CELL), CELL, "left_anti"))
        around = ra.moved(area, ra.N8).select(*CELL, "seed").groupBy(*CELL).agg(F.min("seed").alias("seed"))
        touch = settle(skeleton.join(around, CELL))
    count = ra.count_around(skeleton, ra.N8)
    rows = settle(skeleton.join(count, CELL, "left").join(touch, CELL, "left").select(*CELL, F.coalesce("n", F.lit(0)).alias("n"), "seed"))
    # ends and crossings are nodes, so is what touches a seed
    is_node = (F.col("n") != 2) | F.col("seed").isNotNull()
    nodes = settle(ra.label_components(rows.where(is_node).select(*CELL)))
    segments = settle(ra.label_components(rows.where(~is_node).select(*CELL)))
    near = ra.nearest_clusters(mask.select(*CELL), segments)
    out = {"segments": segments, "nodes": nodes, "areas": near}
    if seeds is not None:
        out["contacts"] = nodes.join(touch, CELL).groupBy(ITEM, F.col("label").alias("node")).agg(F.min("seed").alias("seed"))
        out["centres"] = seeds.groupBy(ITEM, F.col("label").cast("int").alias("seed")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return out


def image_graph(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``nodes(item_key, node_id, x, y)`` and ``segments(item_key, seg_id, n0, n1, seed, length,
    area, radius)`` of ``linear_labels``: segments that touch two nodes, neighbouring nodes
    joined directly, and one from every contact to its seed.  Seeds have node ids below 0."""
    nodes, plain = ra.image_graph(parts["segments"], parts["nodes"])
    length = ra.curve_length(parts["segments"]).withColumnRenamed("label", "seg_id")
    area = parts["areas"].groupBy(ITEM, F.col("label").alias("seg_id")).agg(F.count("*").cast("double").alias("area"))
    sized = measure.segment_size(plain.join(length, [ITEM, "seg_id"], "left").join(area, [ITEM, "seg_id"], "left"))
    segments = sized.select(ITEM, "seg_id", "n0", "n1", F.lit(0).alias("seed"), "length", "area", "radius")
    if "contacts" in parts:
        null = F.lit(None).cast("double")
        seed_node = lambda c: -F.col(c).cast("bigint")
        nodes = nodes.union(parts["centres"].select(ITEM, seed_node("seed").alias("node_id"), "x", "y"))
        bridge = parts["contacts"].select(ITEM, (-F.col("node") - 1).alias("seg_id"), seed_node("seed").alias("n0"), F.col("node").alias("n1"), "seed", null, null, null)
        segments = segments.union(bridge)
    return nodes, segments


def line_graph(nodes: DataFrame, segments: DataFrame, skeleton: DataFrame, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes and segments of polylines: each curve is cut at every ``every``-th cell, its ends
    are the segment's nodes ``n0`` and ``n1`` (``n0`` where the curve starts nearer to it),
    seed segments stay.  New nodes have ids by curve and place."""
    order = settle(ra.curve_order(skeleton))
    size = order.groupBy(ITEM, "label").agg(F.max("rank").alias("last"))
    kept = order.join(size, [ITEM, "label"]).where((F.col("rank") % every == 0) & (F.col("rank") < F.col("last")) & (F.col("rank") > 1))
    first = order.where("rank = 1").select(ITEM, F.col("label").alias("seg_id"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    at = lambda n: nodes.select(ITEM, F.col("node_id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    ends = segments.where("seed = 0").join(at("n0"), [ITEM, "n0"]).join(at("n1"), [ITEM, "n1"]).join(first, [ITEM, "seg_id"])
    far = lambda n: F.hypot(F.col(f"x{n}") - F.col("fx"), F.col(f"y{n}") - F.col("fy"))
    swap = far("n1") < far("n0")
    ends = settle(ends.select(ITEM, F.col("seg_id").alias("label"), F.when(swap, F.col("n1")).otherwise(F.col("n0")).alias("s"), F.when(swap, F.col("n0")).otherwise(F.col("n1")).alias("e")))
    inner = kept.join(ends.select(ITEM, "label"), [ITEM, "label"], "left_semi")
    fresh = settle(inner.select(ITEM, "label", "rank", F.xxhash64("label", "rank").bitwiseAND((1 << 62) - 1).alias("node_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    chain = fresh.select(ITEM, "label", "rank", "node_id")
    chain = chain.union(ends.select(ITEM, "label", F.lit(0), "s")).union(ends.select(ITEM, "label", F.lit((1 << 31) - 1), "e"))
    w = Window.partitionBy(ITEM, "label").orderBy("rank")
    pairs = chain.select(ITEM, "label", "rank", F.col("node_id").alias("n0"), F.lead("node_id").over(w).alias("n1")).where("n1 is not null")
    lines = pairs.select(ITEM, F.xxhash64("label", "rank", F.lit("s")).bitwiseAND((1 << 62) - 1).alias("seg_id"), "n0", "n1", F.lit(0).alias("seed"), F.col("label").alias("curve"))
    seeds = segments.where("seed > 0").select(ITEM, "seg_id", "n0", "n1", "seed", F.lit(None).cast("bigint"))
    return nodes.union(fresh.select(ITEM, "node_id", "x", "y")), lines.union(seeds)


def compute_graph(mask: DataFrame, seeds: DataFrame, corner: DataFrame | None = None, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes and segments of the roots of a mask with seeds, moved back by the corner it was
    cut at."""
    parts = linear_labels(mask, seeds)
    nodes, segments = image_graph(parts)
    nodes, segments = line_graph(settle(nodes), settle(segments), parts["segments"], every)
    if corner is not None:
        nodes = nodes.join(corner, ITEM).select(ITEM, "node_id", (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"))
    return settle(nodes), settle(segments)


def compute_tree(nodes: DataFrame, segments: DataFrame, min_length: float = 15.0, scale: DataFrame | None = None) -> dict[str, DataFrame]:
    """``axes, axe_segments`` and ``segments`` (with length) of the estimated root systems;
    ``scale(item_key, scale)`` is carried along on the axes."""
    sized = settle(measure.segment_lengths(segments.select(ITEM, "seg_id", "n0", "n1", "seed"), nodes))
    none = sized.select(ITEM, "seg_id", F.lit(False).alias("flip")).limit(0)
    edges, _ = trees.graph_to_dag(sized, none)
    way = lambda n: sized.select(ITEM, F.col("seg_id").alias(n), F.col("length").alias("l1" if n == "a" else "l2"))
    dag = settle(edges.select(ITEM, "a", "b", F.col("cost").alias("angle")).join(way("a"), [ITEM, "a"]).join(way("b"), [ITEM, "b"]))
    found = trees.estimate(dag, sized, min_length)
    axes = found["axes"] if scale is None else found["axes"].join(scale, ITEM, "left")
    return {"axes": axes, "axe_segments": found["axe_segments"], "segments": sized}


def image_tree(image: DataFrame, shape: DataFrame, plants: int, frame: str = "plate", plate_size: float = 120.0, border: float = 0.08, root_radius: int = 5, leaf_box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 0.4), smooth: float = 1.0, least_side: int = 50, min_length: float = 15.0, marker: tuple[float | None, int, float] = (None, 10, 10.0)) -> dict[str, DataFrame]:
    """Images to trees by a preset: ``plate``, ``marked`` or ``none`` for the frame, then root
    mask, leaves, graph and tree, for all images together."""
    if frame == "plate":
        found = plate(foreground(image, shape, smooth), image, border, plate_size)
    elif frame == "marked":
        found = marked_plate(image, *marker)
    else:
        found = whole_image(image, 1.0)
    zones = None if frame == "none" else found["cells"]
    mask, corner = item_mask(image, zones, root_radius, least_side, smooth)
    mask = settle(mask)
    cut = image.join(corner, ITEM).select(ITEM, (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v").where("y >= 0 and x >= 0")
    seeds = settle(leaves(mask, settle(cut), shape, plants, root_radius, leaf_box))
    nodes, segments = compute_graph(mask, seeds, corner)
    return {"nodes": nodes, "seeds": seeds, "mask": mask, **compute_tree(nodes, segments, min_length, found["scale"])}
