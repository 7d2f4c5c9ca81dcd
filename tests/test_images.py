"""From drawn images to plates, masks, leaves, graphs and trees with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from rootweave.operators import raster as ra
from rootweave.operators import segment

RASTER, CELLS, SHAPE = "item_key string, y int, x int, v double", "item_key string, y int, x int", "item_key string, height int, width int"


def image(spark, drawn, height, width):
    """``drawn``: item -> function of y, x."""
    rows = [(k, y, x, float(f(y, x))) for k, f in drawn.items() for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, RASTER), spark.createDataFrame([(k, height, width) for k in drawn], SHAPE)


def places(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_key, set()).add((r.y, r.x))
    return out


def box(y0, y1, x0, x1):
    return {(y, x) for y in range(y0, y1) for x in range(x0, x1)}


def test_plate_of_each_item_is_its_own(spark):
    large, small = box(4, 36, 4, 36), box(10, 20, 12, 22)
    img, shape = image(spark, {"large": lambda y, x: 0, "small": lambda y, x: 0}, 40, 40)
    mask = spark.createDataFrame([("large", *c) for c in large] + [("small", *c) for c in small | {(1, 1)}], CELLS)
    both = segment.plate(mask, img, 0.125, 100.0)
    cells = {(r.item_key, r.y, r.x): r.zone for r in both["cells"].collect()}
    assert {c[1:] for c in cells if c[0] == "small"} <= small and (("small", 1, 1) not in cells)
    # a border of 4 cells for the one, of 1 for the other
    assert {c[1:] for c, z in cells.items() if c[0] == "large" and z == 2} == box(8, 32, 8, 32)
    assert {c[1:] for c, z in cells.items() if c[0] == "small" and z == 2} == box(11, 19, 13, 21)
    assert {r.item_key: r.scale for r in both["scale"].collect()} == {"large": pytest.approx(100 / 32), "small": pytest.approx(100 / 101**0.5, rel=0.02)}
    alone = segment.plate(mask.where("item_key = 'small'"), img, 0.125, 100.0)["cells"]
    assert {(r.item_key, r.y, r.x): r.zone for r in alone.collect()} == {c: z for c, z in cells.items() if c[0] == "small"}


def test_foreground_marks_and_frames(spark):
    plate = box(10, 30, 8, 32)
    img, shape = image(spark, {"a": lambda y, x: 10.0 if (y, x) in plate else 0.0}, 40, 40)
    found = places(segment.foreground(img, shape, smooth=0))["a"]
    assert plate <= found <= box(8, 32, 6, 34)
    marks = box(5, 9, 5, 9) | box(5, 9, 31, 35) | box(31, 35, 5, 9) | box(31, 35, 31, 35)
    marked = segment.marked_plate(image(spark, {"a": lambda y, x: 9.0 if (y, x) in marks else 0.0}, 40, 40)[0], None, 3, 8.0)
    assert box(5, 34, 5, 34) <= places(marked["cells"])["a"] <= box(5, 35, 5, 35) and marked["scale"].first().scale == pytest.approx(2.0)
    ring = box(4, 36, 4, 36) - box(6, 34, 6, 34)
    line = {(y, 20) for y in range(10, 30)} | {(2, 2), (38, 10)}
    img, _ = image(spark, {"a": lambda y, x: 0}, 40, 40)
    inside = segment.square_frame(spark.createDataFrame([("a", *c) for c in ring | line], CELLS), img)
    assert places(inside)["a"] == {(y, 20) for y in range(10, 30)}


def test_circle_frame(spark):
    centres = [(8, 10), (11, 30), (30, 9), (32, 31)]
    discs = {(y, x): k for k, (cy, cx) in enumerate(centres) for y in range(40) for x in range(40) if math.hypot(y - cy, x - cx) <= 4}
    img, _ = image(spark, {"a": lambda y, x: 0}, 40, 40)
    labels = spark.createDataFrame([("a", y, x, k) for (y, x), k in discs.items()], "item_key string, y int, x int, label int")
    row = segment.circle_frame(labels, img, 50.0).first()
    assert row.scale == pytest.approx(50.0 / math.hypot(20, 3))
    m = row.m
    to = lambda x, y: (m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5])
    assert to(10, 8) == pytest.approx((0, 0)) and to(30, 11) == pytest.approx((math.hypot(20, 3), 0))


def test_leaves_and_seeds(spark):
    leaf = [box(3, 10, 4, 11), box(3, 9, 24, 30)]
    roots = {(y, 7) for y in range(10, 34)} | {(y, 27) for y in range(9, 30)}
    bright = lambda y, x: 9.0 if any((y, x) in b for b in leaf) else 4.0 if (y, x) in roots else 0.0
    img, shape = image(spark, {"a": bright}, 36, 36)
    mask = img.where("v > 0").select("item_key", "y", "x")
    for found in (segment.leaves(mask, img, shape, 2, 1), segment.seed_blobs(mask, img, shape, 2, 2.0)):
        by = {}
        for r in found.collect():
            by.setdefault(r.label, set()).add((r.y, r.x))
        assert sorted(by) == [1, 2]
        assert all(len(by[k] & leaf[k - 1]) >= 0.8 * len(leaf[k - 1]) and not by[k] & leaf[2 - k] for k in by)
    two = segment.kmeans_leaves(mask, 2)
    assert {(r.x < 18, r.label) for r in two.collect()} == {(True, 1), (False, 2)}
    assert {r.label for r in segment.find_seeds(img.withColumn("v", -F.col("v")), "local_min", 2).collect()}


def drawing(lateral):
    """A plate with a leaf, a primary root and a lateral of it."""
    leaf = box(14, 22, 37, 44)
    main = {(y, 40) for y in range(22, 26)} | {(y, x) for y in range(26, 70) for x in (39, 40, 41)}
    side = {(40 + k, 41 + k + d) for k in range(lateral) for d in (0, 1, 2)}
    inside = box(4, 84, 4, 84)
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    wide = {(y + a, x + b) for y, x in leaf | main | side for a, b in around}
    closed = {(y, x) for y, x in wide if all((y + a, x + b) in wide for a, b in around)}

    def value(y, x):
        if (y, x) in leaf:
            return 250.0
        if (y, x) in closed:
            return 200.0
        return 60.0 if (y, x) in inside else 0.0

    return value


def test_image_to_tree(spark):
    """The whole way without a frame: one plant an image, a primary root with one lateral."""
    drawn = {"short": drawing(12), "long": drawing(18)}
    img, shape = image(spark, drawn, 88, 88)
    img = img.withColumn("v", F.when(F.col("v") < 100, 0.0).otherwise(F.col("v")))
    found = segment.image_tree(img, shape, 1, "none", root_radius=4, leaf_box=(0.0, 0.0, 1.0, 0.5), smooth=0.0, least_side=12, min_length=8.0)
    length = {(r.item_key, r.seg_id): r.length for r in found["segments"].collect()}
    own = {}
    for r in found["axe_segments"].collect():
        own[r.item_key, r.axe_id] = own.get((r.item_key, r.axe_id), 0.0) + length[r.item_key, r.seg_id]
    axes = {(r.item_key, r.axe_id): r for r in found["axes"].collect()}
    for item in drawn:
        assert sorted(r.ord for k, r in axes.items() if k[0] == item) == [1, 2]
        main = next(k for k, r in axes.items() if k[0] == item and r.ord == 1)
        side = next(k for k, r in axes.items() if k[0] == item and r.ord == 2)
        assert axes[side].parent == axes[main].axe_id and axes[main].plant == 1 and axes[main].scale == 1.0
        # from the leaf's middle to the root's tip, and from the branching to the lateral's
        assert own[main] == pytest.approx(50, abs=6) and own[side] == pytest.approx(1.414 * (18 if item == "long" else 12), abs=6)
