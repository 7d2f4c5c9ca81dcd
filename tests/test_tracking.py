"""Sequences of drawn root systems that grow."""

from pyspark.sql import functions as F

from rootweave.operators import tracking

#: node_id: x, y; the primary goes down, laterals leave it at nodes 2 and 4
SPOTS = {0: (0, 0), 1: (0, 10), 2: (0, 20), 3: (0, 30), 4: (0, 40), 5: (10, 24), 6: (0, 50), 7: (0, 61), 8: (20, 28), 9: (9, 45), 10: (18, 50)}
#: frame 2; some segments lie against the growth
LATER = [(1, 0, 1, 7), (2, 2, 1, 0), (3, 2, 3, 0), (4, 3, 4, 0), (5, 5, 2, 0), (6, 4, 6, 0), (7, 7, 6, 0), (8, 5, 8, 0), (9, 4, 9, 0), (10, 10, 9, 0)]


def test_sequence_grows(spark):
    nodes = [("a", 2, n, float(x), float(y)) for n, (x, y) in SPOTS.items()]
    links = [("a", 2, *r) for r in LATER]
    at = spark.createDataFrame(nodes, "item_key string, frame int, node_id bigint, x double, y double")
    seg = spark.createDataFrame(links, "item_key string, frame int, seg_id bigint, n0 bigint, n1 bigint, seed int")
    first = {1: (1, 0, 1), 2: (1, 1, 2), 3: (1, 2, 3), 4: (1, 3, 4), 5: (2, 2, 5)}
    tree = [("a", s, SPOTS[p][0] - 3.0, SPOTS[p][1] - 0.5, SPOTS[q][0] - 3.0, SPOTS[q][1] - 0.5) for s, (_, p, q) in first.items()]
    start = {
        "axes": spark.createDataFrame([("a", 1, 1, 1, None), ("a", 2, 1, 2, 1)], "item_key string, axe_id bigint, plant bigint, ord int, parent bigint"),
        "axe_segments": spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 2, 2), ("a", 1, 3, 3), ("a", 1, 4, 4), ("a", 2, 1, 5)], "item_key string, axe_id bigint, pos int, seg_id bigint"),
        "tree": spark.createDataFrame(tree, "item_key string, seg_id bigint, x0 double, y0 double, x1 double, y1 double"),
        "seeds": spark.createDataFrame([("a", 1, -3.0, 4.5)], "item_key string, plant bigint, x double, y double"),
    }
    m = spark.createDataFrame([("a", 2, [1.0, 0.0, 3.0, 0.0, 1.0, 0.5, 0.0, 0.0, 1.0])], "item_key string, frame int, m array<double>")
    rows = tracking.follow([2], start, at, seg, m, 5.0).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.pos):
        found.setdefault((r.axe_id, r.plant, r.ord, r.parent), []).append(r.seg_id)
    assert found == {(1, 1, 1, None): [1, 2, 3, 4, 6, 7], (2, 1, 2, 1): [5, 8], (3, 1, 2, 1): [9, 10]}


def test_growth_goes_to_the_next_branching(spark):
    seg = spark.createDataFrame([("a", s, a, b, 1.0) for s, a, b in ((1, 0, 1), (2, 2, 1), (3, 2, 3), (4, 3, 4), (5, 3, 5))], "item_key string, seg_id bigint, n0 bigint, n1 bigint, length double")
    way = spark.createDataFrame([("a", 7, 1, 0), ("a", 7, 2, 1), ("a", 8, 1, 3), ("a", 8, 2, 2), ("a", 9, 1, 4)], "item_key string, axe_id bigint, pos int, node_id bigint")
    found = tracking.grow(way, seg).orderBy("axe_id", "pos").collect()
    assert [(r.axe_id, r.pos, r.seg_id, r.flip) for r in found] == [(7, 1, 1, False), (7, 2, 2, True), (7, 3, 3, False), (8, 1, 3, True), (8, 2, 2, False), (8, 3, 1, True)]
    assert tracking.grow(way.limit(0), seg.where(F.lit(False))).count() == 0
