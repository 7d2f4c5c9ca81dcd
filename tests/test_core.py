"""Operators on hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from rootweave.functions import geometry as g
from rootweave.functions import text as tx
from rootweave.operators import catalog, graph, match, measure, paths, stats
from rootweave.operators import raster as ra
from rootweave.plans.steps import Pipeline, Step, missing_items
from rootweave.sources import text_files


@pytest.fixture(scope="module")
def tree(spark):
    nodes = [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 2, 1.5), (6, 0, 2.5)]
    segs = [(1, 1, 2, 1, None), (2, 2, 3, 0, 1), (3, 3, 4, 0, 2), (4, 2, 5, 0, 1), (5, 3, 6, 0, 2)]
    n = spark.createDataFrame([("t", i, float(x), float(y)) for i, x, y in nodes], "item_key string, node_id bigint, x double, y double")
    s = spark.createDataFrame([("t", *r) for r in segs], "item_key string, seg_id bigint, n0 bigint, n1 bigint, seed bigint, parent bigint")
    a = spark.createDataFrame([("t", 1, 1, 1), ("t", 2, 1, 2), ("t", 3, 1, 2)], "item_key string, axe_id bigint, plant bigint, ord int")
    m = spark.createDataFrame([("t", 1, 1, 1), ("t", 1, 2, 2), ("t", 1, 3, 3), ("t", 2, 1, 4), ("t", 3, 1, 5)], "item_key string, axe_id bigint, pos int, seg_id bigint")
    return n, measure.segment_lengths(s, n), a, m


def by(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hand_made_tree(spark, tree):
    nodes, segs, axes, members = tree
    assert sum(r.terminal for r in measure.terminal_nodes(segs).collect()) == 4
    assert by(measure.terminal_segments(segs).where("terminal"), "seg_id") == [(1,), (3,), (4,), (5,)]
    parents = measure.parent_axe(members, measure.parent_segment(members, segs))
    got = {r.axe_id: (r.parent, r.parent_segment) for r in parents.collect()}
    assert got == {1: (None, None), 2: (1, 1), 3: (1, 2)}
    full = axes.join(parents, ["item_key", "axe_id"])
    arcs = measure.arc_length(members, segs)
    position = measure.position_on_parent(full, arcs)
    assert by(position, "axe_id", "position") == [(1, 0.0), (2, 1.0), (3, 2.0)]
    ranks = measure.partial_order(full, position)
    assert by(ranks, "axe_id", "rank") == [(1, 1), (2, 2), (3, 3)]
    assert by(measure.main_axe(members, ranks), "seg_id", "axe_id") == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)]
    order = measure.axe_nodes(members, segs, parents)
    assert [r.node_id for r in order.where("axe_id = 1").orderBy("rank").collect()] == [1, 2, 3, 4]
    assert [r.node_id for r in order.where("axe_id = 2").orderBy("rank").collect()] == [2, 5]
    lengths = measure.axe_length(members, segs)
    rows = full.join(lengths, ["item_key", "axe_id"]).join(position, ["item_key", "axe_id"])
    stat = measure.plant_statistics(axes, rows).first()
    assert stat.axe1_length == 3 and stat.axe2_number == 2 and stat.ramification_length == 2
    assert stat.total_length == pytest.approx(3 + math.hypot(1, 0.5) * 2) and stat.ramification_percent == pytest.approx(2 / 3)
    mtg = paths.to_mtg(full, members)
    assert by(mtg.groupBy("scale").count(), "scale", "count") == [("axe", 3), ("plant", 1), ("segment", 5)]
    assert by(paths.propagate_orders(full), "axe_id", "ord", "plant") == [(1, 1, 1), (2, 2, 1), (3, 2, 1)]
    assert by(graph.reachable(segs), "reachable") == [(True,)] * 5


def test_catalogue(spark):
    files = ["J10/Photo_001.jpg", "J10/Photo_011.jpg", "J10/Photo_invalid.jpg", "J11/Photo_001.jpg", "J11/Photo_011.jpg"]
    rows = catalog.parse_paths(spark.createDataFrame([(f"/d/{f}",) for f in files], "filename string"), "[age:str]/Photo_[id:int].jpg", "/d/")
    good, bad = catalog.split_valid(rows)
    assert by(good, "item_key") == [("J10/Photo_001",), ("J10/Photo_011",), ("J11/Photo_001",), ("J11/Photo_011",)] and bad.count() == 1
    grouped = catalog.positional_group(good, {0: "A", 1: "B"})
    assert by(grouped, "item_key", "group") == [("J10/Photo_001", "A"), ("J10/Photo_011", "B"), ("J11/Photo_001", "A"), ("J11/Photo_011", "B")]
    sections = catalog.read_sections(spark, "[A]\nGlutamin=0.5\n[B:A]\nnitrate=1\n")
    extra = {r.item_key: r.extra for r in catalog.layered(grouped, {"plant_number": "5", "glutamin": "0"}, sections, F.col("group")).collect()}
    assert extra["J10/Photo_001"] == {"plant_number": "5", "glutamin": "0.5"} and extra["J10/Photo_011"]["nitrate"] == "1"
    items = spark.createDataFrame([(i, i // 2, i // 3) for i in range(6)], "item_key int, a int, b int")
    assert by(catalog.group_items(items, ["a", "b"], "item_key"), "a", "b") == [(0, 0), (1, 0), (1, 1), (2, 1)]
    t = spark.createDataFrame([("x_12_y", "Boite 7 Sequence 3")], "t string, u string")
    r = t.select(tx.first_number(F.col("t")).alias("a"), tx.numbered(F.col("u"), "Sequence").alias("b"), tx.format_scan(F.col("t"), "x_{n:d}_y").alias("c")).first()
    assert (r.a, r.b, r.c.n) == (12, 3, 12)


def test_tracings(spark):
    text = "// Parameters\n1\n// Tracing\n1\n3\n1\nDefault\n// Segment 1 of 1\n10\n20\n11\n21\n// Tracing\n2\n0\n0\nDefault\n// Segment 1 of 1\n5\n6\n// End of NeuronJ Data File\n"
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(text.split("\n"))], "file string, line int, value string")
    tracings, points = text_files.parse_tracings(lines)
    assert by(points, "tracing_id", "pos", "x", "y") == [(1, 0, 10, 20), (1, 1, 11, 21), (2, 0, 5, 6)]
    assert by(text_files.fix_tracings(tracings), "tracing_id", "plant", "ord", "fixed") == [(1, 1, 1, False), (2, 1, 1, True)]


def test_greedy_match_and_maxima(spark):
    import random

    rng = random.Random(1)
    pairs = [("a", i, j, round(rng.random(), 3)) for i in range(8) for j in range(6)]
    free_i, free_j, want = set(range(8)), set(range(6)), []
    for _, i, j, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if i in free_i and j in free_j and d <= 0.6:
            want.append((i, j))
            free_i.discard(i)
            free_j.discard(j)
    found = match.greedy_match(spark.createDataFrame(pairs, "k string, i int, j int, d double"), ["k"], 0.6)
    assert by(found, "i", "j") == sorted(want)
    peaks = [("a", n, float(x), 0.0, r) for n, (x, r) in enumerate([(0, 5.0), (3, 2.0), (4.5, 4.0), (20, 1.0), (21, 0.5)])]
    kept = match.strong_maxima(spark.createDataFrame(peaks, "k string, id int, x double, y double, r double"), ["k"])
    assert by(kept, "id") == [(0,), (3,)]


def test_graphs(spark):
    e = [("g", 1, 2, 1.0), ("g", 2, 3, 1.0), ("g", 1, 3, 5.0), ("g", 3, 4, 1.0), ("g", 4, 2, 1.0), ("g", 8, 9, 1.0)]
    edges = spark.createDataFrame(e, "item_key string, a bigint, b bigint, cost double")
    source = spark.createDataFrame([("g", 1, 0.0)], "item_key string, node_id bigint, dist double")
    assert by(graph.shortest_paths(edges, source), "node_id", "dist") == [(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]
    kept, removed = graph.to_dag(edges, source)
    assert by(removed, "a", "b") == [(4, 2), (8, 9)]
    assert by(graph.topological_levels(source, kept, source), "node_id", "level") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    parents = spark.createDataFrame([("g", 1, None), ("g", 2, 1), ("g", 3, 2), ("g", 4, 2)], "item_key string, node_id bigint, parent bigint")
    cover = paths.covering_paths(parents)
    assert by(cover, "path_id", "pos", "seg_id") == [(3, 1, 1), (3, 2, 2), (3, 3, 3), (4, 1, 1), (4, 2, 2), (4, 3, 4)]
    p = [[], [11, 12, 15], [11, 12, 14, 19], [11, 13, 18, 17], [13]]
    rows = spark.createDataFrame([("g", k, i, s) for k, path in enumerate(p) for i, s in enumerate(path)], "item_key string, path_id int, pos int, seg_id int")
    assert by(paths.tips(rows), "path_id", "seg_id") == [(1, 15), (2, 14), (2, 19), (3, 17), (3, 18)]
    segs = spark.createDataFrame([("g", i) for i in (1, 2, 3)], "item_key string, seg_id bigint")
    ends = spark.createDataFrame([("g", 1, 1, 2, 1, 1.0), ("g", 2, 0, 3, 0, 2.0)], "item_key string, s1 bigint, side1 int, s2 bigint, side2 int, cost double")
    fixed = spark.createDataFrame([("g", 1, False)], "item_key string, seg_id bigint, flip boolean")
    # 1 ends where 2 ends, so 2 turns; 2 and 3 share their starts, so 3 keeps
    assert by(graph.segment_direction(segs, ends, fixed), "seg_id", "flip") == [(1, False), (2, True), (3, False)]


def test_loops_do_not_stop_half_way(spark):
    source = spark.createDataFrame([("k", 1, 0.0)], "item_key string, node_id long, dist double")
    chain = [("k", i, i + 1, 1.0) for i in range(1, 6)]
    edges = spark.createDataFrame(chain, "item_key string, a long, b long, cost double")
    far = graph.shortest_paths(edges, source).collect()
    assert {r.node_id: r.dist for r in far} == {i: i - 1.0 for i in range(1, 7)}
    loop = spark.createDataFrame([*chain[:2], ("k", 3, 1, -3.0)], "item_key string, a long, b long, cost double")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(loop, source)
    bar = spark.createDataFrame([("k", y, x) for y in range(9) for x in range(20)], "item_key string, y int, x int")
    with pytest.raises(RuntimeError):
        ra.thin(bar, most=1)


def test_geometry_and_statistics(spark):
    one = spark.range(1)
    p = one.select(g.point_to_segment(*[F.lit(float(v)) for v in (1, 1, 0, 0, 4, 0)]).alias("p")).first().p
    assert (p.d, p.x, p.t) == (1.0, 1.0, 0.25)
    m = g.product(g.translation(2, 3), g.inverse(g.translation(2, 3)))
    assert one.select(m.alias("m")).first().m == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    pts = [("h", float(x), float(y)) for x in range(5) for y in range(4)] + [("line", 0.0, 0.0), ("line", 1.0, 1.0)]
    area = measure.hull_area(spark.createDataFrame(pts, "k string, x double, y double"), ["k"])
    assert by(area, "k", "area") == [("h", 12.0), ("line", 0.0)]
    pairs = spark.createDataFrame([("a", float(x), float(y), 2.0 * x - y + 3, x + 2.0 * y - 1) for x in range(4) for y in range(3)] + [("a", 0.5, 0.5, 99.0, 99.0)], "k string, x double, y double, u double, v double")
    best = match.robust_affine(pairs, ["k"], draws=40, tolerance=0.01).first()
    assert best.inliers == 12 and best.m == pytest.approx([2, -1, 3, 1, 2, -1, 0, 0, 1])
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    s = v.agg(stats.fit_normal(F.col("v")).alias("s")).select(stats.remove_value(F.col("s"), F.lit(10.0)).alias("r"), "s").first()
    assert (s.r.n, s.r.mean, s.r.m2) == (3, pytest.approx(2), pytest.approx(2)) and s.s.mean == 4


def test_rasters(spark):
    cells = [("r", y, x) for y in range(6) for x in range(8) if not (y == 2 and x == 2)]
    mask = spark.createDataFrame(cells, "item_key string, y int, x int")
    shape = spark.createDataFrame([("r", 6, 8)], "item_key string, height int, width int")
    assert ra.fill_holes(mask, shape).count() == 48
    two = spark.createDataFrame([("r", 0, 0), ("r", 1, 1), ("r", 4, 4)], "item_key string, y int, x int")
    assert ra.label_components(two).select("label").distinct().count() == 2
    assert ra.label_components(two, ra.N4).select("label").distinct().count() == 3
    full = spark.createDataFrame([("r", y, x, float(x)) for y in range(5) for x in range(5)], "item_key string, y int, x int, v double")
    d = {(r.y, r.x): r.d for r in ra.distance_transform(full, two.where("y = 0")).collect()}
    assert d[(3, 4)] == 5 and d[(0, 0)] == 0 and len(d) == 25
    bar = spark.createDataFrame([("r", y, x) for y in range(3) for x in range(9)], "item_key string, y int, x int")
    skeleton = ra.thin(bar)
    assert skeleton.count() <= 9 and all(r.y == 1 for r in skeleton.collect())
    line = spark.createDataFrame([("r", 0, x, 1) for x in range(5)], "item_key string, y int, x int, label bigint")
    assert [r.x for r in ra.curve_order(line).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_steps(spark):
    halve = Step("halve", lambda size: (size / 2, size - 1), ("size",), ("half", "less"))
    total = Step("total", lambda rest, half, less: rest + half * less, ("rest", "half", "less"), ("sum",))
    assert Pipeline((halve, total)).inputs == ["size", "rest"] and Pipeline((halve, total)).run({"size": 6, "rest": 4})["sum"] == 19
    first, second = Step("mask", None, ("image", "level"), ("mask", "box"), {"level": 7}), Step("graph", None, ("mask", "seeds"), ("nodes", "lines"))
    both = Pipeline((first, second))
    assert both.to_run({"mask", "seeds"}, wanted={"nodes"}) == [second]
    assert both.to_run({"image", "mask", "seeds", "nodes", "lines"}, outdated={"image"}, wanted={"nodes"}) == [first, second]
    items = spark.createDataFrame([("i",), ("j",)], "item_key string")
    have = spark.createDataFrame([("i", "m", 1), ("i", "n", 1), ("j", "m", 1)], "item_key string, name string, version int")
    assert by(missing_items(items, have, ["m", "n"]), "item_key") == [("j",)]
