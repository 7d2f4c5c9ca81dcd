"""Distance transforms and nearest segments against brute force: gaps, nulls, NaN, ties,
repeated rows, empty tables, uneven lengths."""

import math
import random
import subprocess
import sys

import pytest

from rootweave.operators import match
from rootweave.operators import raster as ra

METRIC = {
    "euclidean": lambda a, b: math.hypot(a, b),
    "taxicab": lambda a, b: float(abs(a) + abs(b)),
    "chessboard": lambda a, b: float(max(abs(a), abs(b))),
}
CELLS, LABELS = "item_key string, y int, x int", "item_key string, y int, x int, label int"


@pytest.mark.parametrize("metric", METRIC)
def test_distance_transform_of_sparse_rasters(spark, metric):
    rng = random.Random(1)
    cells, features = [], []
    for item, n, m, size in (("a", 60, 9, 150), ("b", 200, 40, 40), ("c", 5, 1, 400), ("d", 30, 0, 10), ("e", 40, 40, 7)):
        cells += [(item, rng.randrange(-size, size), rng.randrange(-size, size)) for _ in range(n)]
        features += [(item, rng.randrange(-size, size), rng.randrange(-size, size)) for _ in range(m)]
    cells, features = sorted(set(cells)), features + features[:3] + [("a", None, 3), ("z", 1, 1)]
    found = ra.distance_transform(spark.createDataFrame([*cells, ("a", None, 1)], CELLS), spark.createDataFrame(features, CELLS), metric).collect()
    places = {f for f in features if f[1] is not None}
    assert sorted((r.item_key, r.y, r.x) for r in found) == [c for c in cells if c[0] != "d"]
    for r in found:
        far = min(METRIC[metric](r.y - y, r.x - x) for item, y, x in places if item == r.item_key)
        assert r.d == pytest.approx(far) and (r.item_key, r.fy, r.fx) in places
        assert METRIC[metric](r.y - r.fy, r.x - r.fx) == pytest.approx(far)
    empty = spark.createDataFrame([], CELLS)
    assert ra.distance_transform(empty, empty, metric).count() == 0


def test_nearest_clusters_on_a_diagonal_and_areas_of_lines(spark):
    from rootweave.operators import segment

    mask = [("a", i, i) for i in range(33)]
    seeds = [("a", 0, 0, 1), ("a", 32, 32, 2)]
    found = ra.nearest_clusters(spark.createDataFrame(mask, CELLS), spark.createDataFrame(seeds, LABELS)).collect()
    assert len(found) == 33 and all(r.label == 1 for r in found if r.y < 16) and all(r.label == 2 for r in found if r.y > 16)
    thick = sorted({("a", i + dy, i // 2 + dx) for i in range(40) for dy in range(-1, 2) for dx in range(-1, 2)} | {("a", 20 + dy, j + dx) for j in range(10, 50) for dy in (-1, 0, 1) for dx in (-1, 0, 1)})
    parts = segment.linear_labels(spark.createDataFrame(thick, CELLS))
    assert sorted((r.item_key, r.y, r.x) for r in parts["areas"].collect()) == thick


def brute(points, segments):
    out = {}
    for k, i, x, y in points:
        if x is None or y is None or x != x or y != y:
            continue
        for kk, j, x0, y0, x1, y1 in segments:
            if kk != k or any(v is None or v != v for v in (x0, y0, x1, y1)):
                continue
            dx, dy = x1 - x0, y1 - y0
            size = dx * dx + dy * dy
            t = min(max(((x - x0) * dx + (y - y0) * dy) / size, 0), 1) if size else 0
            d = math.hypot(x - x0 - t * dx, y - y0 - t * dy)
            if (k, i) not in out or d < out[k, i]:
                out[k, i] = d
    return out


POINTS, SEGMENTS = "k string, point_id int, x double, y double", "k string, seg_id int, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("radius", [None, 3.0, 500.0])
def test_nearest_segment(spark, radius):
    rng, nan = random.Random(2), float("nan")
    points = [(k, i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for k in "ab" for i in range(60)]
    points += [("far", i, 1e5 + i, -2e5) for i in range(5)] + [("null", 1, 0.0, 0.0), ("a", 99, nan, 1.0), ("a", 98, None, 1.0), ("none", 1, 0.0, 0.0)]
    segments = []
    for k in ("a", "b", "far"):
        for j in range(40):
            x, y = rng.uniform(-90, 90), rng.uniform(-90, 90)
            long = rng.choice([0.0, 0.5, 3.0, 3.0, 60.0, 5000.0 if k == "b" else 3.0])
            turn = rng.uniform(0, 6.3)
            segments.append((k, j, x, y, x + long * math.cos(turn), y + long * math.sin(turn)))
    segments += [("null", 1, None, None, None, None), ("a", 77, nan, 0.0, 1.0, 1.0)]
    found = match.nearest_segment(spark.createDataFrame(points, POINTS), spark.createDataFrame(segments, SEGMENTS), ["k"], radius).collect()
    truth = brute(points, segments)
    assert {(r.k, r.point_id) for r in found} == set(truth) and len(found) == len(truth)
    for r in found:
        assert r.d == pytest.approx(truth[r.k, r.point_id])


def test_nearest_segment_of_ties_and_nothing(spark):
    s = spark.createDataFrame([("a", 2, 0.0, 1.0, 5.0, 1.0), ("a", 1, 0.0, -1.0, 5.0, -1.0)], SEGMENTS)
    p = spark.createDataFrame([("a", 1, 2.0, 0.0), ("a", 1, 2.0, 0.0)], POINTS)
    assert {(r.seg_id, r.d) for r in match.nearest_segment(p, s, ["k"]).collect()} == {(1, 1.0)}
    assert match.nearest_segment(p, s.limit(0), ["k"]).count() == 0 and match.nearest_segment(p.limit(0), s, ["k"]).count() == 0


def test_point_segment_pairs_of_uneven_lengths(spark):
    rng = random.Random(3)
    points = [("a", i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(80)] + [("a", 200, None, 1.0)]
    segments = [("a", j, x := rng.uniform(0, 100), y := rng.uniform(0, 100), x + rng.choice([0, 1, 20]), y + rng.choice([0, 2, 1e6])) for j in range(30)]
    segments += [("a", 99, None, 0.0, 0.0, 0.0)]
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame([tuple(float(v) if isinstance(v, int) and i > 1 else v for i, v in enumerate(r)) for r in segments], SEGMENTS)
    found = {(r.point_id, r.seg_id): r.d for r in match.point_segment_distance(p, s, ["k"], 4.0).collect()}
    truth = {}
    for a in points:
        for b in segments:
            d = brute([a], [b]).get(("a", a[1]))
            if d is not None and d <= 4.0:
                truth[a[1], b[1]] = d
    assert set(found) == set(truth) and all(found[k] == pytest.approx(truth[k]) for k in truth)


def test_workers_get_the_package_whatever_their_folder(tmp_path):
    """Queries with Python functions in tasks, started from another folder."""
    import pathlib

    top = pathlib.Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(top)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
for name in ("d12_hull_area", "e15_distance_transform"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
print("both ran")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "both ran" in done.stdout, done.stderr[-3000:]


def test_nearest_segment_lists_few_pairs(spark):
    """In one task and down the grids; many points at one place, equal segments."""
    rng = random.Random(4)
    points = [(k, i, float(rng.randrange(1, 5)), float(rng.randrange(900, 905))) for k in "ab" for i in range(200)]
    segments = [(k, i, x + 50, y, x + 53, y + 4) for k, i, x, y in rng.sample(points, 300)]
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame(segments, SEGMENTS)
    truth = {}
    for k, i, x, y in points:
        for kk, j, x0, y0, _, _ in segments:
            if k == kk:  # all have the same direction
                t = min(max((x - x0) * 0.12 + (y - y0) * 0.16, 0), 1)
                truth[k, i] = min(truth.get((k, i), (1e9, 0)), (round(math.hypot(x - x0 - 3 * t, y - y0 - 4 * t), 9), j))
    for held in (10_000, 10):
        found = match.nearest_segment(p, s, ["k"], held=held).collect()
        assert {(r.k, r.point_id): (round(r.d, 9), r.seg_id) for r in found} == truth and len(found) == len(truth)


def test_nearest_of_axes_lists_few_pairs(spark):
    """As the nearest of all distances, which are never made: one row a point and axis."""
    rng = random.Random(5)
    points = [(k, i, float(rng.randrange(40)), float(rng.randrange(40))) for k in "ab" for i in range(60)]
    segments = [("a", j, x := float(rng.randrange(40)), y := float(rng.randrange(40)), x + rng.choice([0.0, 3.0, 30.0]), y + 4) for j in range(60)]
    axes = spark.createDataFrame([("a", j, j % 7) for j in range(60)], "k string, seg_id int, axe_id int")
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame(segments, SEGMENTS)
    found = match.nearest_of_axes(p, s, axes, ["k"], 6.0).collect()
    plain = match.nearest_per_axe(match.point_segment_distance(p, s, ["k"], 6.0), axes, ["k"]).collect()
    told = lambda rows: sorted((r.k, r.point_id, r.axe_id, r.seg_id, round(r.d, 9), round(r.px, 9), round(r.py, 9)) for r in rows)
    assert plain and told(found) == told(plain)
    asked = []
    try:
        match.point_segment_distance, kept = lambda *a: asked.append(a), match.point_segment_distance
        from rootweave.plans import catalogue

        assert catalogue.queries()["c08_nearest_per_axe"](spark, "/root/testdata/sf0.001").count() > 0 and not asked
    finally:
        match.point_segment_distance = kept


def greedy_pairs(a, b, most, squared, digits):
    found, ranks = [], {}
    for k, i, x, y in a:
        for kk, j, u, v in b:
            if k == kk and None not in (x, u) and (d := math.hypot(x - u, y - v)) <= most:
                ranks[k, i, j] = round((x - u) ** 2 + (y - v) ** 2 if squared else d, digits)
    left, right = set(), set()
    for (k, i, j), d in sorted(ranks.items(), key=lambda r: (r[1], r[0])):
        if (k, i) not in left and (k, j) not in right:
            found.append((k, i, j, d))
            left.add((k, i))
            right.add((k, j))
    return sorted(found)


@pytest.mark.parametrize("held", [10_000, 20])
def test_greedy_points_without_pairs(spark, held, monkeypatch):
    """Many points at one place, ties between places, few pairs looked at together."""
    from rootweave.operators import compare, nearby

    rng = random.Random(6)
    a = [(k, i, float(rng.randrange(6)), float(rng.randrange(6))) for k in "ab" for i in range(30)] + [("a", 90, None, 1.0), ("c", 1, 0.0, 0.0)]
    b = [(k, j, float(rng.randrange(12)), float(rng.randrange(6))) for k in "ab" for j in range(20 if k == "a" else 4)] + [(None, 1, 0.0, 0.0)]
    one, two = spark.createDataFrame(a, "k string, i int, x double, y double"), spark.createDataFrame(b, "k string, j int, x double, y double")
    told = lambda rows: sorted((r.k, r.i, r.j, round(r.d, 6)) for r in rows.collect())
    assert told(match.greedy_points(one, two, ["k"], 3.0, digits=6, held=held)) == greedy_pairs(a, b, 3.0, False, 6)
    if held > 100:
        plants = lambda t, i: t.selectExpr("k as item_key", f"{i} as plant", "x", "y")
        monkeypatch.setattr(match, "greedy_match", None)  # no list of pairs
        found = compare.seed_match(plants(one, "i"), plants(two, "j"), digits=6).withColumnRenamed("item_key", "k")
        assert told(found) == greedy_pairs(a, b, math.inf, True, 6)
        monkeypatch.setattr(nearby, "PAIRS", 7)
        import numpy as np

        (i, ax, ay), (j, bx, by) = ([np.array(c) for c in zip(*[r[1:] for r in t if r[0] == "a" and None not in r])] for t in (a, b))
        small = zip(*nearby.greedy(i, ax, ay, j, bx, by, digits=6))
        assert sorted(("a", *r) for r in small) == [r for r in greedy_pairs(a, b, math.inf, False, 6) if r[0] == "a"]


def test_pairs_of_many_points_at_one_place(spark, monkeypatch):
    """Packs of a place, none of which is broadcast, against all pairs."""
    monkeypatch.setattr(match, "PACK", 3)
    rng = random.Random(7)
    a = [(k, i, float(rng.randrange(3)), rng.randrange(40) / 10) for k in "ab" for i in range(60)] + [("a", 99, None, 1.0)]
    points = spark.createDataFrame(a, "k string, i int, x double, y double")
    found = match.close_pairs(points, ["k"], 1.5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    far = {(k, i, j): math.hypot(x - u, y - v) for k, i, x, y in a for kk, j, u, v in a if k == kk and None not in (x, u)}
    told = lambda rows: sorted((r.k, r.i, r.j, round(r.d, 9)) for r in rows.collect())
    assert told(found) == sorted((*p, round(d, 9)) for p, d in far.items() if p[1] < p[2] and d < 1.5)
    both = match.near_pairs(points, points.withColumnRenamed("i", "j"), ["k"], 1.5)
    assert told(both) == sorted((*p, round(d, 9)) for p, d in far.items() if d <= 1.5)


def test_segments_of_many_points_at_one_place(spark, monkeypatch):
    """A distance is found once for a place and equal segments, whatever they hold."""
    monkeypatch.setattr(match, "PACK", 4)
    rng = random.Random(8)
    points = [("a", i, float(rng.randrange(4)), float(rng.randrange(3))) for i in range(50)]
    segments = [("a", j, x := float(rng.randrange(4)), y := float(rng.randrange(3)), x + 3, y + 4) for j in range(40)]
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame(segments, SEGMENTS)
    found = match.point_segment_distance(p, s, ["k"], 2.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("collect_list") > 1
    truth = {(i, j): brute([("a", i, x, y)], [("a", j, *e)])["a", i] for _, i, x, y in points for _, j, *e in segments}
    assert sorted((r.point_id, r.seg_id, round(r.d, 9)) for r in found.collect()) == sorted((*k, round(d, 9)) for k, d in truth.items() if d <= 2.0)


def test_background_over_parts_of_a_raster(spark):
    """Cells on both sides of the parts' borders, with holes, dealt once and never joined."""
    rng = random.Random(9)
    cells = {(k, y, x): float(rng.randrange(50)) for k in "ab" for y in [*range(-6, 4), *range(506, 518)] for x in [*range(-5, 5), *range(507, 516)] if rng.random() < 0.6}
    found = ra.remove_background(spark.createDataFrame([(*c, v) for c, v in cells.items()], CELLS + ", v double"), 2, 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    low = cells
    for dy, dx in ((0, 1), (1, 0)):
        low = {(k, y, x): min(low[c] for n in range(-2, 3) if (c := (k, y + n * dy, x + n * dx)) in low) for k, y, x in low}
    weights = ra.gaussian_kernel(1.0)
    for dy, dx in ((0, 1), (1, 0)):
        near = {(k, y, x): [(weights[n + 3], low[c]) for n in range(-3, 4) if (c := (k, y + n * dy, x + n * dx)) in low] for k, y, x in low}
        low = {c: sum(w * v for w, v in rows) / sum(w for w, _ in rows) for c, rows in near.items()}
    got = {(r.item_key, r.y, r.x): r.v for r in found.collect()}
    assert set(got) == set(cells) and all(got[c] == pytest.approx(cells[c] - low[c]) for c in cells)
