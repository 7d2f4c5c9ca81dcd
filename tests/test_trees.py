"""Trees, comparison, merge search, images: small cases against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootweave.operators import compare, graph, match, measure, paths, segment, stats, trees

ROOT = [(-1, 0.0, 0.0), (1, 0.0, 1.0), (2, 0.0, 2.0), (3, 0.0, 3.0), (4, 0.0, 4.0), (5, 1.0, 3.0), (6, 2.0, 4.0)]
#: seg_id, n0, n1, seed: some segments are stored against the growth
LINKS = [(10, -1, 1, 1), (1, 2, 1, 0), (2, 2, 3, 0), (3, 4, 3, 0), (4, 5, 2, 0), (5, 5, 6, 0)]


def tables(spark):
    nodes = spark.createDataFrame([("a", *r) for r in ROOT], "item_key string, node_id bigint, x double, y double")
    return nodes, spark.createDataFrame([("a", *r) for r in LINKS], "item_key string, seg_id bigint, n0 bigint, n1 bigint, seed int")


def test_graph_to_tree(spark):
    nodes, segs = tables(spark)
    found = segment.compute_tree(nodes, segs, 0.5, spark.createDataFrame([("a", 0.25)], "item_key string, scale double"))
    axes = {r.axe_id: (r.plant, r.ord, r.parent, r.parent_segment, r.scale) for r in found["axes"].collect()}
    assert axes == {5: (1, 1, None, None, 0.25), 3: (1, 2, 5, 1, 0.25)}
    assert sorted((r.axe_id, r.pos, r.seg_id) for r in found["axe_segments"].collect()) == [(3, 1, 2), (3, 2, 3), (5, 1, 10), (5, 2, 1), (5, 3, 4), (5, 4, 5)]


def test_dag_is_acyclic_and_keeps_what_it_can(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(40)}
    edges = {(a, b) for a, b in edges if a != b}
    e = spark.createDataFrame([("a", a, b, 1.0) for a, b in edges], "item_key string, a bigint, b bigint, cost double")
    kept = {(r.a, r.b) for r in graph.to_dag(e, spark.createDataFrame([("a", 0, 0.0)], "item_key string, node_id bigint, dist double"))[0].collect()}
    assert kept <= edges
    reach = {0}
    while more := {b for a, b in edges if a in reach} - reach:
        reach |= more

    def cyclic(links):
        left = set(links)
        while free := {a for a, _ in left} - {b for _, b in left}:
            left = {(a, b) for a, b in left if a not in free}
        return bool(left)

    assert not cyclic(kept)
    assert all(cyclic(kept | {x}) for x in edges - kept if x[0] in reach)


def test_paths_merge(spark):
    # two ways lead to the crossing 3; the path that ends before 4 takes over its rest
    rows = [("a", 1, 1, 1), ("a", 1, 2, 3), ("a", 1, 3, 5), ("a", 2, 1, 1), ("a", 2, 2, 3), ("a", 2, 3, 4), ("a", 3, 1, 2), ("a", 3, 2, 7)]
    p = spark.createDataFrame(rows, "item_key string, path_id bigint, pos int, seg_id bigint")
    e = spark.createDataFrame([("a", 7, 4)], "item_key string, a bigint, b bigint")
    size = spark.createDataFrame([("a", k, float(4 - k)) for k in (1, 2, 3)], "item_key string, path_id bigint, length double")
    out = trees.merge_paths(p, e, size).orderBy("path_id", "pos").collect()
    assert [(r.path_id, r.seg_id) for r in out] == [(1, 1), (1, 3), (1, 5), (3, 2), (3, 7), (3, 4)]


def test_paths_merge_by_turns(spark):
    # at 10 the straight comer 8 goes on as the path whose second turn is smaller does
    ways = {1: [1, 2, 10, 11, 12], 2: [1, 2, 10, 11, 13], 3: [1, 2, 14], 4: [1, 8], 5: [1, 9]}
    bends = {(8, 10): 0.1, (9, 10): 0.4, (10, 11): 0.0, (11, 12): 0.5, (11, 13): 0.2}
    p = spark.createDataFrame([("a", k, i, x) for k, w in ways.items() for i, x in enumerate(w, 1)], "item_key string, path_id bigint, pos int, seg_id bigint")
    e = spark.createDataFrame([("a", a, b, c) for (a, b), c in bends.items()], "item_key string, a bigint, b bigint, cost double")
    size = spark.createDataFrame([("a", k, 1.0) for k in range(1, 15)], "item_key string, seg_id bigint, length double")

    def told(df):
        out = {}
        for r in df.orderBy("path_id", "pos").collect():
            out.setdefault(r.path_id, []).append(r.seg_id)
        return out

    assert told(trees.merge_paths(p, e, segments=size)) == {3: [1, 2, 14], 4: [1, 8, 10, 11, 13], 5: [1, 9, 10, 11, 12]}
    kept = spark.createDataFrame([("a", 2)], "item_key string, path_id bigint")
    assert told(trees.merge_paths(p, e, segments=size, fixed=kept)) == {2: ways[2], 3: ways[3], 4: [1, 8, 10, 11, 12], 5: ways[5]}
    assert trees.merge_paths(p.limit(0), e, segments=size).count() == 0
    with pytest.raises(ValueError):
        trees.merge_paths(p, e)


def random_tree(rng, n, first):
    """Parents of a random tree and its covering paths."""
    up = {first: None, **{first + k: first + rng.randrange(max(0, k - 6), k) for k in range(1, n)}}
    ways = {}
    for leaf in set(up) - set(up.values()):
        way = [leaf]
        while up[way[-1]] is not None:
            way.append(up[way[-1]])
        ways[leaf] = way[::-1]
    return up, ways


def test_many_merges_in_a_round(spark):
    rng = random.Random(11)
    rows, links, given = [], [], {}
    for item in "ab":
        up, ways = random_tree(rng, 24, 1)
        # edges lead to larger ids, so there is no cycle
        more = {(a, b) for a, b in ((rng.randrange(1, 25), rng.randrange(1, 25)) for _ in range(30)) if a < b}
        given[item] = (ways, more | {(v, k) for k, v in up.items() if v})
        rows += [(item, k, i, x) for k, w in ways.items() for i, x in enumerate(w, 1)]
        links += [(item, a, b, rng.random()) for a, b in given[item][1]]
    p = spark.createDataFrame(rows, "item_key string, path_id bigint, pos int, seg_id bigint")
    e = spark.createDataFrame(links, "item_key string, a bigint, b bigint, cost double")
    size = spark.createDataFrame([(i, k, 1.0) for i in "ab" for k in range(1, 25)], "item_key string, seg_id bigint, length double")
    out = {i: {} for i in "ab"}
    for r in trees.merge_paths(p, e, segments=size).orderBy("item_key", "path_id", "pos").collect():
        out[r.item_key].setdefault(r.path_id, []).append(r.seg_id)
    for item, (ways, edges) in given.items():
        found = out[item]
        # every segment keeps a path, every step is an edge, no way ends elsewhere than before
        assert {x for w in found.values() for x in w} == {x for w in ways.values() for x in w}
        assert all((a, b) in edges for w in found.values() for a, b in zip(w, w[1:]))
        assert {w[-1] for w in found.values()} <= {w[-1] for w in ways.values()} and len(found) < len(ways)
        cover = {}
        for w in found.values():
            for x in w:
                cover[x] = cover.get(x, 0) + 1
        ends = {(a, b) for w in found.values() for a, b in edges if a == w[-1] and b not in w}
        assert not any(k and min(cover[x] for x in w[:k]) > 1 and b == y for w in found.values() for k, y in enumerate(w) for _, b in ends)


def test_pruning_by_brute_force(spark):
    rng = random.Random(5)
    rows, sizes, wanted = [], [], {}
    for item in range(3):
        _, ways = random_tree(rng, 40, 1)
        length = {k: float(rng.randrange(0, 5)) for k in range(1, 41)}
        rows += [(str(item), k, i, x) for k, w in ways.items() for i, x in enumerate(w, 1)]
        sizes += [(str(item), k, v) for k, v in length.items()]
        left = dict(ways)
        while True:
            cover = {}
            for w in left.values():
                for x in w:
                    cover[x] = cover.get(x, 0) + 1
            tips = [(sum(length[x] for x in w if cover[x] == 1), k) for k, w in left.items()]
            if not tips or min(tips)[0] >= 9:
                break
            del left[min(tips)[1]]
        wanted[str(item)] = set(left)
    p = spark.createDataFrame(rows, "item_key string, path_id bigint, pos int, seg_id bigint")
    kept = paths.prune(p, spark.createDataFrame(sizes, "item_key string, seg_id bigint, length double"), 9.0)
    found = {k: set() for k in wanted}
    for r in kept.select("item_key", "path_id").distinct().collect():
        found[r.item_key].add(r.path_id)
    assert found == wanted and any(wanted.values())


LENGTH = {s: float(l) for s, l in zip(range(1, 30), [9, 4, 7, 3, 8, 5, 6, 2, 9, 4, 5, 7, 3, 6, 8, 4, 5, 9, 2, 6, 7, 3, 5, 8, 4, 6, 9, 5, 7])}


def worth(state, primary):
    """Value of a set of paths: spread of the growth ratios plus extra branchings."""
    size = lambda p: sum(LENGTH[s] for s in p)
    laterals = [(p, base) for p, base in state if p != primary]
    ratios = [(size(primary) - size(p)) / size(primary) for p, _ in laterals]
    bases = [base for _, base in laterals]
    return float(np.std(ratios)) + len(bases) - len(set(bases))


def all_merges(state, primary, edges):
    """Every state one merge away."""
    cover = {}
    for p, _ in state:
        for s in p:
            cover[s] = cover.get(s, 0) + 1
    out = []
    for x in state:
        for y in state:
            if x == y or primary in (x[0], y[0]):
                continue
            for k, s in enumerate(y[0]):
                if k and (x[0][-1], s) in edges and s not in x[0] and min(cover[t] for t in y[0][:k]) > 1:
                    out.append((state - {x, y}) | {(x[0] + y[0][k:], x[1])})
                    break
    return out


def test_merge_search_by_brute_force(spark):
    from rootweave.operators import merges

    # a primary 1-8; laterals that share starts, and edges by which they may go on
    paths = {1: (1, 2, 3, 4, 5, 6, 7, 8), 2: (1, 2, 9, 10), 3: (1, 2, 3, 11, 12, 13), 4: (1, 2, 3, 11, 14, 15), 5: (1, 2, 3, 4, 16, 17), 6: (1, 2, 3, 4, 16, 18, 19), 7: (1, 20, 21, 22), 8: (1, 20, 21, 23)}
    edges = {(10, 12), (10, 14), (13, 17), (13, 18), (15, 18), (17, 22), (19, 22), (10, 11), (15, 23), (22, 99), (19, 21)}
    rows = [("a", p, k, s) for p, own in paths.items() for k, s in enumerate(own, 1)] + [("b", 1, k, s) for k, s in enumerate(paths[1], 1)]
    p = spark.createDataFrame(rows, "item_key string, path_id bigint, pos int, seg_id bigint")
    segs = spark.createDataFrame([(i, s, l) for i in "ab" for s, l in LENGTH.items()], "item_key string, seg_id bigint, length double")
    e = spark.createDataFrame([("a", *x) for x in edges], "item_key string, a bigint, b bigint")
    axes = trees.initial_axes(p, spark.createDataFrame([("a", 1), ("b", 1)], "item_key string, path_id bigint"), segs)
    primary = paths[1]

    def base(own):
        k = next((i for i, (s, t) in enumerate(zip(own, primary)) if s != t), min(len(own), len(primary)))
        return own[k]

    start = frozenset((own, None if own == primary else base(own)) for own in paths.values())
    seen, front = {start}, {start}
    while front:
        front = {frozenset(t) for s in front for t in all_merges(s, primary, edges)} - seen
        seen |= front
    most = max(len(start) - len(s) for s in seen)
    assert most >= 3  # axes merge again and again
    found = merges.search(p, axes, segs, e, width=100_000, coef=1e9)
    value = {r.item_key: r.value for r in found["values"].collect()}
    assert value["a"] == pytest.approx(min(worth(s, primary) for s in seen)) and value["b"] == 0.0
    got = {}
    for r in found["paths"].orderBy("pos").collect():
        got.setdefault((r.item_key, r.path_id), []).append(r.seg_id)
    best = {tuple(v) for k, v in got.items() if k[0] == "a"}
    assert any({own for own, _ in s} == best and worth(s, primary) == pytest.approx(value["a"]) for s in seen) and got["b", 1] == list(primary)
    made = {r.path_id: [(x.path, x["at"], x.start) for x in r.pieces] for r in found["pieces"].where("item_key = 'a'").collect()}
    for (item, i), own in got.items():
        if item == "a":
            parts = made[i]
            ends = [x[2] for x in parts[1:]] + [len(own) + 1]
            assert [s for (q, at, begin), stop in zip(parts, ends) for s in paths[q][at - 1 : at - 1 + stop - begin]] == own
    greedy = merges.search(p, axes, segs, e, width=1).get("values").collect()
    assert all(r.value <= worth(start, primary) for r in greedy)
    with pytest.raises(RuntimeError):
        merges.search(p, axes, segs, e, width=10, coef=1e9, most=1)


def test_crossing_leaves_the_outermost(spark):
    from rootweave.operators import merges

    # 9 ends next to 12, where three ways come from 11 and part: two at once to the left, one to the right
    paths = {1: (1, 2, 3), 2: (1, 9), 3: (1, 2, 11, 12, 13), 4: (1, 2, 11, 12, 14, 15), 5: (1, 2, 11, 12, 14, 16)}
    p = spark.createDataFrame([("a", k, i, s) for k, own in paths.items() for i, s in enumerate(own, 1)], "item_key string, path_id bigint, pos int, seg_id bigint")
    segs = spark.createDataFrame([("a", s, 4.0) for s in range(1, 20)], "item_key string, seg_id bigint, length double")
    side = [(9, 12, 0.5), (11, 12, 0.1), (12, 13, 0.4), (12, 14, -0.4), (14, 15, 0.2), (14, 16, -0.2)]
    e = spark.createDataFrame([("a", *x) for x in side], "item_key string, a bigint, b bigint, side double")
    axes = trees.initial_axes(p, spark.createDataFrame([("a", 1)], "item_key string, path_id bigint"), segs)
    s, a = merges.first_state(p, axes, segs)
    pairs = lambda c: {(r.p1, r.p2) for r in merges.possible(s, a, e, c).collect()}
    assert pairs(None) == {(2, 3), (2, 4), (2, 5)}
    # 3 is outermost on the side 9 comes from; 4 parts from 5, the outermost of the other side, after 8
    assert pairs(5.0) == {(2, 3)} and pairs(10.0) == {(2, 3), (2, 4)}


def test_traced_axes_to_tables(spark):
    tracings = spark.createDataFrame([("f", 1, 1, 1), ("f", 2, 1, 2), ("f", 3, 1, 2)], "file string, tracing_id int, plant int, ord int")
    pts = [("f", 1, 1, k, 0, 10 * k) for k in range(4)] + [("f", 2, 1, k, 2 + 5 * k, 12) for k in range(3)] + [("f", 3, 1, k, 900 + k, 29) for k in range(2)]
    points = spark.createDataFrame(pts, "file string, tracing_id int, segment_no int, pos int, x int, y int")
    t = trees.tree_tables(tracings, points)
    assert sorted((r.axe_id, r.parent, r.parent_segment) for r in t["axes"].collect() if r.parent) == [(2, 1, 2), (3, 1, 3)]
    seg = {r.seg_id: r for r in t["segments"].collect()}
    assert len(seg) == 6 and seg[1].seed == 1 and seg[1].parent is None and seg[2].parent == 1 and seg[4].parent == 2 and seg[6].parent == 3
    assert t["nodes"].count() == 9 and seg[1].length == 10


def test_trees_match(spark):
    line = lambda k, x, shift: [("a", k, i, x + shift, float(10 * i)) for i in range(4)]
    pts = "item_key string, root_id bigint, pos int, x double, y double"
    ref, cmp = line(1, 0.0, 0) + line(2, 50.0, 0), line(11, 0.0, 1) + line(12, 50.0, 2) + line(13, 55.0, 0)
    roots = "item_key string, root_id bigint, plant bigint, ord int"
    r = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 1, 2)], roots)
    c = spark.createDataFrame([("a", 11, 7, 1), ("a", 12, 7, 2), ("a", 13, 7, 2)], roots)
    seeds = [spark.createDataFrame(x, "item_key string, plant bigint, x double, y double") for x in ([("a", 1, 0.0, 0.0), ("a", 2, 900.0, 0.0)], [("a", 7, 3.0, 4.0)])]
    found = compare.match_trees(tuple(seeds), (r, c), (spark.createDataFrame(ref, pts), spark.createDataFrame(cmp, pts)), most_plant=50.0)
    assert [(x.i, x.j, x.d) for x in found["plants"].collect()] == [(1, 7, 5.0)]
    assert sorted((x.i, x.j, round(x.d, 6)) for x in found["roots"].collect()) == [(1, 11, 1.0), (2, 12, 2.0)]
    assert [x.j for x in found["roots_cmp"].collect()] == [13] and [x.i for x in found["plants_ref"].collect()] == [2]
    assert tuple(compare.match_counters(found).first()) == (1, 1, 0)
    k = compare.resample_roots(spark.createDataFrame([("a", 1, 0, 0.0, 0.0), ("a", 1, 1, 1.0, 0.0), ("a", 1, 2, 1.0, 3.0)], pts), 5).orderBy("k").collect()
    assert [(round(x.x, 6), round(x.y, 6)) for x in k] == [(0, 0), (1, 0), (1, 1), (1, 2), (1, 3)]


def test_axes_are_projected(spark):
    nodes, segs = tables(spark)
    ends = {i: (x, y) for i, x, y in ROOT}
    tree = [("a", s, *ends[a], *ends[b]) for s, a, b in ((1, 1, 2), (2, 2, 3), (3, 3, 4))]
    t = spark.createDataFrame(tree, "item_key string, seg_id bigint, x0 double, y0 double, x1 double, y1 double")
    axis = spark.createDataFrame([("a", 1, k, k) for k in (1, 2, 3)], "item_key string, axe_id bigint, pos int, seg_id bigint")
    links = [("a", a, b, 1.0) for _, a, b, _ in LINKS] + [("a", b, a, 1.0) for _, a, b, _ in LINKS]
    e = spark.createDataFrame(links, "item_key string, a bigint, b bigint, length double")
    moved = nodes.withColumn("x", F.col("x") + 0.1)
    out = trees.project_axes(axis, t, moved, e).orderBy("pos").collect()
    assert [r.node_id for r in out] == [1, 2, 3, 4]
    m = spark.createDataFrame([("a", 2, [1.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "item_key string, frame int, m array<double>")
    followed = trees.track([2], (axis, t), moved.withColumn("frame", F.lit(2)), e.withColumn("frame", F.lit(2)), m)
    assert [r.node_id for r in followed.orderBy("pos").collect()] == [1, 2, 3, 4]


def test_hull_by_brute_force(spark):
    pts = [(math.cos(2 * math.pi * k / 64), math.sin(2 * math.pi * k / 64)) for k in range(64)] + [(1500.0, 0.0), (1500.0, 0.5), (0.0, 0.0)]
    rng = random.Random(3)
    few = [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(60)]
    rows = [("a", *p) for p in pts] + [("b", *p) for p in few] + [("c", 1.0, 1.0), ("c", 1.0, 1.0), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    limit, measure.HULL_PART = measure.HULL_PART, 10
    try:
        found = {r.k: [(p.x, p.y) for p in r.hull] for r in measure.hull(df, ["k"]).collect()}
    finally:
        measure.HULL_PART = limit
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for k, own in (("a", pts), ("b", few)):
        ring = found[k]
        assert all(cross(a, b, p) >= -1e-9 for a, b in zip(ring, ring[1:] + ring[:1]) for p in own)
        assert all(cross(a, b, c) > 0 for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2])) and ring[0] == min(own)
    assert len(found["a"]) == 35 and found["c"] == [(1.0, 1.0)] and "d" not in found


def test_loops_end_or_raise(spark):
    chain = spark.createDataFrame([("a", k, k + 1, 1.0) for k in range(40)], "item_key string, a bigint, b bigint, cost double")
    nodes = spark.createDataFrame([("a", k) for k in range(41)], "item_key string, node_id bigint")
    with pytest.raises(RuntimeError):
        graph.components(nodes, chain, most=1)
    ring = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 3, 1)], "item_key string, node_id bigint, parent bigint")
    for fn in (graph.ancestors, graph.roots):
        with pytest.raises(ValueError):
            fn(ring)
    with pytest.raises(RuntimeError):
        graph.markov_clusters(chain, most=1)


def test_mixture_outliers_and_flow(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(10, 1, 3000), rng.normal(30, 2, 1000)])
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, v double")
    fit = stats.gaussian_mixture(df, ["k"], "v").orderBy("class").collect()
    assert [round(r.weight, 2) for r in fit] == [0.75, 0.25] and abs(fit[0]["mean"] - 10) < 0.2 and abs(fit[1]["mean"] - 30) < 0.3 and abs(fit[1]["std"] - 2) < 0.3
    odd = spark.createDataFrame([("a", float(x)) for x in rng.normal(0, 1, 200)] + [("a", 60.0), ("a", -75.0)], "k string, v double")
    assert {r.v for r in stats.outliers(odd, ["k"], "v").where("outlier").collect()} >= {60.0, -75.0}
    cliques = [("a", i, j, 1.0) for g in (0, 10) for i in range(g, g + 5) for j in range(i + 1, g + 5)] + [("a", 4, 10, 0.1)]
    flow = graph.markov_clusters(spark.createDataFrame(cliques, "item_key string, a bigint, b bigint, cost double"))
    assert {r.node_id: r.cluster for r in flow.collect()} == {i: g for g in (0, 10) for i in range(g, g + 5)}


def test_nearest_segment_has_no_limit(spark):
    p = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 5000.0, 1.0), ("b", 3, 0.0, 0.0)], "k string, point_id int, x double, y double")
    s = spark.createDataFrame([("a", 7, 100.0, 0.0, 101.0, 0.0), ("a", 8, 200.0, 0.0, 201.0, 0.0)], "k string, seg_id int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.point_id, r.seg_id, round(r.d)) for r in match.nearest_segment(p, s, ["k"]).collect()} == {(1, 7, 100), (2, 8, 4799)}


def test_image_to_graph(spark):
    cells = {(y, x) for y in range(8, 24) for x in range(9, 12)} | {(12 + k, 10 + k + d) for k in range(8) for d in (0, 1, 2)}
    seed = {(y, x) for y in range(3, 9) for x in range(7, 14)}
    mask = spark.createDataFrame([("a", y, x) for y, x in cells | seed], "item_key string, y int, x int")
    seeds = spark.createDataFrame([("a", y, x, 1) for y, x in seed], "item_key string, y int, x int, label int")
    parts = segment.linear_labels(mask, seeds)
    nodes, segs = segment.image_graph(parts)
    rows = segs.collect()
    assert [r.n0 for r in rows if r.seed] == [-1] and all(r.radius > 0 for r in rows if not r.seed)
    points = {r.node_id: (r.x, r.y) for r in nodes.collect()}
    assert points[-1] == (10.0, 5.5) and all({r.n0, r.n1} <= points.keys() for r in rows)
    lines_n, lines_s = segment.line_graph(nodes, segs, parts["segments"], 4)
    assert lines_s.where("seed = 0").count() >= len(rows) - 1 and lines_s.where("seed = 1").count() == 1
    known = {r.node_id for r in lines_n.collect()}
    assert all({r.n0, r.n1} <= known for r in lines_s.collect())


def test_exchange_formats(spark, tmp_path):
    from rootweave.sources import exchange

    axes = spark.createDataFrame([("a", 1, 1, 1, None), ("a", 2, 1, 2, 1), ("b", 3, 2, 1, None)], "item_key string, axe_id bigint, plant bigint, ord int, parent bigint")
    points = spark.createDataFrame([("a", 1, 0, 0.5, 1.0), ("a", 1, 1, 2.0, 3.0), ("a", 2, 0, 2.0, 3.0), ("a", 2, 1, 4.0, 4.0), ("b", 3, 0, 9.0, 9.0), ("b", 3, 1, 9.0, 8.0)], "item_key string, axe_id bigint, pos int, x double, y double")
    exchange.write_root_xml(axes, points, f"{tmp_path}/rsml")
    a, p = exchange.read_root_xml(spark, f"{tmp_path}/rsml")
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert rows(a) == rows(axes) and rows(p) == rows(points)
    c = spark.createDataFrame([(1.5, 1, 1), (1.5, 2, 1), (2.0, 1, 1)], "inflation double, node_id bigint, cluster bigint")
    exchange.write_clusters(c, f"{tmp_path}/clusters")
    assert {r.inflation for r in exchange.list_clusters(spark, f"{tmp_path}/clusters").collect()} == {1.5, 2.0}
    assert exchange.read_clusters(spark, f"{tmp_path}/clusters", 1.5).count() == 2
