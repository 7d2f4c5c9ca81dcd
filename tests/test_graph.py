"""Ways, strong components, acyclic subsets and levels against plain versions, in one task
and dealt into blocks: nulls, loops, repeated edges, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from rootweave.operators import graph
from rootweave.operators import raster as ra

EDGES, SOURCES = "item_key string, a bigint, b bigint, cost double", "item_key string, node_id bigint, dist double"


@pytest.fixture(params=[None, 60])
def limit(request, monkeypatch):
    """Edges of a task: as built, or so few that graphs are dealt out."""
    if request.param:
        monkeypatch.setattr(graph, "LOCAL", request.param)
    return request.param


def graphs(rng, dense=1.0):
    rows = []
    for item, n, m in (("a", 30, int(90 * dense)), ("b", 12, 30), ("c", 5, 3)):
        rows += [(item, rng.randrange(n) * 3, rng.randrange(n) * 3, float(rng.choice([0, 1, 1, 2, 5]))) for _ in range(m)]
    return rows


def ways(edges, sources, larger):
    """Bellman-Ford, then steps over edges that lie on cheapest ways."""
    best = {}
    for k, v, d in sources:
        best[k, v] = min(d, best.get((k, v), d))
    start = dict(best)
    join = max if larger else (lambda d, c: d + c)
    for _ in range(200):
        for k, a, b, c in edges:
            if (k, a) in best and join(best[k, a], c) < best.get((k, b), float("inf")):
                best[k, b] = join(best[k, a], c)
    state = {key: (0, -1, None, key[1]) for key, d in start.items() if d == best[key]}
    level, front = 0, dict(state)
    while front:
        level, new = level + 1, {}
        for k, a, b, c in edges:
            if (k, a) in front and (k, b) not in state and join(best[k, a], c) == best[k, b]:
                offer = (level, a, a, front[k, a][3])
                new[k, b] = min(new.get((k, b), offer), offer)
        state |= new
        front = new
    return {key: (best[key], s[2], s[3]) for key, s in state.items()}


@pytest.mark.parametrize("combine", ["sum", "max"])
def test_shortest_paths(spark, limit, combine):
    if limit and combine == "sum":
        pytest.skip("dealt out by max, which has the ties")
    rng = random.Random(11)
    edges = graphs(rng)
    sources = [("a", 0, 0.0), ("a", 60, 1.0), ("a", 60, 2.0), ("b", 3, 0.0), ("d", 7, 2.5)]
    rows = spark.createDataFrame([*edges, ("a", None, 3, 1.0), ("a", 3, None, 1.0)], EDGES)
    seen = []
    found = graph.shortest_paths(rows, spark.createDataFrame([*sources, ("a", None, 0.0), ("b", 6, None)], SOURCES), combine, on_round=lambda n, c: seen.append(n))
    got = {(r.item_key, r.node_id): (r.dist, r.parent, r.source) for r in found.collect()}
    assert got == ways(edges, sources, combine == "max") and seen
    empty = spark.createDataFrame([], EDGES)
    assert graph.shortest_paths(empty, spark.createDataFrame([], SOURCES), combine).count() == 0


def test_paths_go_on_from_a_start(spark):
    rows = spark.createDataFrame([("a", i, i + 1, 1.0) for i in range(60)], EDGES)
    one = graph.shortest_paths(rows, spark.createDataFrame([("a", 30, 0.0)], SOURCES))
    both = graph.shortest_paths(rows, spark.createDataFrame([("a", 0, 5.0)], SOURCES), start=one)
    assert {r.node_id: r.dist for r in both.collect()} == {i: (5.0 + i if i < 30 else i - 30.0) for i in range(61)}


def test_cycles_below_nothing_raise(spark):
    rows = [("a", i, (i + 1) % 40, -1.0) for i in range(40)]
    with pytest.raises(RuntimeError):
        graph.shortest_paths(spark.createDataFrame(rows, EDGES), spark.createDataFrame([("a", 0, 0.0)], SOURCES))


def reach(pairs, start):
    seen, stack = {start}, [start]
    while stack:
        v = stack.pop()
        for a, b in pairs:
            if a == v and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def test_strong_components(spark, limit):
    rng = random.Random(12)
    edges = graphs(rng, 0.7) + [("e", i, (i + 1) % 50, 1.0) for i in range(50)] + [("e", 100 + i, 101 + i, 1.0) for i in range(40)] + [("e", 10, 100, 1.0)]
    found = {(r.item_key, r.node_id): r.strong for r in graph.strong_components(spark.createDataFrame([*edges, ("a", None, 1, 1.0)], EDGES)).collect()}
    truth = {}
    for item in "abce":
        pairs = {(a, b) for k, a, b, _ in edges if k == item}
        nodes = {v for p in pairs for v in p}
        far = {v: reach(pairs, v) for v in nodes}
        truth |= {(item, v): min(w for w in far[v] if v in far[w]) for v in nodes}
    assert found == truth


def dag(edges, sources):
    """Edges tried one by one."""
    dist = {key: v[0] for key, v in ways(edges, sources, False).items()}
    kept = set()
    rank = lambda k, v: (dist[k, v], v)
    rows = sorted({(k, a, b) for k, a, b, _ in edges if (k, a) in dist and (k, b) in dist and a != b}, key=lambda e: (rank(e[0], e[1]), rank(e[0], e[2])))
    kept = {(k, a, b) for k, a, b in rows if rank(k, b) > rank(k, a)}
    for k, a, b in rows:
        if (k, a, b) not in kept and a not in reach({(x, y) for q, x, y in kept if q == k}, b):
            kept.add((k, a, b))
    return kept


def test_acyclic_edges(spark, limit):
    rng = random.Random(13)
    edges = graphs(rng) + [("e", i, (i + 1) % 40, 1.0) for i in range(40)] + [("e", i, (i - 1) % 40, 1.0) for i in range(0, 40, 9)]
    sources = [("a", 0, 0.0), ("b", 3, 0.0), ("e", 0, 0.0)]
    kept, removed = graph.to_dag(spark.createDataFrame(edges, EDGES).withColumn("seg", F.lit(1)), spark.createDataFrame(sources, SOURCES))
    assert kept.columns == ["item_key", "a", "b", "cost", "seg"]
    got = {(r.item_key, r.a, r.b) for r in kept.collect()}
    assert got == dag(edges, sources)
    assert {(r.item_key, r.a, r.b) for r in removed.collect()} == {(k, a, b) for k, a, b, _ in edges} - got


def test_levels(spark, limit):
    rng = random.Random(14)
    edges = [(k, min(a, b), max(a, b), c) for k, a, b, c in graphs(rng) if a != b] + [("a", 900, 903, 1.0), ("a", 903, 900, 1.0), ("a", 0, 900, 1.0)]
    sources = [("a", 0, 0.0), ("b", 3, 0.0)]
    rows = spark.createDataFrame(edges, EDGES)
    found = {(r.item_key, r.node_id): r.level for r in graph.topological_levels(None, rows, spark.createDataFrame(sources, SOURCES)).collect()}
    truth = {}
    for item, source, _ in sources:
        pairs = {(a, b) for k, a, b, _ in edges if k == item}
        inside = reach(pairs, source)
        pairs = {(a, b) for a, b in pairs if a in inside}
        left, level = set(inside), 0
        while free := {v for v in left if not any(b == v and a in left for a, b in pairs)}:
            truth |= {(item, v): level for v in free}
            left, level = left - free, level + 1
    assert found == truth and ("a", 900) not in found


def test_edge_costs(spark):
    nodes = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 5.0)], "item_key string, node_id bigint, value double")
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 9, 1.0)], EDGES)
    found = {r.b: r.cost for r in graph.edge_costs(edges, nodes, lambda e, a, b: e + F.abs(a - b)).collect()}
    assert found == {2: 4.0, 9: None}


def test_watershed_over_tiles(spark, monkeypatch):
    rng = random.Random(15)
    cells = [("a", y, x, float(rng.randrange(6))) for y in range(-5, 9) for x in range(-6, 9) if rng.random() < 0.95]
    places = {(y, x) for _, y, x, _ in cells}
    seeds = [("a", y, x, i) for i, (y, x) in enumerate(sorted(places)[::47])]
    raster = spark.createDataFrame(cells, "item_key string, y int, x int, v double")
    marks = spark.createDataFrame(seeds, "item_key string, y int, x int, label int")
    whole = {(r.y, r.x): r.label for r in ra.watershed(raster, marks).collect()}
    monkeypatch.setattr(graph, "LOCAL", 100)
    monkeypatch.setattr(ra, "TILE", 8)
    assert {(r.y, r.x): r.label for r in ra.watershed(raster, marks).collect()} == whole and len(whole) > 150


def test_runs_are_drawn_together(spark):
    rows, n = [], 0

    def chain(item, nodes):
        nonlocal n
        for a, b in zip(nodes, nodes[1:]):
            n += 1
            rows.append((item, n, *((a, b) if n % 3 else (b, a)), float(n % 5 + 1)))

    chain("a", [1, 10, 11, 12, 13, 14, 15, 16, 17, 2])
    chain("a", [2, 20, 3])
    chain("a", [2, 30, 31, 4])
    chain("a", [2, 5])
    chain("b", [1, 2, 3, 4, 1])  # a ring
    chain("b", [50, 51, 52, 50])
    chain("b", [51, 60])  # a ring with a stalk
    chain("c", [7, 7])  # a loop
    chain("c", [8, 9])
    chain("c", [8, 9])  # twice between the same nodes: a ring of two
    table = spark.createDataFrame([*rows, ("a", 900, None, 3, 1.0)], "item_key string, seg_id bigint, n0 bigint, n1 bigint, length double")
    members, runs = graph.run_graph(table)
    got = {}
    for r in members.orderBy("pos").collect():
        got.setdefault((r.item_key, r.run), []).append((r.pos, r.seg_id, r.forward))
    ends = {(k, s): (a, b) for k, s, a, b, _ in rows}
    size = {(k, s): w for k, s, _, _, w in rows}
    found = {(r.item_key, r.run): r for r in runs.collect()}
    assert set(found) == set(got) and sorted(s for v in got.values() for _, s, _ in v) == [r[1] for r in rows]
    for (item, run), part in got.items():
        r = found[item, run]
        assert [p for p, *_ in part] == list(range(1, len(part) + 1)) and run == min(s for _, s, _ in part)
        at = r.a
        for _, s, forward in part:
            a, b = ends[item, s] if forward else ends[item, s][::-1]
            assert a == at
            at = b
        assert at == r.b and r.segments == len(part) and r.length == pytest.approx(sum(size[item, s] for _, s, _ in part))
    edges = sorted((k[0], r.a, r.b) for k, r in found.items())
    assert [e for e in edges if e[0] == "a"] == [("a", 1, 2), ("a", 2, 3), ("a", 2, 4), ("a", 2, 5)]
    assert ("b", 51, 51) in edges and ("b", 51, 60) in edges and sum(e[0] == "b" for e in edges) == 3 and sum(e[0] == "c" for e in edges) == 2
    assert graph.run_graph(table.limit(0))[1].count() == 0
