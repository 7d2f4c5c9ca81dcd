"""Graph operators over all items at once: incidence, neighbours, components,
shortest paths, branchings, orders, directed acyclic graphs.

Edges are ``(item_key, a, b, cost)``.  Loops advance every item in the same round and
write each round to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.iterate import rounds, settle, ship
from rootweave.operators import local

ITEM = "item_key"


def incidence(segments: DataFrame) -> DataFrame:
    """``item_key, node_id, seg_id, side``: side 0 is a segment's first node."""
    ends = F.posexplode(F.array("n0", "n1")).alias("side", "node_id")
    return segments.select(ITEM, "seg_id", ends).where("node_id is not null").select(ITEM, "node_id", "seg_id", "side")


def segment_neighbours(segments: DataFrame) -> DataFrame:
    """``item_key, s1, side1, s2, side2, node_id``: segments that share a node; nodes
    that join seed segments only don't count."""
    inc = incidence(segments)
    if "seed" in segments.columns:
        seeds = segments.select(ITEM, "seg_id", (F.coalesce("seed", F.lit(0)) > 0).alias("is_seed"))
        plain = inc.join(seeds, [ITEM, "seg_id"]).groupBy(ITEM, "node_id").agg(F.bool_and("is_seed").alias("all_seed")).where("not all_seed")
        inc = inc.join(plain.select(ITEM, "node_id"), [ITEM, "node_id"], "left_semi")
    one = inc.select(ITEM, "node_id", F.col("seg_id").alias("s1"), F.col("side").alias("side1"))
    two = inc.select(ITEM, "node_id", F.col("seg_id").alias("s2"), F.col("side").alias("side2"))
    return one.join(two, [ITEM, "node_id"]).where("s1 <> s2").select(ITEM, "s1", "side1", "s2", "side2", "node_id")


def unique_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Edge pairs once, ``cost`` summed."""
    pair = edges if directed else edges.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    return pair.groupBy(ITEM, "a", "b").agg(F.sum("cost").alias("cost"))


def grid_edges(raster: DataFrame, footprint: list[tuple[int, int]], value: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``item_key, ya, xa, yb, xb, cost``: neighbours of a footprint's offsets; missing
    cells are masked.  ``value(va, vb, distance)`` is the edge's cost."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in footprint])).alias("o")
    moved = raster.select(ITEM, F.col("y").alias("ya"), F.col("x").alias("xa"), F.col("v").alias("va"), offsets)
    moved = moved.select("*", (F.col("ya") + F.col("o.dy")).alias("yb"), (F.col("xa") + F.col("o.dx")).alias("xb"))
    other = raster.select(ITEM, F.col("y").alias("yb"), F.col("x").alias("xb"), F.col("v").alias("vb"))
    far = F.hypot("o.dy", "o.dx")
    return moved.join(other, [ITEM, "yb", "xb"]).select(ITEM, "ya", "xa", "yb", "xb", value(F.col("va"), F.col("vb"), far).alias("cost"))


EDGE_VALUES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "mean": lambda a, b, d: (a + b) / 2,
    "diff": lambda a, b, d: b - a,
    "grad": lambda a, b, d: (b - a) / d,
    "min": lambda a, b, d: F.least(a, b),
    "max": lambda a, b, d: F.greatest(a, b),
    "distance": lambda a, b, d: d,
}


def components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``item_key, node_id, component``: the least node reachable, isolated nodes too.

    Large-star and small-star rounds until the edges stay the same: both are a
    minimum by node and a join, so no neighbourhood is gathered."""
    e = edges.where("a <> b").select(ITEM, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = settle(e), None
    for _ in rounds(most):
        both = e.union(e.select(ITEM, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(ITEM, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, [ITEM, "a"]).where("b > a and b <> m").select(ITEM, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(ITEM, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [ITEM, "a"]).where("b <> m").select(ITEM, F.col("b").alias("a"), F.col("m").alias("b"))
        e = settle(small.union(least.select(ITEM, "a", F.col("m").alias("b"))).distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64(ITEM, "a", "b") % F.lit(1 << 40))).first())
        if state == before:
            break
        before = state
    label = e.select(ITEM, F.col("a").alias("node_id"), F.col("b").alias("component"))
    return nodes.select(ITEM, "node_id").distinct().join(label, [ITEM, "node_id"], "left").select(ITEM, "node_id", F.coalesce("component", "node_id").alias("component"))


def reachable(segments: DataFrame) -> DataFrame:
    """``item_key, seg_id, reachable``: a seed segment is in the same component."""
    e = segment_neighbours(segments.drop("seed")).select(ITEM, F.col("s1").alias("a"), F.col("s2").alias("b"))
    label = components(segments.select(ITEM, F.col("seg_id").alias("node_id")), e)
    seeded = segments.select(ITEM, F.col("seg_id").alias("node_id"), (F.coalesce("seed", F.lit(0)) > 0).alias("s")).join(label, [ITEM, "node_id"])
    good = seeded.groupBy(ITEM, "component").agg(F.bool_or("s").alias("reachable"))
    return label.join(good, [ITEM, "component"]).select(ITEM, F.col("node_id").alias("seg_id"), "reachable")


#: Edges of a graph that one task may hold.
LOCAL = 500_000



def _same(value, n: int) -> pd.Series:
    """A column of one value, strings as plain objects."""
    return pd.Series([value] * n, dtype=object)


def edge_costs(edges: DataFrame, nodes: DataFrame, cost: Callable[[Column, Column, Column], Column], value: str = "value") -> DataFrame:
    """``edges`` with ``cost(edge, a, b)`` of their own cost and their ends' values; the
    value of a node that is not in ``nodes(item_key, node_id, value)`` is null."""
    at = lambda end: nodes.select(ITEM, F.col("node_id").alias(end), F.col(value).alias(f"__{end}"))
    rows = edges.join(at("a"), [ITEM, "a"], "left").join(at("b"), [ITEM, "b"], "left")
    return rows.withColumn("cost", cost(F.col("cost"), F.col("__a"), F.col("__b"))).drop("__a", "__b")


def whole(edges: DataFrame) -> DataFrame:
    """Edges with both ends, those of items beyond ``LOCAL`` marked ``large``."""
    sizes = edges.groupBy(ITEM).agg((F.count("*") > LOCAL).alias("large"))
    return edges.where("a is not null and b is not null").join(sizes, ITEM)


def blocks(edges: DataFrame, place: Callable[[Column], Column] | None = None) -> DataFrame | None:
    """``item_key, node_id, block``: blocks of about ``LOCAL`` edges for the nodes of items
    that have more; None where no item has.

    ``place`` gives a node's block, where the caller knows what lies together.  Otherwise
    whole components share a block, and components too large for one are cut into
    ranges of node ids."""
    sizes = settle(edges.groupBy(ITEM).agg(F.count("*").alias("n")).where(F.col("n") > LOCAL))
    if sizes.isEmpty():
        return None
    large = settle(edges.select(ITEM, "a", "b").join(sizes, ITEM))
    nodes = settle(large.select(ITEM, F.col("a").alias("node_id")).union(large.select(ITEM, F.col("b").alias("node_id"))).distinct())
    if place is not None:
        return settle(nodes.withColumn("block", place(F.col("node_id")).cast("string")))
    label = settle(components(nodes, large.select(ITEM, "a", "b")))
    of = label.select(ITEM, F.col("node_id").alias("a"), "component")
    counts = settle(large.join(of, [ITEM, "a"]).groupBy(ITEM, "component").agg(F.count("*").alias("m"), F.first("n").alias("n")))
    most = counts.agg(F.max("m")).first()[0]
    parts = -(-2 * most // LOCAL)
    rows = label.join(counts, [ITEM, "component"])
    dealt = F.concat(F.lit("c"), F.pmod(F.xxhash64("component"), F.ceil(2 * F.col("n") / LOCAL)).cast("string"))
    small = rows.where(F.col("m") <= LOCAL).select(ITEM, "node_id", dealt.alias("block"))
    giant = rows.where(F.col("m") > LOCAL)
    cuts = giant.groupBy(ITEM, "component").agg(F.percentile_approx("node_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("cuts"))
    number = F.size(F.filter("cuts", lambda c: c < F.col("node_id"))).cast("string")
    return settle(small.union(giant.join(cuts, [ITEM, "component"]).select(ITEM, "node_id", F.concat_ws(":", F.lit("r"), "component", number).alias("block"))))


LABEL = ("node_id", "dist", "hops", "parent", "source")


def shortest_paths(
    edges: DataFrame,
    sources: DataFrame,
    combine: str = "sum",
    start: DataFrame | None = None,
    place: Callable[[Column], Column] | None = None,
    on_round: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """``item_key, node_id, dist, parent, source``: cheapest path from any source.

    ``edges(item_key, a, b, cost)`` directed, ``sources(item_key, node_id, dist)``.  A path
    costs the ``sum`` of its edges or their ``max``.  ``start`` is an earlier result to go
    on from.  Of paths of equal cost the one of fewest steps counts, then the smaller
    parent, so the result is the same however the graph is dealt out.

    An item of up to ``LOCAL`` edges is solved in one task.  A larger one is dealt into
    ``blocks``: each is solved in a task from its sources and from what the edges that
    enter it offer, only these offers are written, and blocks whose offers changed are
    solved again.  So the rounds grow with the blocks a path crosses, not with its steps.
    ``on_round`` gets the round and the number of changed offers.

    Edges and sources with null ends, and sources without a distance, don't count; an
    empty table gives no row.  A cycle that costs less than nothing raises."""
    ship(edges.sparkSession)
    larger = {"sum": False, "max": True}[combine]
    kind, item = edges.schema["a"].dataType.simpleString(), edges.schema[ITEM].dataType.simpleString()
    first = sources.select(ITEM, "node_id", F.col("dist").cast("double").alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("parent"), F.col("node_id").alias("source"))
    if start is not None:
        first = first.union(start.select(ITEM, "node_id", "dist", F.lit(0).alias("hops"), "parent", "source"))
    first = first.select(ITEM, *[F.col(c).cast(kind).alias(c) if c in ("node_id", "parent", "source") else F.col(c) for c in LABEL]).where("node_id is not null and dist is not null and not isnan(dist)")
    edges = edges.select(ITEM, "a", "b", F.col("cost").cast("double").alias("cost")).where("a is not null and b is not null and cost is not null")
    schema = f"{ITEM} {item}, node_id {kind}, dist double, hops int, parent {kind}, source {kind}"
    where = blocks(edges, place)

    def solved(a, b, cost, begin: pd.DataFrame):
        parents = [None if pd.isna(p) else int(p) if isinstance(p, float) else p for p in begin["parent"].tolist()]
        return local.labels(a, b, cost, begin["node_id"].to_numpy(), begin["dist"].tolist(), begin["hops"].tolist(), parents, begin["source"].tolist(), larger)

    def table(key, found) -> pd.DataFrame:
        ids, dist, hops, parent, source = found
        number = "Int64" if kind in ("bigint", "int") else None
        return pd.DataFrame({ITEM: _same(key, len(ids)), "node_id": ids, "dist": dist, "hops": hops, "parent": pd.array(parent, number) if number else parent, "source": source})

    def item_labels(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return table(key[0], ([],) * 5)
        found = solved(left["a"].to_numpy(), left["b"].to_numpy(), left["cost"].to_numpy(), right)
        return table(key[0], found if found else ([right["node_id"].iloc[0]], [float("-inf")], [0], [None], [right["node_id"].iloc[0]]))

    if where is None:
        own = first.select(*[F.col(c).alias(c) for c in (ITEM, *LABEL)])
        found = settle(edges.groupBy(ITEM).cogroup(own.groupBy(ITEM)).applyInPandas(item_labels, schema))
        if on_round:
            on_round(1, 0)
        return _sound(found)

    at = lambda end, name: where.select(ITEM, F.col("node_id").alias(end), F.col("block").alias(name))
    rows = edges.join(at("a", "block"), [ITEM, "a"], "left").join(at("b", "other"), [ITEM, "b"], "left")
    rows = rows.select(ITEM, F.coalesce("block", F.lit("")).alias("block"), "a", "b", "cost", F.coalesce("other", F.lit("")).alias("other"))

    def pack(key, group: pd.DataFrame) -> pd.DataFrame:
        inner = group[group["other"] == key[1]]
        cut = group[group["other"] != key[1]]
        cells = {c: [inner[c].tolist()] for c in ("a", "b", "cost")} | {f"cut_{c}": [cut[c].tolist()] for c in ("a", "b", "cost", "other")}
        return pd.DataFrame({ITEM: _same(key[0], 1), "block": _same(key[1], 1), **cells})

    packed_schema = f"{ITEM} {item}, block string, a array<{kind}>, b array<{kind}>, cost array<double>, cut_a array<{kind}>, cut_b array<{kind}>, cut_cost array<double>, cut_other array<string>"
    packed = settle(rows.groupBy(ITEM, "block").applyInPandas(pack, packed_schema))
    begin = settle(first.join(where, [ITEM, "node_id"], "left").select(ITEM, F.coalesce("block", F.lit("")).alias("block"), *LABEL))
    offer = f"{ITEM} {item}, origin string, block string, node_id {kind}, dist double, hops int, parent {kind}, source {kind}"

    def block_labels(left: pd.DataFrame, right: pd.DataFrame):
        if not len(right):
            return None
        row = left.iloc[0] if len(left) else None
        part = (lambda c: np.asarray(row[c])) if row is not None else (lambda c: right["node_id"].to_numpy()[:0])
        found = solved(part("a"), part("b"), part("cost"), right)
        return found or ([right["node_id"].iloc[0]], [float("-inf")], [0], [None], [right["node_id"].iloc[0]])

    def offers_of(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, out = block_labels(left, right), []
        if found and len(left):
            known = {v: (d, h, s) for v, d, h, s in zip(found[0], found[1], found[2], found[4])}
            row = left.iloc[0]
            for a, b, c, other in zip(row["cut_a"], row["cut_b"], row["cut_cost"], row["cut_other"]):
                if a in known:
                    d, h, s = known[a]
                    out.append((key[0], key[1], other, b, (max(d, c) if larger else d + c), h + 1, a, s))
        return pd.DataFrame(out, columns=[ITEM, "origin", "block", *LABEL], dtype=object)

    def block_table(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = block_labels(left, right)
        return table(key[0], found or ([],) * 5)

    key = [ITEM, "block"]
    offers, active = None, settle(begin.select(*key).distinct())
    nodes = None
    for n in rounds():
        given = begin if offers is None else begin.unionByName(offers.drop("origin"))
        given = given.join(active, key, "left_semi")
        given = given.select(*[F.col(c).alias(c) for c in given.columns])
        new = settle(packed.join(active, key, "left_semi").groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(offers_of, offer))
        if offers is None:
            changed, offers = new, new
        else:
            changed = new.join(offers, list(new.columns), "left_anti")
            done = active.withColumnRenamed("block", "origin")
            offers = settle(offers.join(done, [ITEM, "origin"], "left_anti").unionByName(new))
        active = settle(changed.select(*key).distinct())
        if on_round:
            on_round(n + 1, changed.count())
        if active.isEmpty():
            break
        if n % 64 == 63:
            nodes = nodes or where.groupBy(ITEM).count().agg(F.max("count")).first()[0]
            if n > nodes:
                raise RuntimeError(f"paths still improve after {n + 1} rounds: a cycle of negative cost")
    given = begin.unionByName(offers.drop("origin"))
    given = given.select(*[F.col(c).alias(c) for c in given.columns])
    return _sound(settle(packed.groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(block_table, schema)))


def _sound(found: DataFrame) -> DataFrame:
    if not found.where(F.col("dist") == float("-inf")).isEmpty():
        raise RuntimeError("a cycle of negative cost")
    return found.drop("hops")


def longest_way(parents: DataFrame) -> int:
    """The number of nodes of the largest item: no way to a root is longer."""
    return parents.groupBy(ITEM).count().agg(F.max("count")).first()[0] or 0


def roots(parents: DataFrame) -> DataFrame:
    """``item_key, node_id, root, steps`` of ``parents(item_key, node_id, parent)`` by pointer
    doubling; one row a node in every round.  A parent that is no node is a root.
    Parents that make a cycle raise."""
    bound, size = longest_way(parents), 1
    state = parents.select(ITEM, "node_id", F.coalesce("parent", "node_id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps"))
    state = settle(state)
    while True:
        on = state.where("steps > 0").select(ITEM, F.col("node_id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        moved = state.join(on, [ITEM, "root"], "left")
        state = settle(moved.select(ITEM, "node_id", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("on")))
        if state.where("on").isEmpty():
            return state.drop("on")
        if size > bound:
            raise ValueError("parents make a cycle")
        size *= 2
        state = state.drop("on")


def ancestors(parents: DataFrame) -> DataFrame:
    """``item_key, node_id, ancestor, steps`` of ``parents(item_key, node_id, parent)`` by
    pointer doubling: every node's whole way to its root, itself at step 0, so there are
    as many rows as nodes times steps (``roots`` gives the ends alone).  Parents that
    make a cycle raise."""
    bound = longest_way(parents)
    hop = settle(parents.where("parent is not null").select(ITEM, "node_id", F.col("parent").alias("to")))
    known = parents.select(ITEM, "node_id", F.col("node_id").alias("ancestor"), F.lit(0).alias("steps"))
    size = 1
    for _ in rounds():
        if bound and size > 2 * bound:
            raise ValueError("parents make a cycle")
        on = hop.select(ITEM, F.col("node_id").alias("ancestor"), "to")
        more = known.join(on, [ITEM, "ancestor"]).select(ITEM, "node_id", F.col("to").alias("ancestor"), (F.col("steps") + size).alias("steps"))
        known = settle(known.union(more))
        hop = settle(hop.join(hop.select(ITEM, F.col("node_id").alias("to"), F.col("to").alias("next")), [ITEM, "to"]).select(ITEM, "node_id", F.col("next").alias("to")))
        size *= 2
        if hop.isEmpty():
            break
    return known


def paths_to(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """``item_key, path_id, pos, node_id``: from the root to every target node."""
    way = ancestors(parents).join(targets.select(ITEM, "node_id"), [ITEM, "node_id"], "left_semi")
    order = Window.partitionBy(ITEM, "node_id").orderBy(F.desc("steps"))
    return way.select(ITEM, F.col("node_id").alias("path_id"), F.row_number().over(order).alias("pos"), F.col("ancestor").alias("node_id"))


def parent_edges(parents: DataFrame, way: str = "both") -> DataFrame:
    """Edges of a tree given by parents: ``up``, ``down`` or ``both``."""
    up = parents.where("parent is not null").select(ITEM, F.col("node_id").alias("a"), F.col("parent").alias("b"))
    down = up.select(ITEM, F.col("b").alias("a"), F.col("a").alias("b"))
    return {"up": up, "down": down}.get(way, up.union(down))


def orient(segments: DataFrame, turned: DataFrame) -> DataFrame:
    """``segments`` with ends swapped where ``turned(item_key, seg_id, flip)`` says so."""
    rows = segments.join(turned, [ITEM, "seg_id"], "left").withColumn("flip", F.coalesce("flip", F.lit(False)))
    swapped = {"n0": F.when(F.col("flip"), F.col("n1")).otherwise(F.col("n0")), "n1": F.when(F.col("flip"), F.col("n0")).otherwise(F.col("n1"))}
    return rows.withColumns(swapped).drop("flip")


def digraph(segments: DataFrame) -> DataFrame:
    """``item_key, a, b``: segment ``b`` starts where ``a`` ends."""
    one = segments.select(ITEM, F.col("seg_id").alias("a"), F.col("n1").alias("node_id"))
    two = segments.select(ITEM, F.col("seg_id").alias("b"), F.col("n0").alias("node_id"))
    return one.join(two, [ITEM, "node_id"]).where("a <> b").select(ITEM, "a", "b")


def segment_direction(segments: DataFrame, edges: DataFrame, fixed: DataFrame, most: int | None = None) -> DataFrame:
    """``item_key, seg_id, flip``: directions that follow the cheapest connections.

    ``edges(item_key, s1, side1, s2, side2, cost)`` join ends of segments; two joined
    segments follow one another when they meet with opposite sides.  Groups merge along
    edges in increasing cost, one of them turned if need be; ``fixed(item_key, seg_id,
    flip)`` may not turn, and an edge between two fixed groups that disagree is dropped.
    In a round every edge that is the cheapest of both its groups is taken, which equals
    the sequential result for a strict order; ties go by ids."""
    state = segments.select(ITEM, "seg_id").join(fixed, [ITEM, "seg_id"], "left")
    state = settle(state.select(ITEM, "seg_id", F.col("seg_id").alias("grp"), F.coalesce("flip", F.lit(False)).alias("flip"), F.col("flip").isNotNull().alias("fast")))
    e = edges.where("s1 < s2").withColumn("differ", F.col("side1") == F.col("side2"))
    live = settle(e.select(ITEM, "s1", "s2", "differ", "cost"))
    for _ in rounds(most):
        side = lambda k: state.select(ITEM, F.col("seg_id").alias(f"s{k}"), F.col("grp").alias(f"g{k}"), F.col("flip").alias(f"f{k}"))  # noqa: E731, B023
        rows = live.join(side(1), [ITEM, "s1"]).join(side(2), [ITEM, "s2"]).where("g1 <> g2")
        # whether the second group must turn, given how its members lie now
        rows = rows.withColumn("turn", (F.col("f1") != F.col("f2")) != F.col("differ"))
        groups = state.groupBy(ITEM, "grp").agg(F.bool_or("fast").alias("fast"))
        mark = lambda k: groups.select(ITEM, F.col("grp").alias(f"g{k}"), F.col("fast").alias(f"h{k}"))  # noqa: E731, B023
        rows = settle(rows.join(mark(1), [ITEM, "g1"]).join(mark(2), [ITEM, "g2"]).where("not (h1 and h2 and turn)"))
        if rows.isEmpty():
            break
        rank = F.struct("cost", "s1", "s2")
        ends = rows.select(ITEM, F.col("g1").alias("g"), rank.alias("r")).union(rows.select(ITEM, F.col("g2").alias("g"), rank.alias("r")))
        best = ends.groupBy(ITEM, "g").agg(F.min("r").alias("r"))
        bests = lambda k: best.select(ITEM, F.col("g").alias(f"g{k}"), F.col("r").alias(f"r{k}"))  # noqa: E731, B023
        taken = rows.join(bests(1), [ITEM, "g1"]).join(bests(2), [ITEM, "g2"]).where((rank == F.col("r1")) & (rank == F.col("r2")))
        # the fixed group, else the smaller, keeps its directions and its name
        keep_first = F.when(F.col("h1") != F.col("h2"), F.col("h1")).otherwise(F.col("g1") < F.col("g2"))
        moves = settle(taken.select(ITEM, F.when(keep_first, F.col("g2")).otherwise(F.col("g1")).alias("grp"), F.when(keep_first, F.col("g1")).otherwise(F.col("g2")).alias("into"), "turn"))
        moved = state.join(moves, [ITEM, "grp"], "left")
        state = settle(moved.select(ITEM, "seg_id", F.coalesce("into", "grp").alias("grp"), (F.col("flip") != F.coalesce("turn", F.lit(False))).alias("flip"), "fast"))
        live = settle(rows.select(*live.columns))
    return state.select(ITEM, "seg_id", "flip")


def strong_components(edges: DataFrame) -> DataFrame:
    """``item_key, node_id, strong``: the least node of each node's strong component, for
    every node of an edge.

    Items, and components of larger items, of up to ``LOCAL`` edges are solved in a task.
    For the rest each round gives every node the least node that reaches it; who reaches
    that one back makes its component, which then goes, with nodes that nothing enters
    or leaves."""
    ship(edges.sparkSession)
    edges = edges.select(ITEM, "a", "b").where("a is not null and b is not null").distinct()
    where = blocks(edges)
    kind, item = edges.schema["a"].dataType.simpleString(), edges.schema[ITEM].dataType.simpleString()

    def solve(key, group: pd.DataFrame) -> pd.DataFrame:
        ids, label = local.strong_components(group["a"].to_numpy(), group["b"].to_numpy())
        return pd.DataFrame({ITEM: _same(key[0], len(ids)), "node_id": ids, "strong": label})

    schema = f"{ITEM} {item}, node_id {kind}, strong {kind}"
    if where is None:
        return edges.groupBy(ITEM).applyInPandas(solve, schema)
    rows = settle(edges.join(where.withColumnRenamed("node_id", "a"), [ITEM, "a"], "left").withColumn("block", F.coalesce("block", F.lit(""))))
    found = rows.where(~F.col("block").startswith("r:")).groupBy(ITEM, "block").applyInPandas(solve, schema)
    live, parts = settle(rows.where(F.col("block").startswith("r:")).select(ITEM, "a", "b")), []
    ends = lambda e: e.select(ITEM, F.col("a").alias("node_id")).union(e.select(ITEM, F.col("b").alias("node_id"))).distinct()
    left = settle(ends(live))
    while not left.isEmpty():
        # nodes that nothing enters or leaves are components of their own
        while True:
            inner = live.where("a <> b")
            through = inner.select(ITEM, F.col("b").alias("node_id")).distinct().intersect(inner.select(ITEM, F.col("a").alias("node_id")).distinct())
            alone = settle(left.join(through, [ITEM, "node_id"], "left_anti"))
            if alone.isEmpty():
                break
            parts.append(alone.withColumn("strong", F.col("node_id")))
            left = settle(left.join(alone, [ITEM, "node_id"], "left_anti"))
            live = settle(_inside(live, left))
        if left.isEmpty():
            break
        free = live.withColumn("cost", F.lit(float("-inf")))
        colour = shortest_paths(free, left.withColumn("dist", F.col("node_id").cast("double")), combine="max").select(ITEM, "node_id", F.col("source").alias("strong"))
        same = live.join(colour.select(ITEM, F.col("node_id").alias("a"), F.col("strong").alias("ca")), [ITEM, "a"]).join(colour.select(ITEM, F.col("node_id").alias("b"), F.col("strong").alias("cb")), [ITEM, "b"]).where("ca = cb")
        turned = same.select(ITEM, F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1.0).alias("cost"))
        back = shortest_paths(turned, colour.where("node_id = strong").select(ITEM, "node_id", F.lit(0.0).alias("dist"))).select(ITEM, "node_id", F.col("source").alias("strong"))
        parts.append(back)
        left = settle(left.join(back, [ITEM, "node_id"], "left_anti"))
        live = settle(_inside(live, left))
    return reduce(DataFrame.union, parts, found)


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for c in ("a", "b"):
        edges = edges.join(nodes.withColumnRenamed("node_id", c), [ITEM, c], "left_semi")
    return edges


def to_dag(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)`` edges: all that lead to a node later in the order (distance
    from the sources, id) stay.  An edge back stays only if its start is not reachable
    from its end over kept edges; they are tried in order of (distance, start, distance,
    end), so the result is acyclic and no removed edge could be taken back.  Edges of
    nodes that no source reaches are removed, and so are loops.

    An edge between two strong components closes no cycle; only those inside one are
    tried, all components at once, each in a task.  A strong component of more than
    ``LOCAL`` edges goes by a round for each edge back."""
    ship(edges.sparkSession)
    dist = shortest_paths(edges, sources).select(ITEM, "node_id", "dist")
    end = lambda c: dist.select(ITEM, F.col("node_id").alias(c), F.col("dist").alias(f"d{c}"))
    rows = settle(edges.join(end("a"), [ITEM, "a"]).join(end("b"), [ITEM, "b"]).where("a <> b"))
    strong = settle(strong_components(rows))
    label = lambda c: strong.select(ITEM, F.col("node_id").alias(c), F.col("strong").alias(f"s{c}"))
    pairs = settle(rows.select(ITEM, "a", "b", "da", "db").distinct().join(label("a"), [ITEM, "a"]).join(label("b"), [ITEM, "b"]))
    inner = pairs.where("sa = sb").drop("sb").withColumnRenamed("sa", "strong")
    sizes = inner.groupBy(ITEM, "strong").agg(F.count("*").alias("n"))
    inner = settle(inner.join(sizes, [ITEM, "strong"]))
    kind, item = rows.schema["a"].dataType.simpleString(), rows.schema[ITEM].dataType.simpleString()

    def tried(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["da", "a", "db", "b"], kind="stable")
        keep = local.acyclic(group["a"].to_numpy(), group["b"].to_numpy(), group["da"].tolist(), group["db"].tolist())
        return group.loc[keep, [ITEM, "a", "b"]]

    taken = inner.where(F.col("n") <= LOCAL).groupBy(ITEM, "strong").applyInPandas(tried, f"{ITEM} {item}, a {kind}, b {kind}")
    kept = settle(pairs.where("sa <> sb").select(ITEM, "a", "b").union(taken))
    giant = inner.where(F.col("n") > LOCAL)
    later = (F.col("db") > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b") > F.col("a")))
    waiting = settle(giant.where(~later))
    inside = giant.where(later).select(ITEM, "a", "b")
    while not waiting.isEmpty():
        first = settle(waiting.groupBy(ITEM, "strong").agg(F.min(F.struct("da", "a", "db", "b")).alias("x")).select(ITEM, "strong", "x.a", "x.b"))
        found = shortest_paths(inside.withColumn("cost", F.lit(1.0)), first.select(ITEM, F.col("b").alias("node_id"), F.lit(0.0).alias("dist")))
        closes = first.join(found.select(ITEM, F.col("node_id").alias("a")), [ITEM, "a"], "left_semi")
        inside = settle(inside.union(first.join(closes, [ITEM, "a", "b"], "left_anti").select(ITEM, "a", "b")))
        waiting = settle(waiting.join(first, [ITEM, "a", "b"], "left_anti"))
    kept = kept.union(inside)
    removed = edges.join(kept, [ITEM, "a", "b"], "left_anti")
    return rows.drop("da", "db").join(kept, [ITEM, "a", "b"], "left_semi").select(*edges.columns), removed


def minimum_branching(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``item_key, node_id, parent``: every node's cheapest incoming edge; parents of
    ``known(item_key, node_id, parent)`` come first."""
    best = edges.groupBy(ITEM, F.col("b").alias("node_id")).agg(F.min(F.struct("cost", "a")).alias("x"))
    best = best.select(ITEM, "node_id", F.col("x.a").alias("parent"))
    if known is None:
        return best
    joined = best.join(known.select(ITEM, "node_id", F.col("parent").alias("k")), [ITEM, "node_id"], "full")
    return joined.select(ITEM, "node_id", F.coalesce("k", "parent").alias("parent"))


def topological_levels(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``item_key, node_id, level``: Kahn's order by levels, from the sources; what they
    don't reach, or what lies behind a cycle, is left out.  Items of up to ``LOCAL`` edges
    go in one task each, of larger ones all free nodes a round; a round writes its own
    level and the edges that are left."""
    ship(edges.sparkSession)
    edges = edges.select(ITEM, "a", "b").where("a is not null and b is not null").distinct()
    marked = settle(whole(edges))
    kind, item = edges.schema["a"].dataType.simpleString(), edges.schema[ITEM].dataType.simpleString()

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, level = local.levels(left["a"].to_numpy(), left["b"].to_numpy(), right["node_id"].to_numpy()) if len(right) else ([], [])
        return pd.DataFrame({ITEM: _same(key[0], len(ids)), "node_id": ids, "level": level})

    begin = sources.select(ITEM, F.col("node_id").cast(kind).alias("node_id")).where("node_id is not null").distinct()
    big = marked.where("large").select(ITEM).distinct()
    few = begin.join(big, ITEM, "left_anti")
    few = few.select(*[F.col(c).alias(c) for c in few.columns])
    parts = [marked.where("not large").groupBy(ITEM).cogroup(few.groupBy(ITEM)).applyInPandas(solve, f"{ITEM} {item}, node_id {kind}, level int")]
    live = settle(marked.where("large").select(ITEM, "a", "b"))
    if not live.isEmpty():
        inside = shortest_paths(live.withColumn("cost", F.lit(1.0)), begin.join(big, ITEM, "left_semi").withColumn("dist", F.lit(0.0))).select(ITEM, "node_id")
        left = settle(inside)
        live = settle(live.join(inside.withColumnRenamed("node_id", "a"), [ITEM, "a"], "left_semi"))
        for level in rounds():
            free = settle(left.join(live.select(ITEM, F.col("b").alias("node_id")), [ITEM, "node_id"], "left_anti"))
            if free.isEmpty():
                break
            parts.append(free.withColumn("level", F.lit(level)))
            left = settle(left.join(free, [ITEM, "node_id"], "left_anti"))
            live = settle(live.join(free.withColumnRenamed("node_id", "a"), [ITEM, "a"], "left_anti"))
            if len(parts) > 32:
                parts = [parts[0], settle(reduce(DataFrame.union, parts[1:]))]
    return reduce(DataFrame.union, parts)


def linear_runs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``item_key, node_id, run``: nodes of degree 2 or less joined to such neighbours."""
    both = edges.select(ITEM, "a", "b").union(edges.select(ITEM, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy(ITEM, F.col("a").alias("node_id")).agg(F.count("*").alias("k"))
    thin = nodes.select(ITEM, "node_id").join(degree, [ITEM, "node_id"], "left").where("coalesce(k, 0) <= 2").select(ITEM, "node_id")
    inner = both.join(thin.withColumnRenamed("node_id", "a"), [ITEM, "a"], "left_semi").join(thin.withColumnRenamed("node_id", "b"), [ITEM, "b"], "left_semi")
    return components(thin, inner).withColumnRenamed("component", "run")


def crossing_nodes(edges: DataFrame) -> DataFrame:
    both = edges.select(ITEM, "a", "b").union(edges.select(ITEM, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.groupBy(ITEM, F.col("a").alias("node_id")).agg(F.count("*").alias("degree")).where("degree > 2")


def branch_segments(edges: DataFrame, axe: DataFrame) -> DataFrame:
    """``item_key, seg_id, on``: segments that touch an axis ``(item_key, seg_id, pos)`` from
    outside, with the first axis segment they touch; edges ``(item_key, a, b)``."""
    both = edges.select(ITEM, "a", "b").union(edges.select(ITEM, F.col("b").alias("a"), F.col("a").alias("b")))
    touching = both.join(axe.select(ITEM, F.col("seg_id").alias("a"), "pos"), [ITEM, "a"]).join(axe.select(ITEM, F.col("seg_id").alias("b")), [ITEM, "b"], "left_anti")
    return touching.groupBy(ITEM, F.col("b").alias("seg_id")).agg(F.min_by("a", F.struct("pos", "a")).alias("on"))


def markov_clusters(edges: DataFrame, inflation: float = 2.0, prune: float = 1e-4, most: int = 200) -> DataFrame:
    """``item_key, node_id, cluster`` of a weighted graph by flow: expand (a sparse square
    of the column-stochastic matrix) and inflate until it stays the same; flow that is
    not settled after ``most`` rounds raises."""
    def stochastic(m):
        total = m.groupBy(ITEM, "b").agg(F.sum("w").alias("t"))
        return m.join(total, [ITEM, "b"]).select(ITEM, "a", "b", (F.col("w") / F.col("t")).alias("w"))

    both = edges.select(ITEM, "a", "b", F.col("cost").alias("w")).union(edges.select(ITEM, F.col("b").alias("a"), F.col("a").alias("b"), F.col("cost").alias("w")))
    nodes = both.select(ITEM, F.col("a").alias("node_id")).distinct()
    loops = both.groupBy(ITEM, "a").agg(F.max("w").alias("w")).select(ITEM, "a", F.col("a").alias("b"), "w")
    m = settle(stochastic(both.where("a <> b").union(loops).groupBy(ITEM, "a", "b").agg(F.sum("w").alias("w"))))
    for _ in rounds(most):
        right = m.select(ITEM, F.col("a").alias("k"), "b", F.col("w").alias("wr"))
        square = m.withColumnRenamed("b", "k").join(right, [ITEM, "k"]).groupBy(ITEM, "a", "b").agg(F.sum(F.col("w") * F.col("wr")).alias("w"))
        new = settle(stochastic(stochastic(square.withColumn("w", F.pow("w", F.lit(inflation)))).where(F.col("w") > prune)))
        old = m.withColumnRenamed("w", "w0")
        gap = new.join(old, [ITEM, "a", "b"], "full").agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0))))).first()[0]
        m = new
        if gap is None or gap < 1e-6:
            break
    return components(nodes, m.where(F.col("w") > 10 * prune)).withColumnRenamed("component", "cluster")


def run_graph(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with its unbranched runs drawn together.

    ``segments(item_key, seg_id, n0, n1, length)``.  Returns ``members(item_key, run, pos,
    seg_id, forward)``, the segments of every run in order, ``forward`` where they lead from
    ``n0`` to ``n1``, and ``runs(item_key, run, a, b, segments, length)``, edges between the nodes
    where runs end (those of any degree but 2).  A run is named by its least segment and
    goes from its end with the smaller node, of equal ones with the smaller segment; a
    closed ring starts at its least segment, forward, and ends where it starts.

    List ranking by pointer doubling over both directions of every segment: as many
    rounds as the logarithm of the longest run.  Segments with a null end don't count,
    loops at one node are runs of their own, an empty table gives no row."""
    own = segments.where("n0 is not null and n1 is not null").select(ITEM, "seg_id", "n0", "n1", F.col("length").cast("double").alias("length"))
    # an arc is a segment with a direction: 2 * seg_id forward, 2 * seg_id + 1 back
    way = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("n0").alias("s"), F.col("n1").alias("e")), F.struct(F.lit(1).alias("turn"), F.col("n1").alias("s"), F.col("n0").alias("e")))).alias("w")
    arcs = own.select(ITEM, "seg_id", "length", way).select(ITEM, (F.col("seg_id") * 2 + F.col("w.turn")).cast("bigint").alias("arc"), "seg_id", "length", "w.s", "w.e")
    arcs = settle(arcs)
    inner = arcs.groupBy(ITEM, F.col("s").alias("node_id")).agg(F.count("*").alias("k"), F.count_distinct("seg_id").alias("m")).where("k = 2 and m = 2").select(ITEM, "node_id")
    inner = settle(inner)
    into = arcs.select(ITEM, "arc", "seg_id", F.col("e").alias("node_id")).join(inner, [ITEM, "node_id"])
    out = arcs.select(ITEM, F.col("arc").alias("next"), F.col("seg_id").alias("other"), F.col("s").alias("node_id"))
    follow = settle(into.join(out, [ITEM, "node_id"]).where("seg_id <> other").select(ITEM, "arc", "next"))
    # closed rings never end: they are cut before their least segment
    label = settle(components(own.select(ITEM, F.col("seg_id").alias("node_id")), follow.select(ITEM, F.expr("arc div 2").alias("a"), F.expr("next div 2").alias("b"))))
    open_runs = arcs.join(inner.withColumnRenamed("node_id", "e"), [ITEM, "e"], "left_anti").join(label.withColumnRenamed("node_id", "seg_id"), [ITEM, "seg_id"]).select(ITEM, "component").distinct()
    rings = settle(label.join(open_runs, [ITEM, "component"], "left_anti").select(ITEM, "component").distinct())
    cuts = rings.select(ITEM, F.explode(F.array(F.col("component") * 2, F.col("component") * 2 + 1)).alias("next"))
    follow = follow.join(cuts, [ITEM, "next"], "left_anti")
    state = arcs.select(ITEM, "arc").join(follow, [ITEM, "arc"], "left")
    state = settle(state.select(ITEM, "arc", F.coalesce("next", "arc").alias("last"), F.col("next").isNotNull().cast("int").alias("steps")))
    while True:
        on = state.where("steps > 0").select(ITEM, F.col("arc").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        moved = state.join(on, [ITEM, "last"], "left")
        state = settle(moved.select(ITEM, "arc", F.coalesce("further", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("on")))
        if state.where("on").isEmpty():
            break
        state = state.drop("on")
    ranked = state.drop("on").join(arcs, [ITEM, "arc"]).join(label.withColumnRenamed("node_id", "seg_id"), [ITEM, "seg_id"])
    # of the two directions the one that starts at the smaller node; the arcs of one direction share their last
    end = ranked.groupBy(ITEM, "component", "last").agg(F.max_by(F.struct("s", "arc"), "steps").alias("begin"), F.min_by("e", "steps").alias("b"), F.count("*").alias("segments"), F.sum("length").alias("length"))
    ring = rings.withColumn("ring", F.lit(True))
    rank = F.struct(F.when(F.col("ring"), F.lit(0)).otherwise(F.col("begin.s")), "begin.arc", "last")
    chosen = end.join(ring, [ITEM, "component"], "left").groupBy(ITEM, "component").agg(F.min_by(F.struct("last", F.col("begin.s").alias("a"), "b", "segments", "length"), rank).alias("x")).select(ITEM, "component", "x.*")
    chosen = settle(chosen)
    members = ranked.join(chosen.select(ITEM, "component", "last", "segments"), [ITEM, "component", "last"])
    members = members.select(ITEM, F.col("component").alias("run"), (F.col("segments") - F.col("steps")).cast("int").alias("pos"), "seg_id", (F.col("arc") % 2 == 0).alias("forward"))
    return members, chosen.select(ITEM, F.col("component").alias("run"), "a", "b", "segments", "length")
