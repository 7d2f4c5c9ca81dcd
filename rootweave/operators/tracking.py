"""Root systems followed over time-lapse sequences: projected on the next frame's graph
order by order, grown to the next branching, estimated again with what is known.

A frame's graph is ``nodes(item_key, node_id, x, y)`` and ``segments(item_key, seg_id, n0, n1,
seed)``; a tree is ``axes(item_key, axe_id, plant, ord, parent)``, ``axe_segments(item_key,
axe_id, pos, seg_id)`` and ``tree(item_key, seg_id, x0, y0, x1, y1)``, segments in the direction
of growth.  All items go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.functions import geometry as g
from rootweave.iterate import settle
from rootweave.operators import compare, graph, measure, paths as pt, trees

ITEM = "item_key"
AXE = [ITEM, "axe_id"]


def project_tree(axes: DataFrame, axe_segments: DataFrame, tree: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``item_key, axe_id, pos, node_id``: a tree's projection, axes of lower order first.  An
    axis starts at a node of its plant's seed ``seeds(item_key, plant, node_id)`` or on the
    projection of its parent; ``edges(item_key, a, b, length)`` go both ways.  Axes without an
    order or without segments have no projection."""
    out = None
    # the orders of root systems are a handful of small numbers
    for row in axes.where("ord is not null").select("ord").distinct().orderBy("ord").collect():
        level = axes.where(F.col("ord") == row["ord"])
        starts = level.join(seeds, [ITEM, "plant"]).select(*AXE, "node_id")
        if out is not None:
            on = out.select(ITEM, F.col("axe_id").alias("parent"), "node_id")
            starts = starts.union(level.join(on, [ITEM, "parent"]).select(*AXE, "node_id"))
        found = trees.project_axes(axe_segments.join(level.select(*AXE), AXE, "left_semi"), tree, nodes, edges, settle(starts.distinct()))
        out = settle(found if out is None else out.union(found))
    return out


def arcs(segments: DataFrame) -> DataFrame:
    """``item_key, arc, s, e, length``: every segment in both directions, ``2 * seg_id`` from
    ``n0`` to ``n1``, ``2 * seg_id + 1`` back."""
    way = lambda turn, s, e: F.struct((F.col("seg_id") * 2 + turn).cast("bigint").alias("arc"), F.col(s).alias("s"), F.col(e).alias("e"))
    return segments.select(ITEM, "length", F.explode(F.array(way(0, "n0", "n1"), way(1, "n1", "n0"))).alias("w")).select(ITEM, "w.*", "length")


def grow(projection: DataFrame, segments: DataFrame) -> DataFrame:
    """``item_key, axe_id, pos, seg_id, flip``: segments of projected axes ``(item_key, axe_id, pos,
    node_id)`` and, after them, those up to the end of the unbranched run that the last of
    them stands on; ``flip`` where an axis goes from ``n1`` to ``n0``.  Of several segments
    between two nodes the shortest counts; axes of one node have no row."""
    every = settle(arcs(segments))
    step = projection.withColumn("s", F.lag("node_id").over(Window.partitionBy(*AXE).orderBy("pos"))).where("s is not null").withColumnRenamed("node_id", "e")
    own = step.join(every, [ITEM, "s", "e"]).groupBy(*AXE, "pos").agg(F.min_by("arc", F.struct("length", "arc")).alias("seg_id"))
    own = settle(own.select(*AXE, (F.col("pos") - 1).cast("int").alias("pos"), "seg_id"))
    members, runs = graph.run_graph(segments)
    rows = members.join(runs.select(ITEM, "run", "segments"), [ITEM, "run"])
    turn = F.col("forward").cast("int")
    there = F.struct((F.col("run") * 2).alias("run"), F.col("pos").cast("bigint").alias("run_pos"), (F.col("seg_id") * 2 + 1 - turn).alias("seg_id"))
    back = F.struct((F.col("run") * 2 + 1).alias("run"), (F.col("segments") - F.col("pos") + 1).cast("bigint").alias("run_pos"), (F.col("seg_id") * 2 + turn).alias("seg_id"))
    both = settle(rows.select(ITEM, F.explode(F.array(there, back)).alias("w")).select(ITEM, "w.*"))
    return pt.grow_axes(own, both).select(*AXE, "pos", F.expr("seg_id div 2").alias("seg_id"), (F.col("seg_id") % 2 == 1).alias("flip"))


def known_tree(axes: DataFrame, way: DataFrame, segments: DataFrame, prune: float = 15.0) -> dict[str, DataFrame]:
    """The tree of a graph of which axes are known: ``way(item_key, axe_id, pos, seg_id, flip)``.

    Their segments keep their directions (where axes differ, those of the lower order
    count) and their parents, so far as the acyclic graph has these edges; the rest is
    estimated as ``trees.simple_tree`` does, with tips shorter than ``prune`` left out.
    ``segments`` have ``length`` and ``direction``.  Returns ``axes`` and ``axe_segments`` with
    the ids of known axes kept, and ``turned``, the segments in the direction of growth."""
    ranked = settle(way.join(axes.select(*AXE, "plant", "ord"), AXE))
    rank = F.struct("ord", "axe_id", "pos")
    fixed = settle(ranked.groupBy(ITEM, "seg_id").agg(F.min_by("flip", rank).alias("flip")))
    edges, flips = trees.graph_to_dag(segments, fixed)
    edges = settle(edges)
    before = F.lag("seg_id").over(Window.partitionBy(*AXE).orderBy("pos"))
    steps = ranked.withColumn("a", before).where("a is not null").withColumnRenamed("seg_id", "b").join(edges.select(ITEM, "a", "b"), [ITEM, "a", "b"], "left_semi")
    given = settle(steps.groupBy(ITEM, F.col("b").alias("node_id")).agg(F.min_by("a", rank).alias("parent")))
    sources = segments.where("seed > 0").select(ITEM, F.col("seg_id").alias("node_id"))
    inside = settle(trees.cheapest_tree(edges, sources, "cost").select(ITEM, "node_id"))
    held = inside.select(ITEM, F.col("node_id").alias("a"))
    straight = graph.minimum_branching(edges.join(held, [ITEM, "a"], "left_semi"), given.join(held.withColumnRenamed("a", "parent"), [ITEM, "parent"], "left_semi"))
    parents = inside.join(straight, [ITEM, "node_id"], "left").join(sources.withColumn("top", F.lit(True)), [ITEM, "node_id"], "left")
    parents = settle(parents.select(ITEM, "node_id", F.when(F.col("top").isNull(), F.col("parent")).alias("parent")))
    last = settle(ranked.groupBy(*AXE, "plant", "ord").agg(F.max_by("seg_id", "pos").alias("seg_id")))
    tree = trees.simple_tree(parents, segments, edges, prune, known=last)
    found = settle(tree["axes"])
    name = found.select(ITEM, "axe_id", F.col("ext_id").cast("bigint").alias("ext_id"))
    up = name.select(ITEM, F.col("axe_id").alias("parent"), F.col("ext_id").alias("up"))
    named = found.join(up, [ITEM, "parent"], "left").select(ITEM, F.col("ext_id").cast("bigint").alias("axe_id"), "plant", "ord", F.col("up").alias("parent"), "parent_segment")
    rows = tree["axe_segments"].join(name, AXE).select(ITEM, F.col("ext_id").alias("axe_id"), "pos", "seg_id")
    return {"axes": settle(named), "axe_segments": settle(rows), "turned": settle(graph.orient(segments, flips))}


def follow(frames: list[int], start: dict[str, DataFrame], nodes: DataFrame, segments: DataFrame, transforms: DataFrame, prune: float = 15.0) -> DataFrame:
    """``item_key, frame, axe_id, plant, ord, parent, pos, seg_id``: root systems over ``frames``.

    ``start`` holds the first frame's ``axes``, ``axe_segments``, ``tree`` and ``seeds(item_key,
    plant, x, y)``; ``nodes`` and ``segments`` are the graphs of all frames, with ``frame``;
    ``transforms(item_key, frame, m)`` lead from the frame before to a frame.  In every frame
    plants are paired by their seeds, greedily from the nearest; the tree is projected,
    grown and estimated again with its axes known, which keep their ids; what is new is
    numbered on.  A plant that has no pair ends, a seed without one is a new plant.  A
    sequence that lacks a frame or its transform has no rows from there on."""
    axes, held, tree, seeds = (start[k] for k in ("axes", "axe_segments", "tree", "seeds"))
    out = None
    for frame in frames:
        at = nodes.where(F.col("frame") == frame).select(ITEM, "node_id", "x", "y")
        own = segments.where(F.col("frame") == frame).select(ITEM, "seg_id", "n0", "n1", "seed")
        m = transforms.where(F.col("frame") == frame).select(ITEM, "m")
        move = lambda x, y: g.transform(F.col("m"), F.col(x), F.col(y))
        point = lambda x, y: [move(x, y)["x"].alias(x), move(x, y)["y"].alias(y)]
        tree = settle(tree.join(m, ITEM).select(ITEM, "seg_id", *point("x0", "y0"), *point("x1", "y1")))
        seeds = settle(seeds.join(m, ITEM).select(ITEM, "plant", *point("x", "y")))
        pairs = compare.seed_match(seeds, pt.mean_seed_position(at, own)).select(ITEM, F.col("i").alias("old"), F.col("j").alias("seed"))
        top = seeds.groupBy(ITEM).agg(F.max("plant").alias("top"))
        plant = F.when(F.col("seed") > 0, F.coalesce("old", F.col("seed") + F.coalesce("top", F.lit(0)))).otherwise(0)
        own = own.join(pairs, [ITEM, "seed"], "left").join(top, ITEM, "left").select(ITEM, "seg_id", "n0", "n1", plant.cast("bigint").alias("seed"))
        own = settle(measure.segment_lengths(own, at))
        ends = own.where("seed > 0").select(ITEM, F.col("seed").alias("plant"), F.explode(F.array("n0", "n1")).alias("node_id")).distinct()
        links = settle(arcs(own)).select(ITEM, F.col("s").alias("a"), F.col("e").alias("b"), "length")
        found = project_tree(axes, held, tree, at, links, settle(ends))
        new = known_tree(axes, settle(grow(found, own)), own, prune)
        axes, held = new["axes"], new["axe_segments"]
        spot = lambda n, k: at.select(ITEM, F.col("node_id").alias(n), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))  # noqa: E731, B023
        tree = settle(new["turned"].join(spot("n0", 0), [ITEM, "n0"]).join(spot("n1", 1), [ITEM, "n1"]).select(ITEM, "seg_id", "x0", "y0", "x1", "y1"))
        seeds = settle(pt.mean_seed_position(at, own))
        rows = axes.join(held, AXE).select(ITEM, F.lit(frame).alias("frame"), "axe_id", "plant", "ord", "parent", "pos", "seg_id")
        out = rows if out is None else out.union(rows)
    return out
