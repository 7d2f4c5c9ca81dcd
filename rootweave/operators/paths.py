"""Paths over trees and graphs: covers, uncovered tips, pruning, orders of axes,
tracking helpers.

Paths are ``(item_key, path_id, pos, seg_id)`` with positions from 1 at the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.functions import geometry as g
from rootweave.iterate import rounds, settle
from rootweave.operators import graph

ITEM = "item_key"


def covering_paths(parents: DataFrame) -> DataFrame:
    """One path for every leaf of ``parents(item_key, node_id, parent)``, from its root."""
    inner = parents.where("parent is not null").select(ITEM, F.col("parent").alias("node_id")).distinct()
    leaves = parents.join(inner, [ITEM, "node_id"], "left_anti")
    return graph.paths_to(parents, leaves).withColumnRenamed("node_id", "seg_id")


def path_lengths(paths: DataFrame, segments: DataFrame) -> DataFrame:
    rows = paths.join(segments.select(ITEM, "seg_id", "length"), [ITEM, "seg_id"])
    return rows.groupBy(ITEM, "path_id").agg(F.sum("length").alias("length"), F.count("*").alias("n"))


def tips(paths: DataFrame) -> DataFrame:
    """The last segments of every path that no other path covers."""
    cover = paths.groupBy(ITEM, "seg_id").agg(F.countDistinct("path_id").alias("cover"))
    after = Window.partitionBy(ITEM, "path_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    rows = paths.join(cover, [ITEM, "seg_id"]).withColumn("shared", F.max("cover").over(after))
    return rows.where("shared = 1").select(ITEM, "path_id", "pos", "seg_id")


def tip_lengths(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """``item_key, path_id, tip``: length of the uncovered tip, 0 without one."""
    own = tips(paths).join(segments.select(ITEM, "seg_id", "length"), [ITEM, "seg_id"]).groupBy(ITEM, "path_id").agg(F.sum("length").alias("tip"))
    return paths.select(ITEM, "path_id").distinct().join(own, [ITEM, "path_id"], "left").select(ITEM, "path_id", F.coalesce("tip", F.lit(0.0)).alias("tip"))


def prune(paths: DataFrame, segments: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """What is left of a tree's covering paths when the shortest tip of every item (of equal
    ones that of the smaller id) is removed as long as it is below ``least``; tips grow as
    their neighbours go.

    Where a tip begins only the other paths through the segment before it can make it
    grow.  So a short tip goes at once where one of them is longer, which it stays, or
    begins at the same place and comes later; all such tips go in one round, and the
    rounds grow with the short branchings above each other, not with the paths.
    A segment without a length has none in tips; a path that others cover whole has a
    tip of 0; an empty table gives no row."""
    paths = settle(paths)
    length = segments.select(ITEM, "seg_id", "length")
    after = Window.partitionBy(ITEM, "path_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    for _ in rounds(most):
        cover = paths.groupBy(ITEM, "seg_id").agg(F.countDistinct("path_id").alias("cover"))
        rows = paths.join(cover, [ITEM, "seg_id"]).withColumn("own", F.max("cover").over(after) == 1).join(length, [ITEM, "seg_id"], "left")
        tip = F.coalesce(F.sum(F.when(F.col("own"), F.col("length"))), F.lit(0.0)).alias("tip")
        ends = settle(rows.groupBy(ITEM, "path_id").agg(tip, F.max_by("seg_id", F.when(~F.col("own"), F.col("pos"))).alias("base")))
        bases = ends.where("base is not null").select(ITEM, F.col("base").alias("seg_id")).distinct()
        beside = paths.join(bases, [ITEM, "seg_id"]).join(ends, [ITEM, "path_id"]).groupBy(ITEM, "seg_id")
        rivals = beside.agg(F.max("tip").alias("longest"), F.max(F.when(F.col("base") == F.col("seg_id"), F.struct("tip", "path_id"))).alias("last")).withColumnRenamed("seg_id", "base")
        short = ends.where(F.col("tip") < least).join(rivals, [ITEM, "base"], "left")
        gone = settle(short.where(F.col("base").isNull() | (F.col("longest") > F.col("tip")) | (F.col("last") > F.struct("tip", "path_id"))).select(ITEM, "path_id"))
        if gone.isEmpty():
            break
        paths = settle(paths.join(gone, [ITEM, "path_id"], "left_anti"))
    return paths


def longest(paths: DataFrame, lengths: DataFrame, group: DataFrame, number: int = 1, selected: DataFrame | None = None) -> DataFrame:
    """``item_key, grp, path_id``: the longest paths of each group ``(item_key, path_id, grp)``;
    groups with a selected path already are left out."""
    rows = lengths.join(group, [ITEM, "path_id"])
    if selected is not None:
        busy = selected.join(group, [ITEM, "path_id"]).select(ITEM, "grp").distinct()
        rows = rows.join(busy, [ITEM, "grp"], "left_anti")
    order = Window.partitionBy(ITEM, "grp").orderBy(F.desc("length"), "path_id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= number).select(ITEM, "grp", "path_id")


def crop_to_order(paths: DataFrame, orders: DataFrame) -> DataFrame:
    """Paths without the leading segments that a path of lower order (or of equal order
    and smaller id) covers: what is left are axes."""
    rows = paths.join(orders, [ITEM, "path_id"])
    owner = rows.groupBy(ITEM, "seg_id").agg(F.min_by("path_id", F.struct("ord", "path_id")).alias("owner"))
    kept = rows.join(owner, [ITEM, "seg_id"]).where("owner = path_id")
    pos = F.row_number().over(Window.partitionBy(ITEM, "path_id").orderBy("pos"))
    return kept.select(ITEM, F.col("path_id").alias("axe_id"), pos.alias("pos"), "seg_id")


def propagate_orders(axes: DataFrame) -> DataFrame:
    """``item_key, axe_id, ord, plant``: order = that of the parent + 1 and the parent's
    plant, from axes without parent down."""
    way = graph.roots(axes.select(ITEM, F.col("axe_id").alias("node_id"), "parent"))
    depth = way.select(ITEM, F.col("node_id").alias("axe_id"), (F.col("steps") + 1).alias("ord"), "root")
    plants = axes.select(ITEM, F.col("axe_id").alias("root"), "plant")
    return depth.join(plants, [ITEM, "root"]).select(ITEM, "axe_id", "ord", "plant")


def common_prefix(paths: DataFrame) -> DataFrame:
    """``item_key, p1, p2, split``: how many leading segments two paths of an item that
    share their first segment have in common."""
    a = paths.select(ITEM, F.col("path_id").alias("p1"), "pos", F.col("seg_id").alias("s1"))
    b = paths.select(ITEM, F.col("path_id").alias("p2"), "pos", F.col("seg_id").alias("s2"))
    same = a.join(b, (a[ITEM] == b[ITEM]) & (a["pos"] == b["pos"]) & (a["s1"] == b["s2"])).where("p1 <> p2").select(a[ITEM], "p1", "p2", a["pos"])
    order = Window.partitionBy(ITEM, "p1", "p2").orderBy("pos")
    run = same.withColumn("r", F.row_number().over(order)).where("r = pos")
    return run.groupBy(ITEM, "p1", "p2").agg(F.max("pos").alias("split"))


def mean_seed_position(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """``item_key, plant, x, y``: mean of the end nodes of each seed's segments."""
    ends = segments.where("seed > 0").select(ITEM, F.col("seed").alias("plant"), F.explode(F.array("n0", "n1")).alias("node_id"))
    return ends.join(nodes, [ITEM, "node_id"]).groupBy(ITEM, "plant").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def chained_transforms(steps: DataFrame) -> DataFrame:
    """``seq_id, frame, m``: products of the 3 x 3 matrices ``steps(seq_id, frame, m)`` up to
    each frame, by doubling: log2 of the longest sequence joins."""
    rows = steps.withColumn("k", F.row_number().over(Window.partitionBy("seq_id").orderBy("frame"))).select("seq_id", "k", "frame", "m")
    rows = settle(rows)
    top = rows.agg(F.max("k")).first()[0] or 0
    span = 1
    while span < top:
        before = rows.select("seq_id", (F.col("k") + span).alias("k"), F.col("m").alias("before"))
        joined = rows.join(before, ["seq_id", "k"], "left")
        rows = settle(joined.select("seq_id", "k", "frame", F.when(F.col("before").isNotNull(), g.product(F.col("before"), F.col("m"))).otherwise(F.col("m")).alias("m")))
        span *= 2
    return rows.select("seq_id", "frame", "m")


def coverage(segments: DataFrame, axe_segments: DataFrame, reach: DataFrame, forward: DataFrame) -> DataFrame:
    """``item_key, seg_id, state``: 0 covered by an axis, 1 unreachable, 2 reachable and
    forward, 3 reachable and backward."""
    covered = axe_segments.select(ITEM, "seg_id").distinct().withColumn("c", F.lit(True))
    rows = segments.select(ITEM, "seg_id").join(covered, [ITEM, "seg_id"], "left").join(reach, [ITEM, "seg_id"], "left").join(forward, [ITEM, "seg_id"], "left")
    state = F.when(F.col("c"), 0).when(~F.coalesce("reachable", F.lit(False)), 1).when(F.coalesce("forward", F.lit(True)), 2).otherwise(3)
    return rows.select(ITEM, "seg_id", state.alias("state"))


def grow_axes(axe_segments: DataFrame, runs: DataFrame) -> DataFrame:
    """``axe_segments`` with the rest of the unbranched run its last segment stands on;
    ``runs(item_key, seg_id, run, run_pos)``."""
    last = axe_segments.groupBy(ITEM, "axe_id").agg(F.max_by("seg_id", "pos").alias("seg_id"), F.max("pos").alias("top"))
    at = last.join(runs, [ITEM, "seg_id"]).select(ITEM, "axe_id", "top", "run", F.col("run_pos").alias("from_pos"))
    more = runs.join(at, [ITEM, "run"]).where("run_pos > from_pos").join(axe_segments.select(ITEM, "seg_id"), [ITEM, "seg_id"], "left_anti")
    pos = (F.col("top") + F.row_number().over(Window.partitionBy(ITEM, "axe_id").orderBy("run_pos"))).cast("int")
    return axe_segments.select(ITEM, "axe_id", "pos", "seg_id").union(more.select(ITEM, "axe_id", pos.alias("pos"), "seg_id"))


def to_mtg(axes: DataFrame, axe_segments: DataFrame, most_order: int | None = None) -> DataFrame:
    """``item_key, vid, scale, complex_vid, parent_vid, edge_type``: plants, axes and segments
    as one multiscale tree; ``/`` component, ``+`` branch, ``<`` successor."""
    if most_order is not None:
        axes = axes.where(F.col("ord") <= most_order)
        axe_segments = axe_segments.join(axes.select(ITEM, "axe_id"), [ITEM, "axe_id"], "left_semi")
    vid = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    null = F.lit(None).cast("string")
    plants = axes.select(ITEM, "plant").distinct().select(ITEM, vid("P", "plant").alias("vid"), F.lit("plant").alias("scale"), null.alias("complex_vid"), null.alias("parent_vid"), F.lit("/").alias("edge_type"))
    branch = F.when(F.col("parent").isNull(), "/").otherwise("+")
    a = axes.select(ITEM, vid("A", "axe_id").alias("vid"), F.lit("axe"), vid("P", "plant"), F.when(F.col("parent").isNotNull(), vid("A", "parent")), branch)
    w = Window.partitionBy(ITEM, "axe_id").orderBy("pos")
    s = axe_segments.join(axes.select(ITEM, "axe_id", "parent_segment"), [ITEM, "axe_id"]).withColumn("before", F.lag("seg_id").over(w))
    up = F.coalesce("before", "parent_segment")
    kind = F.when(F.col("before").isNotNull(), "<").when(F.col("parent_segment").isNotNull(), "+").otherwise("/")
    s = s.select(ITEM, vid("S", "seg_id").alias("vid"), F.lit("segment"), vid("A", "axe_id"), F.when(up.isNotNull(), F.concat(F.lit("S"), up.cast("string"))), kind)
    return plants.union(a).union(s)
