"""Search for the merges of axes that make a root system most plausible.

A state is a set of axes of an item.  An axis that ends next to a segment of another
one may go on along that one's rest, if other axes cover what the other one had before;
both then are one axis, which may merge again.  A beam of the best states of every item
is extended by one merge a round, all items and states at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.iterate import rounds, settle
from rootweave.operators.models import ARABIDOPSIS, Model, growth_ratio

ITEM = "item_key"
STATE = [ITEM, "state"]
AXE = [*STATE, "axe"]
PIECES = "array<struct<path:bigint,at:int,start:int>>"


def mark(axe):
    """What an axis adds to its state's number."""
    return F.xxhash64(axe)


def first_state(paths: DataFrame, axes: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``S(item_key, state, axe, pos, seg_id, length, way, path, at)``, the segments of every
    axis with the way up to their end and their place in the path they came from, and
    ``A(item_key, state, axe, free, parent_length, length, base, v, pieces)``.

    ``axes(item_key, path_id, kind, parent, split)`` as from ``initial_axes``."""
    number = F.col("path_id").cast("bigint")
    rows = paths.join(segments.select(ITEM, "seg_id", "length"), [ITEM, "seg_id"])
    way = F.sum("length").over(Window.partitionBy(ITEM, "path_id").orderBy("pos"))
    rows = rows.select(ITEM, number.alias("axe"), F.col("pos").cast("int").alias("pos"), "seg_id", "length", way.alias("way"), number.alias("path"), F.col("pos").cast("int").alias("at"))
    states = axes.groupBy(ITEM).agg(F.bit_xor(mark(number)).alias("state"))
    whole = rows.groupBy(ITEM, "axe").agg(F.max("way").alias("total"))
    base = rows.join(axes.select(ITEM, number.alias("axe"), (F.col("split") + 1).alias("pos")), [ITEM, "axe", "pos"]).select(ITEM, "axe", F.col("seg_id").alias("base"))
    parent = whole.select(ITEM, F.col("axe").alias("parent"), F.col("total").alias("parent_length"))
    a = axes.select(ITEM, number.alias("axe"), "kind", F.col("parent").cast("bigint").alias("parent")).join(whole, [ITEM, "axe"]).join(parent, [ITEM, "parent"], "left").join(base, [ITEM, "axe"], "left").join(states, ITEM)
    free = F.col("kind") == "lateral"
    pieces = F.array(F.struct(F.col("axe").alias("path"), F.lit(1).alias("at"), F.lit(1).alias("start"))).cast(PIECES)
    a = a.select(
        *AXE, free.alias("free"), "parent_length", F.col("total").alias("length"), F.when(free, F.col("base")).alias("base"), F.when(free, growth_ratio(F.col("total"), F.col("parent_length"))).alias("v"), pieces.alias("pieces")
    )
    return settle(rows.join(states, ITEM).select(*AXE, "pos", "seg_id", "length", "way", "path", "at")), settle(a)


def possible(s: DataFrame, a: DataFrame, edges: DataFrame, crossing: float | None = None) -> DataFrame:
    """``item_key, state, p1, p2, pos, seg_id, way``: lateral ``p1`` ends next to (``edges(item_key,
    a, b)``) segment ``seg_id`` at ``pos`` of lateral ``p2``, which is not on ``p1``; at least one more
    axis covers each segment of ``p2`` before it, of which there is one or more.  ``way`` is
    the length of ``p2`` before the place.  Of several places the first counts.

    With ``crossing``, an axis that can go on at one segment only, where all the others come
    from the same segment before, does not go on along every one of them.  It takes the
    one that leaves the rest farthest on its own side, as ``edges.side`` tells (the angle
    at which ``a`` meets ``b``, null where unknown), and on the other side those that have
    parted from the outermost one there within that length."""
    cover = s.groupBy(*STATE, "seg_id").agg(F.count_distinct("axe").alias("cover"))
    before = Window.partitionBy(*AXE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    free = a.where("free").select(*AXE)
    cut = s.join(free, AXE, "left_semi").join(cover, [*STATE, "seg_id"]).withColumn("least", F.min("cover").over(before)).where("least > 1")
    end = s.join(free, AXE, "left_semi").groupBy(*AXE).agg(F.max_by("seg_id", "pos").alias("a")).withColumnRenamed("axe", "p1")
    tails = end.join(edges.select(ITEM, "a", "b").distinct(), [ITEM, "a"])
    target = cut.select(*STATE, F.col("seg_id").alias("b"), F.col("axe").alias("p2"), "pos", (F.col("way") - F.col("length")).alias("way"))
    found = tails.join(target, [*STATE, "b"]).where("p1 <> p2")
    found = found.join(s.select(*STATE, F.col("axe").alias("p1"), F.col("seg_id").alias("b")), [*STATE, "p1", "b"], "left_anti")
    first = F.min(F.struct("pos", F.col("b").alias("seg_id"), "way", "a")).alias("x")
    found = found.groupBy(*STATE, "p1", "p2").agg(first).select(*STATE, "p1", "p2", "x.*")
    if crossing is not None:
        found = outermost(settle(found), s, edges, crossing)
    return found.drop("a")


def outermost(found: DataFrame, s: DataFrame, edges: DataFrame, crossing: float) -> DataFrame:
    """The merges that ``crossing`` leaves (see ``possible``)."""
    group = [*STATE, "p1"]
    angle = edges.groupBy(ITEM, "a", "b").agg(F.min("side").alias("side"))
    # the segment before the place and the turns and lengths after it
    before = s.select(*STATE, F.col("axe").alias("p2"), (F.col("pos") + 1).alias("pos"), F.col("seg_id").alias("from"))
    rows = found.join(before, [*STATE, "p2", "pos"])
    alone = rows.groupBy(*group).agg(F.count_distinct("seg_id").alias("places"), F.count_distinct("from").alias("froms"), F.count("*").alias("n"))
    judged = settle(rows.join(alone.where("places = 1 and froms = 1 and n > 1").select(*group), group))
    step = s.select(*STATE, F.col("axe").alias("p2"), F.col("pos").alias("at"), F.col("seg_id").alias("to"), "length", F.lag("seg_id").over(Window.partitionBy(*AXE).orderBy("pos")).alias("a"))
    tail = judged.select(*group, "p2", "pos").join(step, [*STATE, "p2"]).where("at >= pos")
    tail = tail.join(angle.withColumnRenamed("b", "to"), [ITEM, "a", "to"], "left")
    curve = F.array_sort(F.collect_list(F.struct("at", F.coalesce("side", F.lit(0.0)).alias("side"), "length", "to")))
    curves = tail.groupBy(*group, "p2").agg(curve.alias("c"))
    curves = curves.withColumns({"turns": F.transform("c", lambda x: x["side"]), "ways": F.transform("c", lambda x: F.struct(x["to"], x["length"]))})
    own = judged.join(angle.withColumnRenamed("b", "seg_id").withColumnRenamed("side", "own"), [ITEM, "a", "seg_id"], "left").join(
        angle.withColumnRenamed("a", "from").withColumnRenamed("b", "seg_id").withColumnRenamed("side", "others"), [ITEM, "from", "seg_id"], "left"
    )
    upper = (F.coalesce("own", F.lit(0.0)) > F.coalesce("others", F.lit(0.0))).alias("upper")
    rows = own.select(*group, "p2", upper).join(curves.select(*group, "p2", "turns", "ways"), [*group, "p2"])
    w = Window.partitionBy(*group)
    high, low = F.max_by(F.struct("p2", "ways"), F.struct("turns", "p2")).over(w), F.min_by(F.struct("p2", "ways"), F.struct("turns", "p2")).over(w)
    rows = rows.withColumns({"same": F.when(F.col("upper"), high).otherwise(low), "opposite": F.when(F.col("upper"), low).otherwise(high)})
    # the common way with the outermost axis of the other side
    both = F.zip_with("ways", "opposite.ways", lambda x, y: F.struct((x["to"] == y["to"]).alias("same"), x["length"].alias("length")))
    shared = F.aggregate(both, F.struct(F.lit(True).alias("on"), F.lit(0.0).alias("d")), lambda z, x: F.struct((z["on"] & F.coalesce(x["same"], F.lit(False))).alias("on"), (z["d"] + F.when(z["on"] & F.coalesce(x["same"], F.lit(False)), F.coalesce(x["length"], F.lit(0.0))).otherwise(0.0)).alias("d")))
    keep = (F.col("p2") == F.col("same.p2")) | ((F.col("p2") != F.col("opposite.p2")) & (shared["d"] <= crossing))
    gone = rows.where(~keep).select(*group, "p2")
    return found.join(gone, [*group, "p2"], "left_anti")


def extended(found: DataFrame, a: DataFrame, front: DataFrame, model: Model) -> DataFrame:
    """Every state of ``front(item_key, state, s, extra, value)`` after each merge of ``found``: its
    number ``next``, and what the new axis ``axe`` is."""
    count = a.where("base is not null").groupBy(*STATE, "base").agg(F.count("*").alias("on_base"))
    rows = found
    for n in (1, 2):
        side = a.select(*STATE, *[F.col(c).alias(f"{c}{n}") for c in ("parent_length", "length", "base", "v", "pieces")], F.col("axe").alias(f"p{n}"))
        rows = rows.join(side, [*STATE, f"p{n}"])
    rows = rows.join(count.withColumnRenamed("base", "base2"), [*STATE, "base2"], "left").join(front.withColumnRenamed("value", "before"), STATE)
    total = F.col("length1") + F.col("length2") - F.col("way")
    size = F.col("size1")
    rest = F.filter("pieces2", lambda p: p["start"] > F.col("pos"))
    head = F.element_at(F.filter("pieces2", lambda p: p["start"] <= F.col("pos")), -1)
    cut = F.struct(head["path"].alias("path"), (head["at"] + F.col("pos") - head["start"]).cast("int").alias("at"), (size + 1).cast("int").alias("start"))
    pieces = F.concat("pieces1", F.array(cut), F.transform(rest, lambda p: F.struct(p["path"].alias("path"), p["at"].alias("at"), (p["start"] + size + 1 - F.col("pos")).cast("int").alias("start"))))
    rows = rows.withColumns({"pieces": pieces.cast(PIECES), "length": total})
    rows = rows.withColumn("axe", F.xxhash64(F.transform("pieces", lambda p: F.struct(p["path"], p["at"]))))
    rows = rows.withColumns(
        {
            "v": growth_ratio(F.col("length"), F.col("parent_length1")),
            "next": F.col("state").bitwiseXOR(mark(F.col("p1"))).bitwiseXOR(mark(F.col("p2"))).bitwiseXOR(mark(F.col("axe"))),
            # the second axis' branching goes
            "extra": F.col("extra") - F.when(F.col("on_base") > 1, 1).otherwise(0),
        }
    )
    rows = rows.withColumn("s", model.merged(F.col("s"), F.col("v1"), F.col("v2"), F.col("v")))
    rows = rows.withColumn("value", model.value(F.col("s"), F.col("extra")))
    return rows.select(*STATE, "next", "p1", "p2", "pos", "size1", "axe", F.col("parent_length1").alias("parent_length"), "length", F.col("base1").alias("base"), "v", "pieces", "s", "extra", "value", "before")


def moved(s: DataFrame, a: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and axes of the chosen states."""
    step = chosen.select(*STATE, "next", "p1", "p2", F.col("pos").alias("cut"), "size1", F.col("axe").alias("new"), F.col("length").alias("total"))
    rows = s.join(step, STATE)
    first, second = F.col("axe") == F.col("p1"), F.col("axe") == F.col("p2")
    rows = rows.where(~second | (F.col("pos") >= F.col("cut")))
    pos = F.when(second, F.col("size1") + F.col("pos") - F.col("cut") + 1).otherwise(F.col("pos")).cast("int")
    rows = rows.select(ITEM, F.col("next").alias("state"), F.when(first | second, F.col("new")).otherwise(F.col("axe")).alias("axe"), pos.alias("pos"), "seg_id", "length", "path", "at")
    rows = rows.withColumn("way", F.sum("length").over(Window.partitionBy(*AXE).orderBy("pos")))
    kept = a.join(step, STATE).where("axe <> p1 and axe <> p2").select(ITEM, F.col("next").alias("state"), *[c for c in a.columns if c not in STATE])
    new = chosen.select(ITEM, F.col("next").alias("state"), "axe", F.lit(True).alias("free"), "parent_length", "length", "base", "v", "pieces")
    return settle(rows.select(*s.columns)), settle(kept.select(*a.columns).union(new.select(*a.columns)))


def search(
    paths: DataFrame, axes: DataFrame, segments: DataFrame, edges: DataFrame, model: Model = ARABIDOPSIS, width: int = 10, coef: float = 1.1, crossing: float | None = None, most: int = 10_000
) -> dict[str, DataFrame]:
    """The best set of axes of every item by beam search: ``paths(item_key, path_id, pos, seg_id)``,
    ``pieces(item_key, path_id, pieces)``, what of which path each one is made of, and
    ``values(item_key, value, merges)``.

    Starts from ``paths`` with ``axes(item_key, path_id, kind, parent, split)``; a round adds
    one merge (``possible``) to every state of the front, merged axes too.  States seen
    before are dropped, those not below ``coef`` times the value before are given up, the
    ``width`` best of an item stay.  Each merge takes an axis away, so the search ends.
    ``width=1`` is the greedy search.  ``most`` rounds raise; items without laterals stay as
    they are; an empty table gives none."""
    s, a = first_state(paths, axes, segments)
    fitted = model.fit(a.where("free"), STATE)
    begin = settle(a.select(*STATE).distinct().join(fitted, STATE, "left"))
    front = begin.where("value is not null")
    best = settle(begin.select(*STATE, F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(0).alias("merges")))
    best_s, best_a, seen = s, a, settle(front.select(*STATE))
    for n in rounds(most):
        sizes = s.groupBy(*AXE).agg(F.max("pos").alias("size1")).withColumnRenamed("axe", "p1")
        found = settle(possible(s, a, edges, crossing).join(sizes, [*STATE, "p1"]))
        grown = extended(found, a, front, model).where(F.col("value") < coef * F.col("before"))
        grown = grown.join(seen.withColumnRenamed("state", "next"), [ITEM, "next"], "left_anti")
        once = grown.withColumn("r", F.row_number().over(Window.partitionBy(ITEM, "next").orderBy("value", "state", "p1", "p2"))).where("r = 1")
        order = Window.partitionBy(ITEM).orderBy("value", "next")
        chosen = settle(once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= width).drop("r"))
        if chosen.isEmpty():
            break
        s, a = moved(s, a, chosen)
        front = settle(chosen.select(ITEM, F.col("next").alias("state"), "s", "extra", "value"))
        seen = settle(seen.union(front.select(*STATE)))
        new = front.select(*STATE, "value", F.lit(n + 1).alias("merges"))
        top = best.union(new).withColumn("r", F.row_number().over(Window.partitionBy(ITEM).orderBy("value", "merges", "state"))).where("r = 1").drop("r")
        top = settle(top)
        held = best_s.join(top, STATE, "left_semi"), best_a.join(top, STATE, "left_semi")
        best_s, best_a = settle(held[0].union(s.join(top, STATE, "left_semi"))), settle(held[1].union(a.join(top, STATE, "left_semi")))
        best = top
    return {
        "paths": best_s.select(ITEM, F.col("axe").alias("path_id"), "pos", "seg_id"),
        "pieces": best_a.select(ITEM, F.col("axe").alias("path_id"), "pieces"),
        "values": best.select(ITEM, "value", "merges"),
    }
