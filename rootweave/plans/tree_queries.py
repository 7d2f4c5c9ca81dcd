"""Queries over trees and their measures.

A customer's orders, numbered from 1 by key, are a binary tree: order r hangs on order
r // 2.  Items are eight groups of customers, a customer is a plant, an order's price is
its length.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.functions import geometry as g
from rootweave.iterate import settle
from rootweave.operators import catalog, compare, graph, match, measure, paths, stats, trees, words
from rootweave.plans import bindings as b
from rootweave.plans.catalogue import query

HEAP = """h AS (SELECT CAST(o_custkey % 8 AS VARCHAR) AS item_key, o_custkey AS plant, o_orderkey AS node_id, o_totalprice AS length, o_orderpriority AS priority,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
 t AS (SELECT c.*, p.node_id AS parent FROM h c LEFT JOIN h p ON p.plant = c.plant AND p.r = c.r // 2 AND c.r > 1)"""
#: Every node with all nodes up to its root; the place of a node counts from 1 at the root.
ANCESTORS = """anc AS (SELECT c.item_key, c.plant, c.node_id, a.node_id AS ancestor, k.k AS steps, a.length, CAST(floor(log2(a.r)) AS INTEGER) + 1 AS pos
 FROM h c, (SELECT unnest(range(0, 40)) AS k) k, h a WHERE a.plant = c.plant AND (c.r >> k.k) >= 1 AND a.r = (c.r >> k.k)),
 leaf AS (SELECT * FROM t WHERE node_id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
 way AS (SELECT anc.* FROM anc JOIN leaf USING (node_id))"""


def heap(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = b.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 8).cast("string").alias("item_key"),
        F.col("o_custkey").alias("plant"),
        F.col("o_orderkey").alias("node_id"),
        F.col("o_totalprice").alias("length"),
        F.col("o_orderpriority").alias("priority"),
        F.row_number().over(w).cast("bigint").alias("r"),
    )
    up = o.select("plant", F.col("r").alias("half"), F.col("node_id").alias("parent"))
    return settle(o.withColumn("half", F.when(F.col("r") > 1, F.floor(F.col("r") / 2))).join(up, ["plant", "half"], "left").drop("half"))


def parents(t):
    return t.select("item_key", "node_id", "parent")


def lengths(t):
    return t.select("item_key", F.col("node_id").alias("seg_id"), "length")


def own_paths(t):
    return settle(paths.covering_paths(parents(t)))


def path_plant(p, t):
    first = p.where("pos = 1").select("item_key", "path_id", F.col("seg_id").alias("node_id"))
    return first.join(t.select("item_key", "node_id", "plant"), ["item_key", "node_id"]).select("item_key", "path_id", "plant")


@query(f"WITH {HEAP}, {ANCESTORS} SELECT item_key, node_id AS path_id, pos, ancestor AS seg_id FROM way")
def i20_path_elements(spark, sf_dir):
    return own_paths(heap(spark, sf_dir)).select("item_key", "path_id", "pos", "seg_id")


@query(f"WITH {HEAP}, {ANCESTORS} SELECT item_key, node_id AS path_id, pos, ancestor AS node_id FROM anc WHERE node_id % 7 = 0")
def i10_paths_to_targets(spark, sf_dir):
    t = heap(spark, sf_dir)
    return graph.paths_to(parents(t), t.where("node_id % 7 = 0")).select("item_key", "path_id", "pos", "node_id")


@query(f"WITH {HEAP} SELECT item_key, node_id AS a, parent AS b FROM t WHERE parent IS NOT NULL UNION ALL SELECT item_key, parent, node_id FROM t WHERE parent IS NOT NULL")
def i11_tree_edges(spark, sf_dir):
    return graph.parent_edges(parents(heap(spark, sf_dir))).select("item_key", "a", "b")


@query(f"WITH {HEAP} SELECT item_key, node_id, CAST(floor(log2(r)) AS INTEGER) AS level FROM h")
def i19_topological_levels(spark, sf_dir):
    t = heap(spark, sf_dir)
    return graph.topological_levels(t, graph.parent_edges(parents(t), "down"), t.where("parent is null")).select("item_key", "node_id", "level")


@query(f"WITH {HEAP} SELECT item_key, node_id AS axe_id, CAST(floor(log2(r)) AS INTEGER) + 1 AS ord, plant FROM h")
def i27_propagated_orders(spark, sf_dir):
    axes = heap(spark, sf_dir).select("item_key", F.col("node_id").alias("axe_id"), "parent", "plant")
    return paths.propagate_orders(axes).select("item_key", "axe_id", "ord", "plant")


@query(f"WITH {HEAP} SELECT item_key, node_id, min(node_id) OVER (PARTITION BY plant) AS component FROM h")
def i06_tree_components(spark, sf_dir):
    """Binary trees of a customer's orders; items hold many."""
    t = heap(spark, sf_dir)
    return graph.components(t, graph.parent_edges(parents(t), "up")).select("item_key", "node_id", "component")


@query(f"WITH {HEAP}, {ANCESTORS} SELECT item_key, node_id, round(sum(CASE WHEN pos > 1 THEN length ELSE 0 END), 2) AS dist FROM anc GROUP BY 1, 2")
def i18_shortest_axe_tree(spark, sf_dir):
    t = heap(spark, sf_dir)
    e = t.where("parent is not null").select("item_key", F.col("parent").alias("a"), F.col("node_id").alias("b"), F.lit(0.5).alias("angle"), F.lit(1.0).alias("l1"), F.col("length").alias("l2"))
    return trees.cheapest_tree(e, t.where("parent is null")).select("item_key", "node_id", F.round("dist", 2).alias("dist"))


CURVED = f"""WITH {HEAP}, {ANCESTORS}, e AS (SELECT node_id, ((node_id % 13) / 10.0) * (1.0 + length) / 2 AS cost FROM t WHERE parent IS NOT NULL)"""


@query(CURVED + " SELECT anc.item_key, anc.node_id, round(sum(coalesce(e.cost, 0)), 4) AS dist FROM anc LEFT JOIN e ON e.node_id = anc.ancestor GROUP BY 1, 2")
def i18_least_curvature_tree(spark, sf_dir):
    t = heap(spark, sf_dir)
    e = t.where("parent is not null").select("item_key", F.col("parent").alias("a"), F.col("node_id").alias("b"), (F.col("node_id") % 13 / 10.0).alias("angle"), F.lit(1.0).alias("l1"), F.col("length").alias("l2"))
    return trees.cheapest_tree(e, t.where("parent is null"), "curvature").select("item_key", "node_id", F.round("dist", 4).alias("dist"))


TIPS = f"""WITH {HEAP}, {ANCESTORS}, cover AS (SELECT ancestor, count(*) AS k FROM way GROUP BY 1),
 tip AS (SELECT way.* FROM way JOIN cover USING (ancestor) WHERE k = 1)"""


@query(TIPS + " SELECT item_key, node_id AS path_id, pos, ancestor AS seg_id FROM tip")
def e21_uncovered_tips(spark, sf_dir):
    return paths.tips(own_paths(heap(spark, sf_dir))).select("item_key", "path_id", "pos", "seg_id")


@query(TIPS + " SELECT item_key, node_id AS path_id, round(sum(length), 2) AS tip FROM tip GROUP BY 1, 2")
def i24_tip_lengths(spark, sf_dir):
    t = heap(spark, sf_dir)
    return paths.tip_lengths(own_paths(t), lengths(t)).select("item_key", "path_id", F.round("tip", 2).alias("tip"))


LONGEST = f"""WITH {HEAP}, {ANCESTORS}, total AS (SELECT item_key, plant, node_id AS path_id, sum(length) AS length, count(*) AS n FROM way GROUP BY 1, 2, 3),
 main AS (SELECT *, row_number() OVER (PARTITION BY plant ORDER BY round(length, 4) DESC, path_id) AS k FROM total)"""


@query(LONGEST + " SELECT item_key, path_id, round(length, 2) AS length, n FROM total")
def e10_path_lengths(spark, sf_dir):
    t = heap(spark, sf_dir)
    return paths.path_lengths(own_paths(t), lengths(t)).select("item_key", "path_id", F.round("length", 2).alias("length"), "n")


@query(LONGEST + " SELECT item_key, plant AS grp, path_id FROM main WHERE k = 1")
def e10_longest_paths(spark, sf_dir):
    t = heap(spark, sf_dir)
    p = own_paths(t)
    total = paths.path_lengths(p, lengths(t)).withColumn("length", F.round("length", 4))
    return paths.longest(p, total, path_plant(p, t).withColumnRenamed("plant", "grp")).select("item_key", "grp", "path_id")


AXES = LONGEST + """, ranked AS (SELECT way.item_key, way.plant, way.node_id AS path_id, way.pos, way.ancestor AS seg_id, CASE WHEN main.k = 1 THEN 1 ELSE 2 END AS ord
 FROM way JOIN main ON main.path_id = way.node_id), owner AS (SELECT seg_id, min(ord * 1000000000000 + path_id) AS own FROM ranked GROUP BY 1),
 kept AS (SELECT ranked.* FROM ranked JOIN owner USING (seg_id) WHERE ord * 1000000000000 + path_id = own)"""


@query(AXES + " SELECT item_key, path_id AS axe_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY pos) AS INTEGER) AS pos, seg_id FROM kept")
def i25_axes_by_rules(spark, sf_dir):
    """The longest path of a plant is of order 1, all others of order 2."""
    t = heap(spark, sf_dir)
    p = own_paths(t)
    orders = trees.path_orders(p, lengths(t).withColumn("length", F.round("length", 4)), path_plant(p, t), [("longest", 1)])
    return trees.path_axes(p, settle(orders), parents(t))["axe_segments"].select("item_key", "axe_id", "pos", "seg_id")


@query(
    AXES
    + """, head AS (SELECT path_id, arg_min(seg_id, pos) AS seg_id, any_value(ord) AS ord, any_value(plant) AS plant, any_value(item_key) AS item_key FROM kept GROUP BY 1)
    SELECT head.item_key, head.path_id AS axe_id, head.plant, head.ord, k.path_id AS parent, t.parent AS parent_segment FROM head JOIN t ON t.node_id = head.seg_id LEFT JOIN kept k ON k.seg_id = t.parent"""
)
def i25_axes_table(spark, sf_dir):
    t = heap(spark, sf_dir)
    p = own_paths(t)
    orders = trees.path_orders(p, lengths(t).withColumn("length", F.round("length", 4)), path_plant(p, t), [("longest", 1)])
    return trees.path_axes(p, settle(orders), parents(t))["axes"].select("item_key", "axe_id", "plant", "ord", "parent", "parent_segment")


@query(
    LONGEST
    + """, m AS (SELECT * FROM main WHERE k = 1), mp AS (SELECT m.plant, m.path_id AS main, way.pos, way.ancestor FROM m JOIN way ON way.node_id = m.path_id),
    s AS (SELECT way.item_key, way.node_id AS path_id, mp.main, count(*) AS split FROM way JOIN mp ON mp.plant = way.plant AND mp.pos = way.pos AND mp.ancestor = way.ancestor WHERE way.node_id <> mp.main GROUP BY 1, 2, 3),
    l AS (SELECT s.*, sum(CASE WHEN way.pos > s.split THEN way.length ELSE 0 END) AS branch FROM s JOIN way ON way.node_id = s.path_id GROUP BY ALL)
    SELECT item_key, path_id, 'lateral' AS kind, main AS parent, CAST(split AS INTEGER) AS split, round(branch, 2) AS branch FROM l
    UNION ALL SELECT item_key, path_id, 'primary', NULL, 0, round(length, 2) FROM m"""
)
def i30_initial_axes(spark, sf_dir):
    t = heap(spark, sf_dir)
    p = own_paths(t)
    total = paths.path_lengths(p, lengths(t)).withColumn("length", F.round("length", 4))
    main = paths.longest(p, total, path_plant(p, t).withColumnRenamed("plant", "grp"))
    return trees.initial_axes(p, settle(main), lengths(t)).select("item_key", "path_id", "kind", "parent", F.col("split").cast("int").alias("split"), F.round("branch", 2).alias("branch"))


@query(
    f"""WITH {HEAP}, {ANCESTORS} SELECT a.item_key, a.node_id AS p1, c.node_id AS p2, CAST(count(*) AS INTEGER) AS split FROM way a JOIN way c
    ON a.plant = c.plant AND a.pos = c.pos AND a.ancestor = c.ancestor AND a.node_id <> c.node_id GROUP BY 1, 2, 3"""
)
def h28_common_prefix(spark, sf_dir):
    return paths.common_prefix(own_paths(heap(spark, sf_dir))).select("item_key", "p1", "p2", F.col("split").cast("int").alias("split"))


RUNS = """WITH o AS (SELECT CAST(o_custkey % 8 AS VARCHAR) AS item_key, o_custkey AS run, o_orderkey AS seg_id, o_orderstatus = 'F' AS masked,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


def chain(spark, sf_dir):
    """A customer's orders in a row are an unbranched run."""
    o = b.table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return settle(o.select((F.col("o_custkey") % 8).cast("string").alias("item_key"), F.col("o_orderkey").alias("seg_id"), F.col("o_custkey").alias("run"), pos.alias("run_pos"), "o_orderstatus", "o_totalprice"))


@query(
    RUNS
    + """, s AS (SELECT run, coalesce(max(CASE WHEN masked THEN p END), 0) AS stop FROM o GROUP BY 1), e AS (SELECT run, seg_id AS axe_id FROM o WHERE p = n AND NOT masked)
    SELECT o.item_key, e.axe_id, CAST(row_number() OVER (PARTITION BY o.run ORDER BY p) AS INTEGER) AS pos, o.seg_id FROM o JOIN e USING (run) JOIN s USING (run) WHERE p > stop"""
)
def e26_tip_axes(spark, sf_dir):
    runs = chain(spark, sf_dir)
    last = runs.groupBy("item_key", "run").agg(F.max_by("seg_id", "run_pos").alias("seg_id")).select("item_key", "seg_id")
    return trees.tip_axes(last, runs.select("item_key", "seg_id", "run", "run_pos"), runs.where("o_orderstatus = 'F'")).select("item_key", "axe_id", "pos", "seg_id")


@query(RUNS + " SELECT item_key, run AS axe_id, CAST(p AS INTEGER) AS pos, seg_id FROM o")
def e25_tip_growth(spark, sf_dir):
    """Axes of the first two orders grow along the rest of the run."""
    runs = chain(spark, sf_dir)
    axes = runs.where("run_pos <= 2").select("item_key", F.col("run").alias("axe_id"), F.col("run_pos").alias("pos"), "seg_id")
    return paths.grow_axes(axes, runs.select("item_key", "seg_id", "run", "run_pos")).select("item_key", "axe_id", F.col("pos").cast("int").alias("pos"), "seg_id")


@query("WITH o AS (SELECT CAST(o_custkey % 8 AS VARCHAR) AS item_key, o_custkey AS run, o_totalprice AS l FROM orders) SELECT item_key, run, round(sum(l), 2) AS length, count(*) AS n FROM o GROUP BY 1, 2")
def d51_run_length(spark, sf_dir):
    runs = chain(spark, sf_dir)
    return measure.run_length(runs.select("item_key", "seg_id", "run"), runs.withColumnRenamed("o_totalprice", "length")).select("item_key", "run", F.round("length", 2).alias("length"), "n")


# reference and computed: finished and open orders of a customer ---------------------------

ROOTS = """WITH r AS (SELECT CAST(o_custkey % 8 AS VARCHAR) AS item_key, o_orderkey AS root_id, o_custkey AS plant, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS ord, o_totalprice AS length, o_orderstatus AS s FROM orders),
 m AS (SELECT f.item_key, f.plant FROM (SELECT DISTINCT item_key, plant FROM r WHERE s = 'F') f JOIN (SELECT DISTINCT plant FROM r WHERE s = 'O') o USING (plant))"""


def both_sides(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    rows = o.select(
        (F.col("o_custkey") % 8).cast("string").alias("item_key"),
        F.col("o_orderkey").alias("root_id"),
        F.col("o_custkey").alias("plant"),
        F.when(F.col("o_orderpriority") < "3", 1).otherwise(2).alias("ord"),
        F.col("o_totalprice").alias("length"),
        (F.col("o_orderkey") % 100).cast("double").alias("position"),
        F.lit(100.0).alias("parent_length"),
        "o_orderstatus",
    )
    ref, cmp = (rows.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FO")
    pairs = ref.select("item_key", F.col("plant").alias("i")).distinct().join(cmp.select("item_key", F.col("plant").alias("i")).distinct(), ["item_key", "i"])
    return pairs.withColumn("j", F.col("i")).withColumn("d", F.lit(0.0)), ref, cmp


@query(ROOTS + " SELECT r.item_key, plant AS plant_ref, plant AS plant_cmp, CASE WHEN s = 'F' THEN 'ref' ELSE 'cmp' END AS side, root_id FROM r JOIN m USING (plant) WHERE s IN ('F', 'O') AND ord = 2")
def c18_matched_roots(spark, sf_dir):
    return compare.matched_roots(*both_sides(spark, sf_dir), 2).select("item_key", "plant_ref", "plant_cmp", "side", "root_id")


@query(
    ROOTS
    + """ SELECT r.item_key, plant AS plant_ref, round(sum(CASE WHEN s = 'F' THEN length ELSE 0 END), 2) AS ref_all, round(sum(CASE WHEN s = 'F' AND ord = 1 THEN length ELSE 0 END), 2) AS ref_ord1,
    round(sum(CASE WHEN s = 'F' AND ord = 2 THEN length ELSE 0 END), 2) AS ref_ord2, round(sum(CASE WHEN s = 'O' THEN length ELSE 0 END), 2) AS cmp_all,
    round(sum(CASE WHEN s = 'O' AND ord = 1 THEN length ELSE 0 END), 2) AS cmp_ord1, round(sum(CASE WHEN s = 'O' AND ord = 2 THEN length ELSE 0 END), 2) AS cmp_ord2 FROM r JOIN m USING (plant) WHERE s IN ('F', 'O') GROUP BY 1, 2"""
)
def d22_total_lengths(spark, sf_dir):
    rows = compare.total_lengths(*both_sides(spark, sf_dir))
    return rows.select("item_key", "plant_ref", *[F.round(f"{s}_{n}", 2).alias(f"{s}_{n}") for s in ("ref", "cmp") for n in ("all", "ord1", "ord2")])


@query(
    ROOTS
    + """ SELECT r.item_key, plant AS plant_ref, CASE WHEN s = 'F' THEN 'ref' ELSE 'cmp' END AS side, count(*) AS n,
    string_agg(CAST(root_id % 100 AS VARCHAR) || ':' || CAST(CAST(round(length * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY root_id % 100, length) AS branches FROM r JOIN m USING (plant) WHERE s IN ('F', 'O') AND ord = 2 GROUP BY 1, 2, 3"""
)
def d23_branching(spark, sf_dir):
    rows = compare.branching(*both_sides(spark, sf_dir))
    text = F.transform("branches", lambda x: F.concat_ws(":", x["position"].cast("bigint"), F.round(x["length"] * 100).cast("bigint")))
    return rows.select("item_key", "plant_ref", "side", "n", F.array_join(text, ",").alias("branches"))


@query(
    ROOTS
    + """, l AS (SELECT plant, sum(CASE WHEN s = 'F' THEN length END) AS f, sum(CASE WHEN s = 'O' THEN length END) AS o FROM r JOIN m USING (plant) WHERE s IN ('F', 'O') GROUP BY 1),
    q AS (SELECT m.item_key AS label, o / f AS v FROM l JOIN m USING (plant)), t AS (SELECT label, count(*) AS n FROM q GROUP BY 1)
    SELECT label, CAST(least(floor(v / 4.0 * 8), 7) AS INTEGER) AS bin, round(sum(1.0 / n), 6) AS w FROM q JOIN t USING (label) WHERE v BETWEEN 0 AND 4 GROUP BY 1, 2"""
)
def d25_measurement_histogram(spark, sf_dir):
    pairs, ref, cmp = both_sides(spark, sf_dir)
    labels = pairs.select("item_key", F.col("item_key").alias("label")).distinct()
    rows = compare.measurement_histogram(compare.total_lengths(pairs, ref, cmp), labels, "all", 0.0, 4.0, 8)
    return rows.select("label", "bin", F.round("w", 6).alias("w"))


@query(
    """WITH f AS (SELECT DISTINCT o_custkey AS p FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey AS p FROM orders WHERE o_orderstatus = 'O')
    SELECT (SELECT count(*) FROM f JOIN o USING (p)) AS matched, (SELECT count(*) FROM f WHERE p NOT IN (SELECT p FROM o)) AS missed, (SELECT count(*) FROM o WHERE p NOT IN (SELECT p FROM f)) AS added"""
)
def d21_match_counters(spark, sf_dir):
    pairs, ref, cmp = both_sides(spark, sf_dir)
    lone = lambda df, k: match.unmatched(df.select("item_key", F.col("plant").alias(k)).distinct(), pairs, ["item_key"], k)
    return compare.match_counters({"plants": pairs, "plants_ref": lone(ref, "i"), "plants_cmp": lone(cmp, "j")})


GREEDY = """WITH RECURSIVE p AS ({pairs}),
 s AS (SELECT k, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS d, []::BIGINT[] AS ui, []::BIGINT[] AS uj FROM (SELECT DISTINCT k FROM p)
 UNION ALL SELECT k, x.i, x.j, x.d, list_append(ui, x.i), list_append(uj, x.j) FROM (SELECT s.k, s.ui, s.uj, min(struct_pack(d := p.d, i := p.i, j := p.j)) AS x FROM s JOIN p ON p.k = s.k
 WHERE NOT list_contains(s.ui, p.i) AND NOT list_contains(s.uj, p.j) GROUP BY 1, 2, 3))
 SELECT {key}, i, j, round(d, 4) AS d FROM s WHERE i IS NOT NULL"""


@query(
    GREEDY.format(
        key="k AS item_key",
        pairs="""SELECT CAST(c_nationkey AS VARCHAR) AS k, c_custkey AS i, s_suppkey AS j, round(sqrt(power((c_acctbal - s_acctbal) / 100, 2) + power(c_custkey % 100 - s_suppkey % 100, 2)), 9) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey""",
    )
)
def c05_plant_match(spark, sf_dir):
    """Customers and suppliers of a nation, by balance and number."""
    at = lambda t, p: b.table(spark, sf_dir, t).select(F.col(f"{p}_nationkey").cast("string").alias("item_key"), F.col({"c": "c_custkey", "s": "s_suppkey"}[p]).alias("plant"), (F.col(f"{p}_acctbal") / 100).alias("x"), (F.col({"c": "c_custkey", "s": "s_suppkey"}[p]) % 100).cast("double").alias("y"))
    return compare.plant_match(at("customer", "c"), at("supplier", "s"), digits=9).select("item_key", "i", "j", F.round("d", 4).alias("d"))


@query()
def c15_match_trees(spark, sf_dir):
    """Customers' orders as roots: a line of points for the lines of an order."""
    li, o = b.table(spark, sf_dir, "lineitem"), b.table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    pts = li.select("l_orderkey", pos.alias("pos"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"))
    rows = settle(o.join(pts, F.col("o_orderkey") == F.col("l_orderkey")))
    item = (F.col("o_custkey") % 8).cast("string").alias("item_key")
    level = F.when(F.col("o_orderpriority") < "3", 1).otherwise(2).alias("ord")
    side = lambda s: rows.where(F.col("o_orderstatus") == s)
    seeds = [side(s).select(item, F.col("o_custkey").alias("plant")).distinct().select("item_key", "plant", F.col("plant").cast("double").alias("x"), F.lit(0.0).alias("y")) for s in "FO"]
    roots = [side(s).select(item, F.col("o_orderkey").alias("root_id"), F.col("o_custkey").alias("plant"), level).distinct() for s in "FO"]
    points = [side(s).select(item, F.col("o_orderkey").alias("root_id"), "pos", "x", "y") for s in "FO"]
    return compare.match_trees(tuple(seeds), tuple(roots), tuple(points), most_plant=0.5)["roots"].select("item_key", "i", "j", F.round("d", 4).alias("d"))


# measures of axes -------------------------------------------------------------------------

SEGMENT = """seg AS (SELECT l_orderkey AS axe_id, l_linenumber AS pos, l_orderkey * 10 + l_linenumber AS seg_id, sum(l_quantity) AS length, (l_orderkey * 10 + l_linenumber) % 6 - 3 AS direction FROM lineitem GROUP BY 1, 2)"""


def segments(spark, sf_dir):
    """The lines of an order, end to end: line k runs from node k to node k + 1."""
    node = F.col("axe_id") * 10 + F.col("pos")
    return b.segments(spark, sf_dir).select("*", node.alias("n0"), (node + 1).alias("n1"), (F.pmod(F.col("seg_id"), F.lit(6)) - 3).cast("double").alias("direction"))


@query(f"""WITH {SEGMENT}, d AS (SELECT *, direction - lag(direction) OVER (PARTITION BY axe_id ORDER BY pos) AS t FROM seg)
    SELECT axe_id, pos, round(coalesce(t + pi() - 2 * pi() * floor((t + pi()) / (2 * pi())) - pi(), 0), 6) AS turn, round(length, 4) AS length FROM d""")
def e20_axis_turns(spark, sf_dir):
    s = segments(spark, sf_dir)
    return measure.axis_turns(s.select("item_key", "axe_id", "pos", "seg_id"), s).select("axe_id", "pos", F.round("turn", 6).alias("turn"), F.round("length", 4).alias("length"))


@query(
    f"""WITH {SEGMENT}, e AS (SELECT axe_id * 10 + pos AS n FROM seg UNION ALL SELECT axe_id * 10 + pos + 1 FROM seg) SELECT n AS node_id, count(*) AS degree, count(*) = 1 AS terminal FROM e GROUP BY 1"""
)
def h10_terminal_nodes(spark, sf_dir):
    return measure.terminal_nodes(segments(spark, sf_dir)).select("node_id", "degree", "terminal")


@query(
    f"""WITH {SEGMENT}, x AS (SELECT axe_id, pos, seg_id, lag(seg_id) OVER (PARTITION BY axe_id ORDER BY pos) AS before FROM seg), y AS (SELECT axe_id, arg_min(seg_id, pos) AS first FROM seg GROUP BY 1)
    SELECT axe_id, before AS parent_segment FROM x JOIN y USING (axe_id) WHERE seg_id = first"""
)
def e06_parent_segment(spark, sf_dir):
    s = segments(spark, sf_dir)
    before = F.lag("seg_id").over(Window.partitionBy("axe_id").orderBy("pos"))
    return measure.parent_segment(s.select("item_key", "axe_id", "pos", "seg_id"), s.withColumn("parent", before)).select("axe_id", "parent_segment")


@query("""WITH c AS (SELECT o_orderkey AS axe_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
    s AS (SELECT DISTINCT l_orderkey AS o FROM lineitem WHERE l_linenumber = 2) SELECT axe_id, s.o AS parent FROM c LEFT JOIN s ON s.o = p""")
def e07_parent_axe(spark, sf_dir):
    """The second line of the customer's order before is the parent segment."""
    s = segments(spark, sf_dir)
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    up = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("axe_id"), (before * 10 + 2).alias("parent_segment"))
    return measure.parent_axe(s.select("item_key", "axe_id", "pos", "seg_id"), up).select("axe_id", "parent")


@query(
    f"""WITH {SEGMENT}, a AS (SELECT axe_id, ord, row_number() OVER (ORDER BY axe_id) AS x FROM (SELECT o_orderkey AS axe_id, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS ord FROM orders)),
    r AS (SELECT seg_id % 1000 AS seg_id, ord * 1000000000 + axe_id AS k, axe_id FROM seg JOIN a USING (axe_id)) SELECT seg_id, arg_min(axe_id, k) AS axe_id FROM r GROUP BY 1"""
)
def e05_main_axe(spark, sf_dir):
    """Axes that share segments (numbers modulo 1000), by order, then id."""
    s = segments(spark, sf_dir).select("item_key", "axe_id", "pos", (F.col("seg_id") % 1000).alias("seg_id"))
    level = F.when(F.col("o_orderpriority") < "3", 1).otherwise(2)
    ranks = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("axe_id"), (level.cast("bigint") * 1000000000 + F.col("o_orderkey")).alias("rank"))
    return measure.main_axe(s, ranks).select("seg_id", "axe_id")


@query(
    f"""WITH {SEGMENT} SELECT axe_id, CAST(0 AS INTEGER) AS rank, axe_id * 10 + min(pos) AS node_id FROM seg GROUP BY 1
    UNION ALL SELECT axe_id, CAST(row_number() OVER (PARTITION BY axe_id ORDER BY pos) AS INTEGER), axe_id * 10 + pos + 1 FROM seg"""
)
def e09_axe_nodes(spark, sf_dir):
    s = segments(spark, sf_dir)
    none = s.select("item_key", "axe_id", F.lit(None).cast("bigint").alias("parent_segment")).distinct()
    return measure.axe_nodes(s.select("item_key", "axe_id", "pos", "seg_id"), s, none).select("axe_id", "rank", "node_id")


@query(
    f"""WITH {SEGMENT}, f AS (SELECT axe_id, arg_min(direction, pos) AS d FROM seg GROUP BY 1), c AS (SELECT o_orderkey AS axe_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
    x AS (SELECT f.axe_id, abs(f.d - s.direction) AS a FROM f JOIN c USING (axe_id) JOIN seg s ON s.axe_id = c.p AND s.pos = 2) SELECT axe_id, round(least(a, 2 * pi() - a), 6) AS angle FROM x"""
)
def e08_insertion_angle(spark, sf_dir):
    s = segments(spark, sf_dir)
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    up = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("axe_id"), (before * 10 + 2).alias("parent_segment"))
    return measure.insertion_angle(s.select("item_key", "axe_id", "pos", "seg_id"), up, s).select("axe_id", F.round("angle", 6).alias("angle"))


NEIGHBOURS = """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS n0, -l_partkey AS n1 FROM lineitem), e AS (SELECT id, n0 AS n, 0 AS side FROM s UNION ALL SELECT id, n1, 1 FROM s)"""


@query(NEIGHBOURS + " SELECT CAST(a.side AS INTEGER) AS side1, CAST(c.side AS INTEGER) AS side2, a.n AS node_id, count(*) AS n, CAST(sum(a.id % 1000 - c.id % 10) AS BIGINT) AS mark FROM e a JOIN e c ON a.n = c.n AND a.id <> c.id GROUP BY 1, 2, 3")
def c20_segment_neighbours(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    seg = li.select(F.lit("all").alias("item_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_id"), F.col("l_orderkey").alias("n0"), F.negate("l_partkey").alias("n1"))
    rows = graph.segment_neighbours(seg)
    return rows.groupBy("side1", "side2", "node_id").agg(F.count("*").alias("n"), F.sum(F.col("s1") % 1000 - F.col("s2") % 10).alias("mark"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS n1, o_custkey - 1 AS n0 FROM orders) SELECT a.id AS a, c.id AS b FROM o a JOIN o c ON a.n1 = c.n0 AND a.id <> c.id""")
def i14_digraph(spark, sf_dir):
    """Orders lead from the customer before to their own."""
    o = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("seg_id"), (F.col("o_custkey") - 1).alias("n0"), F.col("o_custkey").alias("n1"))
    return graph.digraph(o).select("a", "b")


@query(
    """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS item_key, c_custkey AS id, c_acctbal > 0 AS kept, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY id) - 1 AS n FROM c WHERE kept) SELECT a.item_key, CAST(a.n AS BIGINT) AS a, CAST(k.n AS BIGINT) AS b FROM k a JOIN k ON k.id = a.b"""
)
def b13_induced_subgraph(spark, sf_dir):
    """Customers with money, each joined to the next one of the nation."""
    after = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = b.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("item_key"), F.col("c_custkey").alias("node_id"), "c_acctbal", after.alias("b"))
    e = c.where("b is not null").select("item_key", F.col("node_id").alias("a"), "b")
    return catalog.induced_subgraph(c, e, c.where("c_acctbal > 0"))[1].select("item_key", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


# more joins and fits ------------------------------------------------------------------------

PART = """WITH p AS (SELECT p_brand AS brand, p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
 d AS (SELECT p.brand, p.id AS point_id, s.id AS seg_id, least(greatest(((p.x - s.x - 50) * 3.0 + (p.y - s.y) * 4.0) / 25.0, 0), 1) AS t, p.x - s.x - 50 AS dx, p.y - s.y AS dy FROM p JOIN p s USING (brand)),
 n AS (SELECT brand, point_id, seg_id, sqrt(power(dx - t * 3.0, 2) + power(dy - t * 4.0, 2)) AS d FROM d)"""


def point_and_segments(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    points = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("point_id"), x.alias("x"), y.alias("y"))
    segs = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("seg_id"), (x + 50).alias("x0"), y.alias("y0"), (x + 53.0).alias("x1"), (y + 4.0).alias("y1"))
    return points, segs


@query(PART + " SELECT brand, point_id, round(min(d), 4) AS d FROM n GROUP BY 1, 2")
def c08_nearest_segment(spark, sf_dir):
    """Segments stand off by 50, far beyond where the search starts."""
    return match.nearest_segment(*point_and_segments(spark, sf_dir), ["brand"]).select("brand", "point_id", F.round("d", 4).alias("d"))


@query(PART + ", a AS (SELECT brand, point_id, seg_id % 3 AS axe_id, min(d) AS d FROM n WHERE d <= 60 GROUP BY 1, 2, 3) SELECT brand, point_id, axe_id, round(d, 4) AS d FROM a")
def c08_nearest_per_axe(spark, sf_dir):
    points, segs = point_and_segments(spark, sf_dir)
    axes = segs.select("brand", "seg_id", (F.col("seg_id") % 3).alias("axe_id"))
    return match.nearest_of_axes(points, segs, axes, ["brand"], 60.0).select("brand", "point_id", "axe_id", F.round("d", 4).alias("d"))


@query(
    """WITH d AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS d2 FROM orders),
    g AS (SELECT k % 8 AS g, k, id, d FROM d WHERE r = 1 AND d < 0.7 * d2), n AS (SELECT g FROM g GROUP BY 1 HAVING count(*) >= 2) SELECT CAST(g AS BIGINT) AS grp, k AS query_id, id AS vec_id, d FROM g JOIN n USING (g)"""
)
def c12_ratio_test(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    rows = b.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("grp"), F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("vec_id"), F.col("o_totalprice").alias("d"), F.row_number().over(w).alias("rank"))
    return match.ratio_test(rows.where("rank <= 2"), ["grp"], 0.7, 2).select("grp", "query_id", "vec_id", "d")


PROJECTED = "WITH l AS (SELECT DISTINCT l_returnflag FROM lineitem) SELECT l_returnflag, CAST({} AS DOUBLE) AS a, CAST({} AS DOUBLE) AS b, CAST({} AS DOUBLE) AS c FROM l"


@query(PROJECTED.format(2, 3, 0.01))
def d53_homography(spark, sf_dir):
    """Points sent through a known homography give it back."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100 + F.col("l_linenumber")
    w = 0.01 * x - 0.002 * y + 1
    pairs = b.table(spark, sf_dir, "lineitem").select("l_returnflag", x.alias("x"), y.alias("y"), ((2 * x + 0.5 * y + 3) / w).alias("u"), ((x - y + 7) / w).alias("v"))
    m = match.homography(pairs, ["l_returnflag"])
    return m.select("l_returnflag", *[F.round(F.col("m")[i], 3).alias(n) for i, n in ((0, "a"), (2, "b"), (6, "c"))])


@query(PROJECTED.format(2, 3, -1))
def d53_affine(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    pairs = b.table(spark, sf_dir, "lineitem").select("l_returnflag", x.alias("x"), y.alias("y"), (2 * x + 0.5 * y + 3).alias("u"), (x - y + 7).alias("v"))
    m = match.normal_equations(pairs, ["l_returnflag"])
    return m.select("l_returnflag", *[F.round(F.col("m")[i], 3).alias(n) for i, n in ((0, "a"), (2, "b"), (4, "c"))])


@query("WITH l AS (SELECT DISTINCT l_returnflag AS k FROM lineitem) SELECT k AS item_key, CAST(CASE WHEN k = 'N' THEN 1 ELSE 2 END AS DOUBLE) AS a, CAST(CASE WHEN k = 'N' THEN 0 ELSE 3 END AS DOUBLE) AS b FROM l")
def e24_item_transforms(spark, sf_dir):
    """A tenth of the points are off; flag N is the reference."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100 + F.col("l_linenumber")
    off = F.when(F.col("l_partkey") % 10 == 0, 500.0).otherwise(0.0)
    pairs = b.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("item_key"), x.alias("x"), y.alias("y"), (2 * x + 0.5 * y + 3 + off).alias("u"), (x - y + 7 - off).alias("v"))
    m = match.item_transforms(pairs, "N")
    return m.select("item_key", F.round(F.col("m")[0], 3).alias("a"), F.round(F.col("m")[2], 3).alias("b"))


# statistics -----------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT user_id % 20 AS plant, CAST(month(ts) AS INTEGER) AS time, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS s, CAST(least(floor(value / 100.0 * 10), 9) AS INTEGER) AS bin FROM events WHERE value BETWEEN 0 AND 100),
    g AS (SELECT plant, time, bin, count(*) FILTER (s = 'a') AS a, count(*) FILTER (s = 'b') AS b FROM e GROUP BY 1, 2, 3),
    k AS (SELECT plant, time, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM g GROUP BY 1, 2)
    SELECT plant, time, round(CASE WHEN 10 * saa > sa * sa AND 10 * sbb > sb * sb THEN (10 * sab - sa * sb) / sqrt((10.0 * saa - sa * sa) * (10 * sbb - sb * sb)) END, 5) AS corr, CAST(sa + sb AS BIGINT) AS total FROM k"""
)
def d19_sequence_correlation(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("plant"), F.month("ts").alias("time"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("source"), "value")
    return stats.sequence_correlation(ev, "value", 0.0, 100.0, 10).select("plant", "time", F.round("corr", 5).alias("corr"), "total")


@query("""SELECT event_type AS prop, CAST(month(ts) AS INTEGER) AS frame, round(sum(value) / (count(DISTINCT user_id) * 5), 4) AS mean FROM events GROUP BY 1, 2""")
def d28_mean_by_property(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("prop"), F.month("ts").alias("frame"), "user_id", "value")
    return stats.mean_by_property(ev, ["prop", "frame"], "value", "user_id", 5).select("prop", "frame", F.round("mean", 4).alias("mean"))


@query(
    """WITH d AS (SELECT l_partkey % 50 AS node_id, CAST(least(floor((l_suppkey % 6 - 3 + pi()) / (2 * pi()) * 8), 7) AS INTEGER) AS bin, l_quantity AS q FROM lineitem)
    SELECT node_id, round(coalesce(sum(q) FILTER (bin = 0), 0), 4) AS b0, round(coalesce(sum(q) FILTER (bin = 3), 0), 4) AS b3, round(coalesce(sum(q) FILTER (bin = 6), 0), 4) AS b6 FROM d GROUP BY 1"""
)
def d52_crossing_descriptor(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select(F.lit("all").alias("item_key"), (F.col("l_partkey") % 50).alias("node_id"), (F.col("l_suppkey") % 6 - 3).cast("double").alias("direction"), F.col("l_quantity").alias("length"))
    return measure.crossing_descriptor(li).select("node_id", *[F.round(F.col("histogram")[k], 4).alias(f"b{k}") for k in (0, 3, 6)])


@query("""SELECT o_orderkey AS seg_id, CAST(floor(0.5 * o_totalprice / greatest(o_custkey / 100.0, 1.0) * 1000) AS BIGINT) AS thousandths FROM orders""")
def d50_segment_radius(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg_id"), F.col("o_totalprice").alias("area"), (F.col("o_custkey") / 100.0).alias("length"))
    return measure.segment_size(o).select("seg_id", F.floor(F.col("radius") * 1000).alias("thousandths"))


@query(
    """SELECT event_id, CASE WHEN 0.4 * exp(-power(value - 20, 2) / 1800.0) / 30 >= 0.6 * exp(-power(value - 60, 2) / 1250.0) / 25 THEN 0 ELSE 1 END AS class FROM events WHERE value IS NOT NULL"""
)
def d42_cluster_values(spark, sf_dir):
    params = spark.createDataFrame([("all", 0, 0.4, 20.0, 30.0), ("all", 1, 0.6, 60.0, 25.0)], "item_key string, class int, weight double, mean double, std double")
    ev = b.table(spark, sf_dir, "events").where("value is not null").withColumn("item_key", F.lit("all"))
    return stats.cluster_values(ev, ["item_key"], "value", params).select("event_id", "class")


@query(
    """WITH s AS (SELECT event_type AS k, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT a.k AS a, c.k AS b, round(power(a.m - c.m, 2) / (4 * a.s * a.s + c.s * c.s), 6) AS d FROM s a JOIN s c ON a.k < c.k"""
)
def d44_normal_distance(spark, sf_dir):
    s = b.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    other = s.withColumnsRenamed({"k": "k2", "m": "m2", "s": "s2"})
    return s.join(other, F.col("k") < F.col("k2")).select(F.col("k").alias("a"), F.col("k2").alias("b"), F.round(stats.normal_distance(F.col("m"), F.col("s"), F.col("m2"), F.col("s2")), 6).alias("d"))


@query("""WITH p AS (SELECT o_orderpriority AS o, o_orderstatus AS i, count(*) AS n FROM orders GROUP BY 1, 2) SELECT i AS status, o AS priority, n FROM p""")
def d31_inverted_map(spark, sf_dir):
    one = b.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    nested = one.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("groups"))
    return words.invert(nested, "o_orderpriority", "groups", "status").select("status", F.explode("groups").alias("priority", "n"))


@query(f"""WITH {b.WORDS_SQL} SELECT word, img, count(*) AS n, min(xmin) AS xmin FROM words GROUP BY 1, 2""")
def d55_box_matrix(spark, sf_dir):
    return words.box_table(b.words(spark, sf_dir)).select("word", "img", "n", F.col("box.xmin").alias("xmin"))


@query("""SELECT l_orderkey, l_linenumber, round(abs(l_quantity * (l_extendedprice + 1.0) - l_extendedprice * (l_quantity * 2.0)) / 2, 4) AS area FROM lineitem""")
def d48_polygon_area(spark, sf_dir):
    """The triangle of the origin, (quantity, price) and (2 quantity, price + 1)."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    ring = F.array(at(F.lit(0), F.lit(0)), at(q, p), at(q * 2, p + 1))
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(measure.polygon_area(ring), 4).alias("area"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < l_discount THEN l_partkey ELSE l_suppkey END AS n0, CASE WHEN l_tax < l_discount THEN l_suppkey ELSE l_partkey END AS n1 FROM lineitem""")
def h09_downward(spark, sf_dir):
    e = g.downward(F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_tax"), F.col("l_suppkey"), F.col("l_partkey"))
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", e["n0"].alias("n0"), e["n1"].alias("n1"))
