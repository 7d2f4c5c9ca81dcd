"""Queries over columns, records and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootweave.functions import geometry as g
from rootweave.functions import numbers as nb
from rootweave.functions import text as tx
from rootweave.iterate import settle
from rootweave.operators import catalog, measure, words
from rootweave.operators import raster as ra
from rootweave.plans import bindings as b
from rootweave.plans.catalogue import query
from rootweave.sources import text_files

# files and items -----------------------------------------------------------------------------

PATHS = r"""paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
 f AS (SELECT *, regexp_extract(path, '^(.*)/(.*)/([0-9]*)', 1) AS host, TRY_CAST(regexp_extract(path, '^(.*)/(.*)/([0-9]*)', 3) AS BIGINT) AS id FROM paths)"""


def page_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return b.table(spark, sf_dir, "pages").select("page_id", path.alias("filename"))


@query(f"WITH {PATHS} SELECT path AS filename, 'no cast' AS error FROM f WHERE id IS NULL")
def a03_rejected_rows(spark, sf_dir):
    return catalog.split_valid(catalog.parse_paths(page_paths(spark, sf_dir), "[host:str]/[lang:str]/[id:int]"))[1].select("filename", "error")


@query(f"""WITH {PATHS}, r AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(path, '[^/]*$', '') ORDER BY path, page_id) - 1 AS place FROM f WHERE id IS NOT NULL)
    SELECT page_id, id, CASE WHEN place >= 2 THEN 'B' ELSE 'A' END AS grp, CASE WHEN place >= 2 THEN '1' ELSE '5' END AS nitrate FROM r""")
def a01_items_by_ini(spark, sf_dir):
    ini = "[PATTERN]\npattern=[host:str]/[lang:str]/[id:int]\ngroup=0:A, 2:B\n[metadata]\nnitrate=5\n[A]\nxp=x\n[B]\nnitrate=1\n"
    good, _ = catalog.make_items(page_paths(spark, sf_dir), ini)
    return good.select("page_id", "metadata.id", F.col("group").alias("grp"), F.col("extra")["nitrate"].alias("nitrate"))


TRACED = """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey AS id, CAST(o_orderkey % 5 AS INTEGER) AS type, CAST(o_orderkey % 3 AS INTEGER) AS cluster FROM orders)"""


def traced_lines(spark, sf_dir):
    """Every customer's orders as a file of tracings, their two points from key and price."""
    o = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file"), "o_orderkey", F.floor("o_totalprice").cast("int").alias("p"))
    text = F.array(
        F.lit("// Tracing"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 5).cast("string"), (F.col("o_orderkey") % 3).cast("string"), F.lit("Default"),
        F.lit("// Segment 1 of 1"), F.lit("10"), F.col("p").cast("string"), F.lit("20"), (F.col("p") + 1).cast("string"),
    )
    lines = o.select("file", "o_orderkey", F.posexplode(text).alias("k", "value"))
    return lines.select("file", (F.col("o_orderkey") * 10 + F.col("k")).alias("line"), "value")


@query(TRACED + " SELECT file, CAST(id AS INTEGER) AS tracing_id, type, cluster FROM t")
def a11_traced_roots(spark, sf_dir):
    return text_files.parse_tracings(traced_lines(spark, sf_dir))[0].select("file", "tracing_id", "type", "cluster")


@query("""WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS file, CAST(o_orderkey AS INTEGER) AS tracing_id, CAST(floor(o_totalprice) AS INTEGER) AS v FROM orders)
    SELECT file, tracing_id, 0 AS pos, 10 AS x, v AS y FROM p UNION ALL SELECT file, tracing_id, 1, 20, v + 1 FROM p""")
def a11_traced_points(spark, sf_dir):
    return text_files.parse_tracings(traced_lines(spark, sf_dir))[1].select("file", "tracing_id", "pos", "x", "y")


@query(
    TRACED
    + """, v AS (SELECT *, CASE WHEN cluster >= 1 THEN cluster END AS c, CASE WHEN type - 2 >= 1 THEN type - 2 END AS k FROM t)
    SELECT file, id AS tracing_id, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY file ORDER BY id ROWS UNBOUNDED PRECEDING), 1) AS plant,
    coalesce(k, max(k) OVER (PARTITION BY file), 1) AS ord, c IS NULL OR k IS NULL AS fixed FROM v"""
)
def a13_fixed_tracings(spark, sf_dir):
    t = text_files.parse_tracings(traced_lines(spark, sf_dir))[0]
    return text_files.fix_tracings(t).select("file", F.col("tracing_id").cast("bigint").alias("tracing_id"), "plant", "ord", "fixed")


@query(f"WITH {PATHS} SELECT page_id FROM f WHERE regexp_replace(path, '\\.[^./]*$', '') IN (SELECT regexp_replace(path, '\\.[^./]*$', '') FROM f WHERE page_id % 3 = 0)")
def a12_reference_items(spark, sf_dir):
    rows = page_paths(spark, sf_dir).withColumn("item_key", tx.item_key(F.col("filename")))
    traced = rows.where("page_id % 3 = 0").select(F.concat("item_key", F.lit(".ndf")).alias("filename"))
    return text_files.reference_items(rows, traced).select("page_id")


@query("""SELECT c_custkey, CAST(c_nationkey * 0.5 AS DOUBLE) AS scale FROM customer WHERE c_nationkey < 20""")
def a14_scales(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation").where("n_nationkey < 20")
    lines = n.select((F.col("n_nationkey") + 1).alias("line"), F.concat(F.lit("n"), "n_nationkey", F.lit(" = "), F.col("n_nationkey") * 0.5).alias("value"))
    parts, scales = text_files.parse_scales(lines.union(spark.createDataFrame([(0, "1")], "line int, value string")))
    items = b.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("x/n"), "c_nationkey").alias("item_key"))
    return text_files.set_scales(items, scales, parts)[0].select("c_custkey", "scale")


@query("""SELECT o_orderkey AS plant, CAST(o_custkey * 0.5 AS DOUBLE) AS geometry, CAST(o_custkey * 0.25 AS DOUBLE) AS topology, 'k' || CAST(o_custkey % 10 AS VARCHAR) AS key FROM orders""")
def a19_structure_scores(spark, sf_dir):
    line = F.concat_ws(" ", F.concat(F.lit("k"), F.col("o_custkey") % 10), "o_orderkey", F.col("o_custkey") * 0.5, F.col("o_custkey") * 0.25)
    return text_files.parse_scores(b.table(spark, sf_dir, "orders").select(line.alias("value"))).select("plant", "geometry", "topology", "key")


@query("""SELECT o_orderkey AS img_id, '/data/' || o_orderpriority AS path FROM orders""")
def a18_image_ids(spark, sf_dir):
    line = F.concat(F.lit("img="), "o_orderkey", F.lit("\tpath="), "o_orderpriority")
    kv = text_files.parse_key_values(b.table(spark, sf_dir, "orders").select(line.alias("value")))
    return text_files.image_ids(text_files.split_image_list(kv)[1], "/data").select("img_id", "path")


@query("""SELECT o_orderkey, o_custkey AS box, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS frame FROM orders""")
def a22_time_lapse(spark, sf_dir):
    name = F.concat(F.lit("Boite "), "o_custkey", F.lit("/Sequence "), "o_orderkey", F.lit("/x.jpg"))
    rows = text_files.time_lapse(b.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("filename")))
    return rows.select("o_orderkey", "box", F.col("frame").cast("int").alias("frame"))


@query(f"""WITH {b.WORDS_SQL}, s AS (SELECT DISTINCT img, word FROM words), l AS (SELECT img, string_agg(CAST(word AS VARCHAR), ' ' ORDER BY word) AS line FROM s GROUP BY 1)
    SELECT i AS img, coalesce(line, '') AS line FROM (SELECT unnest(range(0, (SELECT max(img) + 1 FROM words))) AS i) LEFT JOIN l ON img = i""")
def a23_item_set_lines(spark, sf_dir):
    return words.item_set_lines(words.item_sets(b.words(spark, sf_dir)), "img")


# records ----------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS k, event_type AS t FROM events""")
def b05_merged_records(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events")
    first, second = F.create_map(F.lit("k"), F.lit("none"), F.lit("t"), F.col("event_type")), F.create_map(F.lit("k"), F.col("user_id").cast("string"))
    m = catalog.merge_maps(first, second)
    return ev.select("event_id", m["k"].alias("k"), m["t"].alias("t"))


@query("""SELECT event_id, value * 2 AS v, user_id AS u FROM events""")
def b06_nested_assignment(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").select("event_id", "value", F.struct(F.struct(F.col("value").alias("v")).alias("sub"), F.col("user_id").alias("u")).alias("m"))
    return ev.withColumn("m", catalog.assign("m", "sub.v", F.col("value") * 2)).select("event_id", "m.sub.v", "m.u")


@query("""SELECT event_id, value FROM events""")
def b07_without_temporary(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").select("event_id", "value", F.lit(1).alias("_tmp"), F.lit(2).alias("_x"))
    return catalog.drop_temporary(ev)


@query("""SELECT l_orderkey, l_linenumber, (l_tax IS NOT DISTINCT FROM l_discount) AND l_partkey % 2 = l_suppkey % 2 AS same FROM lineitem""")
def b09_equal_records(spark, sf_dir):
    one, two = F.struct(F.col("l_tax").alias("a"), (F.col("l_partkey") % 2).alias("b")), F.struct(F.col("l_discount").alias("a"), (F.col("l_suppkey") % 2).alias("b"))
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", catalog.equal_records(one, two, ["a", "b"]).alias("same"))


@query("""SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 200000)""")
def b11_key_mask(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    return catalog.key_mask(o, ["o_custkey", "o_orderstatus"], o.where("o_totalprice > 200000")).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 4 <> 0 AND l_suppkey % 3 <> 0""")
def b14_valid_segments(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4).alias("n0"), (F.col("l_suppkey") % 3).alias("n1"))
    return catalog.valid_segments(li).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey AS word FROM part WHERE p_partkey IN (3, 5, 8) OR regexp_matches(p_name, '^[a-c]') OR regexp_matches(p_name, '7$')""")
def b15_words_by(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("word"), F.col("p_name").alias("file"))
    return catalog.words_by(p, [3, 5, 8], "^[a-c]|7$").select("word")


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderstatus, o_totalprice, o_orderkey) AS BIGINT) AS place FROM orders""")
def f02_sorted(spark, sf_dir):
    """All orders in sorted order, numbered."""
    rows = catalog.sort_by(b.table(spark, sf_dir, "orders"), ["o_orderstatus", "o_totalprice"], "o_orderkey")
    return catalog.numbered(rows.select("o_orderkey"), "place")


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY TRY_CAST(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1) AS BIGINT), c_custkey) - 1 AS INTEGER) AS place FROM customer""")
def f07_numeric_order(spark, sf_dir):
    return catalog.numeric_order(b.table(spark, sf_dir, "customer"), "c_name", ["c_nationkey", "c_custkey"]).select("c_custkey", F.col("place").cast("int").alias("place"))


# scalar functions ----------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) || '.5' WHEN 2 THEN '[' || CAST(user_id AS VARCHAR) || ', x]' ELSE event_type END AS s, event_id % 4 AS k, user_id, event_type FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'list' ELSE 'str' END AS kind, CASE k WHEN 0 THEN user_id * 1.0 WHEN 1 THEN user_id + 0.5 END::DOUBLE AS number,
    CASE WHEN k = 2 THEN CAST(user_id AS VARCHAR) || '|x' END AS items, CASE WHEN k = 3 THEN event_type END AS text FROM t"""
)
def h02_typed_literals(spark, sf_dir):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    s = F.when(k == 0, u).when(k == 1, F.concat(u, F.lit(".5"))).when(k == 2, F.concat(F.lit("["), u, F.lit(", x]"))).otherwise(F.col("event_type"))
    ev = b.table(spark, sf_dir, "events").select("event_id", tx.typed_literal(s).alias("v"))
    return ev.select("event_id", "v.kind", "v.number", F.array_join("v.items", "|").alias("items"), "v.text")


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders""")
def h03_parsed_dates(spark, sf_dir):
    t = F.concat(F.lit("img_"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", tx.field(t, "^img_(.*)$", 1, "date").alias("t"))
    return rows.select("o_orderkey", F.year("t").alias("y"), F.dayofmonth("t").alias("d"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '/base/' || regexp_replace(url, '^[a-z]+://', '') END AS path, replace(url, '/', '_') AS key FROM pages""")
def h05_absolute_paths(spark, sf_dir):
    own = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^[a-z]+://", ""))
    return b.table(spark, sf_dir, "pages").select("page_id", tx.absolute(own, "/base").alias("path"), tx.safe_key(F.col("url")).alias("key"))


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber, abs(l_suppkey % 6 - l_partkey % 6) * 1.0 AS d, l_tax < l_discount AS same, l_suppkey % 6 - 3.0 AS a FROM lineitem), e AS (SELECT *, least(d, 2 * pi() - d) AS m FROM d)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN same THEN pi() - m ELSE m END, 6) AS turn, round(a + CASE WHEN same THEN pi() ELSE 0 END - 2 * pi() * floor((a + CASE WHEN same THEN pi() ELSE 0 END) / (2 * pi())), 6) AS way FROM e"""
)
def h11_direction_difference(spark, sf_dir):
    same = F.col("l_tax") < F.col("l_discount")
    one, two = (F.col("l_suppkey") % 6).cast("double"), (F.col("l_partkey") % 6).cast("double")
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(g.direction_difference(one, two, same), 6).alias("turn"), F.round(g.flipped_direction(one - 3, same), 6).alias("way")
    )


@query("""SELECT l_orderkey, l_linenumber, round((abs(l_tax * 3 - l_discount * l_quantity) + abs(l_quantity * 2 - l_tax * 5)) / 2, 4) AS area FROM lineitem""")
def h17_projection_area(spark, sf_dir):
    """Segment (0,0)-(tax, quantity... ) and a projection given by other columns."""
    z, t, q, d = F.lit(0.0), F.col("l_tax"), F.col("l_quantity"), F.col("l_discount")
    # the segment runs from the origin by (t, q); its first end is projected to (d, 3), the other one so that the gap is (5, 2) back
    p2x, p2y = t + 5, q + 2
    area = (F.abs(t * 3 - q * d) + F.abs((p2x - d) * (p2y - q) - (p2y - 3) * (p2x - t))) / 2
    own = g.projection_area(z, z, t, q, d, F.lit(3.0), p2x, p2y)
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.when(F.abs(own - area) < 1e-6, (F.abs(t * 3 - d * q) + F.abs(q * 2 - t * 5)) / 2), 4).alias("area"))


@query(
    """SELECT l_orderkey, l_linenumber, round(l_quantity + cos(l_tax) * -5 - sin(l_tax) * -1, 5) AS x0, round(l_discount + sin(l_tax) * 5 + cos(l_tax) * 1, 5) AS y2, round(l_quantity + cos(l_tax) * 10 - sin(l_tax) * 2, 5) AS x2 FROM lineitem"""
)
def h24_rectangles(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    one, two = g.rectangle_corners(q, d, F.lit(10.0), F.lit(2.0), t), g.rectangle_from_corner(q, d, F.lit(10.0), F.lit(2.0), t)
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(one[0]["x"], 5).alias("x0"), F.round(one[2]["y"], 5).alias("y2"), F.round(two[2]["x"], 5).alias("x2"))


@query(
    """WITH h AS (SELECT l_orderkey, l_linenumber, l_tax * 100 AS a, l_discount * 100 AS b, l_quantity - 25.0 AS c FROM lineitem), e AS (SELECT *, (a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b) AS one, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS two FROM h),
    s AS (SELECT *, CASE WHEN abs(one) <= abs(two) THEN one ELSE two END AS l1 FROM e) SELECT l_orderkey, l_linenumber, round(l1, 5) AS l1, round(a + c - l1, 5) AS l2,
    round(CASE WHEN a + c - l1 < 0 THEN 0 ELSE exp(-power(l1 / CASE WHEN a + c - l1 = 0 THEN 1e-12 ELSE a + c - l1 END, 2) / 0.5) * (1 - exp(-(l1 * l1 + power(a + c - l1, 2)) / 450.0)) END, 5) AS v FROM s"""
)
def h21_eigenvalues(spark, sf_dir):
    e = nb.eigenvalues(F.col("l_tax") * 100, F.col("l_discount") * 100, F.col("l_quantity") - 25.0)
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", e.alias("e"))
    return rows.select("l_orderkey", "l_linenumber", F.round("e.l1", 5).alias("l1"), F.round("e.l2", 5).alias("l2"), F.round(nb.vesselness(F.col("e.l1"), F.col("e.l2")), 5).alias("v"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL AS number FROM events""")
def h27_type_tests(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return b.table(spark, sf_dir, "events").select("event_id", nb.as_whole(k).alias("k"), nb.is_number(k).alias("number"))


# rasters -----------------------------------------------------------------------------------------

R = f"WITH {b.RASTER_SQL}"
#: Supplier and part numbers folded to a dense raster, one for each return flag.
DENSE = """r AS (SELECT l_returnflag AS item_key, CAST(l_suppkey % 20 AS INTEGER) AS y, CAST(l_partkey % 30 AS INTEGER) AS x, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)"""
D = f"WITH {DENSE}"


def dense(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_returnflag").alias("item_key"), (F.col("l_suppkey") % 20).cast("int").alias("y"), (F.col("l_partkey") % 30).cast("int").alias("x"))
    return settle(rows.agg(F.sum("l_quantity").cast("bigint").cast("double").alias("v")))


def shape(spark):
    return spark.createDataFrame([(k, 20, 30) for k in "ANR"], "item_key string, height int, width int")


def mean_above(spark, sf_dir):
    """The dense raster and its cells above the item's mean."""
    r = dense(spark, sf_dir)
    mean = r.groupBy("item_key").agg(F.avg("v").alias("m"))
    return r, settle(r.join(mean, "item_key").where("v > m").select("item_key", "y", "x", "v"))


MASK = f"""{D}, q AS (SELECT item_key, avg(v) AS m FROM r GROUP BY 1), m AS (SELECT r.* FROM r JOIN q USING (item_key) WHERE v > q.m)"""


@query(f"""WITH {b.RASTER_SQL}, f AS (SELECT y, x FROM raster WHERE v > 100), d AS (SELECT r.y, r.x, min(power(r.y - f.y, 2) + power(r.x - f.x, 2)) AS d,
 min(greatest(abs(r.y - f.y), abs(r.x - f.x))) AS c FROM raster r, f GROUP BY 1, 2) SELECT y, x, round(sqrt(d), 6) AS d, CAST(c AS DOUBLE) AS c FROM d""")
def e15_sparse_distances(spark, sf_dir):
    """Distances on a raster with gaps to its few cells of high value."""
    r = settle(b.raster(spark, sf_dir))
    high = r.where("v > 100")
    near = ra.distance_transform(r, high).select("y", "x", F.round("d", 6).alias("d"))
    return near.join(ra.distance_transform(r, high, "chessboard").select("y", "x", F.col("d").alias("c")), ["y", "x"])


@query(MASK + ", d AS (SELECT r.item_key, r.y, r.x, min(power(r.y - m.y, 2) + power(r.x - m.x, 2)) AS d FROM r JOIN m USING (item_key) GROUP BY 1, 2, 3) SELECT item_key, y, x, round(sqrt(d), 6) AS d FROM d")
def e15_distance_transform(spark, sf_dir):
    r, mask = mean_above(spark, sf_dir)
    return ra.distance_transform(r, mask).select("item_key", "y", "x", F.round("d", 6).alias("d"))


@query(MASK + ", d AS (SELECT r.item_key, r.y, r.x, min(abs(r.y - m.y) + abs(r.x - m.x)) AS t, min(greatest(abs(r.y - m.y), abs(r.x - m.x))) AS c FROM r JOIN m USING (item_key) GROUP BY 1, 2, 3) SELECT item_key, y, x, CAST(t AS DOUBLE) AS t, CAST(c AS DOUBLE) AS c FROM d")
def e15_other_distances(spark, sf_dir):
    r, mask = mean_above(spark, sf_dir)
    t = ra.distance_transform(r, mask, "taxicab").select("item_key", "y", "x", F.col("d").alias("t"))
    return t.join(ra.distance_transform(r, mask, "chessboard").select("item_key", "y", "x", F.col("d").alias("c")), ["item_key", "y", "x"])


@query(f"""{D}, k AS (SELECT unnest(range(-3, 4)) AS d), w AS (SELECT d, exp(-d * d / 2.0) AS w FROM k),
    a AS (SELECT r.item_key, r.y, r.x, sum(o.v * w) / sum(w) AS v FROM r JOIN w ON true JOIN r o ON o.item_key = r.item_key AND o.y = r.y AND o.x = r.x + d GROUP BY 1, 2, 3)
    SELECT a.item_key, a.y, a.x, round(sum(o.v * w) / sum(w), 4) AS v FROM a JOIN w ON true JOIN a o ON o.item_key = a.item_key AND o.x = a.x AND o.y = a.y + d GROUP BY 1, 2, 3""")
def e12_smoothing(spark, sf_dir):
    return ra.smooth(dense(spark, sf_dir), 1.0).select("item_key", "y", "x", F.round("v", 4).alias("v"))


BOX = "SELECT r.item_key, r.y, r.x, {fn}(o.v) AS v FROM {source} r JOIN {source} o ON o.item_key = r.item_key AND abs(o.y - r.y) <= {k} AND abs(o.x - r.x) <= {k} GROUP BY 1, 2, 3"
#: A pass along x, then one along y: at a hole each pass sees the cells that are there.
PASSES = """SELECT item_key, y, x, {fn}(v) OVER (PARTITION BY item_key, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v
 FROM (SELECT item_key, y, x, {fn}(v) OVER (PARTITION BY item_key, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {source})"""


@query(f"{D}, a AS ({PASSES.format(fn='min', source='r')}) {PASSES.format(fn='max', source='a')}")
def e13_grey_opening(spark, sf_dir):
    return ra.grey_opening(dense(spark, sf_dir), 1).select("item_key", "y", "x", "v")


@query(f"{D}, a AS ({PASSES.format(fn='max', source='r')}) {PASSES.format(fn='min', source='a')}")
def e13_grey_closing(spark, sf_dir):
    return ra.grey_closing(dense(spark, sf_dir), 1).select("item_key", "y", "x", "v")


@query(f"{D} {BOX.format(fn='median', source='r', k=1)}")
def e11_median(spark, sf_dir):
    return ra.median_filter(dense(spark, sf_dir), ra.square(1)).select("item_key", "y", "x", "v")


@query(
    f"""{D}, n AS (SELECT r.*, u.v AS up, d.v AS down, l.v AS le, g.v AS ri FROM r LEFT JOIN r u ON u.item_key = r.item_key AND u.x = r.x AND u.y = r.y - 1 LEFT JOIN r d ON d.item_key = r.item_key AND d.x = r.x AND d.y = r.y + 1
    LEFT JOIN r l ON l.item_key = r.item_key AND l.y = r.y AND l.x = r.x - 1 LEFT JOIN r g ON g.item_key = r.item_key AND g.y = r.y AND g.x = r.x + 1)
    SELECT item_key, y, x, CASE WHEN up IS NOT NULL AND down IS NOT NULL THEN (down - up) / 2 ELSE coalesce(down - v, v - up, 0) END AS gy, CASE WHEN le IS NOT NULL AND ri IS NOT NULL THEN (ri - le) / 2 ELSE coalesce(ri - v, v - le, 0) END AS gx,
    coalesce(up, v) + coalesce(down, v) - 2 * v AS yy, coalesce(le, v) + coalesce(ri, v) - 2 * v AS xx FROM n"""
)
def e14_derivatives(spark, sf_dir):
    r = dense(spark, sf_dir)
    one, two = ra.gradient(r).select("item_key", "y", "x", "gy", "gx"), ra.second_derivatives(r).select("item_key", "y", "x", "yy", "xx")
    return one.join(two, ["item_key", "y", "x"])


@query(f"{D}, s AS (SELECT item_key, min(v) AS lo, max(v) AS hi FROM r GROUP BY 1), f AS (SELECT r.*, (v - lo) / (hi - lo) AS f FROM r JOIN s USING (item_key)), m AS (SELECT item_key, avg(f) AS m FROM f GROUP BY 1) SELECT item_key, y, x, round(CASE WHEN m > 0.5 THEN 1 - f ELSE f END, 6) AS v FROM f JOIN m USING (item_key)")
def h19_normalised_image(spark, sf_dir):
    return ra.normalise_image(dense(spark, sf_dir)).select("item_key", "y", "x", F.round("v", 6).alias("v"))


@query(f"""{D}, g AS (SELECT k AS item_key, a AS y, c AS x FROM (SELECT unnest(['A', 'N', 'R']) AS k), (SELECT unnest(range(0, 24)) AS a), (SELECT unnest(range(0, 34)) AS c))
    SELECT g.item_key, CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, r.v FROM g LEFT JOIN r ON r.item_key = g.item_key AND r.y = least(greatest(g.y - 2, 0), 19) AND r.x = least(greatest(g.x - 2, 0), 29)""")
def h26_padded(spark, sf_dir):
    return ra.pad(dense(spark, sf_dir), shape(spark), 2).select("item_key", "y", "x", "v")


@query(f"""{D}, g AS (SELECT k AS item_key, a AS y, c AS x FROM (SELECT unnest(['A', 'N', 'R']) AS k), (SELECT unnest(range(0, 15)) AS a), (SELECT unnest(range(0, 15)) AS c))
    SELECT g.item_key, CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, coalesce(r.v, -1) AS v FROM g LEFT JOIN r ON r.item_key = g.item_key AND r.y = g.y + 3 AND r.x = 2 * g.x + 1""")
def h15_resampled(spark, sf_dir):
    return ra.resample(dense(spark, sf_dir), [2, 0, 1, 0, 1, 3, 0, 0, 1], 15, 15, outside=-1.0).select("item_key", "y", "x", "v")


@query(MASK + " SELECT r.item_key, r.y, r.x, CASE WHEN m.y IS NULL THEN r.v ELSE m.v * 2 END AS v FROM r LEFT JOIN m USING (item_key, y, x)")
def h16_stitched(spark, sf_dir):
    r, mask = mean_above(spark, sf_dir)
    return ra.stitch(mask.withColumn("v", F.col("v") * 2), r).select("item_key", "y", "x", "v")


ERODED = "e AS (SELECT m.item_key, m.y, m.x FROM m JOIN m o ON o.item_key = m.item_key AND abs(o.y - m.y) + abs(o.x - m.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 5)"


@query(f"{MASK}, {ERODED} SELECT DISTINCT e.item_key, CAST(e.y + o.dy AS INTEGER) AS y, CAST(e.x + o.dx AS INTEGER) AS x FROM e, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx)")
def j03_opening(spark, sf_dir):
    return ra.opening(mean_above(spark, sf_dir)[1], [(0, 0), *ra.N4]).select("item_key", "y", "x")


@query(
    f"""{MASK}, l AS (SELECT *, CAST(y * 3 + x AS INTEGER) AS label FROM m), d AS (SELECT r.item_key, r.y, r.x, min(power(r.y - m.y, 2) + power(r.x - m.x, 2)) AS d FROM r JOIN m USING (item_key) GROUP BY 1, 2, 3)
    SELECT item_key, y, x FROM d WHERE d <= 2.25"""
)
def j05_label_dilation(spark, sf_dir):
    r, mask = mean_above(spark, sf_dir)
    return ra.label_dilation(mask.withColumn("label", F.col("y") * 3 + F.col("x")), r, 1.5).select("item_key", "y", "x")


@query(f"{MASK}, o AS (SELECT r.* FROM r ANTI JOIN m USING (item_key, y, x)), d AS (SELECT m.item_key, m.y, m.x, min(power(o.y - m.y, 2) + power(o.x - m.x, 2)) AS d FROM m JOIN o USING (item_key) GROUP BY 1, 2, 3) SELECT item_key, y, x FROM d WHERE d > 1")
def j05_label_erosion(spark, sf_dir):
    r, mask = mean_above(spark, sf_dir)
    return ra.label_erosion(mask.withColumn("label", F.lit(1)), r, 1.0).select("item_key", "y", "x")


#: Components of the mask by least cell number, spread until nothing changes.
LABELS = MASK.replace("WITH", "WITH RECURSIVE", 1) + """, n AS (SELECT item_key, y, x, y * 2147483648 + x AS id FROM m), e AS (SELECT a.item_key, a.id AS a, b.id AS b FROM n a JOIN n b ON a.item_key = b.item_key AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 reach AS (SELECT item_key, id AS a, id AS b FROM n UNION SELECT reach.item_key, reach.a, e.b FROM reach JOIN e ON e.item_key = reach.item_key AND e.a = reach.b),
 lab AS (SELECT n.item_key, n.y, n.x, min(b) AS label FROM n JOIN reach ON reach.item_key = n.item_key AND reach.a = n.id GROUP BY 1, 2, 3)"""


def labels(spark, sf_dir):
    r, mask = mean_above(spark, sf_dir)
    return r, settle(ra.label_components(mask))


@query(LABELS + " SELECT item_key, y, x, CAST(label AS BIGINT) AS label FROM lab")
def i06_mask_components(spark, sf_dir):
    return labels(spark, sf_dir)[1].select("item_key", "y", "x", "label")


@query(LABELS + " SELECT item_key, CAST(label AS BIGINT) AS label, count(*) AS cells, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, round(avg(x), 4) AS cx FROM lab GROUP BY 1, 2")
def d35_component_boxes(spark, sf_dir):
    return ra.label_table(labels(spark, sf_dir)[1]).select("item_key", "label", "cells", "y0", "y1", "x0", "x1", F.round("cx", 4).alias("cx"))


@query(LABELS + " SELECT item_key, CAST(label AS BIGINT) AS label, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean, round(sum(v * x) / sum(v), 4) AS mx FROM lab JOIN r USING (item_key, y, x) GROUP BY 1, 2")
def d36_component_statistics(spark, sf_dir):
    r, lab = labels(spark, sf_dir)
    return ra.label_statistics(lab, r).select("item_key", "label", "low", "high", F.round("mean", 4).alias("mean"), F.round("mx", 4).alias("mx"))


@query(LABELS + ", t AS (SELECT item_key, label, count(*) AS n FROM lab GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY n DESC, label) AS r FROM t) SELECT item_key, y, x FROM lab JOIN k USING (item_key, label) WHERE r <= 2")
def f04_biggest_components(spark, sf_dir):
    return ra.biggest(labels(spark, sf_dir)[1], 2).select("item_key", "y", "x")


@query(
    LABELS
    + """, t AS (SELECT item_key, label, count(*) AS n, avg(y) AS cy, avg(x) AS cx, min(x) AS x0 FROM lab GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY n DESC, label) AS r FROM t WHERE cx / 30 BETWEEN 0 AND 0.8 AND cy / 20 BETWEEN 0 AND 0.9),
    z AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY x0, label) AS new FROM k WHERE r <= 3) SELECT item_key, y, x, CAST(new AS INTEGER) AS label FROM lab JOIN z USING (item_key, label)"""
)
def f04_boxed_seeds(spark, sf_dir):
    return ra.box_seeds(labels(spark, sf_dir)[1], (0.0, 0.0, 0.8, 0.9), shape(spark), 3).select("item_key", "y", "x", "label")


@query(
    LABELS
    + """, t AS (SELECT item_key, label FROM lab GROUP BY 1, 2 HAVING count(*) >= 3 AND greatest(max(y) - min(y), max(x) - min(x)) + 1 >= 2)
    SELECT lab.item_key, y, x, CAST(dense_rank() OVER (PARTITION BY lab.item_key ORDER BY lab.label) AS INTEGER) AS label FROM lab JOIN t ON t.item_key = lab.item_key AND t.label = lab.label"""
)
def j04_clean_components(spark, sf_dir):
    return ra.clean_labels(labels(spark, sf_dir)[1], 3, 2).select("item_key", "y", "x", "label")


@query(LABELS + ", s AS (SELECT DISTINCT lab.item_key, label FROM lab JOIN r USING (item_key, y, x) JOIN q USING (item_key) WHERE r.v > 1.5 * q.m) SELECT item_key, y, x FROM lab JOIN s USING (item_key, label)")
def j07_hysteresis(spark, sf_dir):
    r = dense(spark, sf_dir)
    mean = r.groupBy("item_key").agg(F.avg("v").alias("m"))
    scaled = r.join(mean, "item_key").select("item_key", "y", "x", (F.col("v") / F.col("m")).alias("v"))
    return ra.hysteresis(scaled, 1.5, 1.0).select("item_key", "y", "x")


@query(MASK + ", d AS (SELECT r.item_key, r.y, r.x, min(power(r.y - m.y, 2) + power(r.x - m.x, 2)) AS d FROM r ANTI JOIN m USING (item_key, y, x) JOIN m ON m.item_key = r.item_key GROUP BY 1, 2, 3) SELECT item_key, y, x FROM m UNION ALL SELECT item_key, y, x FROM d WHERE sqrt(d) <= 2")
def c09_filled_cells(spark, sf_dir):
    r, mask = mean_above(spark, sf_dir)
    invalid = r.join(mask.select("item_key", "y", "x"), ["item_key", "y", "x"], "left_anti")
    return ra.fill_nearest(r, invalid, 2.0).select("item_key", "y", "x")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_custkey % 7 + 3 AS w, o_orderkey % 5 + 2 AS h FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS item_key, count(*) AS cells FROM c, (SELECT unnest(range(0, 12)) AS y), (SELECT unnest(range(0, 12)) AS x) WHERE x > 0.5 AND x < w + 0.5 AND y > 0.5 AND y < h + 0.5 GROUP BY 1""")
def h25_filled_polygons(spark, sf_dir):
    w, h = F.col("o_custkey") % 7 + 3.5, F.col("o_orderkey") % 5 + 2.5
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lo = F.lit(0.5)
    rings = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_key"), F.array(at(lo, lo), at(w, lo), at(w, h), at(lo, h)).alias("ring"))
    return ra.fill_polygon(rings).groupBy("item_key").agg(F.count("*").alias("cells"))


@query("""SELECT o_orderkey AS seg_id, count(DISTINCT k) AS cells FROM (SELECT o_orderkey, unnest(range(0, greatest(o_custkey % 9, o_orderkey % 6) + 1)) AS k FROM orders) GROUP BY 1""")
def h25_line_cells(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("seg_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), (F.col("o_custkey") % 9).alias("x1"), (F.col("o_orderkey") % 6).alias("y1"))
    return ra.line_cells(o).groupBy("seg_id").agg(F.count("*").alias("cells"))


@query()
def h22_vesselness(spark, sf_dir):
    return ra.vesselness(dense(spark, sf_dir), [1.0, 2.0]).select("item_key", "y", "x", F.round("v", 6).alias("v"), "ridge")


@query()
def j11_skeleton(spark, sf_dir):
    return ra.thin(mean_above(spark, sf_dir)[1]).select("item_key", "y", "x")


@query()
def j09_watershed(spark, sf_dir):
    r = dense(spark, sf_dir)
    return ra.watershed(r, settle(ra.label_components(ra.local_minima(r, 3)))).select("item_key", "y", "x", "label")


@query()
def f05_best_circles(spark, sf_dir):
    r, lab = labels(spark, sf_dir)
    return ra.best_circles(lab, r, 2).select("item_key", "label", F.round("radius", 4).alias("radius"), F.round("quality", 4).alias("quality"))
