"""All queries over the driver's tables, with their SQL.

A query is named after the operator it runs.  Floats are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rootweave.functions import geometry as g
from rootweave.functions import numbers as nb
from rootweave.functions import text as tx
from rootweave.iterate import settle
from rootweave.operators import catalog, graph, match, measure, paths, stats, words
from rootweave.operators import raster as ra
from rootweave.plans import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _load() -> None:
    """Modules that register queries of their own."""
    from rootweave.plans import growth_queries, scalar_queries, tree_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d04_plant_statistics(spark, sf_dir)


# A: catalogue -----------------------------------------------------------------------

PAGES = r"""paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"""


def _paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return b.table(spark, sf_dir, "pages").select("page_id", path.alias("filename"))


@query(
    f"""WITH {PAGES}, f AS (SELECT *, regexp_extract(path, '^(.*)/(.*)/([0-9]*)', 1) AS host, regexp_extract(path, '^(.*)/(.*)/([0-9]*)', 2) AS lang,
    TRY_CAST(regexp_extract(path, '^(.*)/(.*)/([0-9]*)', 3) AS BIGINT) AS id, regexp_matches(path, '^(.*)/(.*)/([0-9]*)') AS m FROM paths)
    SELECT page_id, CASE WHEN m THEN host END AS host, CASE WHEN m THEN lang END AS lang, CASE WHEN m THEN id END AS id,
    coalesce(m AND id IS NOT NULL, false) AS valid, regexp_replace(regexp_replace(path, '^/+', ''), '\\.[^./]*$', '') AS item_key FROM f"""
)
def a02_pattern_metadata(spark, sf_dir):
    rows = catalog.parse_paths(_paths(spark, sf_dir), "[host:str]/[lang:str]/[id:int]")
    return rows.select("page_id", "metadata.host", "metadata.lang", "metadata.id", "valid", "item_key")


@query(
    f"""WITH {PAGES}, f AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM paths),
    r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path, page_id) - 1 AS place FROM f)
    SELECT count(*) AS n, CASE WHEN place >= 3 THEN 'C' WHEN place >= 1 THEN 'B' ELSE 'A' END AS grp FROM r GROUP BY 2"""
)
def a04_positional_group(spark, sf_dir):
    return catalog.positional_group(_paths(spark, sf_dir), {0: "A", 1: "B", 3: "C"}).groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("n"))


@query(
    """SELECT 'l' || CAST(l_linenumber AS VARCHAR) AS section, count(*) AS n, CAST(sum(CASE WHEN l_linenumber <= 2 THEN l_linenumber * 10 ELSE 5 END) AS BIGINT) AS nitrate
    FROM lineitem GROUP BY 1"""
)
def a05_layered_metadata(spark, sf_dir):
    sections = catalog.read_sections(spark, "[l1]\nnitrate=10\n[l2:l1]\nnitrate=20\n")
    items = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("l"), "l_linenumber").alias("section"))
    rows = catalog.layered(items, {"nitrate": "5", "xp": "x"}, sections, F.col("section"))
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.sum(catalog.key_value(F.col("extra"), "nitrate", "0").cast("bigint")).alias("nitrate"))


@query("""SELECT page_id, replace(url, 'https://', 's3://root/') AS url FROM pages WHERE url LIKE 'https://%' UNION ALL SELECT page_id, url FROM pages WHERE url NOT LIKE 'https://%'""")
def a21_relocation(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", tx.relocate(F.col("url"), "https://", "s3://root/").alias("url"))


@query(
    """SELECT CAST(l_orderkey AS BIGINT) AS img, CAST(l_partkey AS BIGINT) AS fid, CAST(l_linenumber AS BIGINT) AS match_num, l_quantity AS xmin, l_quantity + 10 AS xmax FROM lineitem"""
)
def a16_word_rows(spark, sf_dir):
    from rootweave.sources.text_files import parse_word_rows

    li = b.table(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", "l_partkey", "l_orderkey", "l_linenumber", F.lit("x"), "l_quantity", F.lit("1.0"), F.col("l_quantity") + 10, F.lit("4.0"))
    rows = parse_word_rows(li.select(F.lit("word_7.res").alias("file"), line.alias("value")))
    return rows.select("img", "fid", "match_num", "xmin", "xmax")


@query("""SELECT o_orderkey AS img, o_orderstatus AS status, o_orderpriority AS path FROM orders""")
def a17_key_value_lines(spark, sf_dir):
    from rootweave.sources.text_files import parse_key_values

    o = b.table(spark, sf_dir, "orders")
    line = F.concat(F.lit("img="), "o_orderkey", F.lit("\tstatus="), "o_orderstatus", F.lit("\tpath="), "o_orderpriority")
    kv = parse_key_values(o.select(line.alias("value")))
    return kv.select(F.col("kv")["img"].cast("bigint").alias("img"), F.col("kv")["status"].alias("status"), F.col("kv")["path"].alias("path"))


# B: projections and filters ----------------------------------------------------------


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events""")
def b01_dotted_column(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").withColumn("metadata", F.from_json("props", "k bigint"))
    return ev.select("event_id", catalog.dotted(ev, "metadata.k", -1).cast("bigint").alias("k"))


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'click'""")
def b03_equality_filter(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events")
    return catalog.equal_filter(ev, "event_type", "click", prefix="").select("event_id", "user_id", "value")


@query("""SELECT DISTINCT unnest(json_keys(props)) AS key FROM events""")
def b04_metadata_keys(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return catalog.metadata_keys(ev, "m")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10""")
def b08_slice(spark, sf_dir):
    return catalog.slice_rows(b.table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 10, 60).select("o_orderkey", "o_totalprice")


@query("""SELECT event_id, round(least(greatest(value, 10.0), 50.0) * 2.0, 4) AS v FROM events""")
def b12_clip(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", F.round(nb.clip(F.col("value"), 10.0, 50.0, 2.0), 4).alias("v"))


@query(
    f"""WITH {b.WORDS_SQL}, chosen AS (SELECT o_orderkey AS img FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-'))
    SELECT word, count(DISTINCT img) AS n_img FROM words WHERE img IN (SELECT img FROM chosen) GROUP BY 1 HAVING count(DISTINCT img) >= 5"""
)
def b16_support_filter(spark, sf_dir):
    images = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("img"), F.col("o_orderpriority").alias("name"))
    return catalog.support_filter(b.words(spark, sf_dir), images, "^[12]-", 5)[0]


@query(f"""WITH {b.RASTER_SQL} SELECT y - 2 AS y, x - 5 AS x, v FROM raster WHERE y BETWEEN 2 AND 49 AND x BETWEEN 5 AND 999""")
def b17_crop(spark, sf_dir):
    return catalog.crop(b.raster(spark, sf_dir), 2, 5, 50, 1000).select("y", "x", "v")


# C: joins ----------------------------------------------------------------------------


@query("""SELECT d.doc_id AS ref_key, l.doc_id AS cmp_key FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def c01_pairing(spark, sf_dir):
    ref = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("doc_id").alias("item_key"))
    cmp = b.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.col("doc_id").alias("item_key"))
    return match.pair_items(ref, cmp, ["k"])[0].select("ref_key", "cmp_key")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def c02_missing_references(spark, sf_dir):
    labels = b.table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("tree"))
    return catalog.append_reference(b.table(spark, sf_dir, "documents"), labels, ["doc_id"], "reference")[1].select("doc_id")


@query("""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) SELECT d.doc_id, q AS reference FROM documents d LEFT JOIN l USING (doc_id)""")
def c02_append_reference(spark, sf_dir):
    labels = b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("tree"))
    return catalog.append_reference(b.table(spark, sf_dir, "documents"), labels, ["doc_id"], "reference")[0].select("doc_id", "reference")


@query("""SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL AND l.quality IS NOT NULL""")
def c03_complete_pairs(spark, sf_dir):
    rows = b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id", "left")
    return catalog.complete_pairs(rows, "lang", "quality").select("doc_id")


@query(
    """WITH RECURSIVE p AS (SELECT c_nationkey AS nation, c_custkey AS i, s_suppkey AS j, abs(c_acctbal - s_acctbal) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 5000),
    s AS (SELECT nation, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS d, []::BIGINT[] AS ui, []::BIGINT[] AS uj FROM (SELECT DISTINCT nation FROM p)
    UNION ALL SELECT nation, x.i, x.j, x.d, list_append(ui, x.i), list_append(uj, x.j) FROM (SELECT s.nation, s.ui, s.uj, min(struct_pack(d := p.d, i := p.i, j := p.j)) AS x FROM s JOIN p USING (nation)
    WHERE NOT list_contains(s.ui, p.i) AND NOT list_contains(s.uj, p.j) GROUP BY 1, 2, 3)) SELECT nation, i, j, round(d, 4) AS d FROM s WHERE i IS NOT NULL"""
)
def c04_greedy_match(spark, sf_dir):
    """Customers and suppliers of a nation, nearest by account balance, at most 5000 apart."""
    side = lambda t, p, k, n: b.table(spark, sf_dir, t).select(F.col(f"{p}_nationkey").alias("nation"), F.col(k).alias(n), F.col(f"{p}_acctbal").alias("x"), F.lit(0.0).alias("y"))
    return match.greedy_points(side("customer", "c", "c_custkey", "i"), side("supplier", "s", "s_suppkey", "j"), ["nation"], 5000.0).select("nation", "i", "j", F.round("d", 4).alias("d"))


@query(
    f"""WITH {b.WORDS_SQL} SELECT a.word AS a, b.word AS b, count(*) AS n,
    round(sum((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))), 4) AS area
    FROM words a JOIN words b ON a.img = b.img AND a.word < b.word AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax GROUP BY 1, 2"""
)
def c10_box_overlap(spark, sf_dir):
    return match.box_overlap(b.words(spark, sf_dir), ["img"], 16.0).select("a", "b", "n", F.round("area", 4).alias("area"))


@query(
    """WITH one AS (SELECT DISTINCT l_orderkey AS img, l_linenumber AS word, l_quantity FROM lineitem WHERE l_linenumber IN (2, 5)) SELECT img, min(l_quantity) FILTER (word = 2) AS first FROM one GROUP BY img HAVING count(DISTINCT word) = 2"""
)
def c13_relational_division(spark, sf_dir):
    """Orders with a second and a fifth line, and the former's least quantity."""
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("word"), F.struct("l_quantity").alias("box"))
    return match.images_with_all(li, [2, 5]).select("img", F.col("boxes")[0]["box"]["l_quantity"].alias("first"))


@query(
    """WITH p AS (SELECT p_brand AS brand, p_partkey AS i, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)
    SELECT a.brand, a.i, b.i AS j FROM p a JOIN p b ON a.brand = b.brand AND a.i < b.i AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 15.5"""
)
def c14_close_pairs(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return match.close_pairs(p, ["brand"], 15.5).select("brand", "i", "j")


@query(
    """WITH s AS (SELECT o_orderpriority AS stat, o_custkey AS plant, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o
    FROM orders GROUP BY 1, 2) SELECT stat, plant, round(o / greatest(f, 0.0000152587890625), 4) AS ratio FROM s WHERE f IS NOT NULL AND o IS NOT NULL"""
)
def c16_statistic_ratio(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stat"), F.col("o_custkey").alias("plant"), "o_orderstatus").agg(F.sum("o_totalprice").alias("value"))
    side = lambda s: o.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    return match.compare_statistics(side("F"), side("O")).select("stat", "plant", F.round("ratio", 4).alias("ratio"))


# D: aggregations -----------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderstatus, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1, 2""")
def d01_group_by(spark, sf_dir):
    groups = catalog.group_items(b.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey")
    return groups.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), " "))


@query("""SELECT o_custkey, o_orderstatus, o_orderkey FROM orders""")
def d03_members(spark, sf_dir):
    return catalog.members(catalog.group_items(b.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey"), "o_orderkey")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM orders""")
def d02_nested_groups(spark, sf_dir):
    """Of a customer by priority: groups that stay small."""
    nested = catalog.group_nested(b.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")
    return catalog.flatten_nested(nested, "o_custkey", "o_orderpriority", "o_orderkey")


PLANTS = f"""WITH {b.AXES_SQL}, len AS (SELECT l_orderkey AS axe_id, sum(l_quantity) AS length, max(l_linenumber) * 1.0 AS position FROM lineitem GROUP BY 1),
 x AS (SELECT a.item_key, a.plant, a.axe_id, a.ord, l.length, l.position FROM axes a JOIN len l USING (axe_id)),
 p AS (SELECT DISTINCT item_key, plant FROM axes)"""


def _axes_with_length(spark, sf_dir):
    seg = b.segments(spark, sf_dir)
    length = seg.groupBy("axe_id").agg(F.sum("length").alias("length"), F.max("pos").cast("double").alias("position"))
    return b.axes(spark, sf_dir).join(length, "axe_id")


@query(
    PLANTS
    + """ SELECT p.item_key, p.plant, round(coalesce(arg_min(length, axe_id) FILTER (ord = 1), 0), 4) AS axe1_length, round(coalesce(sum(length) FILTER (ord = 2), 0), 4) AS axe2_length_total,
    round(coalesce(avg(length) FILTER (ord = 2), 0), 4) AS axe2_length_mean, round(coalesce(sum(length), 0), 4) AS total_length, count(*) FILTER (ord = 2) AS axe2_number,
    coalesce(max(position) FILTER (ord = 2), 0) AS ramification_length FROM p LEFT JOIN x USING (item_key, plant) GROUP BY 1, 2"""
)
def d04_plant_statistics(spark, sf_dir):
    names = ["axe1_length", "axe2_length_total", "axe2_length_mean", "total_length", "axe2_number", "ramification_length"]
    rows = measure.plant_statistics(b.axes(spark, sf_dir), _axes_with_length(spark, sf_dir), names)
    return rows.select("item_key", "plant", *[F.round(n, 4).alias(n) if n not in ("axe2_number", "ramification_length") else F.col(n) for n in names])


@query(PLANTS + """ SELECT p.item_key, p.plant, count(axe_id) AS n, round(coalesce(sum(length), 0), 4) AS total FROM p LEFT JOIN (SELECT * FROM x WHERE ord = 1) x USING (item_key, plant) GROUP BY 1, 2""")
def d05_axes_property(spark, sf_dir):
    rows = measure.axes_property(b.axes(spark, sf_dir), _axes_with_length(spark, sf_dir), "length", order=1)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rows.select("item_key", "plant", F.size("values").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


@query(
    """WITH p AS (SELECT DISTINCT p_brand AS brand, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
    e AS (SELECT a.brand, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM p a JOIN p b ON a.brand = b.brand AND (a.x <> b.x OR a.y <> b.y)),
    ok AS (SELECT e.brand, ax, ay, ex, ey FROM e JOIN p c ON c.brand = e.brand GROUP BY ALL HAVING bool_and((ex - ax) * (c.y - ay) - (ey - ay) * (c.x - ax) > 1e-9
    OR (abs((ex - ax) * (c.y - ay) - (ey - ay) * (c.x - ax)) <= 1e-9 AND (c.x - ax) * (c.x - ex) + (c.y - ay) * (c.y - ey) <= 1e-9)))
    SELECT brand, round(abs(sum(ax * ey - ex * ay)) / 2, 3) AS area FROM ok GROUP BY 1"""
)
def d12_hull_area(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return measure.hull_area(p, ["brand"]).select("brand", F.round("area", 3).alias("area"))


@query(
    """WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS r,
    count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS c FROM lineitem)
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(v), 2) AS mean, round(stddev_pop(v), 2) AS std FROM r
    WHERE r > floor(c * 0.05) AND r <= c - floor(c * 0.05) GROUP BY 1, 2"""
)
def d15_trimmed_summary(spark, sf_dir):
    rows = stats.trimmed_summary(b.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.05)
    return rows.select("l_returnflag", "l_linestatus", "n", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


@query(
    """WITH a AS (SELECT l_discount AS v FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT l_discount AS v FROM lineitem WHERE l_returnflag = 'N'),
    m AS (SELECT min(v) AS lo, max(v) AS hi FROM a), h AS (SELECT 'a' AS s, least(floor((v - lo) / (hi - lo) * 10), 9) AS bin FROM a, m WHERE v BETWEEN lo AND hi
    UNION ALL SELECT 'b', least(floor((v - lo) / (hi - lo) * 10), 9) FROM c, m WHERE v BETWEEN lo AND hi), t AS (SELECT s, count(*) AS t FROM h GROUP BY 1)
    SELECT CAST(bin AS INTEGER) AS bin, round(coalesce(sum(CASE WHEN s = 'a' THEN 1.0 / t END), 0), 6) AS a, round(coalesce(sum(CASE WHEN s = 'b' THEN 1.0 / t END), 0), 6) AS b FROM h JOIN t USING (s) GROUP BY 1"""
)
def d16_histogram_compare(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    rows = stats.histogram_compare(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'N'"), "l_discount", 10)
    return rows.select("bin", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1""")
def d17_correlation(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@query(
    """WITH x AS (SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS r, count(*) FILTER (o_orderstatus = 'O') AS t FROM orders GROUP BY 1)
    SELECT round(sum(CASE WHEN r <> 0 THEN (r - t) * (r - t) * 1.0 / r END), 6) AS chi FROM x"""
)
def d18_chi_square(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("r"), F.count_if(F.col("o_orderstatus") == "O").alias("t"))
    return o.agg(F.round(stats.chi_square(F.col("r"), F.col("t")), 6).alias("chi"))


@query(
    """SELECT c_nationkey AS nation, o_orderstatus AS source, year(o_orderdate) AS frame, count(*) AS n, round(sum(o_totalprice), 2) AS area, count(*) FILTER (o_totalprice > 100000) AS n_long
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""
)
def d20_time_source_table(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").join(b.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("nation"), F.col("o_orderstatus").alias("source"), F.year("o_orderdate").cast("bigint").alias("frame"), "o_totalprice")
    found = stats.time_source_table(rows, ["nation", "source", "frame"], "o_totalprice", 100000)
    return found.select("nation", "source", "frame", "n", F.round("total", 2).alias("area"), "n_long")


@query(
    """SELECT o_orderpriority AS p, round(coalesce(sum(CASE WHEN l_linenumber * 1.0 / 7 >= 0.2 AND l_linenumber * 1.0 / 7 < 0.6 THEN l_quantity END), 0), 4) AS total
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def d24_band_length(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    roots = rows.select(F.col("o_orderpriority").alias("p"), F.col("l_linenumber").alias("position"), F.lit(7.0).alias("parent_length"), F.col("l_quantity").alias("length"))
    return match.band_length(roots, ["p"], 0.2, 0.6).select("p", F.round("total", 4).alias("total"))


@query("""SELECT l_returnflag AS label, l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def d26_point_multiplicity(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return stats.multiplicity(rows, ["label", "x", "y"])


@query(
    """WITH q AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
    SELECT p, round(any_value(q1), 2) AS q1, round(any_value(median), 2) AS median, round(any_value(q3), 2) AS q3, min(o_totalprice) AS low, max(o_totalprice) AS high
    FROM orders JOIN q ON o_orderpriority = p WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1"""
)
def d27_box_summary(spark, sf_dir):
    rows = stats.box_summary(b.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "p"), ["p"], "o_totalprice")
    return rows.select("p", *[F.round(c, 2).alias(c) for c in ("q1", "median", "q3")], "low", "high")


@query("""SELECT p_brand, count(p_size) AS n, CAST(sum(p_size) AS BIGINT) AS total, min(p_size) AS low, max(p_size) AS high, CAST(floor(sum(p_size) * 1.0 / count(p_size)) AS BIGINT) AS mean FROM part GROUP BY 1""")
def d29_description(spark, sf_dir):
    return words.description(b.table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query(f"""WITH {b.WORDS_SQL}, s AS (SELECT DISTINCT img, word FROM words) SELECT img, string_agg(CAST(word AS VARCHAR), ' ' ORDER BY word) AS line FROM s GROUP BY 1""")
def d30_item_sets(spark, sf_dir):
    sets = words.item_sets(b.words(spark, sf_dir))
    return sets.select("img", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("line"))


@query(f"""WITH {b.SEGMENTS_SQL} SELECT axe_id, round(sum(length), 4) AS length, count(*) AS n_segments FROM seg GROUP BY 1""")
def d33_axe_length(spark, sf_dir):
    seg = b.segments(spark, sf_dir)
    return measure.axe_length(seg.select("item_key", "axe_id", "pos", "seg_id"), seg).select("axe_id", F.round("length", 4).alias("length"), "n_segments")


@query(
    f"""WITH {b.RASTER_SQL} SELECT y AS label, count(*) AS cells, min(x) AS x0, max(x) AS x1, round(avg(x), 4) AS cx FROM raster GROUP BY 1"""
)
def d35_label_boxes(spark, sf_dir):
    labels = b.raster(spark, sf_dir).withColumn("label", F.col("y"))
    return ra.label_table(labels).select("label", "cells", "x0", "x1", F.round("cx", 4).alias("cx"))


@query(
    f"""WITH {b.RASTER_SQL} SELECT y AS label, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(sum(v * x) / sum(v), 4) AS mx FROM raster GROUP BY 1"""
)
def d36_label_statistics(spark, sf_dir):
    r = b.raster(spark, sf_dir)
    rows = ra.label_statistics(r.select("item_key", "y", "x", F.col("y").alias("label")), r)
    return rows.select("label", "low", "high", *[F.round(c, 4).alias(c) for c in ("mean", "std", "mx")])


@query("""SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem""")
def d37_unique_rows(spark, sf_dir):
    return catalog.unique_rows(b.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_tax"])


@query("""SELECT l_returnflag, round(power(sum(power(abs(l_quantity), 3)), 1.0 / 3), 4) AS norm FROM lineitem GROUP BY 1""")
def d38_norm(spark, sf_dir):
    return stats.norm(b.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 3.0).select("l_returnflag", F.round("norm", 4).alias("norm"))


@query(
    """WITH m AS (SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
    SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS v FROM orders JOIN m ON o_orderpriority = p"""
)
def d39_normalise(spark, sf_dir):
    return stats.normalise(b.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderkey", F.round("o_totalprice", 6).alias("v"))


@query(
    """WITH c AS (SELECT l_returnflag AS k, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
    s AS (SELECT k, v, sum(n) OVER w AS n1, sum(n * v) OVER w AS s1, sum(n) OVER (PARTITION BY k) AS n, sum(n * v) OVER (PARTITION BY k) AS s FROM c WINDOW w AS (PARTITION BY k ORDER BY v)),
    b AS (SELECT k, v, CASE WHEN n > n1 THEN (n1 / n) * ((n - n1) / n) * power(s1 / n1 - (s - s1) / (n - n1), 2) ELSE 0 END AS b FROM s)
    SELECT k, arg_max(v, b) AS threshold, round(max(b), 4) AS between FROM b GROUP BY 1"""
)
def d40_otsu(spark, sf_dir):
    rows = stats.otsu(b.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "k"), ["k"], "l_quantity")
    return rows.select("k", "threshold", F.round("between", 4).alias("between"))


@query()
def d41_gaussian_mixture(spark, sf_dir):
    return stats.gaussian_mixture(b.table(spark, sf_dir, "events"), ["event_type"], "value", classes=2)


@query()
def d45_outliers(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return stats.outliers(rows, ["o_orderpriority"], "o_totalprice")


@query(
    """SELECT o_orderpriority AS p, count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS mean, round(var_pop(o_totalprice) / 1e6, 2) AS var FROM orders GROUP BY 1"""
)
def d46_mergeable_normal(spark, sf_dir):
    """Normals of months of the year, merged pair by pair."""
    o = b.table(spark, sf_dir, "orders").withColumn("m", F.month("o_orderdate"))
    parts = o.groupBy("o_orderpriority", "m").agg(stats.fit_normal(F.col("o_totalprice")).alias("s"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    merged = parts.groupBy(F.col("o_orderpriority").alias("p")).agg(F.aggregate(F.collect_list("s"), zero, stats.merge_normal).alias("s"))
    return merged.select("p", "s.n", F.round("s.mean", 2).alias("mean"), F.round(stats.variance(F.col("s")) / 1e6, 2).alias("var"))


# E: windows ----------------------------------------------------------------------------


@query(f"""WITH {b.SEGMENTS_SQL} SELECT axe_id, pos, round(sum(length) OVER (PARTITION BY axe_id ORDER BY pos), 4) AS arc FROM seg""")
def e01_arc_length(spark, sf_dir):
    seg = b.segments(spark, sf_dir)
    return measure.arc_length(seg.select("item_key", "axe_id", "pos", "seg_id"), seg).select("axe_id", "pos", F.round("arc", 4).alias("arc"))


@query(
    f"""WITH {b.SEGMENTS_SQL}, arc AS (SELECT axe_id, pos, sum(length) OVER (PARTITION BY axe_id ORDER BY pos) AS arc FROM seg),
    child AS (SELECT o_orderkey AS axe_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders)
    SELECT child.axe_id, round(coalesce(arc.arc, 0), 4) AS position FROM child LEFT JOIN arc ON arc.axe_id = parent AND pos = 2"""
)
def e02_position_on_parent(spark, sf_dir):
    seg = b.segments(spark, sf_dir)
    arcs = measure.arc_length(seg.select("item_key", "axe_id", "pos", "seg_id"), seg)
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    axes = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("axe_id"), before.alias("parent"))
    axes = axes.withColumn("parent_segment", F.col("parent") * 10 + 2)
    return measure.position_on_parent(axes, arcs).select("axe_id", F.round("position", 4).alias("position"))


@query("""SELECT l_orderkey AS axe_id, arg_min(l_orderkey * 10 + l_linenumber, l_linenumber) AS seg_id FROM lineitem GROUP BY 1""")
def e03_first_segment(spark, sf_dir):
    return measure.first_segment(b.segments(spark, sf_dir)).select("axe_id", "seg_id")


@query(
    f"""WITH {b.AXES_SQL}, p AS (SELECT l_orderkey AS axe_id, sum(l_quantity) AS position FROM lineitem GROUP BY 1)
    SELECT item_key, axe_id, CAST(row_number() OVER (PARTITION BY item_key ORDER BY ord, position, axe_id) AS INTEGER) AS rank FROM axes JOIN p USING (axe_id)"""
)
def e04_partial_order(spark, sf_dir):
    axes = b.axes(spark, sf_dir)
    p = b.segments(spark, sf_dir).groupBy("axe_id").agg(F.sum("length").alias("position"))
    return measure.partial_order(axes, axes.join(p, "axe_id").select("item_key", "axe_id", "position"))


@query(
    f"""WITH {b.RASTER_SQL}, a AS (SELECT y, x, max(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM raster)
    SELECT y, x, CAST(max(v) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS DOUBLE) AS mx FROM a"""
)
def e11_sliding_max(spark, sf_dir):
    return ra.window_filter(b.raster(spark, sf_dir), 3, "max").select("y", "x", F.col("v").alias("mx"))


@query(
    f"""WITH {b.RASTER_SQL}, a AS (SELECT y, x, v, min(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM raster),
    c AS (SELECT y, x, v, min(m) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM a) SELECT y, x, v FROM c WHERE v = m"""
)
def e16_local_minima(spark, sf_dir):
    return ra.local_minima(b.raster(spark, sf_dir), 2).select("y", "x", "v")


@query(
    f"""WITH {b.RASTER_SQL}, a AS (SELECT y, x, v, sum(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s, count(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM raster),
    c AS (SELECT y, x, v, sum(s) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / sum(n) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM a)
    SELECT y, x, round(v - m, 4) AS v FROM c"""
)
def e17_adaptive(spark, sf_dir):
    return ra.adaptive(b.raster(spark, sf_dir), 2).select("y", "x", F.round("v", 4).alias("v"))


# F, G: sorting and sets -------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx FROM orders""")
def f03_index_of(spark, sf_dir):
    rows = catalog.index_of(b.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_orderkey", F.col("index").cast("bigint").alias("idx"))


@query(f"""WITH {b.RASTER_SQL}, t AS (SELECT y, count(*) AS n FROM raster GROUP BY 1), k AS (SELECT y FROM t ORDER BY n DESC, y LIMIT 3) SELECT y, x FROM raster WHERE y IN (SELECT y FROM k)""")
def f04_biggest_labels(spark, sf_dir):
    labels = b.raster(spark, sf_dir).select("item_key", "y", "x", F.col("y").cast("bigint").alias("label"))
    return ra.biggest(labels, 3).select("y", "x")


@query("""SELECT l_orderkey AS img FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 10""")
def g01_intersection(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img"), "l_returnflag", "l_quantity")
    return catalog.common(li.where("l_returnflag = 'R'").select("img"), li.where("l_quantity > 10").select("img"))


@query("""SELECT DISTINCT l_orderkey, 'R' AS side FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)
    UNION ALL SELECT DISTINCT l_orderkey, '3' FROM lineitem WHERE l_linenumber > 3 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def g02_difference(spark, sf_dir):
    """Orders with returns, orders of more than three lines: what either lacks."""
    li = b.table(spark, sf_dir, "lineitem")
    one, two = catalog.unmatched_ids(li.where("l_returnflag = 'R'"), li.where("l_linenumber > 3"), "l_orderkey")
    return one.withColumn("side", F.lit("R")).union(two.withColumn("side", F.lit("3")))


@query("""SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, round(sum(l_quantity), 4) AS cost FROM lineitem GROUP BY 1, 2""")
def g06_unique_edges(spark, sf_dir):
    e = b.table(spark, sf_dir, "lineitem").select(F.lit("all").alias("item_key"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("cost"))
    return graph.unique_edges(e).select("a", "b", F.round("cost", 4).alias("cost"))


# H: scalar functions ------------------------------------------------------------------------


@query(
    """SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '^Customer#([-+]?[0-9]+)$', 1) AS BIGINT) AS id, TRY_CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS first FROM customer"""
)
def h01_format_scan(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.format_scan(F.col("c_name"), "Customer#{id:d}")["id"].alias("id"), tx.first_number(F.col("c_name")).alias("first"))


@query("""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_replace(regexp_replace(url, '^/+', ''), '\\.[^./]*$', '') AS key FROM pages""")
def h04_keys_of_paths(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", tx.url_scheme(F.col("url")).alias("scheme"), tx.item_key(F.col("url")).alias("key"))


@query(
    """SELECT l_orderkey, l_linenumber, round(sqrt(power(l_extendedprice - l_quantity, 2) + power(l_tax - l_discount, 2)), 4) AS length, round(atan2(l_tax - l_discount, l_extendedprice - l_quantity), 6) AS direction FROM lineitem"""
)
def h07_segment_geometry(spark, sf_dir):
    xy = [F.col(c) for c in ("l_quantity", "l_discount", "l_extendedprice", "l_tax")]
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(g.length(*xy), 4).alias("length"), F.round(g.direction(*xy), 6).alias("direction"))


@query("""SELECT l_orderkey, l_linenumber, round(2 * l_quantity - 1 * l_discount + 3, 4) AS x, round(1 * l_quantity + 2 * l_discount - 1, 4) AS y FROM lineitem""")
def h14_apply_transform(spark, sf_dir):
    m = g.product(g.translation(3, -1), g.matrix(2, -1, 0, 1, 2, 0, 0, 0, 1))
    p = g.transform(m, F.col("l_quantity"), F.col("l_discount"))
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))


@query("""SELECT o_orderkey, CAST(least(greatest(round(o_totalprice / 1000), 0), 255) AS INTEGER) AS px, round(CAST(0.3 AS DOUBLE) * o_custkey + CAST(0.59 AS DOUBLE) * o_orderkey + CAST(0.11 AS DOUBLE) * 7, 4) AS grey FROM orders""")
def h18_pixel_types(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey", nb.to_pixel(F.col("o_totalprice") / 1000, "uint8").alias("px"), F.round(nb.gray(F.col("o_custkey"), F.col("o_orderkey"), F.lit(7)), 4).alias("grey")
    )


@query(f"""WITH {b.RASTER_SQL} SELECT CAST(y AS BIGINT) * 100000 + x AS idx, CAST(floor((CAST(y AS BIGINT) * 100000 + x) / 100000.0) AS BIGINT) AS y2 FROM raster""")
def h20_flat_index(spark, sf_dir):
    r = b.raster(spark, sf_dir).select(nb.ravel(F.col("y").cast("bigint"), F.col("x"), 100000).alias("idx"))
    return r.select("idx", nb.unravel(F.col("idx"), 100000)["y"].alias("y2"))


# I: graphs ---------------------------------------------------------------------------------


@query("""SELECT node_id, count(*) AS degree FROM (SELECT l_orderkey AS node_id FROM lineitem UNION ALL SELECT -l_partkey FROM lineitem) GROUP BY 1""")
def i01_incidence(spark, sf_dir):
    seg = b.table(spark, sf_dir, "lineitem").select(F.lit("all").alias("item_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_id"), F.col("l_orderkey").alias("n0"), F.negate("l_partkey").alias("n1"))
    return graph.incidence(seg).groupBy("node_id").agg(F.count("*").alias("degree"))


@query(
    f"""WITH {b.RASTER_SQL} SELECT a.y AS ya, a.x AS xa, c.y AS yb, c.x AS xb, round((a.v + c.v) / 2, 4) AS cost FROM raster a JOIN raster c
    ON (c.y = a.y AND c.x = a.x + 1) OR (c.y = a.y + 1 AND c.x = a.x)"""
)
def i05_grid_adjacency(spark, sf_dir):
    e = graph.grid_edges(b.raster(spark, sf_dir), [(0, 1), (1, 0)], graph.EDGE_VALUES["mean"])
    return e.select("ya", "xa", "yb", "xb", F.round("cost", 4).alias("cost"))


@query(
    """SELECT o_orderkey AS node_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders"""
)
def i06_components(spark, sf_dir):
    """Chains of a customer's orders are components."""
    o = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("node_id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"))
    e = o.where("before is not null").select("item_key", F.col("before").alias("a"), F.col("node_id").alias("b"))
    return graph.components(o, e).select("node_id", "component")


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
    SELECT o_orderkey AS node_id, round(sum(CASE WHEN r > 1 THEN o_totalprice ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY r), 2) AS dist FROM c"""
)
def i08_shortest_paths(spark, sf_dir):
    """Along each customer's orders, a step costs the price of the order it reaches."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = b.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.lag("o_orderkey").over(w).alias("before"))
    o = settle(o)
    e = o.where("before is not null").select(F.lit("all").alias("item_key"), F.col("before").alias("a"), F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("cost"))
    start = o.where("before is null").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("node_id"), F.lit(0.0).alias("dist"))
    return graph.shortest_paths(e, start).select("node_id", F.round("dist", 2).alias("dist"))


@query(
    """WITH c AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
    SELECT min(o_orderkey) AS run, min(before) AS a, max(o_orderkey) AS b, count(*) AS segments, round(sum(o_totalprice), 2) AS length FROM c WHERE before IS NOT NULL GROUP BY o_custkey"""
)
def g05_run_graph(spark, sf_dir):
    """Each customer's orders, one after the other, are a run."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.lag("o_orderkey").over(w).alias("n0"), F.col("o_orderkey").alias("n1"), F.col("o_totalprice").alias("length"))
    runs = graph.run_graph(settle(o.where("n0 is not null").withColumn("seg_id", F.col("n1"))))[1]
    return runs.select("run", "a", "b", "segments", F.round("length", 2).alias("length"))


@query("""SELECT l_partkey AS node_id, arg_min(l_suppkey, l_extendedprice) AS parent FROM lineitem GROUP BY 1""")
def i17_minimum_branching(spark, sf_dir):
    e = b.table(spark, sf_dir, "lineitem").select(F.lit("all").alias("item_key"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_extendedprice").alias("cost"))
    return graph.minimum_branching(e).select("node_id", "parent")


@query("""SELECT -1 - l_suppkey AS node_id, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 2
    UNION ALL SELECT l_partkey, count(DISTINCT l_suppkey) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 2""")
def i22_crossing_nodes(spark, sf_dir):
    e = b.table(spark, sf_dir, "lineitem").select(F.lit("all").alias("item_key"), F.col("l_partkey").alias("a"), (F.lit(-1) - F.col("l_suppkey")).alias("b"))
    return graph.crossing_nodes(e).select("node_id", "degree")


@query()
def i39_markov_clusters(spark, sf_dir):
    """Nations by the trade between customers and suppliers."""
    li, o = b.table(spark, sf_dir, "lineitem"), b.table(spark, sf_dir, "orders")
    c, s = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "supplier")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    e = rows.where("c_nationkey <> s_nationkey").groupBy(F.lit("all").alias("item_key"), F.col("c_nationkey").cast("bigint").alias("a"), F.col("s_nationkey").cast("bigint").alias("b")).agg(F.sum("l_extendedprice").alias("cost"))
    return graph.markov_clusters(e, inflation=1.6).select("node_id", "cluster")


# J: rasters ---------------------------------------------------------------------------------


@query(f"""WITH {b.RASTER_SQL} SELECT y, x FROM raster WHERE v > 40""")
def j01_threshold(spark, sf_dir):
    return ra.threshold(b.raster(spark, sf_dir), 40).select("y", "x")


@query(
    f"""WITH {b.RASTER_SQL}, m AS (SELECT y, x FROM raster WHERE v > 40), o(dy, dx) AS (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))
    SELECT DISTINCT y + dy AS y, x + dx AS x FROM m, o"""
)
def j03_dilation(spark, sf_dir):
    return ra.dilate(b.raster(spark, sf_dir).where("v > 40"), [(0, 0), *ra.N4]).select("y", "x")


@query(f"""WITH {b.RASTER_SQL}, t AS (SELECT y, count(*) AS n FROM raster GROUP BY 1 HAVING count(*) >= 10) SELECT r.y, r.x, CAST(dense_rank() OVER (ORDER BY r.y) AS INTEGER) AS label FROM raster r JOIN t USING (y)""")
def j04_clean_labels(spark, sf_dir):
    labels = b.raster(spark, sf_dir).select("item_key", "y", "x", F.col("y").cast("bigint").alias("label"))
    return ra.clean_labels(labels, 10).select("y", "x", "label")


# More geometry, joins and statistics -----------------------------------------------------------


@query(
    """WITH p AS (SELECT p_brand AS brand, p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
    s AS (SELECT p_brand AS brand, p_partkey AS seg_id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS y0, p_size + 3.0 AS x1, p_retailprice + 4.0 AS y1 FROM part),
    j AS (SELECT brand, point_id, seg_id, x, y, x0, y0, least(greatest(((x - x0) * 3.0 + (y - y0) * 4.0) / 25.0, 0), 1) AS t FROM p JOIN s USING (brand))
    SELECT brand, point_id, seg_id, round(sqrt(power(x - x0 - t * 3.0, 2) + power(y - y0 - t * 4.0, 2)), 4) AS d FROM j WHERE sqrt(power(x - x0 - t * 3.0, 2) + power(y - y0 - t * 4.0, 2)) <= 6.05"""
)
def c07_point_segment_distance(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    points = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("point_id"), x.alias("x"), y.alias("y"))
    segs = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("seg_id"), x.alias("x0"), y.alias("y0"), (x + 3.0).alias("x1"), (y + 4.0).alias("y1"))
    return match.point_segment_distance(points, segs, ["brand"], 6.05, 4).select("brand", "point_id", "seg_id", "d")


@query(
    """WITH e AS (SELECT vec_id, label, embedding FROM embeddings), d AS (SELECT a.vec_id AS query_id, c.vec_id, list_distance(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d
    FROM e a JOIN e c ON a.label = c.label AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, vec_id, round(d, 4) AS d, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2"""
)
def c11_nearest_descriptors(spark, sf_dir):
    """Two nearest descriptors of the same label; queries are every hundredth."""
    e = b.table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return match.nearest_vectors(asked, e.select("label", "vec_id", F.col("embedding").alias("v")), ["label"], 2).select("query_id", "vec_id", F.round("d", 4).alias("d"), "rank")


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r,
    lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS d2 FROM orders)
    SELECT o_custkey AS seg_id, o_orderkey AS axe_id, (o_totalprice <= 20000 AND (d2 IS NULL OR o_totalprice < 0.8 * d2)) AS assigned FROM s WHERE r = 1"""
)
def c21_assignment(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_custkey").alias("seg_id"), F.col("o_orderkey").alias("axe_id"), F.col("o_totalprice").alias("d"))
    return match.assign_segments(rows, ["item_key"], 20000.0, 0.8).select("seg_id", "axe_id", "assigned")


@query("""SELECT seed AS plant, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM (SELECT c_nationkey AS seed, c_acctbal AS x, c_custkey * 1.0 AS y FROM customer WHERE c_nationkey > 0) GROUP BY 1""")
def d32_mean_seed_position(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    nodes = c.select(F.lit("all").alias("item_key"), F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    segs = c.select(F.lit("all").alias("item_key"), F.col("c_nationkey").cast("bigint").alias("seed"), F.col("c_custkey").alias("n0"), F.col("c_custkey").alias("n1"))
    return paths.mean_seed_position(nodes, segs).select("plant", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    """SELECT event_id, class, round(e, 5) AS e FROM (SELECT event_id, class, d / sum(d) OVER (PARTITION BY event_id) AS e FROM (
    SELECT event_id, class, w * exp(-power(value - m, 2) / (2 * s * s)) / (s * sqrt(2 * pi())) AS d FROM events, (VALUES (0, 0.4, 20.0, 30.0), (1, 0.6, 60.0, 25.0)) p(class, w, m, s)))"""
)
def d43_expectation(spark, sf_dir):
    params = spark.createDataFrame([("all", 0, 0.4, 20.0, 30.0), ("all", 1, 0.6, 60.0, 25.0)], "item_key string, class int, weight double, mean double, std double")
    ev = b.table(spark, sf_dir, "events").withColumn("item_key", F.lit("all"))
    return stats.expectation(ev, ["item_key"], "event_id", "value", params).select("event_id", "class", F.round("e", 5).alias("e"))


@query(
    f"""WITH {b.SEGMENTS_SQL}, c AS (SELECT o_orderkey AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
    k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS n_paths, CAST(sum(n) AS BIGINT) AS n_rows FROM k"""
)
def i20_covering_paths(spark, sf_dir):
    """A customer's orders in a row are a tree with one leaf."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("node_id"), before.alias("parent"))
    cover = paths.covering_paths(settle(o))
    return cover.agg(F.countDistinct("path_id").alias("n_paths"), F.count("*").alias("n_rows"))


@query(
    """WITH axes AS (SELECT o_orderkey AS axe_id, o_custkey AS plant, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders)
    SELECT 'P' || CAST(plant AS VARCHAR) AS vid, 'plant' AS scale, NULL AS parent_vid, '/' AS edge_type FROM (SELECT DISTINCT plant FROM axes)
    UNION ALL SELECT 'A' || CAST(axe_id AS VARCHAR), 'axe', 'A' || CAST(parent AS VARCHAR), CASE WHEN parent IS NULL THEN '/' ELSE '+' END FROM axes"""
)
def i35_tree_to_mtg(spark, sf_dir):
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    axes = b.table(spark, sf_dir, "orders").select(F.lit("all").alias("item_key"), F.col("o_orderkey").alias("axe_id"), F.col("o_custkey").alias("plant"), F.lit(1).alias("ord"), before.alias("parent"), F.lit(None).cast("bigint").alias("parent_segment"))
    members = b.segments(spark, sf_dir).select("item_key", "axe_id", "pos", "seg_id")
    return paths.to_mtg(axes, members).where("scale <> 'segment'").select("vid", "scale", "parent_vid", "edge_type")


@query()
def e23_chained_transforms(spark, sf_dir):
    """A user's events as frames: shifts by their values add up."""
    ev = b.table(spark, sf_dir, "events")
    steps = ev.select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("frame"), g.translation(F.col("value"), F.lit(1.0)).alias("m"))
    return paths.chained_transforms(steps).select("seq_id", "frame", F.round(F.col("m")[2], 4).alias("x"), F.col("m")[5].alias("y"))


@query(
    """SELECT user_id AS seq_id, event_id AS frame, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS x FROM events"""
)
def e23_accumulated_shift(spark, sf_dir):
    return e23_chained_transforms(spark, sf_dir).select("seq_id", "frame", F.round("x", 2).alias("x"))
