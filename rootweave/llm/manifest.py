"""Merkle manifest of a dataset, proved by a recursive query.

Every document is a leaf.  The leaves of a source ascend by doc_id; every ``FAN``
consecutive nodes of a level become one node above them until one is left, the
source's subroot.  Subroots, ordered by source, make a tree of the same kind, whose
top is the root.

Built levels are stored as node rows linked to their parent, each with the digests
before and after it in its run.  A recursive query climbs from the leaves along these
links, appends the siblings of each level to the proof and folds the leaf's digest
with them.  Leaves of one run climb in one row: from the second level on they have the
same siblings, which so move once for up to ``FAN`` leaves.  A node with many rows
below it is stored in several copies, among which these rows are dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable
from .urls import LOWER, UPPER

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MANIFEST = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
NODES = "id string, copy int, parent string, parent_copies int, digest string, before string, after string, is_subroot boolean"
#: Lifts the row limit of recursive queries, meant for those that may not end; this
#: one climbs a stored tree.
UNLIMITED = ("spark.sql.cteRecursionRowLimit", "-1")

CLIMB = """WITH RECURSIVE climb AS (
  SELECT origin, number, origin AS at, 0 AS copy, folded, X'' AS proof, CAST(NULL AS STRING) AS subroot FROM {starts}
  UNION ALL
  SELECT c.origin, c.number, n.parent, CAST(pmod(c.number, n.parent_copies) AS INT),
    transform(c.folded, x -> unhex(sha2(concat(n.before, lower(hex(x)), n.after), 256))),
    concat(c.proof, unhex(concat(n.before, n.after))), coalesce(c.subroot, CASE WHEN n.is_subroot THEN n.digest END)
  FROM climb c JOIN {nodes} n ON c.at = n.id AND c.copy = n.copy
) SELECT origin, folded, lower(hex(proof)) AS proof, coalesce(subroot, :root) AS subroot FROM climb WHERE at = :top"""


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(**changed: Column) -> Column:
    """Digest of a document, some of its columns changed."""
    return digest(*[encoded(changed.get(c, F.col(c))) for c in FIELDS])


def siblings(kids: Column, i: Column) -> tuple[Column, Column]:
    """The digests before and after the child at ``i`` of a run, joined."""
    joined = lambda part: F.array_join(F.transform(part, lambda k: k["digest"]), "")
    return joined(F.slice(kids, F.lit(1), i)), joined(F.slice(kids, i + 2, F.lit(FAN)))


def positions(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 within ``tree`` by ``order``, nulls first.

    Rows are sorted in ranges; what lies before a range is added up from one count for
    each range and tree, so a tree may hold any share of the rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, tree, *order).sortWithinPartitions(tree, *order)
    placed = durable(dealt.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    earlier = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("part", tree).agg(F.min("place").alias("least"), F.count("*").alias("n"))
    starts = runs.select("part", tree, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("shift"))
    return placed.join(starts, ["part", tree]).withColumn("pos", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def raised(level: DataFrame) -> DataFrame:
    """The runs of ``level(tree, pos, digest, ...)``: parents ``(tree, pos, kids, lone,
    digest)`` with at most ``FAN`` children in order.  A ``lone`` parent has the only
    node of its tree's level below it: that is the tree's top."""
    kid = F.struct("pos", *[c for c in level.columns if c not in ("tree", "pos")])
    runs = level.groupBy("tree", F.floor(F.col("pos") / FAN).cast("bigint").alias("up")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    return runs.select(
        "tree", F.col("up").alias("pos"), "kids", ((F.col("up") == 0) & (F.size("kids") == 1)).alias("lone"), digest(F.array_join("kids.digest", "")).alias("digest")
    )


def grown(level: DataFrame, height: int, copies: int, is_subroot: bool) -> tuple[list[DataFrame], DataFrame]:
    """Raises ``level(tree, pos, id, rows, digest)`` until each tree has one node; ``rows``
    counts the starts of climbs below a node.  Returns the node rows below the tops and
    the tops ``(tree, id, rows, digest)``."""
    nodes, tops = [], []
    share = lambda rows: F.least(F.ceil(rows / FAN), F.lit(copies)).cast("int")
    while True:
        up = durable(raised(level))
        tops.append(up.where("lone").select("tree", F.explode("kids").alias("k")).select("tree", "k.id", "k.rows", "k.digest"))
        up = up.where("not lone").withColumn("total", F.aggregate("kids", F.lit(0).cast("bigint"), lambda n, k: n + k["rows"]))
        if up.isEmpty():
            return nodes, reduce(DataFrame.unionByName, tops)
        height += 1
        up = up.withColumn("id", F.concat_ws(":", F.lit(height), "pos", "tree"))
        left, right = siblings(F.col("kids"), F.col("i"))
        nodes.append(
            up.select("*", F.posexplode("kids").alias("i", "kid")).select(
                F.col("kid.id").alias("id"),
                F.explode(F.sequence(F.lit(0), share(F.col("kid.rows")) - 1)).alias("copy"),
                F.col("id").alias("parent"),
                share(F.col("total")).alias("parent_copies"),
                F.col("kid.digest").alias("digest"),
                left.alias("before"),
                right.alias("after"),
                F.lit(is_subroot).alias("is_subroot"),
            )
        )
        level, is_subroot = up.select("tree", "pos", "id", F.col("total").alias("rows"), "digest"), False


def manifest(docs: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """One row a document: its leaf, its source's subroot, the root, the digest of its
    proof, and the root folded from its leaf and the proof, where the leaf is made anew
    with ``text`` in place of the text of rows that are ``tampered``.

    Null values have an encoding of their own, a null source is a source, null ids come
    first, rows of one id are ordered by digest, repeated rows are leaves of their own.
    Texts of any length are digested whole.  An empty table gives no row; columns but
    those digested are left out.
    """
    spark = docs.sparkSession
    copies = int(spark.conf.get("spark.sql.shuffle.partitions"))
    changed = F.when(tampered, leaf_digest(text=text))
    leaves = docs.select(encoded(F.col("source")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest().alias("digest"), changed.alias("changed"))
    runs = durable(raised(positions(leaves, "tree", "doc_id", "digest")))
    # the nodes from which climbs start: a run's parent, or a source's only leaf
    runs = runs.withColumn("origin", F.concat_ws(":", F.when(F.col("lone"), 0).otherwise(1), "pos", "tree"))
    top = F.when(F.col("lone"), F.col("kids")[0]["digest"]).otherwise(F.col("digest"))
    nodes, subroots = grown(runs.select("tree", "pos", F.col("origin").alias("id"), F.lit(1).cast("bigint").alias("rows"), top.alias("digest")), 1, copies, False)
    source = F.when(F.col("tree") != "-", F.expr("substr(tree, instr(tree, ':') + 1)"))
    ordered = positions(subroots.select(F.lit("").alias("tree"), source.alias("source"), "id", "rows", "digest"), "tree", "source")
    more, tops = grown(ordered.drop("source"), 0, copies, True)
    root = tops.first()
    if root is None:
        return spark.createDataFrame([], MANIFEST)
    links = durable(reduce(DataFrame.unionByName, [*nodes, *more], spark.createDataFrame([], NODES)))

    def folded(kid, i):
        left, right = siblings(F.col("kids"), i)
        own = F.coalesce(kid["changed"], kid["digest"])
        return F.unhex(F.when(F.col("lone"), own).otherwise(digest(left, own, right)))

    starts = runs.select("origin", F.abs(F.xxhash64("origin") % (1 << 30)).alias("number"), F.transform("kids", folded).alias("folded"))
    before = spark.conf.get(UNLIMITED[0])
    spark.conf.set(*UNLIMITED)
    try:
        found = durable(spark.sql(CLIMB, args={"root": root["digest"], "top": root["id"]}, starts=starts, nodes=links))
    finally:
        spark.conf.set(UNLIMITED[0], before)
    ends = runs.select("origin", "kids", "lone").join(found, "origin").select("*", F.posexplode("kids").alias("i", "kid"))
    left, right = siblings(F.col("kids"), F.col("i"))
    folded_root = F.lower(F.hex(F.get("folded", F.col("i"))))
    return ends.select(
        F.col("kid.doc_id").alias("doc_id"),
        F.col("kid.digest").alias("leaf"),
        "subroot",
        F.lit(root["digest"]).alias("root"),
        digest(left, right, F.col("proof")).alias("proof_sha256"),
        folded_root.alias("folded_root"),
        (folded_root == root["digest"]).alias("verified"),
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
