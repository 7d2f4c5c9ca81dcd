"""Line dedup by a log-template tree.

A line runs down a tree of fixed depth: token count first, then its leading tokens,
fields with a digit masked.  Below a leaf, what varies is generalised: a token stays
in the template where a good share of the leaf's lines has it in that place, the
other places become wildcards; several shares are tried, so that a leaf may hold several
templates.  A template that recurs in many different documents
is dropped from all of them.

Copies must not look like recurrence: a line counts once for every class of
near-copied texts that holds it, and an absolute number of classes decides.  So copied
documents keep their lines (finding them is another operator's work), and a passage
that otherwise different texts share goes, however much of them it is and whatever
else is copied.  Classes are components of links between texts whose word triples
agree by ``ALIKE`` or more, so texts that differ in less than that count as copies.

Lines of every length are judged; one of so few tokens that chance repeats it has no
template but itself, and must stand in more classes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, connected_components, durable, let
from .neardup import GOLD, M1, M2, mix

LINES = "digest binary, pos int, n int, template bigint, leaf bigint, tokens array<int>"
#: Least hashes of a text's word triples, how many of them form a band, and the share
#: that must agree for a link.  A pair at similarity 0.8 shares no band with
#: probability 5e-7.
MINIMA, ROWS, ALIKE = 63, 3, 0.75
#: Position of the row that carries a text's sketch in ``tokens``.
SKETCH = -1
DIGIT = re.compile(rb"[0-9]")
MASK = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")


def sketch(tokens: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """``MINIMA`` least hashes of the triples of neighbouring tokens, as int32."""
    t = tokens.astype(np.uint64)
    if len(t) < 3:
        t = np.concatenate([t, np.zeros(3 - len(t), np.uint64)])
    # 32 bits: a processor takes several at once
    triples = (mix(t[:-2] * M1 + t[1:-1] * M2 + t[2:] * GOLD) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(triples), 1024):
        least = np.minimum(least, (factors * triples[k : k + 1024]).min(axis=1))
    return least.view(np.int32)


def parse_lines(docs: DataFrame, least: int, depth: int) -> DataFrame:
    """Lines with tokens of ``docs(digest, text)``: token count, hashes of the masked
    line and of its leaf, token hashes; and a row at position ``SKETCH`` for every text
    with tokens.  Of lines of fewer than ``least`` tokens, and of those of
    variable fields only, the template is the line as it is; they have no leaf and no
    tokens."""

    def run(batches):
        from hashlib import blake2b
        from zlib import crc32

        whole = lambda x: int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True)
        names = ["digest", "pos", "n", "template", "leaf", "tokens"]
        factors = np.random.default_rng(5).integers(0, 1 << 32, (MINIMA, 1)).astype(np.uint32) | np.uint32(1)
        none = np.zeros(0, np.int32)
        np.seterr(over="ignore")  # scrambling wraps around

        def flush(rows, tokens):
            digests, places, counts, templates, leaves = zip(*rows)
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests, pa.binary()),
                    pa.array(places, pa.int32()),
                    pa.array(counts, pa.int32()),
                    pa.array(templates, pa.int64()),
                    pa.array(leaves, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens))),
                ],
                names,
            )

        for batch in batches:
            rows, flat, size = [], [], 0
            for digest, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1))):
                digest = bytes(digest)
                raw = bytes(text).split(b"\n")
                lines = [(MASK.sub(b"<*>", x) if DIGIT.search(x) else x).lower().split() for x in raw]
                hashes = np.array([crc32(t) for tokens in lines for t in tokens], np.uint32)
                if not len(hashes):
                    continue
                # copies are told by the words as they are: masked numbers would make unlike texts alike
                plain = hashes.copy()
                at = 0
                for x, tokens in zip(raw, lines):
                    if tokens and DIGIT.search(x):
                        plain[at : at + len(tokens)] = [crc32(t) for t in x.lower().split()]
                    at += len(tokens)
                rows.append((digest, SKETCH, 0, 0, 0))
                flat.append(sketch(plain, factors))
                at = 0
                for k, tokens in enumerate(lines):
                    n = len(tokens)
                    if n >= least and any(t != b"<*>" for t in tokens):
                        leaf = whole(b"%d %s" % (n, b" ".join(tokens[:depth])))
                        rows.append((digest, k, n, whole(b" ".join(tokens)), leaf))
                        flat.append(hashes[at : at + n].view(np.int32))
                    elif n:
                        rows.append((digest, k, n, whole(b" ".join(raw[k].lower().split())), None))
                        flat.append(none)
                    at += n
                size += at
                if size > 500_000:
                    yield from flush(rows, flat)
                    rows, flat, size = [], [], 0
            if rows:
                yield from flush(rows, flat)

    return docs.select("digest", "text").mapInArrow(run, LINES)


def copies(sketches: DataFrame) -> DataFrame:
    """``id, class`` of the texts of ``sketches(id, tokens)`` that are linked to others.
    A bucket's members are compared with one of them, another one in every band."""
    bands = [F.xxhash64(F.lit(b), F.slice("tokens", b * ROWS + 1, ROWS)) for b in range(MINIMA // ROWS)]
    # the salt changes the order of the ids from band to band
    each = sketches.select("id", F.posexplode(F.array(*bands)).alias("b", "band"))
    each = each.select("band", F.col("id").bitwiseXOR(F.xxhash64(F.lit("salt"), "b")).alias("salted"), "id", "b")
    buckets = each.groupBy("band").agg(F.min("salted").alias("lo"), F.max("salted").alias("hi")).where("lo <> hi").select("band", "lo")
    pairs = each.join(buckets, "band").where("salted <> lo").select("id", F.col("lo").bitwiseXOR(F.xxhash64(F.lit("salt"), "b")).alias("to"))
    pairs = durable(pairs.distinct())
    need = pairs.select("id").union(pairs.select("to")).distinct()
    known = durable(sketches.join(need, "id", "left_semi").groupBy("id").agg(F.first("tokens").alias("tokens")))
    both = pairs.join(known, "id").join(known.select(F.col("id").alias("to"), F.col("tokens").alias("other")), "to")
    same = F.size(F.filter(F.zip_with("tokens", "other", lambda x, y: x == y), lambda x: x))
    links = both.where(same >= ALIKE * MINIMA).select(F.col("id").alias("a"), F.col("to").alias("b"))
    return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("class"))


def recurring(lines: DataFrame, key: str, need: Column) -> DataFrame:
    """The values of ``key`` that stand in at least ``need`` classes of texts, a number
    from the line's tokens ``n``; ``lines`` carry the ``class`` of their text."""
    often = lines.groupBy(key).agg(F.count("*").alias("k"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("n").alias("n"))
    often = often.where((F.col("k") >= need) & (F.col("lo") != F.col("hi"))).select(key, need.alias("need"))
    unlike = lines.select(key, "class").join(often, key).distinct()
    return unlike.groupBy(key, "need").count().where("count >= need").select(key)


def generalised(lines: DataFrame, leaves: DataFrame, contexts: int, depth: int, constant: tuple[float, ...], similarity: float) -> DataFrame:
    """``template, wild``: for the masked lines ``template`` of ``leaves(leaf, size)`` the more
    general ones, of constant tokens and wildcards, one for each of the shares ``constant``
    that gives another.  A token is constant where at least that share of the leaf's lines
    have it, so a leaf of several templates falls into them at one of the shares; lines
    with less than ``similarity`` of their tokens constant have none at that share.

    Equal lines are counted together first.  The leading tokens are those of the leaf, so
    only the last of them is looked at."""
    each = lines.join(leaves, "leaf").groupBy("template", "leaf", "n", "size").agg(F.count("*").alias("m"), F.first("tokens").alias("tokens"))
    head = F.least(F.lit(depth), F.col("n")) - 1
    fields = durable(each).select("template", "n", "leaf", "size", "m", F.posexplode(F.slice("tokens", head + 1, F.col("n"))).alias("i", "t"))
    common = fields.groupBy("leaf", "size", "i", "t").agg(F.sum("m").alias("k"))
    common = common.where((F.col("k") >= contexts) & (F.col("k") >= min(constant) * F.col("size")))
    common = common.select("leaf", "i", "t", (F.col("k") / F.col("size")).alias("share"))
    # a line's template at each share: how many fields are constant there, and which
    own = lambda c: F.col("share") >= c
    sets = [a for k, c in enumerate(constant) for a in (F.count_if(own(c)).alias(f"c{k}"), F.bit_xor(F.when(own(c), F.xxhash64("i", "t"))).alias(f"h{k}"))]
    kept = fields.join(common, ["leaf", "i", "t"]).groupBy("template", "n", "leaf").agg(*sets)
    wild = [F.when(F.col(f"c{k}") + head >= similarity * F.col("n"), F.xxhash64("leaf", f"h{k}")) for k in range(len(constant))]
    return kept.select("template", F.explode(F.array_distinct(F.array_compact(F.array(*wild)))).alias("wild"))


def drop_lines(text: Column, at: Column) -> Column:
    """The text without the lines at the positions ``at``: the slices between them, so
    the work is in proportion to the text."""
    bounds = lambda n: F.concat(F.array(F.lit(-1)), F.array_sort(at), F.array(n))

    def between(lines, b):
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda k: F.slice(lines, F.get(b, k) + 2, F.get(b, k + 1) - F.get(b, k) - 1)))

    return F.array_join(let(F.split(text, "\n", -1), lambda lines: let(bounds(F.size(lines)), lambda b: between(lines, b))), "\n")


def dedup_lines(
    docs: DataFrame,
    contexts: int = 3,
    least_tokens: int = 4,
    depth: int = 4,
    constant: tuple[float, ...] = (0.3, 0.1, 0.03),
    similarity: float = 0.6,
) -> DataFrame:
    """Every row of ``docs`` with its recurring lines dropped from ``text``, and
    ``n_lines``, ``n_dropped``; all other columns stay as they are.

    Lines are what ``\\n`` parts.  A line of ``n`` < ``least_tokens`` tokens must stand in
    ``contexts * ceil(least_tokens / n)`` classes; lines without tokens stay.  Null and
    empty texts stay as they are, with 0 lines.  Rows with equal texts get equal
    results.  A text of recurring lines only becomes empty; its row stays.  Texts are
    read whole however long, an empty table gives no row.  Columns of ``docs`` named like
    the two new ones are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    taken = {c.lower() for c in docs.columns}
    key, places = (next(n for i in range(len(taken) + 1) if (n := f"{base}{i}") not in taken) for base in ("digest", "places"))
    need = F.lit(contexts) * F.greatest(F.ceil(least_tokens / F.col("n")), F.lit(1))
    digest = F.unhex(F.md5("text"))
    own = docs.select(digest.alias("digest"), "text").where("text <> ''")
    parsed = durable(parse_lines(own, least_tokens, depth))
    lines = parsed.where(F.col("pos") != SKETCH)
    classes = copies(parsed.where(F.col("pos") == SKETCH).select(F.xxhash64("digest").alias("id"), "tokens"))

    def classed(rows: DataFrame, *columns: str) -> DataFrame:
        """Columns of rows with the class of their text; one without any is its own."""
        joined = rows.select(F.xxhash64("digest").alias("id"), *columns).join(classes, "id", "left")
        return durable(joined.select(*columns, F.coalesce("class", "id").alias("class")))

    marks = classed(lines, "template", "leaf", "n")
    exact = durable(recurring(marks, "template", need))
    dropped = lines.join(exact, "template", "left_semi").select("digest", "pos")
    # what may generalise: leaves with several templates, in several classes
    leaves = marks.where("leaf is not null").join(exact, "template", "left_anti").groupBy("leaf").agg(
        F.count("*").alias("size"), F.min("template").alias("t1"), F.max("template").alias("t2"), F.min("class").alias("c1"), F.max("class").alias("c2")
    )
    leaves = leaves.where(f"size >= {contexts} and t1 <> t2 and c1 <> c2").select("leaf", "size")
    rest = lines.where("leaf is not null").join(exact, "template", "left_anti")
    found = durable(generalised(rest, leaves, contexts, depth, constant, similarity))
    wild = durable(rest.select("digest", "pos", "n", "template").join(found, "template").drop("template"))
    general = recurring(classed(wild, "wild", "n"), "wild", F.lit(contexts))
    dropped = dropped.union(wild.join(general, "wild", "left_semi").select("digest", "pos"))
    drops = durable(dropped.groupBy(F.col("digest").alias(key)).agg(F.collect_set("pos").alias(places)))

    out = docs.withColumn(key, digest).join(drops, key, "left")
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(drop_lines(F.col("text"), F.col(places)))
    n_lines = F.when(F.col("text") != "", F.size(F.split("text", "\n", -1))).otherwise(F.lit(0))
    return out.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(n_lines, F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).alias("n_dropped"),
    )
