"""Near duplicates by fast similarity sketching.

A document's set holds its distinct word shingles as 64-bit hashes.  The sketch has
``BINS`` coordinates, filled in rounds: in each of the first ``BINS`` rounds every
element falls into a hashed bin, with the round number and a hash as its value; in
the rounds after them bin ``i`` takes an element whatever its hash, so every
coordinate is filled after ``2 * BINS`` rounds at most.  A coordinate keeps its least
value and a set is done after the round that fills the last one.  Two sets agree in
a coordinate with the probability of their Jaccard similarity, and the share of
equal coordinates is concentrated as for independent ones.

Bands of ``ROWS`` coordinates give the candidates; every link is confirmed on the
full sets.  Rows with equal sets are one class with one representative.  Within a
bucket no pairs are listed: its members are compared with one of them.  Members that
these links have not brought together are compared by prefix filtering, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, connected_components, durable

BINS, ROWS = 128, 4
#: Texts are read together up to about so many bytes.
PIECE = 1 << 20

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

SKETCHED = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>"
SETS = "doc_id bigint, set_key binary, shingles array<bigint>"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def byte_table() -> np.ndarray:
    """A random 64-bit number for every byte; A-Z have those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
    table[65:91] = table[97:123]
    return table


def powers(n: int, base: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    size, factor = 1, base
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(factor & (2**64 - 1))
        size, factor = size + more, factor * factor % (1 << 64)
    return out


class Hasher:
    """Hashes of words and shingles, a task's tables held ready."""

    def __init__(self, size: int):
        self.size = size
        self.table = byte_table()
        self.up, self.down = powers(PIECE, BASE), powers(PIECE, INVERSE)

    def words(self, text) -> np.ndarray:
        """Hash of every word of a text's bytes.  Words are parted by ASCII white
        space (9 to 13 and 32); those equal but for A-Z / a-z have one hash.  Long
        texts are read in pieces that end at white space."""
        data = np.frombuffer(text, np.uint8)
        found, at = [], 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            if end < len(data):
                space = np.flatnonzero(is_space(data[at:end]))
                while not len(space) and end < len(data):  # a word longer than a piece
                    more = np.flatnonzero(is_space(data[end : end + PIECE]))
                    space = more[:1] + (end - at) if len(more) else more
                    end = min(end + PIECE, len(data))
                end = at + int(space[-1]) if len(space) else len(data)
            found.append(self._words(data[at:end]))
            at = end + 1
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def _words(self, data: np.ndarray) -> np.ndarray:
        edge = np.diff(np.concatenate([[1], is_space(data).view(np.int8), [1]]))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            return np.zeros(0, np.uint64)
        if len(data) > len(self.up):
            self.up, self.down = powers(len(data), BASE), powers(len(data), INVERSE)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * GOLD)

    def shingles(self, text) -> np.ndarray:
        """The sorted distinct shingles of a text."""
        return np.unique(combine(self.words(text), self.size))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def combine(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, of all of them."""
    if len(words) == 0:
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * GOLD + words[k : len(words) - n + 1 + k])
    return out


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The filled coordinates of a non-empty set, as 64-bit numbers: the round in the
    upper bits and a hash below, so the least is the earliest round's least hash."""
    low = np.uint64(0x00FFFFFFFFFFFFFF)
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    left = bins
    for i in range(2 * bins):
        h = mix(shingles + np.uint64((i + 1) * int(GOLD) % (1 << 64)))
        value = (h & low) | (np.uint64(i) << np.uint64(56))
        if i < bins:
            np.minimum.at(out, ((h >> np.uint64(32)) % np.uint64(bins)).astype(np.int64), mix_low(value))
        else:
            out[i - bins] = min(out[i - bins], mix_low(value).min())
        left = int((out == np.iinfo(np.uint64).max).sum())
        if left == 0:
            break
    return out


def mix_low(value: np.ndarray) -> np.ndarray:
    """Scramble the lower 56 bits, which also chose the bin, and keep the round."""
    low = np.uint64(0x00FFFFFFFFFFFFFF)
    return (mix(value) & low) | (value & ~low)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A hash for every band of ``ROWS`` coordinates."""
    rows = coordinates.reshape(-1, ROWS)
    out = np.arange(1, len(rows) + 1, dtype=np.uint64) * GOLD
    for k in range(ROWS):
        out = mix(out * GOLD + rows[:, k])
    return out


def set_key(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Set size, key of the set and bands of every row; null key and bands for none."""

    def run(batches):
        hasher = Hasher(size)
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in as_bytes(batch.column(1)):
                s = hasher.shingles(text)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                bands.append(band_keys(sketch(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.mapInArrow(run, SKETCHED)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        hasher = Hasher(size)
        for batch in batches:
            sets = [hasher.shingles(text) for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "set_key", "shingles"],
            )

    return docs.mapInArrow(run, SETS)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of sets with 100 * intersection >= percent * union."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total")).where(
        F.col("common") * 100 >= percent * (F.col("total") - F.col("common"))
    ).select("a", "b")


def left_over(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between the components of ``members(rep, comp)``: exact by
    prefix filtering.

    With the shingles of a set in order of rarity, two sets of the wanted similarity
    share one of the first n - ceil(n * percent / 100) + 1.  So long passages that many
    texts share, which come last in that order, make no candidates.  At the first
    shared shingle what follows in both orders must still hold the overlap wanted.
    Pairs are listed between a shingle's largest component and the others and among
    these.
    """
    own = sets.join(members, "rep").select("rep", "comp", F.size("shingles").alias("n"), "shingles")
    one = own.select("rep", "comp", "n", F.explode("shingles").alias("s"))
    rarity = one.groupBy("s").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "s")))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    prefix = (
        one.join(rarity, "s")
        .groupBy("rep", "comp", "n")
        .agg(order.alias("order"))
        .select("rep", "comp", "n", F.posexplode(F.slice("order", F.lit(1), length)).alias("at", "x"))
        .where("x.df > 1")
        .select("rep", "comp", "n", (F.col("n") - F.col("at")).alias("rest"), F.col("x.s").alias("s"))
    )
    prefix = durable(prefix)
    sizes = prefix.groupBy("s", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("s").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    live = prefix.join(main.drop("comps"), "s")
    side = lambda df, k: df.select("s", *[F.col(c).alias(f"{c}{k}") for c in ("rep", "comp", "n", "rest")])
    pairs = side(live.where("comp <> main"), 1).join(side(live, 2), "s").where(
        (F.col("comp1") != F.col("comp2")) & (F.least("rest1", "rest2") * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)
    )
    return pairs.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """Classes of near-duplicate rows of ``docs(doc_id, text)``.

    Sets hold shingles of ``size`` words, lower-cased A-Z; a shorter text is one
    shingle; rows link at ``percent`` per cent Jaccard similarity or more.  Returns
    ``doc_id, n_shingles, component_id, kept``: the least ``doc_id`` reachable over
    links, and whether it is the row's own.

    Null, empty and blank texts have no set, link with nothing and are kept.  Repeated
    rows are one class.  Rows without ``doc_id`` still have a size; their component is
    that of their set, or null, and they are kept only in the latter case.  Other
    columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = durable(sketches(own, size))
    least = F.min(F.struct(F.col("doc_id").alias("rep"), "bands"))
    classes = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(least.alias("x"))
    classes = durable(classes.select("set_key", "x.rep", "x.bands"))

    bands = classes.select("rep", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    held = durable(bands.join(shared, "band"))
    # a bucket's centre is the member with most company in all its buckets: of many
    # near copies of one text, the one that is closest to them all
    company = held.groupBy("rep").agg(F.sum("k").alias("company"))
    centres = held.join(company, "rep").groupBy("band").agg(F.max_by("rep", F.struct("company", F.negate("rep"))).alias("centre"))
    buckets = durable(held.join(centres, "band"))
    stars = durable(buckets.where("rep <> centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct())

    needed = stars.select("a").union(stars.select("b")).distinct().select(F.col("a").alias("doc_id"))
    sets = full_sets(own.join(needed.hint("merge"), "doc_id", "left_semi"), size)
    sets = durable(sets.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"]).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "shingles"))

    links = durable(confirm(stars, sets, percent))
    found = connected_components(links)
    label = found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    # buckets of three and more whose members are not all together yet
    tagged = buckets.where("k > 2").join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    apart = tagged.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    members = durable(tagged.join(apart.select("band"), "band", "left_semi").select("rep", "comp").distinct())
    if not members.isEmpty():
        more = durable(confirm(left_over(members, sets, percent), sets, percent))
        if not more.isEmpty():
            found = connected_components(links.union(more))

    named = classes.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = durable(named.select("set_key", F.coalesce("component", "rep").alias("class_id")))
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("class_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept")
    )
