"""Document fingerprints by a threshold-scaled sketch.

A document's set holds the hashes of its distinct runs of ``SIZE`` words (of fewer
words: of all of them; words as in near-duplicate search, A-Z like a-z).  Its sketch
retains every hash below a fixed fraction, ``1 / SHARE``, of the 64-bit range.  All
sketches are cut at the same value, so they merge by union and the part of one
document that lies in another of quite other length is estimated from the hashes that
both would have retained.  A set with fewer than ``LEAST`` hashes below the fraction
retains its ``LEAST`` smallest, which merges as well: the smallest of a union are among
the smallest of its parts.

The packed form is a mark (1: the whole set is held) and the hashes, ascending, big
endian.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes
from .neardup import Hasher

SIZE, SHARE, LEAST = 5, 16, 32
TOP = 2**64 - 1
#: Ranges of documents for one partition, so that uneven ones level out.
RANGES = 4
#: Rows go out when so many bytes wait.
WAITING = 4 << 20

EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, sketch binary, edited_sketch binary, "
    "near_edited double, near_next double, jaccard_edited double, jaccard_next double"
)


def retain(shingles: np.ndarray, share: int = SHARE, least: int = LEAST) -> bytes:
    """The packed sketch of a sorted set of hashes."""
    n = max(int(np.searchsorted(shingles, np.uint64(TOP // share), "right")), min(least, len(shingles)))
    return bytes([n == len(shingles)]) + shingles[:n].astype(">u8").tobytes()


def opened(sketch: bytes, share: int = SHARE) -> tuple[np.ndarray, int]:
    """The hashes of a packed sketch and the value up to which it knows its set."""
    hashes = np.frombuffer(sketch, ">u8", offset=1).astype(np.uint64)
    if sketch[0]:
        return hashes, TOP
    return hashes, max(int(hashes[-1]), TOP // share)


def likeness(a: bytes, b: bytes, share: int = SHARE) -> tuple[float, float]:
    """Estimated containment of the smaller set in the larger, and Jaccard similarity,
    from the hashes up to the value that both sketches know.  Equal sketches are alike by
    1; sets of which one has no such hash by 0."""
    if a == b:
        return 1.0, 1.0
    (x, to_x), (y, to_y) = opened(a, share), opened(b, share)
    cut = np.uint64(min(to_x, to_y))
    x, y = x[: np.searchsorted(x, cut, "right")], y[: np.searchsorted(y, cut, "right")]
    if not len(x) or not len(y):
        return 0.0, 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / min(len(x), len(y)), both / (len(x) + len(y) - both)


def fingerprint(docs: DataFrame, text: str = "text", share: int = SHARE, least: int = LEAST) -> DataFrame:
    """``docs`` with the column ``sketch``, of whole texts.  Null, empty and blank texts
    have the sketch of the empty set; long texts are read in pieces.  An empty table gives
    no row; a column named ``sketch`` is replaced."""

    def run(batches):
        hasher = Hasher(SIZE)
        for batch in batches:
            found = [retain(hasher.shingles(t), share, least) for t in as_bytes(batch.column(text))]
            kept = [c for c in batch.schema.names if c != "sketch"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.binary())], [*kept, "sketch"])

    fields = [f for f in docs.schema.fields if f.name != "sketch"]
    schema = type(docs.schema)(list(fields)).add("sketch", "binary")
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)


def merged(sketches: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """The merged sketches of every value of ``key``: rows ``(key, hash)`` of its union
    below the fraction, as signed 64-bit numbers.  They stay rows, so that a key with many
    documents fills no task; ``share`` times a key's rows estimates its distinct shingles.
    Null sketches add nothing."""

    def run(batches):
        for batch in batches:
            keys, hashes = [], []
            for i, s in enumerate(as_bytes(batch.column(1))):
                if len(s) > 1:
                    x, _ = opened(bytes(s), share)
                    x = x[: np.searchsorted(x, np.uint64(TOP // share), "right")]
                    keys.append(np.full(len(x), i))
                    hashes.append(x.view(np.int64))
            at = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            found = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found)], [key, "hash"])

    return sketches.select(key, "sketch").mapInArrow(run, sketches.select(key).schema.add("hash", "long")).distinct()


def firsts(keyed: DataFrame, n: int) -> list:
    """The least key ``(doc_id, tie)`` of each of at most ``n`` ranges of equal size."""
    rows = keyed.select("doc_id", "tie").repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie")
    found = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    keys = [tuple(r["first"]) for r in found.collect()]  # a row a range
    return sorted(set(keys), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))


def number_of(bounds: list) -> Column:
    """The number of the range that holds a row's key; two levels of comparisons."""
    key = F.struct(F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"))
    lit = lambda k: F.struct(F.lit(k[0]).cast("bigint").alias("doc_id"), F.lit(k[1]).cast("bigint").alias("tie"))
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    at_most = lambda keys: F.size(F.filter(keys, lambda k: k <= key))
    block = at_most(F.array(*[lit(b[0]) for b in blocks])) - 1
    inner = F.get(F.array(*[F.array(*[lit(k) for k in b]) for b in blocks]), block)
    return (block * width + at_most(inner) - 1).cast("int")


def edit_likeness(docs: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Fingerprints of whole texts, of their edited forms and how alike they are.

    The edited text has the last quarter of the code points replaced by as many from the
    start of the next document's text, by ascending doc_id (after the last: the first).
    Rows without doc_id come first; rows of one doc_id are in the order of a hash of
    their text, repeated rows are each other's next.  A null text is empty.

    One shuffle deals the documents into ranges of doc_id; the first document of a range
    goes to the range before as well, where it ends the stream.  A task holds two
    documents at a time.  Only the ranges' first keys reach the driver.  An empty table
    gives no row; other columns are left out.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = firsts(keyed, RANGES * n)
    if not bounds:
        return spark.createDataFrame([], EDITED)
    own = keyed.withColumn("range", number_of(bounds))
    key = F.struct("doc_id", "tie")
    first = F.get(F.array(*[F.struct(F.lit(a).cast("bigint").alias("doc_id"), F.lit(b).cast("bigint").alias("tie")) for a, b in bounds]), F.col("range"))
    places = F.when(
        key.eqNullSafe(first),
        F.array(
            F.struct(F.col("range"), F.lit(False).alias("guard")),
            F.struct(F.pmod(F.col("range") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("guard")),
        ),
    ).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("guard"))))
    dealt = own.select(F.explode(places).alias("place"), "doc_id", "tie", "text").select("place.range", "place.guard", "doc_id", "tie", "text")
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "guard", F.asc_nulls_first("doc_id"), "tie")

    def run(batches):
        hasher = Hasher(SIZE)
        before, rows, waiting = None, [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for i, (place, guard, doc_id) in enumerate(zip(*columns)):
                if guard and before is None:  # a guard that was used
                    continue
                text = batch.column(3)[i].as_py()
                sketch = retain(hasher.shingles(text.encode()), share, least)
                if before is not None:
                    last_id, last, last_sketch = before
                    quarter = len(last) // 4
                    edited = (last[: len(last) - quarter] + text[:quarter]).encode()
                    changed = retain(hasher.shingles(edited), share, least)
                    near, far = likeness(last_sketch, changed, share), likeness(last_sketch, sketch, share)
                    rows.append((last_id, len(last), hashlib.sha256(edited).hexdigest(), last_sketch, changed, near[0], far[0], near[1], far[1]))
                    waiting += len(last_sketch) + len(changed) + 200
                before = None if guard else (doc_id, text, sketch)
                if waiting > WAITING:
                    yield out(rows)
                    rows, waiting = [], 0
        yield out(rows)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), *[pa.float64()] * 4)
    names = [f.split()[0] for f in EDITED.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)

    return dealt.select("range", "guard", "doc_id", "text").mapInArrow(run, EDITED)
