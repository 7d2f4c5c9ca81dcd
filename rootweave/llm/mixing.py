"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The tokens to keep of every
cell are raked until their sums agree with the target shares of every margin; no cell
can keep more than it has, so what is full stays full and the other cells of its
margin take its share in the next sweep.  A cell's kept tokens over its tokens are
the probability by which its documents are sampled.

A token is a word, a run between white space.  Without a topic of their own, texts
are clustered: their words are hashed into ``WIDTH`` places, and a text belongs to the
nearest of ``TOPICS`` centres that k-means finds over all rows.  Vectors and centres are
whole numbers, so sums and distances are exact: a text's topic depends neither on the
partitions nor on the order of rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .ann import nearest
from .common import as_bytes, durable
from .neardup import Hasher

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
#: Places of the word vectors, parts of their unit, and clusters.
WIDTH, UNIT, TOPICS = 256, 1 << 14, 8
#: Cells that one task rakes; more are dealt out.
ONE_TASK = 100_000


def word_vector(hasher: Hasher, text) -> tuple[int, np.ndarray]:
    """Number of words, and the root of every place's share of them (length 1), rounded
    to whole parts of the unit."""
    words = hasher.words(text)
    counts = np.bincount((words % np.uint64(WIDTH)).astype(np.int64), minlength=WIDTH)
    return len(words), np.rint(np.sqrt(counts / max(len(words), 1)) * UNIT)


def unpacked(column) -> np.ndarray:
    """Word vectors of an Arrow column of them, a row each."""
    return np.frombuffer(b"".join(as_bytes(column)), np.int16).reshape(-1, WIDTH).astype(np.float64)


def word_vectors(docs: DataFrame) -> DataFrame:
    """``source, lang, tokens, v`` of every row, written: ``v`` is the word vector, 2 bytes
    a place, null without words."""

    def run(batches):
        hasher = Hasher(1)
        for batch in batches:
            found = [word_vector(hasher, x) for x in as_bytes(batch.column(2))]
            tokens, v = pa.array([n for n, _ in found], pa.int64()), pa.array([v.astype(np.int16).tobytes() if n else None for n, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, v], ["source", "lang", "tokens", "v"])

    return durable(docs.select(named("source").alias("source"), named("lang").alias("lang"), "text").mapInArrow(run, "source string, lang string, tokens bigint, v binary"), "zstd")


def first_centres(vectors: DataFrame, seed: int = 3) -> np.ndarray:
    """Up to ``TOPICS`` different vectors, each drawn from all by its squared distance to
    the nearest of those before it (k-means++); equal vectors are drawn as one."""
    held = vectors.where("v is not null")
    centres = np.zeros((0, WIDTH))
    for i in range(TOPICS):

        def draw(batches, centres=centres):
            best = None
            for batch in batches:
                x = unpacked(batch.column(0))
                if not len(x):
                    continue
                weight = (x * x).sum(1) + ((centres * centres).sum(1) - 2 * (x @ centres.T)).min(1) if len(centres) else np.ones(len(x))
                # the least of exponential draws with these rates
                wait = -np.log((batch.column(1).to_numpy() + 0.5) / (1 << 53))
                wait = np.where(weight > 0, wait / np.maximum(weight, 1), np.inf)
                for at in np.flatnonzero(wait == wait.min()) if np.isfinite(wait.min()) else []:
                    found = (float(wait[at]), x[at].astype(np.int16).tobytes())
                    best = min(best or found, found)
            yield pa.RecordBatch.from_arrays([pa.array([best[0]] if best else [], pa.float64()), pa.array([best[1]] if best else [], pa.binary())], ["wait", "v"])

        drawn = held.select("v", F.pmod(F.xxhash64("v", F.lit(seed + i)), F.lit(1 << 53)).alias("u")).mapInArrow(draw, "wait double, v binary")
        found = drawn.agg(F.min(F.struct("wait", "v"))).first()[0]
        if found is None:
            break
        centres = np.vstack([centres, np.frombuffer(bytes(found["v"]), np.int16).astype(np.float64)])
    return centres


def lloyd_round(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of all vectors: sums and number by nearest centre, and the sum of squared distances."""

    def run(batches):
        totals, cost = np.zeros((len(centres), WIDTH + 1)), 0.0
        for batch in batches:
            x = unpacked(batch.column(0))
            if not len(x):
                continue
            gaps = (centres * centres).sum(1) - 2 * (x @ centres.T)
            own = np.zeros(gaps.shape)
            own[np.arange(len(x)), gaps.argmin(1)] = 1
            totals += own.T @ np.column_stack([x, np.ones(len(x))])
            cost += (x * x).sum() + gaps.min(1).sum()
        centre, place = np.indices(totals.shape)
        columns = [np.append(centre, -1), np.append(place, 0), np.append(totals, cost)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["centre", "place", "total"])

    found = vectors.where("v is not null").select("v").mapInArrow(run, "centre bigint, place bigint, total bigint")
    found = found.groupBy("centre", "place").agg(F.sum("total").alias("total")).collect()  # a row a place of a centre
    totals = np.zeros((len(centres), WIDTH + 1))
    for r in found:
        if r.centre >= 0:
            totals[r.centre, r.place] = r.total
    return totals[:, :WIDTH], totals[:, WIDTH], sum(r.total for r in found if r.centre < 0)


def topic_centres(vectors: DataFrame, tolerance: float = 1e-4) -> np.ndarray:
    """Centres of all word vectors: Lloyd's rounds until one lowers the sum of squared
    distances by no more than ``tolerance`` of it.  Centres that lose all rows go."""
    centres, before = first_centres(vectors), None
    while len(centres):
        sums, sizes, cost = lloyd_round(vectors, centres)
        if before is not None and before - cost <= tolerance * before:
            return centres
        centres, before = np.rint(sums[sizes > 0] / sizes[sizes > 0, None]), cost
    return np.zeros((1, WIDTH))


def with_topics(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``source, lang, topic, tokens`` of every row of ``vectors``, topics as ``measure`` has them."""

    def run(batches):
        for batch in batches:
            topic = iter(nearest(unpacked(batch.column(3).drop_null()), centres).tolist())
            topic = [f"t{next(topic)}" if there else NONE for there in batch.column(3).is_valid().to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(topic, pa.string()), batch.column(2)], ["source", "lang", "topic", "tokens"])

    return vectors.mapInArrow(run, "source string, lang string, topic string, tokens bigint")


def named(column: str) -> Column:
    """A margin's values as strings, null as one of them."""
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE))


def measure(docs: DataFrame, centres: np.ndarray | None) -> DataFrame:
    """``docs`` with ``tokens`` and, given centres, ``topic``: the nearest one's number."""
    at, names = docs.columns.index("text"), docs.columns
    more = [T.StructField("tokens", T.LongType())] + ([T.StructField("topic", T.StringType())] if centres is not None else [])

    def run(batches):
        hasher = Hasher(1)
        for batch in batches:
            found = [word_vector(hasher, x) for x in as_bytes(batch.column(at))]
            columns = [*batch.columns, pa.array([n for n, _ in found], pa.int64())]
            if centres is not None:
                topic = nearest(np.array([v for _, v in found]).reshape(-1, WIDTH), centres)
                columns.append(pa.array([f"t{k}" if n else None for k, (n, _) in zip(topic.tolist(), found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names + [f.name for f in more])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + more))


def settled(cells: DataFrame) -> DataFrame:
    """``cells``, written.  Up to ``ONE_TASK`` of them are read back by one task, so
    totals by any margin need no shuffle; more stay dealt out."""
    cells = durable(cells)
    return cells.coalesce(1) if cells.count() <= ONE_TASK else cells


def tempered(cells: DataFrame, margin: str, alpha: float) -> DataFrame:
    """Target shares ``(margin, target)`` proportional to the token share to the power
    ``alpha``: 1 leaves a margin as it is, 0 makes it even."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).withColumn("p", F.when(F.col("t") > 0, F.pow(F.col("t") / 1.0, F.lit(alpha))).otherwise(0.0))
    total = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select(margin, (F.col("p") / F.lit(total)).alias("target"))


def reachable(cells: DataFrame, margin: str, target: DataFrame, want: float) -> DataFrame:
    """``margin, to``: the tokens to keep of every value of a margin, ``want`` in all.
    A value cannot keep more than it has; the others take what it leaves, in proportion
    to their targets."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("has")).join(target.select(margin, "target"), margin, "left").na.fill(0.0, ["target"])
    sums = settled(sums.where("target > 0 or has > 0"))
    full = F.lit(False)
    while True:
        taken, left = sums.agg(F.sum(F.when(full, F.col("has")).otherwise(0.0)), F.sum(F.when(~full, F.col("target")).otherwise(0.0))).first()
        scale = (want - (taken or 0.0)) / left if left else 0.0
        to = F.when(full, F.col("has")).otherwise(F.col("target") * F.lit(scale))
        # a value that is full stays so: the scale only grows from round to round
        over = sums.where((to > F.col("has") * (1 + 1e-12)) & ~full).count()
        if not over:
            return sums.select(margin, to.alias("to"))
        full = F.col("target") * F.lit(scale) >= F.col("has")


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float, tolerance: float = 1e-3, batch: int = 4, report: dict | None = None) -> DataFrame:
    """``cells`` with ``weight``, the tokens to keep of each: at most its ``tokens``,
    ``keep`` of all in sum, shares by the targets of every margin.

    ``targets[margin]`` is a table ``(margin, target)``; targets of values without cells
    are left out and the others scaled up; values without a target keep nothing.  Goes
    on until every margin's sums are within ``tolerance`` of the kept tokens, or until
    sweeps change no sum by a tenth of that; what then is off can't be reached, is told
    in ``report`` (margin: largest gap of a share) and warned of from 1 % on.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    want = keep * total
    for m, t in targets.items():
        cells = cells.join(reachable(cells, m, t, want).withColumnRenamed("to", f"to_{m}"), m, "left").na.fill(0.0, [f"to_{m}"])
    raked, before = settled(cells.withColumn("weight", F.col("tokens") * F.lit(keep))), None
    while total:
        for _ in range(batch):
            for m in targets:
                held = F.sum("weight").over(Window.partitionBy(m))
                raked = raked.withColumn("weight", F.when(held > 0, F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"to_{m}") / held)).otherwise(0.0))
        raked = settled(raked)
        gaps = {m: raked.groupBy(m).agg((F.abs(F.sum("weight") - F.first(f"to_{m}")) / F.lit(want)).alias("gap")).agg(F.max("gap")).first()[0] for m in targets}
        worst = max(gaps.values(), default=0.0)
        if worst <= tolerance or (before is not None and before - worst < tolerance / 10):
            break
        before = worst
    else:
        gaps = {}
    if report is not None:
        report.update(gaps)
    for m, gap in gaps.items():
        if gap > 0.01:
            warnings.warn(f"the targets of {m} can't be reached together with the others: a share is off by {gap:.3f}", stacklevel=2)
    return raked.drop(*[f"to_{m}" for m in targets])


def mix(
    docs: DataFrame,
    alphas: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    topic: Column | None = None,
    keep: float = 0.8,
    seed: int = 17,
    report: dict | None = None,
) -> DataFrame:
    """Every row of ``docs`` with ``topic``, ``tokens``, ``worth`` (share of the kept tokens
    over share of all), ``probability`` and ``kept``.

    Targets are given by margin as tables ``(margin, target)``, or follow from
    ``alphas`` (see ``tempered``); ``topic`` is an expression, else the column of that
    name, else a cluster of the text's words.  A document is kept by a hash of its id
    (of its text, without id) and ``seed``, so a run can be repeated and equal ids go
    together.  ``report`` gets the margins' largest gaps.

    Null source, language or topic is a value of its own, ``(none)``; so is the topic of
    a text without words.  Null and empty texts weigh nothing and are kept with their
    cell's probability; a cell without tokens has probability 1.  An empty table stays
    empty.  Columns named like the new ones, but for ``topic``, are replaced.
    """
    docs = docs.drop("tokens", "worth", "probability", "kept")
    if topic is not None:
        docs = docs.withColumn("topic", topic)
    if "topic" in docs.columns:
        keyed = measure(docs, None)
        counted = keyed.select(*[named(m).alias(m) for m in MARGINS], "tokens")
    else:
        vectors = word_vectors(docs)
        centres = topic_centres(vectors)
        keyed, counted = measure(docs, centres), with_topics(vectors, centres)
    taken = {c.lower() for c in keyed.columns}
    names = {m: next(n for i in range(len(taken) + 1) if (n := f"{m}{i}") not in taken) for m in MARGINS}
    for m, name in names.items():
        keyed = keyed.withColumn(name, named(m))
    cells = settled(counted.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    alphas = {"source": 0.7, "lang": 0.7, "topic": 0.8} | (alphas or {})
    goals = {m: (targets or {}).get(m) or tempered(cells, m, alphas[m]) for m in MARGINS}
    raked = rake(cells, goals, keep, report=report)
    kept, total = raked.agg(F.sum("weight"), F.sum("tokens")).first()
    share = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    rates = raked.select(
        *[F.col(m).alias(name) for m, name in names.items()],
        (share / F.lit(float(kept or 1) / float(total or 1))).alias("worth"),
        F.coalesce(F.least(F.lit(1.0), share), F.lit(1.0)).alias("probability"),
    )
    drawn = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")), F.lit(seed))
    uniform = F.pmod(drawn, F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = keyed.join(rates, list(names.values()), "left").withColumn("kept", uniform < F.col("probability"))
    return out.drop(*names.values())
