"""Toxicity by class-conditional Kneser-Ney models over characters.

Two interpolated Kneser-Ney models of order ``ORDER`` are counted from the labelled
texts, one of toxic and one of ordinary ones.  Only their highest order differs by
class: all lower orders are continuation counts of both classes together, so an
expression that is rare in either class backs off to the same estimate.  A text's
evidence is the difference of its two log-likelihoods per character; a logistic
curve over evidence and length, fitted on texts whose evidence comes from models
that never saw their fold, turns it into a probability.

Characters are folded to ``SYMBOLS`` = 32 classes (letters without case, digits,
separators, four classes of non-ASCII bytes), which bounds a model at
``SYMBOLS ** ORDER`` entries (4 MB) whatever the corpus.  Counts cover every
labelled text.  The price: scripts without ASCII letters are streams of four symbols, in
which different words look alike, so toxic expressions there are told apart poorly;
accented letters merge likewise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, durable

SYMBOLS, ORDER = 32, 4
SIZE = SYMBOLS**ORDER
DISCOUNT = 0.75
#: A text is read in pieces of so many bytes.
PIECE = 1 << 20
#: Evidence is binned so finely for the calibration.
STEP, LOG_STEP = 1e-3, 0.25


def symbol_table() -> np.ndarray:
    """Class of every byte: 0 separates, 1-26 letters, 27 digits, 28-31 non-ASCII."""
    table = np.zeros(256, np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    table[ord("0") : ord("9") + 1] = 27
    table[128:192] = 28 + np.arange(64) % 3
    table[192:256] = 31
    return table


def grams(text, table: np.ndarray):
    """Codes of all runs of ``ORDER`` symbols, in pieces; runs of separators count
    as one, and one stands before and after the text.  A text has at least one."""
    data = np.frombuffer(text, np.uint8)
    carry = np.zeros(1, np.int32)
    for at in range(0, max(len(data), 1), PIECE):
        symbols = np.concatenate([carry, table[data[at : at + PIECE]]])
        last = at + PIECE >= len(data)
        if last:
            symbols = np.append(symbols, 0)
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        symbols = symbols[keep].astype(np.int32)
        if last and at == 0 and len(symbols) < ORDER:
            symbols = np.concatenate([np.zeros(ORDER - len(symbols), np.int32), symbols])
        if len(symbols) >= ORDER:
            n = len(symbols) - ORDER + 1
            code = np.zeros(n, np.int32)
            for k in range(ORDER):
                code = code * SYMBOLS + symbols[k : k + n]
            yield code
        carry = symbols[-(ORDER - 1) :]


def count_grams(labelled: DataFrame, folds: int) -> DataFrame:
    """``(gram, k, n)`` over rows ``(text, toxic, fold)``: how often a gram stands in
    the texts of fold ``fold`` and class ``toxic``, k = 2 * fold + toxic."""

    def count(batches):
        table = symbol_table()
        total = np.zeros((2 * folds, SIZE), np.int64)
        held: list[list[np.ndarray]] = [[] for _ in range(2 * folds)]
        size = 0

        def flush():
            for k, parts in enumerate(held):
                if parts:
                    total[k] += np.bincount(np.concatenate(parts), minlength=SIZE)
                    parts.clear()

        for batch in batches:
            keys = 2 * batch.column(2).to_numpy(zero_copy_only=False) + batch.column(1).to_numpy(zero_copy_only=False)
            for text, k in zip(as_bytes(batch.column(0)), keys):
                for code in grams(text, table):
                    held[k].append(code)
                    size += len(code)
                    if size > 4 * SIZE:
                        flush()
                        size = 0
        flush()
        for k in range(2 * folds):
            found = np.flatnonzero(total[k]).astype(np.int32)
            for at in range(0, len(found), 1 << 17):
                part = found[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(part), k, np.int32)), pa.array(total[k][part])], ["gram", "k", "n"]
                )

    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"))
    return rows.mapInArrow(count, "gram int, k int, n bigint").groupBy("gram", "k").agg(F.sum("n").alias("n"))


def kneser_ney(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio toxic : ordinary of every gram."""
    both = (ordinary > 0) | (toxic > 0)
    levels = [both.reshape(SYMBOLS, -1).sum(0)]  # contexts before each shorter run
    for _ in range(ORDER - 2):
        levels.append((levels[-1].reshape(SYMBOLS, -1) > 0).sum(0))

    def interpolate(counts, lower):
        rows = counts.reshape(-1, SYMBOLS).astype(np.float32)
        total = rows.sum(1, keepdims=True)
        back = DISCOUNT * (rows > 0).sum(1, keepdims=True) * lower
        return np.where(total > 0, (np.maximum(rows - DISCOUNT, 0) + back) / np.maximum(total, 1), lower)

    shared = np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32)
    for counts in reversed(levels):
        lower = np.tile(shared.reshape(-1, SYMBOLS), (len(counts) // SYMBOLS // (shared.size // SYMBOLS), 1))
        shared = interpolate(counts, lower)
    lower = np.tile(shared.reshape(-1, SYMBOLS), (SYMBOLS, 1))
    ratio = np.log(np.maximum(interpolate(toxic, lower), 1e-9)) - np.log(np.maximum(interpolate(ordinary, lower), 1e-9))
    return ratio.ravel().astype(np.float32)


def evidence(docs: DataFrame, tables: list[np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``evidence`` (an array, one entry a table) and ``size`` of every
    row's text; a narrow pass that takes all columns along."""
    held = docs.sparkSession.sparkContext.broadcast(np.stack(tables))
    width, names = len(tables), docs.columns
    at = names.index(text_col)

    def score(batches):
        ratios, table = held.value, symbol_table()
        for batch in batches:
            rows = batch.num_rows
            sums, sizes = np.zeros((rows, width)), np.zeros(rows, np.int64)
            for i, x in enumerate(as_bytes(batch.column(at))):
                if len(x):
                    for code in grams(x, table):
                        sums[i] += ratios[:, code].sum(1, dtype=np.float64)
                        sizes[i] += len(code)
            means = sums / np.maximum(sizes, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(means.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sizes)], [*names, "evidence", "size"])

    schema = T.StructType([*docs.schema.fields, T.StructField("evidence", T.ArrayType(T.DoubleType())), T.StructField("size", T.LongType())])
    return docs.mapInArrow(score, schema)


def features(e, n):
    """What the logistic curve sees: a constant, evidence, evidence by length."""
    return (e * 0 + 1, e * 30, e * 30 * (n - 7))


def logistic(e: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the logistic curve by Newton's method."""
    x = np.stack(features(e, n), 1)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """A table of log-likelihood ratios, the logistic curve (none if only one class
    was seen) and the labels' base rate."""

    table: np.ndarray
    weights: np.ndarray | None
    rate: float

    def probability(self, evidence: Column, size: Column) -> Column:
        if self.weights is None:
            return F.lit(self.rate)
        terms = zip(features(F.get(evidence, F.lit(0)), F.log(size)), self.weights)
        z = sum((f * F.lit(float(w)) for f, w in terms), F.lit(0.0))
        return F.when(size == 0, F.lit(self.rate)).otherwise(1 / (1 + F.exp(-z)))


def learn(docs: DataFrame, labels: DataFrame, fold: Column, folds: int) -> tuple[Model, DataFrame]:
    """The model, and ``doc_id, evidence, size`` of every row of ``docs``.

    ``labels(doc_id, toxic)`` marks some rows; ``fold`` is a column expression over
    ``doc_id`` with 0 .. folds - 1 for rows to learn from and null for the rest.
    Repeated rows are each counted.  Rows whose label is null or not 0 or 1 teach
    nothing; an id with both labels is toxic.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("fold", fold).where("fold is not null")
    # labels grow with the texts, so this is a shuffle of the texts that may teach at every size
    taught = own.where(fold.isNotNull()).join(known.hint("merge"), "doc_id")

    def packed(batches):
        for batch in batches:
            grams, k, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for fold in np.unique(k):
                own = k == fold
                yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), *[pa.array([x[own].tobytes()], pa.binary()) for x in (grams, n)]], ["k", "grams", "n"])

    total = np.zeros((2 * folds, SIZE), np.int64)
    counts = count_grams(taught, folds).select("gram", "k", "n").mapInArrow(packed, "k int, grams binary, n binary")
    for r in counts.collect():  # 12 bytes a gram, at most SIZE grams a class and fold
        total[r["k"], np.frombuffer(r["grams"], np.int32)] = np.frombuffer(r["n"], np.int64)
    ordinary, toxic = total[0::2].sum(0), total[1::2].sum(0)
    tables = [kneser_ney(ordinary, toxic)]
    for k in range(folds):  # models that have not seen fold k
        tables.append(kneser_ney(ordinary - total[2 * k], toxic - total[2 * k + 1]))
    del total

    scored = durable(evidence(own, tables).drop("text"))
    blind = F.get(F.col("evidence"), F.col("fold") + 1)
    bins = (
        scored.join(known, "doc_id")
        .where("size > 0")
        .groupBy("toxic", F.round(blind / STEP).alias("e"), F.round(F.log("size") / LOG_STEP).alias("n"))
        .agg(F.count("*").alias("rows"))
        .toPandas()  # bounded by the number of bins
    )
    rows, y = bins["rows"].to_numpy(float), bins["toxic"].to_numpy(float)
    rate = float((rows * y).sum() / rows.sum()) if len(bins) else 0.0
    weights = logistic(bins["e"].to_numpy(float) * STEP, bins["n"].to_numpy(float) * LOG_STEP, y, rows) if 0 < rate < 1 else None
    return Model(tables[0], weights, rate), scored


def score_all(docs: DataFrame, labels: DataFrame, fold: Column, folds: int) -> DataFrame:
    """``doc_id, score, size`` for every row of ``docs(doc_id, text)``: ``score`` from
    0 to 1, higher for likelier toxic, ``size`` the number of grams.

    Null and empty texts get the base rate of the labels; without labels of both
    classes every score is the base rate (0 without any).  Repeated rows are scored
    each; other columns are ignored.
    """
    model, scored = learn(docs, labels, fold, folds)
    return scored.select("doc_id", model.probability(F.col("evidence"), F.col("size")).alias("score"), "size")


def reject(docs: DataFrame, labels: DataFrame, fold: Column, folds: int, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are.
    Null and empty texts stay."""
    model, _ = learn(docs, labels, fold, folds)
    names = [f"c{i}" for i in range(len(docs.columns))]  # any column names, clashing ones too
    at = docs.columns.index("text")
    scored = evidence(docs.toDF(*names), [model.table], names[at])
    kept = scored.where((F.col("size") == 0) | (model.probability(F.col("evidence"), F.col("size")) < threshold))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
