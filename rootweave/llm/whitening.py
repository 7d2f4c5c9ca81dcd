"""Whitening of embeddings by a bidiagonal qd solver.

Blockwise QR reduces the centred rows: every task folds its blocks into one triangular
factor, factors of neighbouring tasks are merged in a tree.  Householder reflections
bring the last factor to bidiagonal form.  The differential qd algorithm with shifts
(dqds) finds the squares of its singular values, which are the eigenvalues of the
covariance, and twisted factorisations give their vectors.  Values too close for that
share a subspace found by block inverse iteration.

Entries are taken as whole numbers ``floor(64 * c) + 1000000``, so sums and deviations
are exact.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

SCALE, OFFSET = 64, 1_000_000
#: Factors and covariances merged by one task.
FAN = 8
EPS = float(np.finfo(float).eps)
#: Neighbouring values closer than this share of the larger one share a subspace.
CLOSE = 1e-7

WHITENED = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


# ---------------------------------------------------------------- small dense solver


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector ``v`` and ``alpha`` with ``x - 2 v (v . x) = (alpha, 0, ...)``."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0
    alpha = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= alpha
    return v / np.linalg.norm(v), alpha


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of an upper bidiagonal ``B`` and an orthogonal ``V``
    with ``R'R = V B'B V'``."""
    a, n = np.array(r, float), len(r)
    v = np.eye(n)
    for k in range(n):
        u, alpha = reflector(a[k:, k])
        a[k:, k + 1 :] -= 2 * np.outer(u, u @ a[k:, k + 1 :])
        a[k, k] = alpha
        if k < n - 1:
            w, beta = reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
            a[k, k + 1] = beta
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def transform(q: list, e: list, shift: float):
    """One dqds step; nothing where the shift is above the least value."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = total = d + e[i]
        if total == 0.0:
            ratio = 0.0 if q[i + 1] == 0.0 else 1.0
            d = (0.0 if ratio == 0.0 else q[i + 1]) - shift
        else:
            ratio = q[i + 1] / total
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def lower_bound(q: list, e: list) -> float:
    """A bound below the least value: one over the sum of all inverse values."""
    h = 1.0 / q[-1] if q[-1] else float("inf")
    total = h
    for i in range(len(q) - 2, -1, -1):
        if q[i] == 0.0:
            return 0.0
        h = (1.0 + e[i] * h) / q[i]
        total += h
    return 0.0 if total in (0.0, float("inf")) or total != total else (1.0 - 4 * len(q) * EPS) / total


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal, falling, by dqds."""
    top = float(max(np.max(diagonal**2, initial=0.0), np.max(above**2, initial=0.0)))
    if top == 0.0:
        return np.zeros(len(diagonal))
    tiny = top * 1e-40
    found, left = [], [([max(float(x) ** 2, tiny) for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while left:
        q, e, sigma = left.pop()
        for _ in range(100 * len(q) + 100):
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            if len(q) == 2:
                half, product = (q[0] + e[0] + q[1]) / 2, q[0] * q[1]
                larger = half + max(half * half - product, 0.0) ** 0.5
                found += [larger + sigma, (product / larger if larger else 0.0) + sigma]
                break
            cut = [i for i in range(len(e)) if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1])) or e[i] == 0.0]
            if cut:
                i = cut[-1]
                left += [(q[: i + 1], e[:i], sigma), (q[i + 1 :], e[i + 1 :], sigma)]
                break
            if q[0] < q[-1]:  # the small values converge at the lower end
                q, e = q[::-1], e[::-1]
            shift = lower_bound(q, e)
            step = transform(q, e, shift)
            if step is None:
                shift, step = 0.0, transform(q, e, 0.0)
            (q, e), sigma = step, sigma + shift
        else:
            raise ArithmeticError("dqds did not settle")
    return np.sort(np.array(found))[::-1]


def twisted(d: np.ndarray, e: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Unit vector of ``B'B`` for ``value`` from its twisted factorisation, and the
    value's correction.  ``d`` and ``e`` are the squares of B's diagonal and of the
    entries above it, ``l`` the ratios of these to their diagonal entries."""
    n, guard = len(d), EPS * EPS * max(abs(value), 1e-300)
    s, p, down, up = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > guard else guard
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p[i + 1]
        pivot = pivot if abs(pivot) > guard else guard
        ratio = d[i] / pivot
        up[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = float(z @ z)
    return z / size**0.5, gamma[r] / size


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``R'R``, falling, ``most`` at most, and their unit
    vectors as columns.  Values lost in rounding (rank below the width) are left out."""
    diagonal, above, v = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    if not len(values) or values[0] <= 0.0:
        return np.zeros(0), np.zeros((len(r), 0))
    d = np.maximum(diagonal**2, values[0] * 1e-40)
    root = np.where(diagonal < 0, -1.0, 1.0) * np.sqrt(d)
    ratio = np.append(above / root[:-1], 0.0)
    kept = values[values > len(r) * EPS * values[0]]
    # clusters are taken whole, so that a cut does not split a subspace
    groups, at = [], 0
    while at < len(kept) and at < most:
        end = at + 1
        while end < len(kept) and kept[end - 1] - kept[end] <= CLOSE * kept[end - 1]:
            end += 1
        groups.append((at, end))
        at = end
    vectors = np.zeros((len(r), groups[-1][1]))
    values = kept[: groups[-1][1]].copy()
    for at, end in groups:
        if end - at == 1:
            value = float(values[at])
            for _ in range(4):
                z, change = twisted(d, above**2, ratio, value)
                if abs(change) > CLOSE * value or abs(change) <= 2 * EPS * value:
                    break
                value += change
            vectors[:, at] = z
            continue
        b = np.diag(root) + np.diag(above, 1)
        t = b.T @ b
        rng = np.random.default_rng(at)
        x = np.linalg.qr(rng.standard_normal((len(r), end - at)))[0]
        shifted = t - float(values[at:end].mean()) * (1 + 8 * EPS) * np.eye(len(r))
        for _ in range(4):
            x = np.linalg.qr(np.linalg.solve(shifted, x))[0]
        inner, turn = np.linalg.eigh(x.T @ t @ x)
        vectors[:, at:end] = (x @ turn)[:, ::-1]
        values[at:end] = inner[::-1]
    return values[:most], (v @ vectors)[:, :most]


# ---------------------------------------------------------------- distributed passes


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & fits)
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v"))


def by_width(batch: pa.RecordBatch):
    """Of each vector length in a batch: length, row numbers, whole-number matrix."""
    vectors = batch.column(batch.schema.get_field_index("v"))
    widths = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten(), float)
    starts = np.concatenate([[0], np.cumsum(widths)])
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        c = np.floor(flat[starts[rows][:, None] + np.arange(width)] * SCALE)
        if np.abs(c).max() >= 2.0**52:
            raise ValueError("an entry is too large to be taken as a whole number")
        yield width, rows, c.astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact."""
    if n * max(int(np.abs(x).max()), 1) >= 2**62:
        raise ValueError("entries and rows are too many for exact sums")
    return n * x - sums


def deviations(y: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact."""
    if int(np.abs(y).max()) ** 2 * y.shape[1] < 2**63:
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum(v * v for v in row)) for row in y.tolist()], pa.decimal128(38, 0))


def merged(parts: DataFrame, schema: str, merge) -> DataFrame:
    """One row for each ``width`` out of ``parts(width, slot, ...)``, ``FAN`` neighbouring
    slots at a time."""
    parts = durable(parts)
    last = parts.agg(F.max("slot")).first()[0]
    while last:
        parts = durable(parts.groupBy("width", F.floor(F.col("slot") / FAN).cast("int").alias("up")).applyInPandas(merge, schema))
        last //= FAN
    return parts


def merge_factors(rows: pd.DataFrame) -> pd.DataFrame:
    width, r = int(rows["width"].iloc[0]), None
    for part in rows.sort_values("slot")["r"]:
        block = np.frombuffer(part).reshape(-1, width)
        r = block if r is None else np.linalg.qr(np.concatenate([r, block]), mode="r")
    return pd.DataFrame({"width": [width], "slot": [int(rows["slot"].min()) // FAN], "r": [r.tobytes()]})


def merge_scatter(rows: pd.DataFrame) -> pd.DataFrame:
    n, mean, scatter = 0, None, None
    for m, b, c in rows.sort_values("slot")[["n", "mean", "scatter"]].itertuples(index=False):
        other = np.frombuffer(b)
        if mean is None:
            n, mean, scatter = m, other.copy(), np.frombuffer(c).copy()
            continue
        step = other - mean
        scatter += np.frombuffer(c) + (np.outer(step, step) * (n * m / (n + m))).ravel()
        mean += step * (m / (n + m))
        n += m
    return pd.DataFrame(
        {"width": [int(rows["width"].iloc[0])], "slot": [int(rows["slot"].min()) // FAN], "n": [n], "mean": [mean.tobytes()], "scatter": [scatter.tobytes()]}
    )


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every usable vector, one row a component.

    Vectors that are null or empty or hold null or non-finite entries take no part.
    Vectors of each length are a fit list of their own.  ``deviation`` is the exact sum of
    squares of ``n * x - S``, ``explained`` a component's share of the total variance,
    ``identity_error`` the largest deviation of the whitened rows' covariance from the
    identity.  A component without variance (fewer rows than dimensions, constant
    dimensions, one row) is left out; repeated rows count as often as they stand there;
    null ids are kept; an empty table gives no row; other columns are left out.  Entries
    of 2^46 or more raise, since their sums would not be exact.

    The driver holds sums and directions: ``components + 1`` numbers a dimension of each
    length of vectors.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)

    def add(batches):
        totals = {}
        for batch in batches:
            for width, at, x in by_width(batch):
                n, sums = totals.get(width, (0, np.zeros(width, np.int64)))
                totals[width] = n + len(at), sums + x.sum(axis=0)
        columns = [[w, n, s.tolist()] for w, (n, s) in totals.items()]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*columns)) or [()] * 3, kinds)], ["width", "n", "sums"])

    parts = rows.select("v").mapInArrow(add, "width int, n bigint, sums array<bigint>")
    totals = parts.select("width", "n", F.posexplode("sums").alias("i", "s")).groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = {}
    for r in totals.groupBy("width").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s")).collect():
        sums[r["width"]] = r["n"], np.array([x["s"] for x in r["s"]], np.int64)
    if not sums:
        return spark.createDataFrame([], WHITENED)
    held = spark.sparkContext.broadcast(sums)  # a number a dimension of each length

    def reduce_rows(batches):
        factors = {}
        for batch in batches:
            for width, _, x in by_width(batch):
                n, s = held.value[width]
                block = centred(x, n, s) / n
                if width in factors:
                    block = np.concatenate([factors[width], block])
                factors[width] = np.linalg.qr(block, mode="r")
        slot = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(factors), pa.int32()), pa.array([slot] * len(factors), pa.int32()), pa.array([r.tobytes() for r in factors.values()], pa.binary())],
            ["width", "slot", "r"],
        )

    factor = "width int, slot int, r binary"
    factors = merged(rows.select("v").mapInArrow(reduce_rows, factor), factor, merge_factors)

    def solve(batches):
        for batch in batches:
            out = []
            for width, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = np.frombuffer(packed).reshape(-1, width) / held.value[width][0] ** 0.5
                square = np.zeros((width, width))
                square[: len(r)] = r
                values, found = directions(square, components)
                total = float((square * square).sum())
                out.append((width, values.tolist(), total, (found / np.sqrt(values)).tobytes()))
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds)], ["width", "e", "total", "w"])

    solved = durable(factors.select("width", "r").mapInArrow(solve, "width int, e array<double>, total double, w binary"))
    models = {}
    for r in solved.collect():  # ``components`` numbers a dimension of each length
        models[r["width"]] = np.frombuffer(r["w"]).reshape(r["width"], len(r["e"])), [e / r["total"] for e in r["e"]]
    models = spark.sparkContext.broadcast(models)

    def spread(batches):
        found = {}
        for batch in batches:
            for width, at, x in by_width(batch):
                n, s = held.value[width]
                z = centred(x, n, s) / n @ models.value[width][0]
                mean = z.mean(axis=0)
                part = {"width": width, "slot": 0, "n": len(at), "mean": mean.tobytes(), "scatter": ((z - mean).T @ (z - mean)).tobytes()}
                both = [found[width], part] if width in found else [part]
                found[width] = merge_scatter(pd.DataFrame(both)).iloc[0].to_dict()
        slot = TaskContext.get().partitionId()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        out = [(w, slot, p["n"], p["mean"], p["scatter"]) for w, p in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)], ["width", "slot", "n", "mean", "scatter"])

    scatter = "width int, slot int, n bigint, mean binary, scatter binary"
    errors = {}
    for r in merged(rows.select("v").mapInArrow(spread, scatter), scatter, merge_scatter).collect():  # a row a length
        k = models.value[r["width"]][0].shape[1]
        c = np.frombuffer(r["scatter"]).reshape(k, k) / r["n"]
        errors[r["width"]] = float(np.abs(c - np.eye(k)).max()) if k else 0.0

    def project(batches):
        for batch in batches:
            for width, at, x in by_width(batch):
                n, s = held.value[width]
                y = centred(x, n, s)
                w, share = models.value[width]
                z = y / n @ w
                same = lambda value, kind: pa.array([value] * len(at), kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        same(n, pa.int64()),
                        deviations(y),
                        lists,
                        same(share, pa.list_(pa.float64())),
                        same(errors[width], pa.float64()),
                    ],
                    ["vec_id", "n", "deviation", "z", "share", "identity_error"],
                )

    schema = "vec_id bigint, n bigint, deviation decimal(38,0), z array<double>, share array<double>, identity_error double"
    found = rows.mapInArrow(project, schema)
    return found.select("*", F.posexplode("z").alias("i", "whitened")).select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("share", F.col("i")).alias("explained"),
        "identity_error",
    )
