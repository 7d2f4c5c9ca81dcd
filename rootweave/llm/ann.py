"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` rows); every row is indexed under
one of its leaves.  A query walks the tree best-bin-first: a priority queue holds the
branches seen so far by distance, and leaves come out in the order in which they are
worth a visit.  How many leaves a query visits is calibrated: some queries are
answered exactly, and visits widen until their recall reaches the target.

Largest inner product is nearness here; one more coordinate, which fills every
vector up to the longest norm, turns it into Euclidean distance for the tree only.
Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import durable

#: Rows that the tree is fitted on, and queries that calibrate the visits, at most.
SAMPLE, CALIBRATION = 20_000, 256
#: A leaf should hold so many times the root of the number of rows; sampled rows that
#: it must have.
LEAF_ROOT, LEAF_SAMPLES = 5, 8
BRANCHES = 8
#: Rows and queries of one task's block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096

FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass
class Tree:
    """Nodes by number, the root first: centre, children, and leaf number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    norm: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, extra])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row: down the tree to the nearest child."""
        x = self.lift(x)
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            best = nearest(x[rows], self.centres[kids])
            todo += [(int(k), rows[best == i]) for i, k in enumerate(kids)]
        return out

    def visit(self, query: np.ndarray, count: int) -> list[int]:
        """The first ``count`` leaves for a query, best bin first."""
        q = self.lift(query[None, :], query=True)[0]
        gaps = self.centres - q
        gaps = np.einsum("ij,ij->i", gaps, gaps)
        queue, found = [(0.0, 0)], []
        while queue and len(found) < count:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
            for k in self.children[node]:
                heapq.heappush(queue, (float(gaps[k]), k))
        return found


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from ``k`` distinct rows; fewer centres if rows repeat."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        at = nearest(x, centres)
        sizes = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        moved = sums[sizes > 0] / sizes[sizes > 0, None]
        if moved.shape == centres.shape and np.allclose(moved, centres):
            break
        centres = moved
    return centres


def fit(sample: np.ndarray, norm: float, leaf_size: int, seed: int = 7) -> Tree:
    """Split the sample by k-means until a node has at most ``leaf_size`` rows."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, 0)), [], np.zeros(0), norm)
    x = tree.lift(sample) if len(sample) else np.zeros((1, 1))
    centres, children, leaf, leaves = [x.mean(0)], [[]], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        parts = kmeans(x[rows], min(BRANCHES, -(-len(rows) // leaf_size)), rng) if len(rows) > leaf_size else []
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        at = nearest(x[rows], parts)
        for i, centre in enumerate(parts):
            centres.append(centre)
            children.append([])
            leaf.append(-1)
            children[node].append(len(centres) - 1)
            todo.append((len(centres) - 1, rows[at == i]))
    return Tree(np.array(centres), children, np.array(leaf), norm)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: the rows whose vector is neither null, empty or zero nor holds a
    null or non-finite component."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v")
    )


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def top(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows with the largest inner product, ties to the smaller id.
    ``rough`` may differ from the exact score in the last bits: what it cannot tell
    apart is scored again, term by term in one order."""
    rough = np.where(ids == query_id, -np.inf, rough)
    if len(ids) > k:
        least = np.partition(rough, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least)))
    else:
        near = np.arange(len(ids))
    near = near[ids[near] != query_id]
    score = (x[near] * q).sum(1)
    order = np.lexsort((ids[near], -score))[:k]
    return ids[near][order], score[order]


def search(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    recall: float = 0.97,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: dict | None = None,
) -> DataFrame:
    """The ``k`` rows with the largest inner product with each query.

    Queries are the rows where ``is_query`` (a condition over ``vec_id``) holds;
    candidates are all rows but those with the query's id.  Returns ``query_id, rank,
    vec_id, score``, best first from rank 1, ties to the smaller id; all candidates
    where there are fewer than ``k``.  ``report`` gets the leaves, the visits and the
    recall measured on the calibration queries.

    Rows without id, and vectors that are null, empty, zero, or hold a null or
    non-finite component take no part.  Vectors of each length are searched among
    themselves: those of the commonest length (of equally common ones the greater) by
    the tree, those of others by comparing all queries with all rows in blocks.
    Repeated ids are one row, with the greatest of their vectors by component order.
    An empty table gives no row.
    """
    spark = vectors.sparkSession
    all_rows = usable(vectors, id_col, vector_col)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    if not all_rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        all_rows = durable(all_rows.groupBy("vec_id").agg(F.max("v").alias("v")))
    widths = all_rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries"), F.max(length).alias("norm"))
    commonest = widths.orderBy(F.desc("rows"), F.desc("width")).first()
    width, rows, n_queries, norm = commonest or (0, 0, 0, 0.0)
    others, all_rows = all_rows.where(F.size("v") != width), all_rows.where(F.size("v") == width)
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def sample(df, most, total, seed):
        share = int(min(1.0, most / max(total, 1)) * (1 << 30))
        return df.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share).limit(2 * most).toPandas()

    seen = sample(all_rows, SAMPLE, rows, 1)
    points = np.array(seen["v"].tolist()).reshape(len(seen), -1)
    leaf_size = max(LEAF_SAMPLES, int(LEAF_ROOT * rows**0.5 * len(points) / rows))
    tree = fit(points if len(points) else np.zeros((0, width)), norm, leaf_size)
    del seen, points
    held = spark.sparkContext.broadcast(tree)  # bounded by SAMPLE / LEAF_SAMPLES leaves

    def index(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            leaf = held.value.assign(x) if held.value.leaves > 1 else np.zeros(len(x), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf), packed(x)], ["vec_id", "leaf", "v"])

    indexed = durable(all_rows.mapInArrow(index, "vec_id bigint, leaf int, v binary"))

    # calibration: exact answers of some queries, and the visit that would find them
    some = sample(all_rows.where(is_query), CALIBRATION, n_queries, 2)
    visits, ranks = tree.leaves, np.zeros(0, int)
    if len(some) and tree.leaves > 1:
        ids, q = some["vec_id"].to_numpy(), np.array(some["v"].tolist())

        def exact(batches):
            for batch in batches:
                own, leaf, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), unpacked(batch.column(2).to_pylist())
                scores = x @ q.T
                at = {v: i for i, v in enumerate(own.tolist())}
                out = []
                for j, query_id in enumerate(ids.tolist()):
                    found, score = top(own, x, query_id, q[j], scores[:, j], k)
                    out += [(query_id, v, s, int(leaf[at[v]])) for v, s in zip(found.tolist(), score.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))],
                    ["query_id", "vec_id", "score", "leaf"],
                )

        truth = best(indexed.mapInArrow(exact, FOUND + ", leaf int"), k).select("query_id", "leaf").toPandas()
        order = {i: {leaf: r for r, leaf in enumerate(tree.visit(v, tree.leaves))} for i, v in zip(ids.tolist(), q)}
        ranks = np.sort([order[a][b] for a, b in zip(truth["query_id"], truth["leaf"])])
        if len(ranks):
            visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
    if report is not None:
        report.update(rows=rows, leaves=tree.leaves, visits=visits, recall=float((ranks < visits).mean()) if len(ranks) else 1.0)

    def visit(batches):
        for batch in batches:
            q = unpacked(batch.column(1).to_pylist()) if len(batch) else np.zeros((0, 1))
            lists = [held.value.visit(v, visits) for v in q]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists, pa.list_(pa.int32())), batch.column(1)], ["query_id", "leaves", "q"]
            )

    asked = indexed.where(is_query).select("vec_id", "v").mapInArrow(visit, "query_id bigint, leaves array<int>, q binary")
    asked = durable(asked).select("query_id", "q", F.explode("leaves").alias("leaf"))
    # a leaf's rows and queries are dealt into blocks of bounded size
    sizes = indexed.groupBy("leaf").agg(F.count("*").alias("m")).join(asked.groupBy("leaf").agg(F.count("*").alias("n")), "leaf")
    sizes = {r["leaf"]: (-(-r["m"] // BLOCK_ROWS), -(-r["n"] // BLOCK_QUERIES)) for r in sizes.collect()}  # a row a leaf
    row_blocks = F.get(F.lit([sizes.get(i, (1, 1))[0] for i in range(tree.leaves)]), F.col("leaf"))
    query_blocks = F.get(F.lit([sizes.get(i, (1, 1))[1] for i in range(tree.leaves)]), F.col("leaf"))
    members = indexed.select(
        "leaf",
        F.pmod(F.xxhash64("vec_id"), row_blocks).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("qb"),
        "vec_id",
        "v",
    )
    wanted = asked.select(
        "leaf",
        F.explode(F.sequence(F.lit(0), row_blocks - 1)).alias("rb"),
        F.pmod(F.xxhash64("query_id"), query_blocks).cast("int").alias("qb"),
        "query_id",
        "q",
    )

    key = ["leaf", "rb", "qb"]
    found = members.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(lambda left, right: answer(left, right, k), FOUND)
    if not others.isEmpty():
        found = found.unionByName(compared(others, is_query, k))
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def answer(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The nearest of a block of rows for every query of a block."""
    asked, found, scored = [], [], []
    if len(left) and len(right):
        ids, x, q = left["vec_id"].to_numpy(), unpacked(left["v"]), unpacked(right["q"])
        for at in range(0, len(q), 256):
            rough = q[at : at + 256] @ x.T
            for query_id, v, r in zip(right["query_id"].to_numpy()[at : at + 256].tolist(), q[at : at + 256], rough):
                near, score = top(ids, x, query_id, v, r, k)
                asked.append(np.full(len(near), query_id))
                found.append(near)
                scored.append(score)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pd.DataFrame({"query_id": join(asked, np.int64), "vec_id": join(found, np.int64), "score": join(scored, np.float64)})


def compared(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """All queries of ``vectors(vec_id, v)`` against all rows of their length, in blocks
    of at most about ``BLOCK_ROWS`` rows and ``BLOCK_QUERIES`` queries."""

    def pack(batches):
        for batch in batches:
            rows = pa.array([np.asarray(v.values).tobytes() for v in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["vec_id", "v"])

    flat = durable(vectors.mapInArrow(pack, "vec_id bigint, v binary").withColumn("width", F.octet_length("v")))
    blocks = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
    sizes = flat.groupBy("width").agg(F.count("*").alias("m"), F.count_if(is_query).alias("n")).where("n > 0")
    sizes = sizes.select("width", blocks("m", BLOCK_ROWS).alias("rows"), blocks("n", BLOCK_QUERIES).alias("queries"))
    sized = flat.join(sizes, "width")
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = sized.select("width", deal(F.col("rows")).alias("rb"), spread("queries").alias("qb"), "vec_id", "v")
    wanted = sized.where(is_query).select("width", spread("rows").alias("rb"), deal(F.col("queries")).alias("qb"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    key = ["width", "rb", "qb"]
    members = members.select(*[F.col(c).alias(c) for c in members.columns])
    return members.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(lambda left, right: answer(left, right, k), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
