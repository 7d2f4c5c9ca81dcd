"""Helpers shared by the operators: durable tables, let-bindings, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a temporary folder is made
    and set for the session in local mode; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rootweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def durable(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    the rows outlive any executor.  What an application wrote lies in one folder,
    ``rootweave/<application id>``, which may be deleted when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rootweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array of longs, two-level, so that an array of
    k entries costs about k * block / 2 additions rather than k * k / 2."""

    def with_blocks(v):
        n_blocks = F.ceil(F.size(v) / F.lit(block)).cast("int")
        sums = F.transform(
            F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
            lambda b: F.aggregate(F.slice(v, b * block + 1, F.lit(block)), F.lit(0).cast("long"), lambda a, x: a + x),
        )
        return let(sums, lambda s: with_starts(v, s))

    def with_starts(v, s):
        starts = F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0).cast("long"), lambda a, x: a + x))
        return let(
            starts,
            lambda p: F.transform(
                v,
                lambda _, i: F.get(p, F.floor(i / block).cast("int"))
                + F.aggregate(
                    F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            ),
        )

    return let(lengths, with_blocks)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of an undirected edge table ``(a, b)``.

    Returns ``(node, component)`` with the smallest node of each component, for
    every node of an edge.  Alternates large-star and small-star steps: both are a
    minimum by node (combined before the shuffle) and a join, so a hub's
    neighbours are never gathered in one place.  Null ends and loops are ignored;
    an empty table gives an empty result.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = durable(e)
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points to the least of u's neighbourhood
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # small star: u and its smaller neighbours point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = durable(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.union(centres)


def as_bytes(column):
    """UTF-8 bytes of every entry of an Arrow string or binary column, null as empty."""
    import pyarrow as pa

    for value in column.cast(pa.large_binary()):
        buffer = value.as_buffer()
        yield b"" if buffer is None else memoryview(buffer)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for an application, so that Python
    workers can import it whatever their path holds."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="rootweave-")) / f"{top.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
