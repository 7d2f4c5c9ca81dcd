"""Loops over DataFrames: each round is written to the shared folder, so plans stay
short and the state outlives executors.  And the way of the package's own code to the
executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder of ``spark.checkpoint.dir`` and read it back.  A folder
    of its own is made only in local mode; on a cluster it must be set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rootweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/rootweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rounds(most: int | None = None) -> Iterator[int]:
    """Numbers of the rounds of a loop that breaks once it is done; a bound that is hit
    raises, so no loop stops half way in silence."""
    n = 0
    while most is None or n < most:
        yield n
        n += 1
    raise RuntimeError(f"not done in {most} rounds")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for an application: operators with Python
    functions then run wherever the session was started, and whatever the workers' path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="rootweave-")) / f"{top.name}-operators.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
