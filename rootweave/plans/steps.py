"""Declarative pipelines: named steps over DataFrames that run only where an output is
missing or outdated.

``artifacts(item_key, name, version)`` says what is there.  A step maps input tables to
output tables for all items at once; it is run on the items that lack an output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fn = Callable[..., "DataFrame | dict[str, DataFrame]"]


@dataclass(frozen=True)
class Step:
    """``inputs`` by name; those with a default in ``defaults`` may be absent."""

    name: str
    fn: Fn
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    defaults: dict = field(default_factory=dict)

    def renamed(self, names: dict[str, str], fn: Fn | None = None) -> Step:
        """A copy with other input and output names."""
        new = lambda xs: tuple(names.get(x, x) for x in xs)
        return replace(self, fn=fn or self.fn, inputs=new(self.inputs), outputs=new(self.outputs), defaults={names.get(k, k): v for k, v in self.defaults.items()})

    def run(self, namespace: dict) -> dict:
        missing = [x for x in self.inputs if x not in namespace and x not in self.defaults]
        if missing:
            raise KeyError(f"step {self.name}: missing {', '.join(missing)}")
        out = self.fn(*[namespace.get(x, self.defaults.get(x)) for x in self.inputs])
        out = out if isinstance(out, dict) else dict(zip(self.outputs, out if isinstance(out, tuple) else (out,)))
        absent = set(self.outputs) - out.keys()
        if absent:
            raise KeyError(f"step {self.name}: no output {', '.join(sorted(absent))}")
        return {k: out[k] for k in self.outputs}


#: Steps by name, filled by ``step``.
REGISTRY: dict[str, Step] = {}


def step(*outputs: str, **defaults):
    """Register a function as a step; its parameters are the inputs."""

    def add(fn):
        code = fn.__code__
        REGISTRY[fn.__name__] = Step(fn.__name__, fn, code.co_varnames[: code.co_argcount], outputs, defaults)
        return REGISTRY[fn.__name__]

    return add


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...]

    @property
    def inputs(self) -> list[str]:
        """What no earlier step makes."""
        made: set[str] = set()
        out: list[str] = []
        for s in self.steps:
            out += [x for x in s.inputs if x not in made and x not in s.defaults and x not in out]
            made.update(s.outputs)
        return out

    def to_run(self, present: set[str], outdated: set[str] = frozenset(), wanted: set[str] | None = None) -> list[Step]:
        """Steps for the wanted outputs (all by default): outdated names and all that
        follows from them count as missing; then, from the end, a step is needed if
        something missing that is wanted or needed is among its outputs."""
        stale = set(outdated)
        for s in self.steps:
            if stale & set(s.inputs):
                stale |= set(s.outputs)
        there = present - stale | (present & set(self.inputs))
        need = set(wanted) if wanted is not None else {o for s in self.steps for o in s.outputs}
        chosen = []
        for s in reversed(self.steps):
            if (set(s.outputs) & need) - there:
                chosen.append(s)
                need |= set(s.inputs)
        return chosen[::-1]

    def run(self, namespace: dict, outdated: set[str] = frozenset(), wanted: set[str] | None = None) -> dict:
        out = dict(namespace)
        for s in self.to_run(set(namespace), outdated, wanted):
            out |= s.run(out)
        return out


def missing_items(items: DataFrame, artifacts: DataFrame, names: list[str], version: int = 0) -> DataFrame:
    """Items that lack one of the artifacts in at least this version."""
    have = artifacts.where(F.col("name").isin(names) & (F.col("version") >= version)).groupBy("item_key").agg(F.countDistinct("name").alias("n"))
    return items.join(have.where(F.col("n") == len(set(names))), "item_key", "left_anti")


def run_for_missing(s: Step, tables: dict[str, DataFrame], items: DataFrame, artifacts: DataFrame, version: int = 0) -> tuple[dict, DataFrame]:
    """Run a step on the items that lack its outputs; the outputs, and the artifact rows
    to add."""
    todo = missing_items(items, artifacts, list(s.outputs), version).select("item_key")
    some = {k: (t.join(todo, "item_key", "left_semi") if isinstance(t, DataFrame) and "item_key" in t.columns else t) for k, t in tables.items()}
    out = s.run(some)
    rows = [t.select("item_key", F.lit(k).alias("name"), F.lit(version).alias("version")).distinct() for k, t in out.items()]
    added = rows[0]
    for r in rows[1:]:
        added = added.union(r)
    return out, added


def write_artifact(df: DataFrame, folder: str, name: str, buckets: int = 64) -> None:
    """One Parquet table for an artifact, parted by a hash of the item; rewriting some
    items replaces their parts only."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64("item_key"), F.lit(buckets)).cast("int"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/{name}")


def failed_items(results: DataFrame, guard) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the failed items with the reason: ``guard`` is a column that is null
    for good rows and else the error."""
    rows = results.withColumn("error", guard)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("item_key", "error")
