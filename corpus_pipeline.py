"""Corpus pipeline: from ``documents`` to packed sequences.

Each stage works on all that the stage before it kept, and its decisions take
effect.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.llm import linededup, mixing, neardup, packing, toxicity
from rootweave.llm.common import durable, ship
from rootweave.llm.queries import FOLDS, fold, table


def others(docs: DataFrame, *own: str) -> Column:
    """All columns but these as one, ``row``, that no operator's columns can clash with."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("row")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; null and empty texts stay."""
    ship(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), fold(), len(FOLDS), 0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; every document stays, with ``n_chars`` of what is left.  Null
    and empty texts stay as they are; an empty table gives no row; columns named like
    those of the operator keep their values."""
    ship(spark)
    out = linededup.dedup_lines(docs.select("text", others(docs, "text")))
    chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": chars}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id, and one row of an
    id.  Texts without words, and rows without id, stay."""
    ship(spark)
    found = durable(neardup.near_duplicates(docs, size=5, percent=80))
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti")
    again = found.where("doc_id is not null and kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities: source, language and topic come closer to
    even, nine tenths of the tokens stay.  Null sources and languages are a value of
    their own; an empty table gives no row; columns named like those of the operator
    keep their values."""
    ship(spark)
    own = ("doc_id", "text", "source", "lang")
    kept = mixing.mix(docs.select(*own, others(docs, *own)), keep=0.9).where("kept")
    return kept.select(*[F.col(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, one row a piece.  Null and empty texts are one token;
    an empty table gives no row; other columns are left out."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the models nor packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
