"""The pipeline on a small corpus written to a folder."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(120):
        words = prose(rng, 80).split()
        if i % 5 == 0:
            for k in range(6):
                words[k * 11] = "grobians"
        text = " ".join(words)
        if i % 3 == 0:
            text = "read our newsletter and all the other news\n" + text
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + k, rows[1][1], "en", "s1", 0) for k in range(3)] + [(300, None, "en", None, None), (301, "", None, "s1", 0), (None, "some words", "en", "s1", 10)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(i is not None and i < 120 and i % 5 == 0 for i in kept["toxicity"])
    assert all(i in kept["toxicity"] for i in range(120) if i % 5)
    assert not any("newsletter" in (t or "") for t in kept["line_dedup"].values()) and kept["line_dedup"].keys() == kept["toxicity"].keys()
    assert not any(200 + k in kept["near_duplicates"] for k in range(3)) and {1, 300, 301, None} <= kept["near_duplicates"].keys()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept["mixing"])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_pipeline_keeps_clashing_columns_and_takes_no_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40), "en", f"s{i % 2}", 1) for i in range(30)] + [(50, None, None, None, None)]
    names = ["n_lines", "n_dropped", "tokens", "worth", "probability", "kept", "topic", "row", "digest", "evidence"]
    docs = spark.createDataFrame(rows, DOCS)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{i}-"), F.coalesce("doc_id", F.lit(0))))
    spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"{i}-{r.doc_id}" for i in range(len(names))], name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
