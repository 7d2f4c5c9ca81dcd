"""Topics are fitted on all rows, and few cells are raked without shuffles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from rootweave.llm import mixing
from rootweave.llm.common import ship
from rootweave.llm.neardup import Hasher
from tests.llm.test_operators import DOCS, WORDS


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def nearest(x, centres):
    return ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)


def test_topics_are_fitted_on_all_rows(spark):
    """More different texts than any sample of 4,000: centres are those of plain rounds
    over all of them, and no row goes by another topic than its nearest centre's."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices(WORDS[4 * (i % 3) : 4 * (i % 3) + 6], k=12)) + f" w{i}" for i in range(6000)] + [None, "", " \n"]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    vectors = mixing.word_vectors(docs.repartition(5))
    assert vectors.count() == 6003 and vectors.where("v is null and tokens = 0").count() == 3
    hasher = Hasher(1)
    x = np.array([mixing.word_vector(hasher, (t or "").encode())[1] for t in texts[:6000]])
    centres = first = mixing.first_centres(vectors)
    assert len({c.tobytes() for c in first}) == mixing.TOPICS and {c.tobytes() for c in first} <= {v.tobytes() for v in x}
    before = None
    while True:
        at = nearest(x, centres)
        cost = ((x - centres[at]) ** 2).sum()
        if before is not None and before - cost <= 1e-4 * before:
            break
        before, centres = cost, np.rint([x[at == k].mean(0) for k in range(len(centres)) if (at == k).any()])
    assert (mixing.topic_centres(vectors) == centres).all()
    for parts in (1, 7):
        out = mixing.mix(docs.repartition(parts)).orderBy("doc_id").toPandas()
        assert out.topic[:6000].tolist() == [f"t{k}" for k in at] and out.topic[6000:].isna().all()


def test_few_different_texts(spark):
    docs = spark.createDataFrame([(i, "one two" if i % 2 else "three", "en", "a", 0) for i in range(50)], DOCS)
    assert len(mixing.topic_centres(mixing.word_vectors(docs))) == 2
    assert (mixing.topic_centres(mixing.word_vectors(docs.where("false"))) == 0).all()


def test_raking_few_cells_needs_no_shuffles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(0, 3000)), 1) for i, j, k in np.ndindex(6, 3, 4)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint, docs bigint").coalesce(1)
    goals = {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}
    sc, found = spark.sparkContext, []
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (mixing.ONE_TASK, 0):
            monkeypatch.setattr(mixing, "ONE_TASK", most)
            sc.setJobGroup(f"rake {most}", "")
            weights = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, goals, 0.6).collect()}
            stages = {s for j in sc.statusTracker().getJobIdsForGroup(f"rake {most}") for s in sc.statusTracker().getJobInfo(j).stageIds}
            found.append((weights, sum(i.numTasks for s in stages if (i := sc.statusTracker().getStageInfo(s)))))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (few, tasks), (many, dealt) = found
    assert 5 * tasks < dealt
    assert few.keys() == many.keys() and all(few[k] == pytest.approx(many[k], rel=1e-9) for k in few)


def test_pipeline_fits_topics_on_all_rows(spark, monkeypatch):
    rng, seen, plain = random.Random(12), [], mixing.lloyd_round

    def spied(vectors, centres):
        found = plain(vectors, centres)
        seen.append(int(found[1].sum()))
        return found

    monkeypatch.setattr(mixing, "lloyd_round", spied)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=6)) + f" w{i}", "en", "a", 0) for i in range(4500)] + [(4500, None, None, None, None)], DOCS)
    assert corpus_pipeline.mixing_stage(spark, docs, "").columns == docs.columns
    assert seen and set(seen) == {4500}


def test_pipeline_topics_fit_all_rows(spark, monkeypatch):
    """From the topics that the stage goes by, a plain round over all rows wins hardly
    more than the tolerance; centres of a sample of 4,000 leave more to win."""
    rng, mixes, plain = random.Random(13), [], mixing.mix

    def spied(*args, **kwargs):
        mixes.append(plain(*args, **kwargs))
        return mixes[-1]

    monkeypatch.setattr(mixing, "mix", spied)
    texts = [" ".join(rng.choices(WORDS, k=12)) for _ in range(9000)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS).repartition(4)
    corpus_pipeline.mixing_stage(spark, docs, "")
    topics = np.array([int(r.topic[1:]) for r in mixes[0].select("doc_id", "topic").orderBy("doc_id").collect()])
    hasher = Hasher(1)
    x = np.array([mixing.word_vector(hasher, t.encode())[1] for t in texts])

    def centred(at):
        centres = np.array([x[at == k].mean(0) for k in np.unique(at)])
        return centres, ((x - centres[np.unique(at, return_inverse=True)[1]]) ** 2).sum()

    centres, cost = centred(topics)
    gaps = (centres * centres).sum(1) - 2 * (x @ centres.T)
    _, after = centred(gaps.argmin(1))
    assert len(centres) == mixing.TOPICS and cost - after <= 2e-4 * cost
