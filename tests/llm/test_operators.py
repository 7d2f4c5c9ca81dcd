"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns, against brute force where there is one."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootweave.llm import ann, audio, html_extract, linededup, mixing, neardup, packing, secrets, toxicity, urls
from rootweave.llm.common import connected_components, prefix_sums, ship

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "light", "green", "table", "cloud", "paper", "the", "of", "and"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [base, base, near, prose(rng, 80), None, "", "   ", "two words", "TWO words", prose(rng, 40), "x" * 5000, prose(rng, 9000), "tabé 中文 \U0001f600 end"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0", 1), (None, texts[9], None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(7)).withColumn("piece", F.lit("clash"))


def test_components_and_prefix_sums(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 3), (7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert found == {n: root(n) for n in found}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    lengths = [rng.randrange(9) for _ in range(600)]
    row = spark.createDataFrame([(lengths,), ([],)], "v array<bigint>").select(prefix_sums(F.col("v")).alias("p")).collect()
    assert row[0].p == np.concatenate([[0], np.cumsum(lengths)[:-1]]).tolist() and row[1].p == []


def test_mixing(spark, docs):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 400), rng.choice(["en", "de"]), rng.choice(["a", "a", "b"]), 0) for i in range(3000)]
    many = spark.createDataFrame(rows, DOCS)
    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5), ("nowhere", 0.0)], "source string, target double"),
        "lang": spark.createDataFrame([("en", 0.7), ("de", 0.3)], "lang string, target double"),
    }
    report = {}
    out = mixing.mix(many, targets=targets, topic=F.lit("one"), keep=0.5, report=report).toPandas()
    assert out.tokens.tolist() == [len(t.split()) for t in out.text] and max(report.values()) <= 1e-3
    drawn = out[out.kept]
    assert abs(drawn[drawn.source == "a"].tokens.sum() / drawn.tokens.sum() - 0.5) < 0.02
    assert abs(drawn[drawn.lang == "en"].tokens.sum() / drawn.tokens.sum() - 0.7) < 0.02
    assert abs(drawn.tokens.sum() / out.tokens.sum() - 0.5) < 0.02 and abs((out.worth * out.tokens).sum() / out.tokens.sum() - 1) < 1e-6
    with pytest.warns(UserWarning):
        split = many.withColumn("source", F.when(F.col("lang") == "en", "a").otherwise("b"))
        mixing.mix(split, targets=targets, topic=F.lit("one"), keep=0.5, report=report).count()
    assert max(report.values()) > 0.1
    odd = mixing.mix(docs).toPandas()
    assert len(odd) == docs.count() and odd.probability.between(0, 1).all() and odd.kept.notna().all()
    assert odd[odd.doc_id == 3].kept.nunique() == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_by_brute_force(spark):
    rng = np.random.default_rng(6)
    size, want = rng.integers(0, 3000, (5, 3, 4)), {}
    size[0] *= 8
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(size[i, j, k]), 1) for i, j, k in np.ndindex(size.shape)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint, docs bigint")
    goals = {m: mixing.tempered(cells, m, a) for m, a in (("source", 0.3), ("lang", 0.5), ("topic", 0.8))}
    total = size.sum() * 0.6
    for axis, m in enumerate(mixing.MARGINS):
        other = tuple(x for x in range(3) if x != axis)
        has = size.sum(other).astype(float)
        shares = {r[m]: r.target for r in goals[m].collect()}
        share = np.array([shares[f"{m[0]}{i}"] for i in range(size.shape[axis])])
        low, high = 0.0, 1e9  # the scale that fills what it can
        for _ in range(200):
            scale = (low + high) / 2
            low, high = (scale, high) if np.minimum(has, scale * share).sum() < total else (low, scale)
        want[axis] = np.minimum(has, high * share)
    w = size * 0.6
    for _ in range(2000):
        for axis in range(3):
            other = tuple(x for x in range(3) if x != axis)
            shape = [-1 if x == axis else 1 for x in range(3)]
            w = np.minimum(size, w * (want[axis] / np.maximum(w.sum(other), 1e-12)).reshape(shape))
    report = {}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, goals, 0.6, tolerance=1e-4, report=report).collect()}
    mine = np.array([got[f"s{i}", f"l{j}", f"t{k}"] for i, j, k in np.ndindex(size.shape)]).reshape(size.shape)
    assert max(report.values()) <= 1e-3 and (mine <= size + 1e-6).all()
    assert np.abs(mine - w).max() <= 3e-3 * w.max()


def test_topics_are_clusters_of_words(spark):
    rng = random.Random(7)
    kinds = [[f"{c}{k}" for k in range(30)] for c in "xyz"]
    rows = [(i, " ".join(rng.choices(kinds[i % 3], k=80)), "en", "a", 0) for i in range(90)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    assert all(len(set(out[out.doc_id % 3 == k].topic) & set(out[out.doc_id % 3 != k].topic)) == 0 for k in range(3))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, 2.0]), (1080, []), (None, [1.0] * 8), (1100, [None] * 8), (1120, [9.0] * 9)]
    vectors = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    out = ann.search(vectors, F.col("vec_id") % 20 == 0, k=5, recall=1.0).toPandas()
    d = x.astype(np.float64)
    for q, part in out.groupby("query_id"):
        s = (d * d[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert part.sort_values("rank").vec_id.tolist() == want
        assert np.allclose(part.sort_values("rank").score, s[want], rtol=0, atol=1e-12)
    assert out.query_id.nunique() == 20
    assert ann.search(vectors.where("vec_id < 3"), F.col("vec_id") == 0, k=5).count() == 2
    assert ann.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_neighbours_calibrated(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 12))
    x = (centres[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 12))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows + rows[:50], "vec_id bigint, embedding array<float>")
    report = {}
    out = ann.search(vectors, F.col("vec_id") % 20 == 0, k=10, report=report).toPandas()
    assert 1 < report["visits"] < report["leaves"]
    d, hits, total = x.astype(np.float64), 0, 0
    for q, part in out.groupby("query_id"):
        s = (d * d[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(6000), -s)) if i != q][:10]
        hits, total = hits + len(set(want) & set(part.vec_id)), total + 10
        assert sorted(part["rank"]) == list(range(1, 11)) and part.vec_id.is_unique
    assert total == 3000 and hits / total >= 0.9


def test_url_rules_and_aliases(spark):
    rules = [urls.rule("block", "net/"), urls.rule("allow", "example.net/en/"), urls.rule("block", "bad.org/"), urls.rule("allow", "good.org/")]
    refresh = '<meta http-equiv="refresh" content="0; url=%s">'
    canonical = '<link href="%s" rel="canonical"/>'
    pages = [
        (1, "http://A.example.net/en/1", ""),
        (2, "http://x.net/en/1", None),
        (3, "http://x.net", None),
        (4, "https://one.com/a?q=1#f", refresh % "http://bad.org/x"),
        (5, "http://one.com/a?q=1", ""),
        (6, "http://two.com/b", canonical % "/c"),
        (7, "http://two.com/c/", refresh % "//one.com/a?q=1"),
        (8, "http://good.org/z", refresh % "http://bad.org/x2"),
        (9, "http://three.com/", canonical % "http://good.org/z"),
        (10, None, None),
        (11, "no scheme", ""),
        (12, "http://notbad.org/", ""),
    ]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("rule", F.lit("clash"))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(rows, rules).collect()}
    assert out[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert out[2] == ("x.net", "/en/1", "net/", "block")
    assert out[3] == ("x.net", "", None, "allow")
    assert [out[k][3] for k in (4, 5, 6, 7)] == ["block"] * 4
    assert out[8][3] == "allow" and out[9][3] == "allow"
    assert out[10] == ("", "", None, "allow") and out[11] == ("", "", None, "allow") and out[12][3] == "allow"
    assert urls.judge_urls(rows.limit(0), rules).count() == 0


def test_html_runs_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcd")
    pages = []
    for i in range(30):
        host = f"h{i % 2}.com"
        blocks = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 4))]
        if i % 3 == 0:
            blocks = ["<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "<p>z z z z w w w w " + word() + "</p></article>"]
        else:
            blocks = [f"<div>{b}</div>" for b in blocks]
        pages.append((i, f"http://{host}/{i}", "".join(blocks)))
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    out = {r.page_id: r for r in html_extract.extract(rows).collect()}
    for host in (0, 1):
        own = [(i, html_extract.page_blocks(x)) for i, _, x in pages if i % 2 == host]
        spread = {"O": {}, "A": {}}
        for i, blocks in own:
            for role, t in blocks:
                w = t.split(" ")
                for k in range(len(w) - 7):
                    spread[role].setdefault(tuple(w[k : k + 8]), set()).add(i)
        for i, blocks in own:
            want = []
            for role, t in blocks:
                w = t.split(" ")
                gone = set()
                for k in range(len(w) - 7):
                    n = len(spread[role][tuple(w[k : k + 8])])
                    if n > 1 and role == "O" or n > len(own) * 0.5 and n >= 4:
                        gone.update(range(k, k + 8))
                want += [x for k, x in enumerate(w) if k not in gone]
            assert out[i].text == " ".join(want), i
    assert sum(r.n_repeated for r in out.values()) > 0


def test_html_boilerplate_in_articles(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    notice, quote = line(12), line(20)
    rows = []
    for i in range(40):
        quoted = f"<p>{quote}</p>" if i % 4 == 0 else ""
        rows.append((i, f"http://one.com/{i}", f"<article class='social card'><p>own{i} {line(20)}</p>{quoted}<p>end{i} {notice}</p></article>"))
    rows += [(100 + i, f"http://two.com/{i}", f"<main><p>{line(9)}</p><article class='comment'>c</article></main>") for i in range(3)]
    rows += [(200 + i, f"http://two.com/{i}/2", f"<div>{quote}</div><div>alone{i}</div>") for i in range(3)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id bigint, url string, html string")
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for i in range(40):
        assert notice not in out[i].text and f"end{i}" in out[i].text and out[i].n_repeated == 12
        assert (quote in out[i].text) == (i % 4 == 0)
    assert out[100].n_chars > 20 and not out[100].text.endswith(" c")
    assert [out[200 + i].text for i in range(3)] == [f"alone{i}" for i in range(3)]
    assert html_extract.extract(pages).count() == len(rows) + 1
    # with the runs left alone the notice stays
    parsed = html_extract.parse(pages).withColumn("runs", F.lit(None).cast("array<bigint>"))
    assert all(notice in r.text for r in html_extract.clean(parsed.select("host", "key", "blocks", "runs", "page_id", "url")).where("page_id < 40").collect())


def test_html(spark):
    shared = "this text stands on every single page of the host today"
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><div class='ad'>buy</div>%s<footer>&copy; me</footer></body></html>"
    rows = [
        (1, "http://h.com/1", page % "<article><h1>Head</h1><p>One <b>bo</b>ld &amp; two<br>three<p>foür<!-- no --><script>x('</p>')</script></p><div class='comments'>c</div></article>"),
        (2, "http://h.com/2", page % f"<div>{shared}</div><div>unique words here {shared}</div>"),
        (3, "http://h.com/3", page % f"<p>{shared}</p><p>other</p>"),
        (4, "http://h.com/4", None),
        (5, None, "plain < text &lt;tag&gt;"),
        (6, "http://h.com/6", "<article>" + "long word " * 30000 + "</article>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert out[1].text == "Head One bold & two three foür"
    assert out[2].text == "unique words here" and out[3].text == "other"
    assert out[4].text == "" and out[4].n_chars == 0 and out[5].text == "plain < text <tag>"
    assert out[6].n_chars == 10 * 30000 - 1
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    extra = spark.createDataFrame([(50, "a <|endoftext|> b")], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text", "piece").unionByName(extra, allowMissingColumns=True)
    out = packing.pack(rows, capacity=256).toPandas()
    tokenizer = Tokenizer.from_file(packing.public_paths()[0])
    for r in rows.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        mine = out[out.doc_id == r.doc_id] if r.doc_id is not None else out[out.doc_id.isna()]
        mine = mine.drop_duplicates("piece").sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[1:] == 256).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist() and s.length.sum() <= 256
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 256) + 1
    assert packing.pack(rows.limit(0)).count() == 0
    once = rows.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.pack(once, capacity=256)
    sizes = {r.sequence_id: r.length for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("length")).collect()}
    assert {r.sequence_id: len(r.ids) for r in packing.token_sequences(once, packed, 256).collect()} == sizes
    given = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(given):
        encoder = packing.Encoder(*packing.public_paths())
        for r in spark.read.parquet(given).collect():
            assert encoder.ids(r.text or "").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids, r.doc_id
    text = "word  two\n\n three " * 20000
    whole = packing.Encoder(*packing.public_paths())
    assert np.array_equal(whole.ids(text), np.array(tokenizer.encode(text, add_special_tokens=False).ids))
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 500)
    opener, offset, fill = packing.best_fit(sizes, 100)
    assert all(sizes[opener == o].sum() == fill[opener == o][0] <= 100 for o in np.unique(opener))


def test_toxicity(spark, docs):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        bad = i % 4 == 0
        words = prose(rng, 60).split()
        if bad:
            for k in range(5):
                words[k * 9] = "grobian" + rng.choice(["s", "ed", ""])
        rows.append((i, " ".join(words), int(bad)))
    many = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    fold = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 3).cast("int"))
    out = toxicity.score_all(many.withColumn("score", F.lit(1)), many.select("doc_id", "toxic"), fold, 3).toPandas().set_index("doc_id").score
    held = [r for r in rows if r[0] % 5 == 0]
    assert min(out[i] for i, _, t in held if t) > max(out[i] for i, _, t in held if not t)
    kept = toxicity.reject(many, many.select("doc_id", "toxic"), fold, 3, 0.5)
    assert kept.columns == many.columns and kept.where("toxic = 1").count() == 0 and kept.count() == 120
    none = spark.createDataFrame([(0, None)], "doc_id bigint, toxic int")
    odd = toxicity.score_all(docs, none, fold, 3).toPandas()
    assert len(odd) == docs.count() and (odd.score == 0).all() and odd[odd.doc_id == 5]["size"].tolist() == [0]
    assert toxicity.score_all(docs.limit(0), none.limit(0), fold, 3).count() == 0
    counts = np.zeros(toxicity.SIZE, np.int64)
    table = toxicity.symbol_table()
    text = ("abc  def. " * 300000).encode()
    for code in toxicity.grams(text, table):
        counts += np.bincount(code, minlength=toxicity.SIZE)
    # a separator, then 300000 times eight symbols, the last of each a separator
    assert counts.sum() == 1 + 300000 * 8 - toxicity.ORDER + 1


def test_kneser_ney_by_brute_force():
    rng = np.random.default_rng(12)
    order, size, d = toxicity.ORDER, toxicity.SYMBOLS, toxicity.DISCOUNT
    counts = [{}, {}]
    for c in counts:
        for _ in range(400):
            gram = tuple(int(x) for x in rng.integers(0, 5, order))
            c[gram] = c.get(gram, 0) + 1
    tables = []
    for c in counts:
        t = np.zeros(toxicity.SIZE, np.int64)
        for gram, n in c.items():
            t[sum(x * size ** (order - 1 - k) for k, x in enumerate(gram))] = n
        tables.append(t)

    seen = set(counts[0]) | set(counts[1])

    def before(run):
        """In how many ways a shorter run goes on to the left."""
        grams = {g[order - len(run) - 1 :] for g in seen}
        return sum(g[1:] == run for g in grams)

    def probability(of, run):
        if not run[1:]:
            own, rest = of, 1 / size
        else:
            own, rest = of, probability(before, run[1:])
        row = [own((*run[:-1], x)) for x in range(size)]
        if not sum(row):
            return rest
        return (max(own(run) - d, 0) + d * sum(x > 0 for x in row) * rest) / sum(row)

    ratio = toxicity.kneser_ney(*tables)
    grams = sorted(seen)[:20] + [(1, 2, 3, 9), (9, 9, 9, 9), (4, 0, 9, 1)]
    for gram in grams:
        p = [probability(lambda g, c=c: c.get(g, 0), gram) for c in counts]
        at = sum(x * size ** (order - 1 - k) for k, x in enumerate(gram))
        assert ratio[at] == pytest.approx(np.log(p[1]) - np.log(p[0]), abs=1e-4)


def brute_components(rows, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [rows[root(i)][0] for i in range(len(rows))], [len(s) for s in sets]


def test_near_duplicates(spark, docs):
    rng = random.Random(11)
    texts = []
    passage = prose(rng, 60)
    for g in range(12):
        base = prose(rng, 90).split()
        for k in range(rng.choice([1, 1, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(90)] = f"v{rng.randrange(999)}"
            texts.append(" ".join(w))
    texts += [passage + " " + prose(rng, rng.randrange(5, 60)) for _ in range(25)]
    rows = list(enumerate(texts))
    want, sizes = brute_components(rows, 4, 80)
    out = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80).collect()}
    assert [out[i].component_id for i, _ in rows] == want
    assert [out[i].n_shingles for i, _ in rows] == sizes
    odd = neardup.near_duplicates(docs, 4, 80).collect()
    by = {r.doc_id: r for r in odd if r.doc_id is not None}
    assert len(odd) == docs.count()
    assert by[1].component_id == 0 and by[2].component_id == 0 and not by[2].kept
    assert [by[i].n_shingles for i in (4, 5, 6)] == [0, 0, 0] and all(by[i].kept for i in (4, 5, 6))
    assert by[8].component_id == 7 and by[7].n_shingles == 1
    assert next(r for r in odd if r.doc_id is None).component_id == 9
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_sketch():
    rng = np.random.default_rng(6)
    full = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    a, b = full[:2000], full[500:2500]
    sa, sb = neardup.sketch(a), neardup.sketch(b)
    top = np.iinfo(np.uint64).max
    assert not (sa == top).any() and not (neardup.sketch(full[:1]) == top).any()
    same = np.mean([np.mean(neardup.sketch(neardup.mix(a + np.uint64(k))) == neardup.sketch(neardup.mix(b + np.uint64(k)))) for k in range(20)])
    assert abs(same - 0.6) < 0.04
    h = neardup.Hasher(4)
    long = " ".join(f"w{i}" for i in range(400000)).encode()
    assert len(h.words(long)) == 400000 and len(h.shingles(long)) == 399997
    assert np.array_equal(h.words(b"One  two\tTHREE\n"), h.words(b"one two three"))


def test_line_dedup(spark, docs):
    rng = random.Random(21)
    boiler, log = "This site uses cookies for the best experience", "lost the connection from host%s after error in worker"
    passage = prose(rng, 70)
    rows = []
    for i in range(12):
        own = [prose(rng, 15) for _ in range(5)]
        lines = [boiler, *own[:2], passage, *own[2:], log % "abcdefghijklmnop"[i]]
        rows.append((i, "\n".join(lines)))
    copy = "\n".join(prose(rng, 12) for _ in range(6))
    rows += [(100 + i, copy) for i in range(8)] + [(200 + i, copy.replace("\n", f" z{chr(97 + i) * 3}\n", 1)) for i in range(6)]
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit("clash")).withColumn("digest0", F.lit("clash"))).collect()}
    for i in range(12):
        lines = out[i].text.split("\n")
        assert len(lines) == 5 and out[i].n_lines == 8 and out[i].n_dropped == 3
        assert boiler not in lines and passage not in lines
    assert all(out[100 + i].text == copy for i in range(8)) and all(out[200 + i].n_dropped == 0 for i in range(6))
    odd = linededup.dedup_lines(docs)
    assert odd.count() == docs.count() and odd.where("n_dropped > 0").count() == 0
    assert odd.where("doc_id = 4 and text is null and n_lines = 0").count() == 1
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_line_sketch():
    rng = np.random.default_rng(4)
    factors = rng.integers(0, 1 << 32, (linededup.MINIMA, 1)).astype(np.uint32) | np.uint32(1)
    for n_shared, n_own in [(400, 50), (200, 100), (3000, 3000)]:
        same = []
        for _ in range(40):
            shared, *own = [rng.integers(0, 1 << 32, n).astype(np.uint32) for n in (n_shared, n_own, n_own)]
            a, b = [linededup.sketch(np.concatenate([shared, x]), factors) for x in own]
            assert a.dtype == np.int32 and len(a) == linededup.MINIMA
            same.append(np.mean(a == b))
        assert abs(np.mean(same) - n_shared / (n_shared + 2 * n_own)) < 0.04
    assert len(linededup.sketch(np.zeros(1, np.uint32), factors)) == linededup.MINIMA


def test_line_dedup_counts_unlike_texts(spark):
    rng = random.Random(22)
    line = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(10))
    rows, shared = [], {}
    for f, (n_shared, n_own, texts) in enumerate([(6, 6, 60), (20, 10, 60), (12, 8, 60)]):
        shared[f] = [line() for _ in range(n_shared)]
        rows += [(1000 * f + i, "\n".join(shared[f] + [line() for _ in range(n_own)])) for i in range(texts)]
    # a passage of unlike texts that also stands in a larger group of near copies
    passage, base = line(), [line() for _ in range(30)]
    rows += [(5000 + i, "\n".join([passage] + [line() for _ in range(8)])) for i in range(40)]
    rows += [(6000 + i, "\n".join([passage] + base[: i % 30] + [line()] + base[i % 30 + 1 :])) for i in range(150)]
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for f in shared:
        assert all(out[i].n_dropped == len(shared[f]) for i in out if i // 1000 == f)
    assert all(out[i].n_dropped == 1 and not out[i].text.startswith(passage) for i in out if i >= 5000)


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(27)
    few = WORDS[:4]
    texts = []
    for i in range(60):
        lines = [" ".join("".join(rng.choices("abcdefghijkl", k=7)) for _ in range(12)) for _ in range(6)]
        other = lambda: "".join(rng.choices("mnopqr", k=rng.choice((1, 5))))
        lines += [" ".join([*few, rng.choice(WORDS[4:9]), other(), "lost", other(), "again"]) for _ in range(2)]
        lines += rng.sample(["all rights", "page 7", "menu", "the river", "Page 12 of 40 pages"], 2) + ["   "]
        texts.append("\n".join(rng.sample(lines, len(lines))))
    masked = lambda x: [("<*>" if re.search("[0-9]", t) else t).lower() for t in x.split()]
    at = {(d, k): x for d, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.split()}
    key = lambda x: tuple(masked(x)) if len(x.split()) >= 4 else tuple(x.lower().split())
    docs_of = {}
    for (d, _), x in at.items():
        docs_of.setdefault(key(x), set()).add(d)
    need = lambda n: 3 * max(1, -(-4 // n))
    gone = {p for p, x in at.items() if len(docs_of[key(x)]) >= need(len(x.split()))}
    leaves = {}
    for p, x in at.items():
        if p not in gone and len(x.split()) >= 4:
            leaves.setdefault((len(x.split()), *masked(x)[:4]), []).append(p)
    wild = {}
    for leaf, ps in leaves.items():
        rows = [at[p].lower().split() for p in ps]
        if len(ps) >= 3 and len({key(at[p]) for p in ps}) > 1 and len({d for d, _ in ps}) > 1:
            for p, w in zip(ps, rows):
                fields = tuple((i, t) for i, t in enumerate(w) if (k := sum(r[i] == t for r in rows)) >= 3 and k >= 0.3 * len(ps))
                if len(fields) >= 0.6 * leaf[0]:
                    wild.setdefault((leaf, fields), set()).add(p)
    general = {p for ps in wild.values() if len({d for d, _ in ps}) >= 3 for p in ps}
    assert general and gone
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for d, t in enumerate(texts):
        want = [x for k, x in enumerate(t.split("\n")) if (d, k) not in gone | general]
        assert out[d].text == "\n".join(want), d


ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def test_secrets(spark, docs):
    rng = random.Random(31)
    hexes = ["%040x" % rng.getrandbits(160) for _ in range(15)]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    hexes += ["".join(rng.choice(letters) for _ in range(40)) for _ in range(15)]
    texts = [f"中 {prose(rng, 5)} token = \"{h}\" and AKIA{'ABCD1234' * 2} Api_Key:short secret=abc secret='{h[:12]}'" for h in hexes]
    plain = " ".join("_".join(rng.choice(WORDS).title() if k % 2 else rng.choice(WORDS) for k in range(5)) + str(k % 7) for k in range(500))
    texts += [plain, "stray aB3xK9qLz7Wm2Rt5Yp8Vn4 here", "token: secret:abcdefghij password=12345678", None, ""]
    texts += ["".join(f"k = 'x'; password={''.join(rng.choices(letters, k=20))} " for _ in range(700))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("spans", F.lit(1))
    out = {r.doc_id: r for r in secrets.scan(rows).select("doc_id", secrets.span_list(F.col("base")).alias("base"), secrets.span_list(F.col("spans")).alias("spans")).collect()}
    for i, t in enumerate(texts):
        t, spans = t or "", []
        spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(ASSIGN, t) if len(m[1]) >= 8]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert out[i].base == ",".join(s for _, _, s in sorted(spans)), i
        assert set(filter(None, out[i].base.split(","))) <= set(out[i].spans.split(","))
    assert "markov" in out[31].spans and "markov" not in out[30].spans
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(docs.limit(0)).count() == 0


def planted(rng):
    """A random string as services write them, none of a base pattern."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kind = rng.randrange(4)
    if kind == 0:
        return "sk_live_" + "".join(rng.choices(letters, k=24))
    if kind == 1:
        return "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=26))
    return "".join(rng.choices(letters + "+/" * (kind == 2), k=rng.randrange(22, 41)))


def test_secrets_found_by_the_models(spark, tmp_path):
    from rootweave.llm import queries

    rng = random.Random(33)
    kinds = ("_".join, "-".join, "/".join, lambda w: "".join(x.title() for x in w), lambda w: w[0] + "".join(x.title() for x in w[1:]) + "7")
    rows = []
    for i in range(300):
        name = rng.choice(kinds)(prose(rng, 4).split())
        rows.append((i, f"{prose(rng, 20)} {planted(rng) if i % 3 == 0 else ''} {prose(rng, 5)} {name} {prose(rng, 30)}"))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.spans for r in queries.op9_secret_scan(spark, str(tmp_path)).collect()}
    found = {i: s.count("markov") for i, s in out.items()}
    hits = sum(found[i] > 0 for i in range(0, 300, 3))
    false = sum(found[i] for i in range(300) if i % 3) + sum(found[i] > 1 for i in range(0, 300, 3))
    assert len(out) == 300 and hits >= 95 and false <= 5


def test_media(spark, docs):
    rows = docs.unionByName(spark.createDataFrame([(60, "y" * 576), (61, "y" * 577)], "doc_id bigint, text string"), allowMissingColumns=True)
    stored = audio.store(rows)
    texts = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    for r in stored.collect():
        rate, samples = audio.read_wav(r.media)
        t = texts[r.doc_id]
        want = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        assert samples.tobytes() == want and r.n_bytes == len(t)
    out = audio.describe(stored).toPandas().set_index("doc_id")
    assert out.loc[60].payload_bytes == 576 and out.loc[61].payload_bytes == 1152 and out.loc[5].payload_bytes == 576
    assert out.loc[5].tail_crc32 == zlib.crc32(b"\xff" * 32)
    assert out.loc[0].payload_sha256 == hashlib.sha256(texts[0] + b"\xff" * (-len(texts[0]) % 576)).hexdigest()
    values = lambda i: audio.read_tensors(out.loc[i].tensors)["values"].chunk(0)
    assert values(0).type.shape == [audio.BLOCK, audio.MELS] and out.loc[0].tensors == out.loc[1].tensors
    kept = audio.digest(audio.describe(stored)).toPandas().set_index("doc_id")
    assert kept.loc[0].tensor_sha256 == kept.loc[1].tensor_sha256 != kept.loc[2].tensor_sha256 and kept.loc[0]["shape"] == f"{len(values(0))}x64x24"
    # log-mel energies of a row by plain sums
    data = np.frombuffer(texts[9] + b"\xff" * (-len(texts[9]) % 576), np.uint8)
    length = -(-len(data) * audio.UP // audio.DOWN)
    signal = audio.resample(data, 0, length + audio.WINDOW, audio.low_pass())
    bank, shape = audio.mel_bank(audio.RATE * audio.UP / audio.DOWN), np.hanning(audio.WINDOW)
    k, n = np.meshgrid(np.arange(audio.WINDOW // 2 + 1), np.arange(audio.WINDOW), indexing="ij")
    wave = np.exp(-2j * np.pi * k * n / audio.WINDOW)
    mels = values(9).to_numpy_ndarray().reshape(-1, audio.MELS)
    for f in range(int(out.loc[9].n_frames)):
        power = np.abs(wave @ (signal[f * audio.HOP : f * audio.HOP + audio.WINDOW] * shape)) ** 2
        assert np.abs(mels[f] - np.log(power @ bank + audio.FLOOR)).max() < 0.02
    spans = audio.read_tensors(out.loc[11].tensors)
    assert spans["start"].to_pylist()[1:] == spans["end"].to_pylist()[:-1] and spans["start"][0].as_py() == 0
    taps = audio.low_pass()
    x = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    whole = audio.resample(x, 0, 375, taps)
    assert np.allclose(np.concatenate([audio.resample(x, 0, 200, taps), audio.resample(x, 200, 375, taps)]), whole)
    slow = [sum(taps[n * 4 % 3][k] * ((float(x[i]) - 128) / 128 if 0 <= (i := n * 4 // 3 - 15 + k) < 500 else 0) for k in range(16)) for n in range(375)]
    assert np.allclose(whole, slow, atol=1e-4)
    assert audio.hysteresis(np.array([-30, -20, -10, -20, -30, -20, -30.0])) == [(2, 4)]
    with pytest.raises(ValueError):
        audio.read_wav(b"RIFFxxxxWAVEdata")
    assert audio.describe(audio.store(docs.limit(0))).count() == 0
