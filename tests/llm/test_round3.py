"""Fingerprints, manifest and whitening: nulls, empty and long texts, ties, repeated
rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rootweave.llm import fingerprints, manifest, queries, whitening
from rootweave.llm.common import ship
from tests.llm.test_operators import DOCS, prose


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def rows_of(rng, n):
    texts = [prose(rng, rng.choice([1, 3, 8, 60, 200])) for _ in range(n)]
    texts[3], texts[4], texts[5], texts[6] = None, "", texts[7], "x" * 70_000 + " " + prose(rng, 9000)
    texts[9] = "ÀB 中文 \U0001f600 " + texts[8]
    out = [(i * 3, t, rng.choice(["en", None]), f"s{i % 19}" if i % 7 else None, len(t or "") if i % 5 else None) for i, t in enumerate(texts)]
    return out + [(6, texts[2], "en", "s1", 1), (None, texts[8], None, "ä", None), (None, None, None, "ä", 3), (12, texts[4], None, "s4", 0), (12, texts[4], None, "s4", 0)]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in __import__("re").split("[ \t-\r]+", low) if w]


def shingles(text, size=5):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))}


def test_fingerprints(spark):
    rng = random.Random(5)
    rows = [r for r in rows_of(rng, 60) if r[0] is not None and r[0] not in (6, 12)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("sketch", F.lit("clash")).withColumn("range", F.lit(1)).withColumn("tie", F.lit(2)).repartition(5)
    found = {r.doc_id: r for r in fingerprints.edit_likeness(docs).collect()}
    rows.sort()
    assert sorted(found) == [r[0] for r in rows]
    gaps = []
    for (i, a, *_), (_, b, *_) in zip(rows, rows[1:] + rows[:1]):
        a, b = a or "", b or ""
        edited = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        r = found[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near, jaccard in ((edited, r.near_edited, r.jaccard_edited), (b, r.near_next, r.jaccard_next)):
            x, y = shingles(a), shingles(other)
            true = len(x & y) / min(len(x), len(y)) if x and y else float(x == y)
            gaps.append(abs(true - near))
            assert 0 <= jaccard <= near <= 1
            if max(len(x), len(y)) <= fingerprints.LEAST:  # the sets are held whole
                assert near == pytest.approx(true)
    assert max(gaps) < 0.35 and np.mean(gaps) < 0.03
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", set()).add(bytes(found[i].sketch))
    assert all(len(s) == 1 for s in by_text.values())


def test_fingerprints_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame(rows_of(random.Random(6), 20), DOCS)
    found = fingerprints.edit_likeness(docs).collect()
    assert len(found) == docs.count() and sum(r.doc_id is None for r in found) == 2 and sum(r.doc_id == 12 for r in found) == 3
    one = fingerprints.edit_likeness(spark.createDataFrame([(1, "abcdefgh", None, None, None)], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.edit_likeness(spark.createDataFrame([], DOCS)).count() == 0
    assert fingerprints.fingerprint(spark.createDataFrame([], DOCS)).count() == 0


def test_merged_sketches_are_those_of_the_union(spark):
    rng = random.Random(7)
    texts = [prose(rng, 400) for _ in range(12)] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)], DOCS)
    found = {}
    for r in fingerprints.merged(fingerprints.fingerprint(docs), "source").collect():
        found.setdefault(r.source, set()).add(r.hash % 2**64)
    hasher, limit = fingerprints.Hasher(5), fingerprints.TOP // fingerprints.SHARE
    for s in range(3):
        whole = {int(h) for t in texts[s::3] for h in hasher.shingles((t or "").encode())}
        assert found[f"s{s}"] == {h for h in whole if h <= limit}
    small, large = fingerprints.retain(hasher.shingles(texts[0].encode())), fingerprints.retain(hasher.shingles(" ".join(filter(None, texts)).encode()))
    assert fingerprints.likeness(small, large)[0] == 1.0 > fingerprints.likeness(small, large)[1]


def encode(v):
    return b"-" if v is None else f"{len(str(v).encode())}:{v}".encode()


def H(*parts):
    return hashlib.sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def tree(level):
    """All levels of a tree from its lowest."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute_manifest(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        return H(*map(encode, (doc_id, source, lang, n_chars, text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = tree([leaf(*r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at, folded, proof = i, leaf(r[0], text, *r[2:]), ""
            for levels, at in ((trees[s], i), (top, j)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    left, right = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    folded, proof, at = H(left, folded, right), proof + left + right, at // 16
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], H(proof), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def of_spark(docs):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest.manifest(docs, tampered, manifest.lower_ascii(F.col("text")))


def check_manifest(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("tree", "pos", "digest", "kids", "id"):
        docs = docs.withColumn(c, F.lit("clash"))
    truth = brute_manifest(rows)
    assert sorted(str(tuple(r)) for r in of_spark(docs).collect()) == truth
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(str(r) for r in con.execute(queries.OP12_SQL).fetchall()) == truth


def test_manifest(spark):
    rng = random.Random(8)
    rows = rows_of(rng, 80)
    # a source of several levels, one of exactly one run, one of 17 and one lone leaf
    for source, n in (("big", 300), ("run", 16), ("over", 17), ("lone", 1), ("", 2)):
        rows += [(1000 + rng.randrange(5000), prose(rng, 4).title(), "en", source, i) for i in range(n)]
    check_manifest(spark, rows)


def test_manifest_of_few_rows(spark):
    check_manifest(spark, [(4, "One", "en", "s", 3)])
    check_manifest(spark, [(4, "One", "en", None, 3), (0, "TWO", None, None, None)])
    check_manifest(spark, [(i, f"T{i}", "en", f"s{i}", i) for i in range(20)])
    assert of_spark(spark.createDataFrame([], DOCS)).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, whitened int"


def check_whitening(found, ids, vectors, most=32):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > len(e) * 1e-15 * e[0]).sum()))
    rows = {}
    for r in found:
        rows.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    z = np.array([[rows[i][c + 1][0].whitened for c in range(k)] for i in ids])
    assert all(set(rows[i]) == set(range(1, k + 1)) for i in ids)
    for i, xi in zip(ids, x.tolist()):
        assert int(rows[i][1][0].deviation) == sum((n * a - int(b)) ** 2 for a, b in zip(xi, s)) and rows[i][1][0].n == n
    share = np.array([rows[ids[0]][c + 1][0].explained for c in range(k)])
    assert np.allclose(share, e[:k] / np.trace(cov), rtol=1e-9)
    assert max(r.identity_error for r in found) < 1e-8
    gaps = np.abs(np.diff(e[: k + 1])) / e[0] if len(e) > k else np.append(np.abs(np.diff(e[:k])), 1) / e[0]
    clear = [c for c in range(k) if (c == 0 or gaps[c - 1] > 1e-6) and (c >= len(gaps) or gaps[c] > 1e-6)]
    assert np.abs(np.abs(z[:, clear]) - np.abs((y @ u / np.sqrt(np.abs(e) + 1e-300))[:, clear])).max(initial=0) < 1e-5
    return k


def test_whitening(spark):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((240, 40)) * np.linspace(0.2, 3, 40) + 5).astype(np.float32)
    v[7] = v[8]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 40, 1), (903, [1.0] * 39 + [None], 1), (904, [float("inf")] * 40, 1)]
    found = whitening.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(20)).collect()
    assert check_whitening(found, list(range(240)), v) == 32 and len(found) == 240 * 32


def test_whitening_of_short_flat_and_few(spark):
    rng = np.random.default_rng(2)
    flat = rng.integers(-3, 4, (60, 6)).astype(np.float32)
    flat[:, 2], flat[:, 4] = 1.5, flat[:, 3]
    few = rng.standard_normal((4, 9)).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(flat)] + [(100 + i, x.tolist(), 1) for i, x in enumerate(few)] + [(200, [3.0], 1), (None, [2.0, 1.0], 1), (None, [2.0, 1.0], 1)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS), components=5).collect()
    assert check_whitening([r for r in found if r.vec_id is not None and r.vec_id < 100], list(range(60)), flat, 5) == 4
    assert check_whitening([r for r in found if r.vec_id is not None and r.vec_id >= 100], [100, 101, 102, 103], few, 5) == 3
    assert {r.vec_id for r in found} == {*range(60), *range(100, 104)}  # no variance, no component
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_deviations_beyond_a_long(spark):
    rows = [(i, [2.0**30 * i, 0.0, float(i % 2)], 1) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    check_whitening(found, list(range(50)), [r[1] for r in rows])
    assert max(int(r.deviation) for r in found) > 2**63


@pytest.mark.parametrize("case", ["random", "clusters", "graded", "split", "zero"])
def test_directions(case):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    r = {
        "random": rng.standard_normal((40, 40)),
        "clusters": q @ np.diag(np.repeat([4.0, 3.0, 2.0, 1.0], 10)) @ q.T,
        "graded": np.diag(10.0 ** -np.arange(12)) @ np.triu(np.ones((12, 12))),
        "split": np.diag([5.0, 5.0, 5.0, 1.0, 1.0, 0.0]),
        "zero": np.zeros((4, 4)),
    }[case]
    e, w = whitening.directions(r, 32)
    truth = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(e, truth[: len(e)], rtol=1e-10) and np.abs(w.T @ w - np.eye(len(e))).max(initial=0) < 1e-11
    assert np.abs(r.T @ (r @ w) - w * e).max(initial=0) <= 1e-13 * max(truth[0], 1e-300)
    values = whitening.squared_singular_values(*whitening.bidiagonal(r)[:2])
    assert np.allclose(values, truth, rtol=1e-9, atol=1e-15 * truth[0])


def test_rules_as_a_table_are_those_inline(spark):
    from rootweave.llm import urls

    rng = random.Random(9)
    hosts = ["net", "example.net", "a.example.net", "example.com", "b.example.com", "org", "x.org", ""]
    some = [urls.Rule(rng.choice(["allow", "block"]), rng.choice(hosts[:-1]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4)))) for _ in range(120)]
    rules = list({(r.host, r.path): r for r in some}.values())
    pages = [(rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(6)))) for _ in range(200)] + [("", ""), ("net", "")]
    rows = spark.createDataFrame(pages, "host string, path string")
    inline = sorted(str(tuple(r)) for r in rows.withColumn("own", urls.own_rule(F.col("host"), F.col("path"), rules)).select("host", "path", "own").collect())
    table = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    assert sorted(str(tuple(r)) for r in urls.own_rule_join(rows, table).select("host", "path", "own").collect()) == inline
    docs = spark.createDataFrame([(i, f"http://{h}{p}", None) for i, (h, p) in enumerate(pages)], "page_id bigint, url string, html string")
    few, many = (sorted(str(tuple(r)) for r in urls.judge_urls(docs, r).collect()) for r in (rules, table))
    assert few == many


def test_neighbours_of_every_length(spark):
    from rootweave.llm import ann

    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist(), 1) for i in range(90)] + [(100 + i, rng.standard_normal(2).tolist(), 1) for i in range(11)] + [(200, [1.0, 2.0, 3.0], 1), (220, [1.0] * 5, 1), (221, [2.0] * 5, 1)]
    report = {}
    found = ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=4, report=report).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 4)))
    exact = {}
    for q, v, _ in rows:
        if q % 20 == 0:
            v = np.array(v, np.float32).astype(float)
            near = [(i, float(np.array(x, np.float32).astype(float) @ v)) for i, x, _ in rows if i != q and len(x) == len(v)]
            exact[q] = [(i, round(s, 4)) for i, s in sorted(near, key=lambda p: (-p[1], p[0]))[:4]]
    assert got == {q: n for q, n in exact.items() if n} and {100, 220} <= set(got) and 200 not in got
    assert report["recall"] >= 0.97


def dropped(spark, texts):
    from rootweave.llm import linededup

    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: (r.n_dropped, r.text) for r in linededup.dedup_lines(docs).collect()}


@pytest.mark.parametrize("word", ["w%d", "%s"])
def test_recurring_lines_of_texts_full_of_numbers(spark, word):
    """80 unlike texts, of words with digits or of letters, that share one template."""
    rng = random.Random(10)
    name = lambda: word % rng.randrange(10**6) if "d" in word else "".join(rng.choices("abcdefgh", k=7))
    texts = [" ".join(name() for _ in range(40)) + f"\nuser {rng.randrange(10**6)} logged in from host {rng.randrange(10**6)} today\n" + " ".join(name() for _ in range(30)) for _ in range(80)]
    found = dropped(spark, texts)
    assert all(n == 1 and "logged" not in t for n, t in found.values())
    near = [texts[0], texts[0] + " more", texts[0].replace("today", "today")]
    assert all(n == 0 for n, _ in dropped(spark, near).values())  # copies keep their lines


def test_equal_templates_of_one_leaf(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    tails = ["was opened by user {} again", "went down with code {} today", "sent mail to box {} twice", "lost link with node {} there"]
    texts = [" ".join(word() for _ in range(40)) + "\nthe old main server " + tails[i % 4].format(word()) + "\n" + " ".join(word() for _ in range(30)) for i in range(80)]
    assert all(n == 1 for n, _ in dropped(spark, texts).values())
