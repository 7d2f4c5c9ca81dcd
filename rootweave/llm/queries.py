"""Queries ``opN_<name>`` over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, fingerprints, html_extract, linededup, manifest, mixing, neardup, packing, secrets, toxicity, urls, whitening
from .common import durable, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (urls.rule("block", "net/"), urls.rule("allow", "example.net/en/"), urls.rule("block", "example.com/de/"), urls.rule("allow", "org/fr/"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "tokens", "worth", "probability", "kept"
    )


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_list(F.col("base")), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars", "n_tokens", "n_repeated"
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: The remainder of crc32(doc_id) that is held out, and the folds of the others.
HELD_OUT, FOLDS = 2, {0: 0, 1: 1, 3: 2}


def remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 4


def fold():
    return F.coalesce(*[F.when(remainder() == r, F.lit(k)) for r, k in FOLDS.items()])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_all(docs, labels, fold(), len(FOLDS)).select(
        "doc_id", (remainder() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media and tensors are both stored and read back; the feature digests what was read."""
    media = durable(audio.store(table(spark, sf_dir, "documents")), compression="zstd")
    found = audio.digest(durable(audio.describe(media), compression="zstd"))
    loud = F.array_join(F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        F.format_string("logmel:%d:%s:%d:%s", "n_frames", "shape", F.size("segments"), F.sha2(F.concat_ws("|", "tensor_sha256", loud), 256)).alias("feature"),
    )


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = lambda c: F.lower(F.hex(c))
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed("sketch").alias("fingerprint"),
        packed("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "jaccard_edited",
        "jaccard_next",
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered, manifest.lower_ascii(F.col("text")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null here; the operator's is a decimal."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def queries() -> dict:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_url_filters": op3_url_filters,
        "op4_html_extraction": op4_html_extraction,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_toxicity": op6_toxicity,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_line_dedup": op8_line_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_media_columns": op10_media_columns,
        "op11_fingerprints": op11_fingerprints,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_whitening": op13_whitening,
    }


def _parts(source: str) -> str:
    """SQL for ``host, path, query`` of the column ``rest``, what follows ``://``."""
    return (
        f"SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, "
        f"regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query FROM {source}"
    )


def _rule_sql(what: str) -> str:
    cases = [
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND path LIKE '{r.path}%' THEN '{r.name if what == 'rule' else r.verdict}'"
        for r in sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))
    ]
    return f"CASE {' '.join(cases)} END"


KEY_SQL = "CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || query END"

OP3_SQL = rf"""WITH RECURSIVE
u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, {KEY_SQL} AS key, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS own FROM ({_parts('u')})),
t AS (SELECT key, host, path, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM (SELECT *, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag FROM p)
 UNION ALL SELECT key, host, path, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM (SELECT *, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS tag FROM p)),
f AS (SELECT key AS a, host AS h, path AS q, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(target, instr(target, '://') + 3) WHEN target LIKE '//%' THEN substr(target, 3)
 WHEN target LIKE '/%' THEN host || target ELSE host || regexp_replace(path, '[^/]*$', '') || target END AS rest
 FROM (SELECT key, host, path, replace(target, '&amp;', '&') AS target FROM t WHERE target <> '') WHERE key IS NOT NULL),
g AS (SELECT a, h, q, {KEY_SQL} AS b, host, path, query FROM ({_parts('f')})),
e AS (SELECT a, b FROM g WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM g WHERE b IS NOT NULL AND a <> b),
ends AS (SELECT key AS node, host, path FROM p WHERE key IS NOT NULL UNION SELECT b, host, path FROM g WHERE b IS NOT NULL),
reach AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT node, min(other) AS alias_of FROM (SELECT * FROM reach UNION SELECT a, a FROM e) GROUP BY 1),
judged AS (SELECT c.alias_of, bool_or({_rule_sql('verdict')} = 'block') AS blocked, bool_or({_rule_sql('verdict')} = 'allow') AS allowed FROM comp c JOIN ends USING (node) GROUP BY 1)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.own, CASE WHEN coalesce(j.blocked, false) AND NOT coalesce(j.allowed, false) THEN 'block' END, 'allow') AS verdict, c.alias_of
FROM p LEFT JOIN comp c ON c.node = p.key LEFT JOIN judged j ON j.alias_of = c.alias_of"""


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field(text if c == 'text' else c) for c in manifest.FIELDS)})"


#: Trees of all sources and, with the key '', of their subroots; levels are raised by a
#: recursive query each, proofs are the siblings of a leaf's ancestors.
OP12_SQL = f"""WITH RECURSIVE
d AS (SELECT doc_id, {_field('source')} AS tree, source, {_leaf_sql('text')} AS leaf, {_leaf_sql(f"translate(text, '{urls.UPPER}', '{urls.LOWER}')")} AS low,
 xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda q, z: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END)), 4294967295) % 5 = 0 AS tampered
 FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv AS (SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
 UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM lv WHERE n > 1 GROUP BY tree, level, pos // 16),
sources AS (SELECT tree, any_value(source) AS source FROM d GROUP BY 1),
subroots AS (SELECT tree, digest, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM lv JOIN sources USING (tree) WHERE n = 1),
top AS (SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
 UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY level, pos // 16),
nodes AS (SELECT tree, level, pos, digest, n FROM lv UNION ALL SELECT '', level, pos, digest, n FROM top),
runs AS (SELECT tree, level, pos // 16 AS up, list(digest ORDER BY pos) AS kids FROM nodes WHERE n > 1 GROUP BY 1, 2, 3),
climb AS (SELECT l.doc_id, l.tree AS own, l.pos AS place, l.leaf, l.tree, 0 AS level, l.pos, CASE WHEN tampered THEN low ELSE leaf END AS folded, '' AS proof FROM leaves l
 UNION ALL SELECT c.doc_id, c.own, c.place, c.leaf, CASE WHEN r.tree IS NULL THEN '' ELSE c.tree END, CASE WHEN r.tree IS NULL THEN 0 ELSE c.level + 1 END, CASE WHEN r.tree IS NULL THEN s.pos ELSE c.pos // 16 END,
  CASE WHEN r.tree IS NULL THEN c.folded ELSE sha256(array_to_string(r.kids[:c.pos % 16], '') || c.folded || array_to_string(r.kids[c.pos % 16 + 2:], '')) END,
  CASE WHEN r.tree IS NULL THEN c.proof ELSE c.proof || array_to_string(r.kids[:c.pos % 16], '') || array_to_string(r.kids[c.pos % 16 + 2:], '') END
  FROM climb c LEFT JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.up = c.pos // 16 LEFT JOIN subroots s ON s.tree = c.tree AND s.height = c.level
  WHERE r.tree IS NOT NULL OR s.tree IS NOT NULL),
root AS (SELECT level, digest FROM top WHERE n = 1)
SELECT c.doc_id, c.leaf, s.digest AS subroot, root.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root.digest AS verified
FROM climb c JOIN root ON c.tree = '' AND c.level = root.level JOIN subroots s ON s.tree = c.own"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"op3_url_filters": OP3_SQL, "op12_merkle_manifest": OP12_SQL}
