"""Secret scan: fixed patterns plus character Markov models.

Three patterns give the base spans (``assign``, ``access``, ``hex``).  Two
first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a run of identifier characters
outside the base spans is reported as ``markov`` where the log-likelihood ratio
is in favour of the random model.

The samples: random strings are drawn from the alphabets that keys are written in;
ordinary identifiers are made of the corpus's own words, in the ways programs join
them, and count as often as their word stands in it.  No run that is judged is a
sample itself.

Everything on this path is DataFrame expressions.  The only thing sent to the
driver is the table of character pairs, at most ``len(ALPHABET) + 1`` squared
entries for each class, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, let, prefix_sums

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"

#: What keys are written in: hexadecimal, base 32, 36, 62 and 64.
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
#: How words become an identifier: their case and the mark between them.
WAYS = (("camel", ""), ("pascal", ""), ("lower", "_"), ("upper", "_"), ("lower", "-"), ("lower", "/"), ("lower", ""), ("pascal", "="))
#: Random strings drawn, of 16 to 47 characters.
DRAWN = 20_000

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."

SPAN = "array<struct<start:bigint,end:bigint,kind:int,text:string>>"


def pattern_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans in code points.

    ``split`` gives what stands between the matches, so a match starts where the
    lengths before it add up to.  Matches whose ``group`` is shorter than ``least``
    take their place in the text but are dropped.
    """
    p = F.lit(pattern)
    parts = F.arrays_zip(
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("g"),
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long")).alias("gap"),
    )

    def spans(rows):
        rows = F.filter(rows, lambda r: r["m"].isNotNull())
        steps = F.transform(rows, lambda r: r["gap"] + F.length(r["m"]))
        found = let(
            prefix_sums(steps),
            lambda starts: F.transform(
                rows,
                lambda r, i: F.struct(
                    (F.get(starts, i) + r["gap"]).alias("start"),
                    (F.get(starts, i) + r["gap"] + F.length(r["m"])).alias("end"),
                    F.lit(kind).alias("kind"),
                    r["m"].alias("text"),
                    F.length(r["g"]).alias("size"),
                ),
            ),
        )
        found = F.filter(found, lambda s: s["size"] >= least) if least else found
        return F.transform(
            found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))
        )

    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 16) -> DataFrame:
    """``doc_id, base, runs``: base spans by start, then kind, and the runs of at
    least ``min_run`` identifier characters that touch none of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.array_sort(
            F.concat(
                pattern_spans(F.col("t"), ASSIGN, 0, 2, 8), pattern_spans(F.col("t"), ACCESS, 1), pattern_spans(F.col("t"), HEX, 2)
            ),
            lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]),
        ).alias("base"),
        pattern_spans(F.col("t"), RUN % min_run, 3).alias("runs"),
    )
    return spans.withColumn(
        "runs",
        F.when(F.size("base") == 0, F.col("runs")).otherwise(
            F.filter("runs", lambda r: ~F.exists(F.col("base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
        ),
    )


def random_strings(spark: SparkSession, rows: int = DRAWN) -> DataFrame:
    """``(token, random, weight)``: strings drawn evenly from each of ``ALPHABETS``, the same
    ones in every run."""
    of = F.array(*[F.lit(a) for a in ALPHABETS])
    drawn = spark.range(rows).select("id", F.get(of, (F.col("id") % len(ALPHABETS)).cast("int")).alias("a"), F.pmod(F.xxhash64("id"), F.lit(32)).alias("more"))
    letter = lambda i: F.substring(F.col("a"), (F.pmod(F.xxhash64("id", i), F.length("a").cast("long")) + 1).cast("int"), F.lit(1))
    return drawn.select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("more") + 16), letter), "").alias("token"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("weight"))


def identifiers(docs: DataFrame, text_col: str = "text", min_run: int = 16) -> DataFrame:
    """``(token, random, weight)``: an identifier of every word of the texts, twice,
    joined in one of ``WAYS`` (by a hash), weighing as much as the word is frequent.
    Words are letters or a number; what mixes both may be part of a secret and is
    left out, as are words so long that they are judged."""
    word = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z0-9]+")).alias("w")
    words = docs.select(word).groupBy("w").agg(F.count("*").alias("weight")).where(F.col("w").rlike("^([A-Za-z]{1,%d}|[0-9]{1,%d})$" % (min_run - 1, min_run - 1)))
    w, way = F.col("w"), F.pmod(F.xxhash64("w"), F.lit(len(WAYS)))
    cases = {"camel": (F.lower(w), F.initcap(w)), "pascal": (F.initcap(w), F.initcap(w)), "lower": (F.lower(w), F.lower(w)), "upper": (F.upper(w), F.upper(w))}
    joined = F.coalesce(*[F.when(way == i, F.concat_ws(mark, *cases[case])) for i, (case, mark) in enumerate(WAYS)])
    return words.select(joined.alias("token"), F.lit(False).alias("random"), "weight")


def train(samples: DataFrame, backing: float = 16.0) -> list[float]:
    """Log-likelihood ratios random : ordinary of every pair of characters, row by
    row of ``ALPHABET`` with the start of a string first.

    ``samples(token, random, weight)``; other characters part tokens, and null or empty
    ones don't count.  A pair's probability backs off to how often its second character
    stands in the class at all, with the weight of ``backing`` pairs.  Without samples
    of a class its model is uniform.
    """
    size = len(ALPHABET) + 1
    pairs = F.regexp_extract_all(F.concat(F.lit(" "), "token"), F.lit("(?s)(?=(.[A-Za-z0-9+/_=.-]))"), F.lit(1))
    code = lambda at: F.instr(F.lit(ALPHABET), F.substring("pair", at, 1))
    rows = samples.where("length(token) > 0").select("random", "weight", F.explode(pairs).alias("pair"))
    counts = rows.groupBy("random", code(1).alias("a"), code(2).alias("b")).agg(F.sum("weight").alias("n"))
    table = {r: [0.0] * (size * size) for r in (True, False)}
    for r in counts.collect():  # at most 2 * size * size rows
        table[r["random"]][r["a"] * size + r["b"]] = r["n"]
    single = {r: [sum(t[b::size]) + 1 for b in range(size)] for r, t in table.items()}
    ratios = []
    for a in range(size):
        logs = {}
        for r, t in table.items():
            row, total = t[a * size : (a + 1) * size], sum(single[r])
            logs[r] = [math.log((n + backing * u / total) / (sum(row) + backing)) for n, u in zip(row, single[r])]
        ratios += [x - y for x, y in zip(logs[True], logs[False])]
    return ratios


def ratio(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio random : ordinary of a token over ``ALPHABET``."""
    size = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def step(state, c):
        code = F.instr(F.lit(ALPHABET), c)
        return F.struct((state["sum"] + F.get(table, state["at"] * size + code)).alias("sum"), code.alias("at"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    return F.aggregate(F.split(token, ""), start, step, lambda s: s["sum"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 16, margin: float = 1.0) -> DataFrame:
    """``doc_id, base, spans`` for every row: the base spans, and these with the
    runs whose log-likelihood ratio is at least ``margin`` a character, by start, then
    kind.

    Null texts count as empty and give no spans.  Repeated rows are scanned each;
    other columns are ignored.  The model of ordinary identifiers is trained from all
    rows of ``docs``; an empty table gives no row.
    """
    found = durable(find_spans(docs, id_col, text_col, min_run))
    ratios = train(random_strings(docs.sparkSession).union(identifiers(docs, text_col, min_run)))
    kept = F.filter("runs", lambda r: ratio(r["text"], ratios) >= margin * F.length(r["text"]))
    spans = F.array_sort(
        F.concat(F.col("base"), kept),
        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]),
    )
    return found.select("doc_id", "base", spans.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
