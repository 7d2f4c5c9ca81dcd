"""Main text of web pages by repeated runs of a host's pages and page structure.

The blocks of all pages of a host are its token stream, pages and blocks parted by
marks.  What decides is its suffix array to the depth of ``RUN`` tokens: suffixes that
agree so far are neighbours there, so a bucket of equal runs tells on how many
distinct pages a run stands, and longer repeats are overlapping runs.  The array is
never laid out in one place: its buckets are Spark groups by the hash of host and run,
so neither a large host nor a frequent run fills a task.

Blocks have a role from the page, which is a prior only for how widely a run must
spread to be boilerplate:

* furniture (elements for menus, adverts, footers and so on) goes;
* open blocks, on pages without an article, lose each run that stands on two pages;
* article blocks lose each run that stands on most of the host's pages.

What a page keeps are its blocks less the runs taken out.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable
from .neardup import GOLD, Hasher, combine, mix
from .urls import split_url

#: Tokens of a run.  Every run holds a seed: the least hash of its parts of ``PART``
#: tokens, so equal runs have equal seeds.
RUN, PART = 8, 4
#: An article's run is boilerplate on more than this share of the host's pages, and on
#: no fewer than ``LEAST`` of them.
MOST, LEAST = 0.5, 4
#: Characters of parsed pages whose seeds one group counts, about.
GROUP = 1 << 25

#: ``OUTSIDE`` is what stands outside the article of a page that has one.
ARTICLE, OPEN, OUTSIDE, FURNITURE = "A", "O", "X", "F"

MAIN_TAGS = frozenset("article main".split())
RAW_TAGS = "script style noscript template textarea svg iframe select object math".split()
FURNITURE_TAGS = frozenset("nav header footer aside form head title button menu dialog label input option".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class, id and role that mark furniture; a page's own article or main
#: element is none, but comments inside it may be articles, too.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related "
    "respond share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert dialog".split()
)

SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(%s)\b[^>]*>.*?(?:</\1\s*>|\Z)" % "|".join(RAW_TAGS), re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


def furniture(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element is furniture; ``inside`` an article or not."""
    if tag in FURNITURE_TAGS:
        return True
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
                return True
            if tag not in ("body", "html") and (inside or tag not in MAIN_TAGS) and name.lower() in ("class", "id", "role") and not WORDS.isdisjoint(re.split(r"[\s_-]+", value)):
                return True
    return False


def page_blocks(page: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every non-empty block of a page, in order."""
    page = SKIP.sub(" ", page)
    stack: list[tuple[str, int, int]] = []  # tag, open articles, open furniture
    mains = out = 0
    found: list[tuple[int, int, str]] = []
    text: list[str] = []

    def close():
        if text:
            block = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if block:
                found.append((mains, out, block))
            text.clear()

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        end, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in BLOCK_TAGS:
            close()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][1:] != (mains, out):
                        close()  # the role changes here; an inline element parts nothing
                    _, mains, out = stack[k]
                    del stack[k:]
                    break
            continue
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if tag in BLOCK_TAGS:
            ends = ENDS.get(tag, ()) + ("p",)
            while stack and stack[-1][0] in ends:
                _, mains, out = stack.pop()
        is_main, is_out = tag in MAIN_TAGS, furniture(tag, attributes, mains > 0)
        if is_main or is_out:
            close()
        stack.append((tag, mains, out))
        mains += is_main
        out += is_out
    text.append(page[at:])
    close()
    has_main = any(a and not f for a, f, _ in found)
    return [(FURNITURE if f else ARTICLE if a else OUTSIDE if has_main else OPEN, x) for a, f, x in found]


def parse(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, key, blocks``: ``key`` tells pages apart by id and url,
    ``host`` is the host's hash; the blocks are one string, each a role letter and its
    text, parted by the record mark (white space in texts is plain spaces)."""

    def run(batches):
        for batch in batches:
            blocks = ["\x1e".join(r + t.replace("\x1e", "") for r, t in page_blocks(str(x, "utf-8"))) for x in as_bytes(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blocks, pa.string())], ["page_id", "url", "host", "key", "blocks"])

    host = F.xxhash64(split_url(F.col("url"))[0])
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), F.xxhash64("page_id", "url").alias("key"), F.coalesce("html", F.lit("")).alias("html")
    )
    return rows.mapInArrow(run, "page_id bigint, url string, host bigint, key bigint, blocks string")


class Page:
    """A page's tokens and runs; hashes depend on the host."""

    def __init__(self, hasher: Hasher, host: int, blocks: str):
        self.blocks = blocks.split("\x1e") if blocks else []
        self.roles = np.array([b[0] for b in self.blocks], "U1")
        sizes = np.array([b.count(" ") + 1 for b in self.blocks], np.int64)
        self.block = np.repeat(np.arange(len(sizes)), sizes)
        self.salt = mix(np.array([host], np.int64).view(np.uint64) + GOLD)
        self.tokens = hasher.words(" ".join(b[1:] for b in self.blocks).encode())
        self.starts = np.zeros(0, np.int64)  # places where a run lies within a block
        if len(self.tokens) >= RUN:
            self.starts = np.flatnonzero(self.block[: 1 - RUN] == self.block[RUN - 1 :])

    def of(self, *roles: str) -> np.ndarray:
        """The starts in blocks of these roles."""
        return self.starts[np.isin(self.roles, roles)[self.block[self.starts]]]

    def runs(self, starts: np.ndarray) -> np.ndarray:
        return mix(combine(self.tokens, RUN)[starts] + self.salt).view(np.int64) if len(starts) else starts

    def seeds(self, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return starts
        parts = mix(combine(self.tokens, PART) + self.salt)
        return np.lib.stride_tricks.sliding_window_view(parts, RUN - PART + 1).min(axis=1)[starts].view(np.int64)

    def without(self, starts: np.ndarray) -> tuple[str, int, int]:
        """The text without the runs at ``starts`` and without furniture, and how many
        blocks are in it and tokens were taken out."""
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + RUN, -1)
        covered = np.cumsum(edge[:-1]) > 0
        dirty = np.zeros(len(self.blocks), bool)
        dirty[self.block[covered]] = True
        kept = []
        for k in np.flatnonzero(np.isin(self.roles, (ARTICLE, OPEN))).tolist():
            text = self.blocks[k][1:]
            if dirty[k]:
                text = " ".join(t for t, c in zip(text.split(" "), covered[self.block == k].tolist()) if not c)
            if text:
                kept.append(text)
        return " ".join(kept), len(kept), int(covered.sum())


def pages_of(batch, hasher: Hasher):
    """``(key, Page)`` of the rows of a batch that starts with host, key and blocks."""
    for host, key, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        yield key, Page(hasher, host, blocks)


def flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def page_runs(parsed: DataFrame, pick) -> DataFrame:
    """``host, run, key``: the distinct runs of every page at the starts that
    ``pick(page, extra)`` chooses; ``extra`` is the fourth column, if there is one."""

    def emit(batches):
        hasher = Hasher(RUN)
        for batch in batches:
            extra = batch.column(3) if batch.num_columns > 3 else [None] * len(batch)
            hosts, keys, runs = [], [], []
            for (key, page), host, x in zip(pages_of(batch, hasher), batch.column(0).to_pylist(), extra):
                own = np.unique(page.runs(pick(page, x)))
                runs.append(own)
                hosts.append(np.full(len(own), host, np.int64))
                keys.append(np.full(len(own), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(flat(x).astype(np.int64)) for x in (hosts, runs, keys)], ["host", "run", "key"])

    return parsed.mapInArrow(emit, "host bigint, run bigint, key bigint")


def listed(values) -> np.ndarray:
    """An Arrow list value as numbers."""
    return values.values.to_numpy(zero_copy_only=False) if values is not None and values.is_valid else np.zeros(0, np.int64)


def open_runs(parsed: DataFrame) -> DataFrame:
    """``key, runs``: for pages without an article, the runs that stand on two pages
    or more of the host, outside articles and furniture."""
    runs = durable(page_runs(parsed.where(F.col("blocks").rlike("(^|\x1e)[OX]")).select("host", "key", "blocks"), lambda p, _: p.of(OPEN, OUTSIDE)))
    spread = runs.groupBy("run").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("run")
    return runs.join(spread, "run").groupBy("key").agg(F.collect_set("run").alias("runs"))


def seed_counts(parsed: DataFrame, groups: int) -> DataFrame:
    """``host, seed, n``: how many rows of a host hold a seed in an article, where they
    are ``LEAST`` or more.  A task sends its counts as packed numbers, dealt into
    groups by the seed; seeds and hosts are cut to 32 bits here, so a count may
    be too high but never too low."""

    def count(batches):
        hasher = Hasher(RUN)
        held, size = [], 0

        def flush():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            group = (pairs & 0xFFFFFFFF) % groups
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            parts = [x for x in np.split(order, cuts) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(group[x[0]]) for x in parts], pa.int64()),
                    pa.array([(pairs[x] >> np.uint64(32)).astype(np.uint32).tobytes() for x in parts], pa.binary()),
                    pa.array([pairs[x].astype(np.uint32).tobytes() for x in parts], pa.binary()),
                    pa.array([n[x].astype(np.uint32).tobytes() for x in parts], pa.binary()),
                ],
                ["bucket", "hosts", "seeds", "counts"],
            )

        for batch in batches:
            for host, (_, page) in zip(batch.column(0).to_pylist(), pages_of(batch, hasher)):
                seeds = np.unique(page.seeds(page.of(ARTICLE)).view(np.uint64) >> np.uint64(32))
                if len(seeds):
                    held.append(np.uint64((host & 0xFFFFFFFF) << 32) | seeds)
                    size += len(seeds)
                if size > 1 << 21:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        hosts, seeds, counts = (np.frombuffer(b"".join(rows[c]), np.uint32) for c in ("hosts", "seeds", "counts"))
        pairs, at = np.unique((hosts.astype(np.uint64) << np.uint64(32)) | seeds, return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(pairs)).astype(np.int64)
        pairs, n = pairs[n >= LEAST], n[n >= LEAST]
        return pd.DataFrame({"host": (pairs >> np.uint64(32)).astype(np.int64), "seed": (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), "n": n})

    sent = parsed.select("host", "key", "blocks").mapInArrow(count, "bucket bigint, hosts binary, seeds binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(add, "host bigint, seed bigint, n bigint")


def article_runs(parsed: DataFrame) -> DataFrame:
    """``host, runs``: the runs of articles on more than ``MOST`` of a host's pages.

    Seeds are counted first: a run's pages all hold its seed.  Only runs of frequent
    seeds are counted themselves.  A host has at most 1 / ``MOST`` times as many such
    runs as its pages have on average, so the lists are short.
    """
    chars = parsed.agg(F.sum(F.length("blocks"))).first()[0] or 0
    hosts = durable(parsed.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST))
    low = hosts.select("host", "pages", F.col("host").bitwiseAND(0xFFFFFFFF).alias("low"))
    often = seed_counts(parsed, max(1, -(-chars // GROUP))).withColumnRenamed("host", "low").join(low, "low").where(F.col("n") > MOST * F.col("pages"))
    often = durable(often.groupBy("host").agg(F.collect_set("seed").alias("seeds")))
    found = parsed.join(often, "host").select("host", "key", "blocks", "seeds")

    def frequent(page: Page, seeds) -> np.ndarray:
        at = page.of(ARTICLE)
        return at[np.isin(page.seeds(at).view(np.uint64) >> np.uint64(32), listed(seeds).astype(np.uint64))]

    spread = page_runs(found, frequent).distinct().groupBy("host", "run").agg(F.count("*").alias("n")).join(hosts, "host")
    spread = spread.where((F.col("n") > MOST * F.col("pages")) & (F.col("n") >= LEAST))
    return durable(spread.groupBy("host").agg(F.collect_set("run").alias("runs")))


TEXTS = "page_id bigint, url string, text string, n_blocks int, n_kept int, n_tokens bigint, n_repeated bigint"


def clean(rows: DataFrame) -> DataFrame:
    """Texts of ``rows(host, key, blocks, runs, page_id, url)`` without these runs."""

    def run(batches):
        hasher = Hasher(RUN)
        for batch in batches:
            out = []
            for (_, page), runs in zip(pages_of(batch, hasher), batch.column(3)):
                runs, at = listed(runs), page.of(ARTICLE, OPEN)
                at = at[np.isin(page.runs(at), runs)] if len(runs) else at[:0]
                text, kept, again = page.without(at)
                out.append((text, len(page.blocks), kept, len(page.tokens), again))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(4), batch.column(5), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["page_id", "url", "text", "n_blocks", "n_kept", "n_tokens", "n_repeated"],
            )

    return rows.mapInArrow(run, TEXTS)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages(page_id, url, html)``.

    Returns ``page_id, url, text, n_chars`` and counts: blocks and tokens of the page,
    blocks in the text and tokens of its article and open blocks that lay in repeated
    runs and were taken out.  Article blocks (in ``article`` or ``main``), or on a page
    without an article the open blocks, are joined by one space in page order,
    references decoded, white space as one space; furniture and repeated runs go.  Words
    that differ in the case of A-Z only are equal in runs.

    Null or empty html gives an empty text.  Pages without a host are one host.  Rows
    with the same id and url are one page where pages are counted, and each is
    returned.  Other columns are ignored.  An empty table gives no row.
    """
    parsed = durable(parse(pages), compression="zstd")
    names = ["host", "key", "blocks", "runs", "page_id", "url"]
    is_open = F.col("blocks").rlike("(^|\x1e)O")
    # only pages without an article are shuffled whole; lists by host are short
    bare = parsed.where(is_open).join(open_runs(parsed), "key", "left").select(names)
    rest = parsed.where(~is_open).join(article_runs(parsed), "host", "left").select(names)
    done = clean(bare.unionByName(rest))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept", "n_tokens", "n_repeated")
