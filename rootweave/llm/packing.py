"""Best-fit packing of tokenised documents into fixed-length sequences.

Packing is hierarchical: every partition packs its own pieces best-fit decreasing;
sequences that are nearly full are done.  The others go on as items: groups of
them, fewer in every round, pack best-fit again, so that underfull sequences of
different partitions meet.  A group is bounded in size, so no task ever holds more
than ``group_items`` sequences; when one group is left, or a round merges almost
nothing, what remains is done as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, done boolean"
#: Texts go to the tokenizer in chunks of about so many characters, cut before white space.
CHUNK = 1 << 16


class Encoder:
    """Ids of ``byte_bpe_50k``: the rank file gives the same ids as the JSON file
    and is several times faster; texts with a special token's string go to the
    JSON file's tokenizer, which knows it."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.slow = json_path, None

    def ids(self, text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) <= CHUNK:
            return np.asarray(self.fast.encode_ordinary(text), "<u4")
        return np.concatenate([np.asarray(self.fast.encode_ordinary(x), "<u4") for x in chunks(text)])


def chunks(text: str) -> Iterator[str]:
    """Parts of at least ``CHUNK`` characters that start at white space after another
    character: no token of the pattern spans such a place."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):
            end += 1
        yield text[at:end]
        at = end


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: all full but the first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenise(docs: DataFrame, capacity: int, paths: tuple[str, str, str], with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``: ids of the whole text, then id
    0.  A piece is a sequence of its own at first, done if it is full.  With
    ``with_ids`` the ids come along."""

    def encode(batches):
        from pyspark import TaskContext

        encoder = Encoder(*paths)
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ids = np.append(encoder.ids(str(text, "utf-8")), np.zeros(1, "<u4"))
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc_id, k, start, length, zlib.crc32(part.tobytes()), key, 0, length == capacity, *([part] if with_ids else [])))
                    key += 1
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()] + [pa.list_(pa.int64())] * with_ids
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(encode, PIECES + ", ids array<bigint>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for every item the item that opened its bin, its offset
    there, and the fill of its bin.  Open bins are kept by free space; a bit mask of
    the spaces in use gives the tightest that fits."""
    opener, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill = np.zeros(len(sizes), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
        else:
            b, space = i, capacity
        opener[i], offset[i] = b, capacity - space
        fill[b] = capacity - space + size
        if space > size:
            by_space[space - size].append(b)
            mask |= 1 << (space - size)
    return opener, offset, fill[opener]


def repack(rows: pd.DataFrame, capacity: int, full: int) -> pd.DataFrame:
    """Pack the sequences in ``rows`` best-fit; a merged one is named after the one
    that opened it.  Those filled to ``full`` are done."""
    if not len(rows):
        return rows
    names, at = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
    sizes = np.bincount(at, weights=rows["length"].to_numpy()).astype(np.int64)
    opener, offset, fill = best_fit(sizes, capacity)
    return rows.assign(sequence_id=names[opener][at], offset=rows["offset"].to_numpy() + offset[at], done=(fill >= full)[at])


def pack(docs: DataFrame, capacity: int = 2048, slack: int = 8, group_items: int = 50_000, fan_in: int = 4, paths=None) -> DataFrame:
    """Pack every row of ``docs(doc_id, text)`` into sequences of ``capacity`` tokens.

    Returns a row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  A sequence with at most ``slack`` free places counts as full.  Null
    and empty texts are the single id 0.  Repeated rows are packed each; other
    columns are ignored; an empty table gives no row.
    """
    columns = [x.split()[0] for x in PIECES.split(", ")][:-1]
    local = lambda batches: (repack(part, capacity, capacity - slack) for part in gathered(batches, group_items))
    pieces = durable(tokenise(docs, capacity, paths or public_paths()))
    packed = [pieces.where("done")]
    rest = durable(pieces.where("not done").mapInPandas(local, PIECES))
    packed.append(rest.where("done"))
    open_rows = rest.where("not done")
    left = sequences(open_rows)
    groups = -(-left // 2048)
    while left:
        groups = max(-(-groups // fan_in), -(-left // group_items))
        full = capacity - slack if groups > 1 else 0
        grouped = open_rows.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("g"))
        rest = durable(grouped.applyInPandas(merging(capacity, full), PIECES))
        packed.append(rest.where("done"))
        open_rows = rest.where("not done")
        before, left = left, sequences(open_rows)
        if left and groups == -(-before // group_items) and left > 0.99 * before:
            packed.append(open_rows)  # one more round would merge next to nothing
            break
    out = packed[0]
    for p in packed[1:]:
        out = out.union(p)
    return out.select(*columns)


def merging(capacity: int, full: int):
    return lambda rows: repack(rows, capacity, full)


def gathered(batches, least: int):
    """Consecutive batches as frames of about ``least`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= least:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def sequences(rows: DataFrame) -> int:
    """Number of sequences: each has one row at offset 0."""
    return rows.where("offset = 0").count()


def public_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_sequences(docs: DataFrame, packed: DataFrame, capacity: int = 2048, paths=None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` with the ids in place.
    ``doc_id`` must be unique.  Pieces meet by sequence, at most ``capacity`` ids each."""
    ids = tokenise(docs, capacity, paths or public_paths(), with_ids=True).select("doc_id", "piece", "ids")
    placed = ids.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
