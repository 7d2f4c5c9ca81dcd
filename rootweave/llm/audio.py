"""Media columns: 8-bit audio and its features.

A payload is stored losslessly as a WAV file (mono, unsigned 8-bit PCM) in a binary
column.  Features come from the stored bytes: the samples are resampled by a
polyphase filter, cut into overlapping windows, turned into log-mel energies and
cut into blocks of ``BLOCK`` frames, each a tensor of fixed shape
``(BLOCK, MELS)`` with its time span; frames are also segmented by energy with
hysteresis.  Audio of any length is read in slices of ``SLICE`` frames.

The tensors of a row are stored as an Arrow IPC stream in a binary column: a table of
``start``, ``end`` and ``values``, whose type is the fixed-shape tensor, so any Arrow
reader gets the shape from what is stored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes

RATE = 16_000
UP, DOWN, TAPS = 3, 4, 16
WINDOW, HOP, MELS, BLOCK = 256, 128, 24, 64
SLICE = 4096
#: A segment starts at a frame above the first level and ends below the second (dB).
START_DB, END_DB = -18.0, -24.0
FLOOR = 1e-7

MEDIA = "doc_id bigint, n_bytes bigint, media binary"
FEATURES = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, n_frames bigint, tensors binary, "
    "segments array<struct<start:double,end:double>>"
)


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    pad = b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(head) + len(payload) + len(pad)) + head + payload + pad


def read_wav(data) -> tuple[int, np.ndarray]:
    """``(rate, samples)`` of an 8-bit mono WAV file; ``ValueError`` for another."""
    view = memoryview(data)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, np.frombuffer(view[at + 8 : at + 8 + size], np.uint8)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def low_pass() -> np.ndarray:
    """Windowed sinc, one row of ``TAPS`` weights for each of ``UP`` phases."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(len(n))
    rows = h.reshape(TAPS, UP).T[:, ::-1]
    return (rows / rows.sum(1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, first: int, last: int, taps: np.ndarray) -> np.ndarray:
    """Outputs ``first`` .. ``last`` of resampling by ``UP / DOWN``: output n is the
    filter's phase ``n * DOWN % UP`` on the ``TAPS`` inputs up to ``n * DOWN // UP``.
    Silence stands before and after the samples."""
    n = np.arange(first, last)
    lo = int(first * DOWN // UP) - TAPS + 1
    hi = int((last - 1) * DOWN // UP) + 1
    x = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(samples))
    if b > a:
        x[a - lo : b - lo] = (samples[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty(len(n), np.float32)
    for k in range(UP):
        mine = np.flatnonzero(n % UP == k)
        if len(mine):
            at = n[mine] * DOWN // UP - TAPS + 1 - lo
            out[mine] = windows[at] @ taps[n[mine[0]] * DOWN % UP]
    return out


def mel_bank(rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced in mel from 0 to half the rate."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def hysteresis(level: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that start at ``START_DB`` and last while at ``END_DB`` or more."""
    above = np.concatenate([[False], level >= END_DB, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1])
    strong = np.concatenate([[0], np.cumsum(level >= START_DB)])
    spans = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if strong[b] > strong[a]:
            spans.append((a + int(np.argmax(level[a:b] >= START_DB)), b))
    return spans


def analyse(samples: np.ndarray, rate: int, taps: np.ndarray, bank: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel energies of every frame, rounded to 1/256, and the loud segments.  A
    last short frame is filled with silence; there is one frame at least."""
    length = -(-len(samples) * UP // DOWN)
    frames = max(1, -(-(length - (WINDOW - HOP)) // HOP))
    shape = np.hanning(WINDOW).astype(np.float32)
    mels, levels = [], []
    for at in range(0, frames, SLICE):
        n = min(SLICE, frames - at)
        y = resample(samples, at * HOP, (at + n - 1) * HOP + WINDOW, taps)
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(cut * shape, axis=1)).astype(np.float32) ** 2
        mels.append(np.round(np.log(power @ bank + FLOOR) * 256) / 256)
        levels.append(10 * np.log10(cut.var(1, dtype=np.float64) + FLOOR))
    return np.concatenate(mels).astype(np.float32), hysteresis(np.concatenate(levels))


def store(docs: DataFrame, multiple: int = 576, fill: int = 255) -> DataFrame:
    """``doc_id, n_bytes, media``: the UTF-8 bytes of every row's text, filled up to a
    positive multiple of ``multiple`` with bytes ``fill``, as a WAV file.

    A null text is empty, and an empty one is all filling.  Repeated rows are stored
    each; other columns are ignored; nothing is dropped or cut.
    """

    def encode(batches):
        for batch in batches:
            media, sizes = [], []
            for x in as_bytes(batch.column(1)):
                n = max(1, -(-len(x) // multiple)) * multiple
                media.append(wav(bytes(x) + bytes([fill]) * (n - len(x))))
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(encode, MEDIA)


def describe(media: DataFrame) -> DataFrame:
    """Read the stored bytes of ``media(doc_id, n_bytes, media)`` back and describe
    them: digests, frames, tensors and segments (times in seconds).

    Equal bytes give equal values: a row's features depend on nothing else.
    """

    def read(batches):
        import hashlib

        taps = low_pass()
        banks = {}
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                rate, samples = read_wav(data)
                out_rate = rate * UP / DOWN
                bank = banks.setdefault(rate, mel_bank(out_rate))
                mels, loud = analyse(samples, rate, taps, bank)
                payload = samples.tobytes()
                seconds = lambda f: f * HOP / out_rate  # noqa: B023, E731
                rows.append(
                    (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), len(mels))
                    + (to_ipc(*blocks(mels, seconds)), [{"start": seconds(a), "end": seconds(b)} for a, b in loud])
                )
            yield to_batch(rows)

    return media.mapInArrow(read, FEATURES)


def blocks(mels: np.ndarray, seconds) -> tuple[np.ndarray, list[float], list[float]]:
    """Tensors of ``BLOCK`` frames with their spans; the last is filled with silence."""
    n = -(-len(mels) // BLOCK)
    tensors = np.full((n * BLOCK, MELS), np.round(np.log(FLOOR) * 256) / 256, np.float32)
    tensors[: len(mels)] = mels
    starts = [seconds(k * BLOCK) for k in range(n)]
    ends = [seconds(min((k + 1) * BLOCK, len(mels))) for k in range(n)]
    return tensors.reshape(n, BLOCK, MELS), starts, ends


def to_ipc(values: np.ndarray, starts: list[float], ends: list[float]) -> bytes:
    """Tensors and their spans as an Arrow IPC stream."""
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(values)
    batch = pa.RecordBatch.from_arrays([pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), tensors], ["start", "end", "values"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data) -> pa.Table:
    """The table ``start, end, values`` of a stored row; ``values`` are fixed-shape tensors."""
    return pa.ipc.open_stream(data).read_all()


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 10
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    arrays.append(pa.array(columns[9], pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))))
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 n_frames tensors segments".split()
    return pa.RecordBatch.from_arrays(arrays, names)


def digest(features: DataFrame) -> DataFrame:
    """``features`` with ``shape`` (of the stored tensors, like ``2x64x24``) and
    ``tensor_sha256``, over their values and spans as read back."""
    at, names = features.columns.index("tensors"), features.columns

    def read(batches):
        import hashlib

        for batch in batches:
            shapes, digests = [], []
            for data in as_bytes(batch.column(at)):
                table = read_tensors(data).combine_chunks()
                values = table["values"].chunk(0).to_numpy_ndarray()
                shapes.append("x".join(map(str, values.shape)))
                found = hashlib.sha256(values.tobytes())
                found.update(np.stack([table[c].to_numpy() for c in ("start", "end")]).tobytes())
                digests.append(found.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.string()), pa.array(digests, pa.string())], [*names, "shape", "tensor_sha256"])

    more = [T.StructField("shape", T.StringType()), T.StructField("tensor_sha256", T.StringType())]
    return features.mapInArrow(read, T.StructType(features.schema.fields + more))
