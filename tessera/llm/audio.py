"""Media columns: payloads as 8-bit mono sound, and features of it.

A payload is stored as a WAV file (unsigned 8-bit samples at 24 kHz). Features: polyphase resampling to
16 kHz (two phases of a windowed sinc), log-mel energies of overlapped 25 ms frames every 10 ms, and
segments by hysteresis on frame energy. Each segment has its time span and a tensor of fixed shape
(TENSOR: equal parts of the span x mel bands). Spans and tensors are stored in Arrow files, one for each task, with
tensors as Arrow's fixed-shape tensor type, and what comes out of them is read from there.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

UNIT, FILL = 576, 255
RATE, UP, DOWN = 24_000, 2, 3
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, FFT, BANDS = 400, 160, 512, 40
TAPS = 12
TENSOR = (8, BANDS)
#: Decibels above the quiet tenth of the frames at which a segment begins, and below which it ends.
BEGIN_DB, END_DB = 6.0, 3.0
#: Frames worked on at once.
BLOCK = 8_192


def payload(raw: bytes) -> bytes:
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE, PCM, mono, unsigned 8 bits."""
    pad = len(samples) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * pad


def samples_of(file: bytes) -> np.ndarray:
    """The samples of a WAV file of that kind, whatever chunks come before them."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(file):
        kind, size = struct.unpack_from("<4sI", file, at)
        if kind == b"fmt " and struct.unpack_from("<HHIIHH", file, at + 8)[0::5] != (1, 8):
            raise ValueError("not 8-bit PCM")
        if kind == b"data":
            return np.frombuffer(file, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _phases() -> list[tuple[int, np.ndarray]]:
    """For each of UP outputs of a period: the offset of its first input sample and its taps."""
    out = []
    for p in range(UP):
        centre = p * DOWN / UP
        first = int(np.floor(centre)) - TAPS // 2 + 1
        t = np.arange(first, first + TAPS) - centre
        cut = UP / DOWN
        h = np.sinc(t * cut) * cut * np.hanning(TAPS * 2 + 1)[np.clip(np.round(t * 2 + TAPS).astype(int), 0, 2 * TAPS)]
        out.append((first, (h / h.sum()).astype(np.float32)))
    return out


def resampled(x: np.ndarray) -> np.ndarray:
    """Float samples at OUT_RATE; beyond its ends the sound is silent."""
    periods = -(-len(x) // DOWN)
    padded = np.zeros(periods * DOWN + 2 * TAPS, np.float32)
    padded[TAPS : TAPS + len(x)] = x
    y = np.zeros((periods, UP), np.float32)
    for p, (first, h) in enumerate(_phases()):
        for t in range(TAPS):
            at = TAPS + first + t
            y[:, p] += h[t] * padded[at : at + periods * DOWN : DOWN]
    return y.reshape(-1)


@cache
def _mel() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(OUT_RATE / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * OUT_RATE / FFT
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies of the frames (the last is filled with silence) and their energies in decibels."""
    frames = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(y)), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    mels, energy = [], []
    for a in range(0, frames, BLOCK):
        part = view[a : a + BLOCK] * window
        spectrum = np.fft.rfft(part, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        mels.append(np.log10(power @ _mel() + 1e-6))
        energy.append(10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, begin: float = BEGIN_DB, end: float = END_DB) -> list[tuple[int, int]]:
    """Spans of frames: one begins when the energy rises to the floor + begin, and ends when it falls below the floor + end.

    The floor is the energy that a tenth of the frames don't reach. Sound without a rise is a single span.
    """
    level = energy - np.partition(energy, len(energy) // 10)[len(energy) // 10]
    mark = np.where(level >= begin, 1, np.where(level < end, 0, -1))
    known = np.flatnonzero(mark >= 0)
    if not len(known) or not (mark == 1).any():
        return [(0, len(energy))]
    last = np.searchsorted(known, np.arange(len(mark)), side="right") - 1
    on = np.where(last >= 0, mark[known[np.maximum(last, 0)]], 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def pooled(mels: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """A tensor of shape TENSOR for every span: means over equal parts of it."""
    total = np.concatenate([np.zeros((1, mels.shape[1])), np.cumsum(mels, axis=0, dtype=np.float64)])
    parts = np.arange(TENSOR[0] + 1) / TENSOR[0]
    at = np.array([[a + (b - a) * p for p in parts] for a, b in spans])
    low = np.minimum(np.floor(at[:, :-1]).astype(int), len(mels) - 1)
    high = np.maximum(np.ceil(at[:, 1:]).astype(int), low + 1)
    return ((total[high] - total[low]) / (high - low)[..., None]).astype(np.float32)


def store(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as a stored table doc_id, n_bytes, media: every text's payload in a WAV file. Null: empty."""

    def media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in common.slices(batch):
                raw = [(t or "").encode() for t in run.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([run.column(0).cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(payload(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    common.bounded(docs)
    return common.stored(docs.select("doc_id", "text").mapInArrow(media, "doc_id long, n_bytes long, media binary"), "media")


#: A tensor in Arrow files: half precision, as log-mel energies have few digits that count.
TENSOR_TYPE = pa.fixed_shape_tensor(pa.float16(), TENSOR)
SPANS = pa.schema([("document", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", TENSOR_TYPE)])
DIGESTS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
_DDL = {pa.int64(): "long", pa.string(): "string"}


def features(media: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores the spans and tensors of media(doc_id, n_bytes, media) in Arrow files below folder (default: a new one in the
    shared folder). Gives a stored row for each record batch of them: path, batch, and arrays of what its documents' stored
    bytes are (DIGESTS). Null media are an empty payload's; repeated rows are documents of their own; a long sound is
    worked on in blocks of frames. An empty table gives no rows."""
    spark = media.sparkSession
    folder = folder or f"{common.shared_folder(spark)}/tessera/tensors-{uuid.uuid4().hex}"

    def described(x) -> tuple[tuple, list[tuple[int, int]], np.ndarray]:
        file = x.as_py() if x.is_valid else wav(payload(b""))
        samples = samples_of(file)
        mels, energy = log_mel(resampled((samples.astype(np.float32) - 128) / 128))
        spans = segments(energy)
        return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(file), hashlib.sha256(file).hexdigest()), spans, pooled(mels, spans)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = common.file_system(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05}.arrow"
        draft, n = f"{root}/{name}.{uuid.uuid4().hex}", 0
        with system.open_output_stream(draft) as out, pa.ipc.new_file(out, SPANS) as writer:
            for batch in batches:
                for run in common.slices(batch, "media"):
                    rows = [described(x) for x in run.column(2)]
                    spans = [(i, a * HOP / OUT_RATE, ((b - 1) * HOP + FRAME) / OUT_RATE) for i, (_, s, _) in enumerate(rows) for a, b in s]
                    values = pa.array(np.concatenate([t for *_, t in rows]).astype(np.float16).ravel())
                    tensors = pa.ExtensionArray.from_storage(TENSOR_TYPE, pa.FixedSizeListArray.from_arrays(values, TENSOR[0] * TENSOR[1]))
                    document, start, end = zip(*spans, strict=True)
                    writer.write_batch(pa.RecordBatch.from_arrays([pa.array(document, pa.int32()), pa.array(start), pa.array(end), tensors], schema=SPANS))
                    columns = [run.column(0).to_pylist(), run.column(1).to_pylist(), *zip(*(d for d, *_ in rows), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int32()), *(pa.array([list(v)], pa.list_(t)) for v, t in zip(columns, DIGESTS.values(), strict=True))], names=["path", "batch", *DIGESTS])
                    n += 1
        system.move(draft, f"{root}/{name}")

    ddl = ", ".join(f"{k} array<{_DDL[t]}>" for k, t in DIGESTS.items())
    return common.stored(media.select("doc_id", "n_bytes", "media").mapInArrow(found, f"path string, batch int, {ddl}"), "tensors")


def _batch(path: str, k: int) -> pa.RecordBatch:
    system, place = common.file_system(path)
    with system.open_input_file(place) as source:
        return pa.ipc.open_file(source).get_batch(k)


def spans(stored: DataFrame) -> DataFrame:
    """Of the rows of features(): doc_id, start_s, end_s and tensor (TENSOR, row by row) of every span."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k, ids in zip(*(batch.column(i) for i in range(3)), strict=True):
                b = _batch(path.as_py(), k.as_py())
                values = b.column(3).to_numpy_ndarray().reshape(b.num_rows, -1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([ids.values.take(b.column(0)), b.column(1), b.column(2), pa.array(list(values), pa.list_(pa.float32()))], names=["doc_id", "start_s", "end_s", "tensor"])

    return stored.select("path", "batch", "doc_id").mapInArrow(read, "doc_id long, start_s double, end_s double, tensor array<float>")


def digests(stored: DataFrame) -> DataFrame:
    """Of the rows of features() a row for each document: DIGESTS, feature, n_segments, last_end_s. feature is the mean of
    the stored tensors, weighed by the lengths of their spans, in hundredths for every band, and the number of spans."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _batch(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                columns = [batch.column(c)[i].values for c in range(2, 2 + len(DIGESTS))]
                m, of = len(columns[0]), np.asarray(b.column(0))
                seconds = np.asarray(b.column(2)) - np.asarray(b.column(1))
                means = np.zeros((m, BANDS))
                np.add.at(means, of, b.column(3).to_numpy_ndarray().mean(axis=1, dtype=np.float64) * seconds[:, None])
                n, last = np.bincount(of, minlength=m), np.zeros(m)
                np.maximum.at(last, of, np.asarray(b.column(2)))
                hundredths = np.rint(means / np.bincount(of, weights=seconds, minlength=m)[:, None] * 100).astype(int)
                feature = [",".join(map(str, x)) + f"|{k}" for x, k in zip(hundredths.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(feature), pa.array(n, pa.int32()), pa.array(last)], names=[*DIGESTS, "feature", "n_segments", "last_end_s"])

    ddl = ", ".join(f"{k} {_DDL[t]}" for k, t in DIGESTS.items())
    return stored.mapInArrow(read, f"{ddl}, feature string, n_segments int, last_end_s double")


def media_digests(docs: DataFrame) -> DataFrame:
    """The rows of op5: sounds and features of docs(doc_id, text), stored and read back. Null texts are empty; a row for
    every row of docs, equal for equal texts; other columns aren't read."""
    return digests(features(store(docs)))
