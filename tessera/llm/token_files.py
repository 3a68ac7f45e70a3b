"""Token-id files coded by a static range asymmetric numeral system (rANS), and the operator that writes and reads them.

A file holds whole documents in ascending doc_id order. Its layout, all little-endian:

    magic "TRA2", bytes of the header (u32), crc32 of the header (u32)
    header:
      documents, symbols, blocks, tokens of a block, lanes (u32 each), tokens (u64)
      doc_id of every document (i64), whether it is null (u8), its tokens (u64)
      symbols (u32) and their frequencies (u32), which add up to 2**20: one static table for all blocks
      directory, the checkpoints: first word of every block (u64), words (u32), crc32 of its token ids (u32)
      end states of the lanes of every block (u64)
    words (u32)

Every block is decoded by itself from its checkpoint: 32 interleaved lanes take turns token by token. A reader needs
the header and the words of the blocks that it wants, so several tasks read a file at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common, tokens

MAGIC, BITS, LANES, BLOCK, LOW = b"TRA2", 20, 32, 16_384, np.uint64(1 << 31)
#: A file is closed after the document that brings it to so many tokens; a task reads the documents that begin in so
#: many tokens of it.
FILE_TOKENS, READ_TOKENS = 2_000_000, 32 * BLOCK
END_ID = 1


def frequencies(counts: np.ndarray) -> np.ndarray:
    """counts, all positive, scaled to add up to 2**BITS with none at zero."""
    total, room = int(counts.sum()), 1 << BITS
    if len(counts) > room:
        raise ValueError(f"more than {room} symbols")
    f = np.maximum(1, counts * room // total).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    over, i = int(f.sum()) - room, 0
    if over < 0:
        f[order[0]] -= over
    while over > 0:
        take = min(over, int(f[order[i]] - max(1, f[order[i]] // 2)))
        f[order[i]] -= take
        over -= take
        i = (i + 1) % len(order)
    return f


def encode(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
    blocks = -(-len(ids) // BLOCK)
    if blocks:
        pad = blocks * BLOCK - len(ids)
        common_one = int(np.argmax(counts))
        where = np.concatenate([where, np.full(pad, common_one)])
        counts[common_one] += pad
    freq = frequencies(counts) if blocks else np.zeros(0, np.int64)
    first = np.cumsum(freq) - freq
    steps = BLOCK // LANES
    rows = where.reshape(blocks, steps, LANES)
    f64, c64 = freq.astype(np.uint64), first.astype(np.uint64)
    x = np.full((blocks, LANES), LOW, np.uint64)
    out, sent = np.zeros((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
    for s in range(steps - 1, -1, -1):
        f = f64[rows[:, s]]
        full = x >= (f << np.uint64(63 - BITS))
        out[s], sent[s] = x.astype(np.uint32), full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + c64[rows[:, s]]
    sent = sent.transpose(1, 0, 2)
    words = out.transpose(1, 0, 2)[sent]
    each = sent.sum((1, 2))
    sums = [zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)]
    header = b"".join([
        struct.pack("<5IQ", len(doc_ids), len(symbols), blocks, BLOCK, LANES, len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        lengths.astype("<u8").tobytes(),
        symbols.astype("<u4").tobytes(),
        freq.astype("<u4").tobytes(),
        (np.cumsum(each) - each).astype("<u8").tobytes(),
        each.astype("<u4").tobytes(),
        np.array(sums, "<u4").tobytes(),
        x.astype("<u8").tobytes(),
    ])
    return MAGIC + struct.pack("<II", len(header), zlib.crc32(header)) + header + words.astype("<u4").tobytes()


class TokenFile:
    """A token file behind read_at(bytes, offset), such as that of an open pyarrow file."""

    def __init__(self, read_at: Callable[[int, int], bytes]):
        self.read_at = read_at
        head = read_at(12, 0)
        size, crc = struct.unpack("<II", head[4:]) if len(head) == 12 else (0, 0)
        header = read_at(size, 12)
        if head[:4] != MAGIC or zlib.crc32(header) != crc:
            raise ValueError("not a token file, or a damaged one")
        n_docs, n_symbols, n_blocks, self.block, self.lanes, self.n_tokens = struct.unpack_from("<5IQ", header)
        at, self.first_byte = 28, 12 + size

        def taken(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(header, kind, n, at)
            at += found.nbytes
            return found

        doc_ids, null = taken("<i8", n_docs), taken("u1", n_docs)
        self.doc_ids = pa.array(doc_ids, mask=null.astype(bool))
        self.lengths = taken("<u8", n_docs).astype(np.int64)
        self.symbols, self.freq = taken("<u4", n_symbols), taken("<u4", n_symbols)
        self.words, self.sizes, self.sums = taken("<u8", n_blocks).astype(np.int64), taken("<u4", n_blocks).astype(np.int64), taken("<u4", n_blocks)
        self.states = taken("<u8", n_blocks * self.lanes).reshape(n_blocks, self.lanes).astype(np.uint64)

    def ids(self, blocks: range | None = None) -> np.ndarray:
        """The token ids of the given blocks, or of all."""
        chosen = blocks if blocks is not None else range(len(self.sums))
        if not len(chosen):
            return np.zeros(0, np.uint32)
        first, last = self.words[chosen.start], self.words[chosen.stop - 1] + self.sizes[chosen.stop - 1]
        raw = self.read_at(int(4 * (last - first)), int(self.first_byte + 4 * first))
        if len(raw) != 4 * (last - first):
            raise ValueError("a token file is cut short")
        words = np.append(np.frombuffer(raw, "<u4"), np.uint32(0)).astype(np.uint64)
        x, pointer = self.states[chosen.start : chosen.stop], self.words[chosen.start : chosen.stop] - first
        slots = np.repeat(np.arange(len(self.freq)), self.freq)
        f64, c64 = self.freq.astype(np.uint64), (np.cumsum(self.freq, dtype=np.int64) - self.freq).astype(np.uint64)
        steps, mask = self.block // self.lanes, np.uint64((1 << BITS) - 1)
        out = np.zeros((len(chosen), steps, self.lanes), np.uint32)
        for s in range(steps):
            slot = x & mask
            which = slots[slot.astype(np.int64)]
            out[:, s] = self.symbols[which]
            x = f64[which] * (x >> np.uint64(BITS)) + slot - c64[which]
            low = x < LOW
            rank = np.cumsum(low, axis=1)
            x = np.where(low, (x << np.uint64(32)) | words[np.where(low, np.minimum(pointer[:, None] + rank - 1, len(words) - 1), -1)], x)
            pointer = pointer + rank[:, -1]
        flat = out.reshape(-1)[: self.n_tokens - chosen.start * self.block]
        for i, b in enumerate(chosen):
            if (x[i] != LOW).any() or zlib.crc32(flat[i * self.block : (i + 1) * self.block].astype("<u4").tobytes()) != self.sums[b]:
                raise ValueError(f"block {b} is damaged")
        return flat

    def documents(self, begin: int, end: int) -> tuple[slice, np.ndarray, np.ndarray]:
        """Of the documents whose first token is one of begin to end: which they are, their ids end to end, and the first
        token of each in the file."""
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        a, b = np.searchsorted(starts, [begin, end])
        if a == b:
            return slice(a, b), np.zeros(0, np.uint32), starts[a:b]
        low = int(starts[a]) // self.block
        ids = self.ids(range(low, -(-int(ends[b - 1]) // self.block)))
        return slice(a, b), ids[starts[a] - low * self.block : ends[b - 1] - low * self.block], starts[a:b]


def opened(file: bytes) -> TokenFile:
    return TokenFile(lambda n, at: file[at : at + n])


def write(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes docs(doc_id, text) as token files below folder (default: a new one in the shared folder), in ascending
    order of doc_id over the range partitions; documents of one doc_id come in the order of a hash of their texts.

    Gives a stored row for each file: part (range partition), number (file within it), path, tokens. Null texts are
    empty, a null doc_id sorts first, repeated rows are documents of their own; every document ends with id 1. A
    long text is held whole by one task, which closes its file behind it. An empty table gives no file. A task that
    runs again writes the same files; each appears under its name once it is whole.
    """
    spark = common.bounded(docs)
    parts = common.partitions(spark)
    folder = folder or f"{common.shared_folder(spark)}/tessera/token-files-{uuid.uuid4().hex}"
    order = ["doc_id", "mark", "text"]
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).drop("mark")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = common.file_system(folder)
        system.create_dir(root, recursive=True)
        part, number, encoder = TaskContext.get().partitionId(), 0, tokens.encoder(tokenizer, True)
        doc_ids, lengths, ids, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            path = f"{root}/part-{part:05}-{number:05}.tra"
            draft = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(encode(doc_ids, np.concatenate(lengths), np.concatenate(ids)))
            system.move(draft, path)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "path": pa.array([f"{folder}/{path.rpartition('/')[2]}"]), "tokens": pa.array([size], pa.int64())})

        for batch in batches:
            for run in common.slices(batch):
                found, n = encoder.ids(run.column(1))
                lengths.append(n + 1)
                ids.append(np.insert(found, np.cumsum(n), END_ID).astype(np.uint32))
                doc_ids += run.column(0).to_pylist()
                size += len(ids[-1])
                if size >= FILE_TOKENS:
                    yield closed()
                    doc_ids, lengths, ids, size, number = [], [], [], 0, number + 1
        if doc_ids:
            yield closed()

    return common.stored(ordered.mapInArrow(files, "part int, number int, path string, tokens long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """The documents of token files(part, number, path, tokens): doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32. No files, no rows. A file is read by a task for every READ_TOKENS of it, from the checkpoints."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, place = common.file_system(path)
                with system.open_input_file(place) as source:
                    file = TokenFile(lambda n, at, source=source: source.read_at(n, at))
                    which, ids, starts = file.documents(chunk * READ_TOKENS, (chunk + 1) * READ_TOKENS)
                lengths = file.lengths[which]
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": file.doc_ids[which], "start": pa.array(starts + first), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(sums, pa.int64())})

    # One row a range partition comes to the driver: as many as shuffle partitions, however large the input.
    per_part = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    bases, base = [], 0
    for part, n in per_part:
        bases.append((part, base))
        base += n
    spark = files.sparkSession
    in_part = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.select("part", "number", "tokens")
        .join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
        .select("part", "number", (F.col("base") + F.coalesce(F.sum("tokens").over(in_part), F.lit(0))).alias("first"))
    )
    chunks = files.join(starts, ["part", "number"]).select("path", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / READ_TOKENS))).alias("chunk"))
    return chunks.repartition(common.partitions(spark), "path", "chunk").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of op10: docs written by write() and read back by read(), a row for every row of docs."""
    return read(write(docs, tokenizer))
