"""Hierarchical packing of documents into sequences of several context sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common, tokens

#: Context sizes, longest first: powers of two, so that a full sequence of any tier needs no padding.
TIERS = (2048, 1024, 512, 256)
#: Tokens of a step group: sequences that one optimiser step takes together.
STEP_TOKENS = 16_384
END_ID = 1

Piece = tuple[int, int, int]  # document, start, length


def packed(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces of documents of the given lengths.

    1. Route: whole windows of the longest tier are cut off; what is left of a document goes to the
       smallest tier that holds it.
    2. Pack each tier, the longest first: a document opens a window of its tier.
    3. Fill the gap from the same or shorter tiers: the longest waiting rest that fits whole, again and
       again, then a cut of the next longer one.
    4. When nothing waits any more, the last window is cut into powers of two.
    """
    top = tiers[0]
    sequences: list[list[Piece]] = []
    waiting: list[Piece] = []  # (length, document, start), ascending
    for doc, n in enumerate(lengths):
        full = n // top
        sequences += [[(doc, k * top, top)] for k in range(full)]
        if n % top:
            waiting.append((n % top, doc, full * top))
    waiting.sort()
    while waiting:
        n, doc, start = waiting.pop()
        window = min(t for t in tiers if t >= n)
        sequence, gap = [(doc, start, n)], window - n
        while gap and waiting:
            i = bisect_right(waiting, (gap, len(lengths), 0))
            if i:
                n, doc, start = waiting.pop(i - 1)
                sequence.append((doc, start, n))
                gap -= n
            else:
                n, doc, start = waiting.pop(0)
                sequence.append((doc, start, gap))
                insort(waiting, (n - gap, doc, start + gap))
                gap = 0
        if gap:
            sequences += _powers(sequence, window)
        else:
            sequences.append(sequence)
    return sequences


def _powers(sequence: list[Piece], window: int) -> list[list[Piece]]:
    left, out, size = list(sequence), [], window
    total = sum(n for _, _, n in sequence)
    while total:
        size //= 2
        if size > total:
            continue
        total -= size
        room, cut = size, []
        while room:
            doc, start, n = left.pop(0)
            take = min(room, n)
            cut.append((doc, start, take))
            if n > take:
                left.insert(0, (doc, start + take, n - take))
            room -= take
        out.append(cut)
    return out


def step_groups(sizes: list[int], tokens_of_a_step: int = STEP_TOKENS) -> list[int]:
    """A step group for every sequence: the sizes divide the step, so in descending order each group fills exactly."""
    out, group, room = [0] * len(sizes), 0, tokens_of_a_step
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i] > room:
            group, room = group + 1, tokens_of_a_step
        out[i] = group
        room -= sizes[i]
    return out


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for every piece of every document of docs(doc_id, text).

    Null texts are empty; a document is its ids and id 1, so none is without tokens. Repeated rows and
    null doc_ids are documents of their own. Every task packs runs of rows of about 2 MB of text: no
    shuffle, memory bounded by the longest text, the same result when a task is run again.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, sequence_id, group_id = tokens.encoder(tokenizer, False), TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 36
        for batch in batches:
            for run in common.slices(batch):
                ids, n = encoder.ids(run.column(1))
                ids = memoryview(np.insert(ids, np.cumsum(n), END_ID).astype("<u4").tobytes())
                n = n + 1
                first = (np.cumsum(n) - n).tolist()
                sequences = packed(n.tolist())
                sizes = [sum(p[2] for p in s) for s in sequences]
                groups = step_groups(sizes)
                rows = [(doc, start, length, zlib.crc32(ids[4 * (first[doc] + start) : 4 * (first[doc] + start + length)]), k) for k, s in enumerate(sequences) for doc, start, length in s]
                doc, start, length, crc, seq = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                before = np.cumsum(length) - length
                opening = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                size = np.array(sizes)[seq]
                yield pa.RecordBatch.from_arrays(
                    [run.column(0).cast(pa.int64()).take(pa.array(doc)), *(pa.array(x) for x in (start, length, crc, n[doc], seq + sequence_id, before - opening[seq], size, np.array(groups)[seq] + group_id))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"],
                )
                sequence_id += len(sequences)
                group_id += max(groups) + 1

    common.bounded(docs)
    return docs.select("doc_id", "text").mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long")
