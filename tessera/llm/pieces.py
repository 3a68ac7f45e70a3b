"""SentencePiece encoding with seeded merge-dropout, and decoding.

The merges of a BPE model are processed from an agenda, best score first and leftmost among equals, as the
sentencepiece library does. A candidate merge that comes to the top is skipped if a hash keyed by the seed, the
text, the word's number in it, the merged piece, its split and its place is below the dropout rate. So the same
seed always gives a text the same segmentation, and every occurrence of a word is segmented by itself. A
candidate that was skipped comes back only if one of its two sides grows.

The agendas of all words of a slice of text are processed at once, in numpy: a matrix has a column for each word
and a row for each place in it, with the order of the candidate that begins there; the least entry of a column is
the top of that word's agenda. Words of more than LONGEST characters have an agenda of their own each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common
from tessera.llm.common import mixed

DROPOUT = 0.1
SEED = 20_240
SPACE = "▁"
#: Bits of a place in a word, and the longest words whose agendas are processed together.
PLACE_BITS = 6
LONGEST = 1 << PLACE_BITS
#: Heights of the matrices: words are grouped by length.
HEIGHTS = (4, 6, 8, 10, 13, 18, 28, LONGEST)
NONE = np.iinfo(np.int32).max
#: What a character is that no piece holds, and a place whose symbol has become part of another.
FOREIGN, GONE = -1, -2


class Model:
    """A model's symbols (pieces, and characters that only longer pieces hold), and the pairs of them that are pieces."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        bytes_ = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        pieces = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        # No piece holds a space after something else, or a line feed: words can be encoded one by one.
        if len(bytes_) < 256 or any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the model needs byte fallback and pieces of single words")
        self.byte_ids[list(bytes_)] = list(bytes_.values())
        self.spelt = [b""] * n
        for p, i in pieces.items():
            self.spelt[i] = p.replace(SPACE, " ").encode()
        for b, i in bytes_.items():
            self.spelt[i] = bytes([b])
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, n + len(symbols) - len(pieces))
        self.n_pieces, self.n_symbols = n, n + len(symbols) - len(pieces)
        merged = sorted((p for p in pieces if len(p) > 1), key=lambda p: -sp.get_score(pieces[p]))
        scores = sorted({-sp.get_score(pieces[p]) for p in merged})
        rank = {x: i for i, x in enumerate(scores)}
        rows = [(symbols[p[:k]] * self.n_symbols + symbols[p[k:]], rank[-sp.get_score(pieces[p])], pieces[p]) for p in merged for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.pairs = {key: (r, piece) for key, r, piece in rows}
        self._pairs(*np.array(rows or [(0, 0, 0)][:0], np.int64).reshape(-1, 3).T)
        #: The piece of each rank, if no other has the same score.
        self.of_rank = np.full(len(scores) + 1, -1, np.int32)
        several = np.bincount([rank[-sp.get_score(pieces[p])] for p in merged], minlength=len(scores) + 1) > 1
        for p in merged:
            self.of_rank[rank[-sp.get_score(pieces[p])]] = pieces[p]
        self.of_rank[several] = -1
        #: The symbol of each character; a literal U+2581 is none, so that decoding returns it.
        self.of_char = np.full(0x110000, FOREIGN, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]
        self.of_char[ord(SPACE)] = FOREIGN

    def _pairs(self, keys: np.ndarray, ranks: np.ndarray, pieces: np.ndarray) -> None:
        """An open-addressing table of the pairs, probed for many at once; its last slot stands for none."""
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.none = 1 << self.bits
        self.slot_key, self.slot_rank, self.slot_piece = np.full(self.none + 1, -1, np.int64), np.full(self.none + 1, NONE, np.int32), np.full(self.none + 1, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[at[left]] < 0]
            self.slot_key[at[free]] = keys[free]
            left = left[self.slot_key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (self.none - 1)
        self.slot_rank[at], self.slot_piece[at] = ranks, pieces

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n_symbols + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        found = self.slot_key[slot]
        missed = found != key
        rest = np.flatnonzero(missed & (found >= 0))
        slot[missed] = self.none
        at = self._slot(key[rest])
        while len(rest):
            at = (at + 1) & (self.none - 1)
            found = self.slot_key[at]
            hit = found == key[rest]
            slot[rest[hit]] = at[hit]
            more = ~hit & (found >= 0)
            rest, at = rest[more], at[more]
        return slot

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that two neighbouring symbols make, NONE if they make none."""
        return self.slot_rank[self._find(left, right)]

    def made(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbouring symbols make, of the given rank."""
        piece = self.of_rank[rank]
        shared = np.flatnonzero(piece < 0)
        if len(shared):
            piece[shared] = self.slot_piece[self._find(left[shared], right[shared])]
        return piece


def skipped(key: np.ndarray, piece: np.ndarray, size: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    """Whether words of the given keys skip the merge to `piece` whose left part, of `size` characters, is at `place`."""
    merge = (piece.astype(np.uint64) << np.uint64(32)) + (size.astype(np.uint64) << np.uint64(24)) + place.astype(np.uint64)
    return (mixed(key + mixed(merge + np.uint64(1))) >> np.uint64(11)) < np.uint64(dropout * 2.0**53)


def _mixed(x: int) -> int:
    """common.mixed() of one number."""
    x &= (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ (x >> 31)


def cuts(chars: np.ndarray) -> np.ndarray:
    """Where words begin in a text: before spaces that follow something else, before and after line feeds."""
    edge = np.ones(len(chars), bool)
    space, line = chars == 0x20, chars == 0x0A
    edge[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
    return edge


class Encoder:
    def __init__(self, file: str, dropout: float = DROPOUT, seed: int = SEED):
        self.model, self.dropout, self.seed = Model(file), dropout, seed

    def _together(self, key: np.ndarray, begin: np.ndarray, size: np.ndarray, height: int) -> None:
        """Processes the agendas of words of at most `height` characters in self.symbol and its neighbours."""
        model, symbol, following, before = self.model, self.symbol, self.following, self.before
        order = np.full((height, len(begin)), NONE, np.int32)
        for place in range(int(size.max()) - 1):
            has = np.flatnonzero(size > place + 1)
            order[place, has] = self._order(self.first[begin[has] + place], place)
        column, key_, begin_ = np.arange(len(begin)), key, begin
        while True:
            top = order.min(axis=0)
            alive = top != NONE
            n = int(alive.sum())
            if not n:
                return
            if n < 0.7 * len(alive):
                order, top, key_, begin_ = np.ascontiguousarray(order[:, alive]), top[alive], key_[alive], begin_[alive]
                column = np.arange(n)
                at, k, b = column, key_, begin_
            else:
                at = np.flatnonzero(alive)
                top, k, b = top[at], key_[at], begin_[at]
            place = top & (LONGEST - 1)
            left = b + place
            right = following[left]
            piece = model.made(top >> PLACE_BITS, symbol[left], symbol[right])
            order[place, at] = NONE
            if self.dropout:
                go = np.flatnonzero(~skipped(k, piece, right - left, place, self.dropout))
                at, b, place, left, right, piece = at[go], b[go], place[go], left[go], right[go], piece[go]
            symbol[left], symbol[right] = piece, GONE
            order[right - b, at] = NONE
            after, earlier = following[right], before[left]
            following[left] = after
            before[after] = left
            # the last places of these arrays stand for none
            order[place, at] = self._order(model.ranks(piece, symbol[after]), place)
            some = np.flatnonzero(earlier >= 0)
            earlier, at, b, piece = earlier[some], at[some], b[some], piece[some]
            order[earlier - b, at] = self._order(model.ranks(symbol[earlier], piece), earlier - b)

    @staticmethod
    def _order(rank: np.ndarray, place) -> np.ndarray:
        return np.where(rank == NONE, NONE, (rank << PLACE_BITS) | place).astype(np.int32)

    def _alone(self, key: int, begin: int, size: int) -> None:
        """Processes the agenda of one word."""
        model, end = self.model, begin + size
        symbol, following, before = self.symbol[begin:end].tolist(), list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = [(r, i, i + 1, 2) for i, r in enumerate(self.first[begin : end - 1].tolist()) if r != NONE]
        span, limit = [1] * size, int(self.dropout * 2.0**53)
        heapify(agenda)
        while agenda:
            rank, i, j, wide = heappop(agenda)
            if symbol[i] == GONE or following[i] != j or span[i] + span[j] != wide:
                continue
            piece = model.pairs[symbol[i] * model.n_symbols + symbol[j]][1]
            if limit and _mixed(key + _mixed((piece << 32) + (span[i] << 24) + i + 1)) >> 11 < limit:
                continue
            symbol[i], symbol[j] = piece, GONE
            span[i] = wide
            following[i] = k = following[j]
            for a, b in ((i, k), (before[i], i)):
                if a >= 0 and b < size:
                    before[b] = a
                    found = model.pairs.get(symbol[a] * model.n_symbols + symbol[b]) if symbol[a] >= 0 and symbol[b] >= 0 else None
                    if found:
                        heappush(agenda, (found[0], a, b, span[a] + span[b]))
        self.symbol[begin:end] = symbol

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a text is prefixed with one space, as the library does."""
        model = self.model
        whole = [" " + t if t else "" for t in texts]
        sizes = np.array([len(t) for t in whole], np.int64)
        chars = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
        n = len(chars)
        if not n:
            return [np.zeros(0, np.uint16) for _ in texts]
        starts = np.cumsum(sizes) - sizes
        edge = cuts(chars)
        edge[starts[sizes > 0]] = True
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, n))
        words = np.diff(np.searchsorted(begin, np.append(starts, n)))
        salt = mixed(np.array([zlib.crc32(t.encode()) for t in whole], np.uint64) + (np.uint64(self.seed) << np.uint64(32)))
        key = mixed(np.repeat(salt, words) + common.spread(np.zeros(len(words), np.int64), words).astype(np.uint64))
        self.symbol = np.append(model.of_char[chars], FOREIGN).astype(np.int32)
        self.following, self.before = np.arange(1, n + 2), np.arange(-1, n)
        self.following[n] = n
        last = begin + size - 1
        self.following[last], self.before[begin] = n, -1
        self.first = model.ranks(self.symbol[:-1], self.symbol[1:])
        low = 1
        for height in HEIGHTS:
            some = np.flatnonzero((size > low) & (size <= height))
            if len(some):
                self._together(key[some], begin[some], size[some], height)
            low = height
        for w in np.flatnonzero(size > LONGEST).tolist():
            self._alone(int(key[w]), int(begin[w]), int(size[w]))
        kept = np.flatnonzero(self.symbol[:n] != GONE)
        out = self.symbol[kept]
        counts = np.diff(np.searchsorted(kept, np.append(starts, n)))
        foreign = np.flatnonzero((out < 0) | (out >= model.n_pieces))
        if len(foreign):
            out, counts = self._spelt(out, counts, foreign, chars[kept[foreign]])
        ends = np.cumsum(counts)
        out = out.astype(np.uint16 if len(model.spelt) <= 65_536 else np.uint32)
        return [out[a:b] for a, b in zip(ends - counts, ends, strict=True)]

    def _spelt(self, out: np.ndarray, counts: np.ndarray, foreign: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """out with the bytes of characters that are no pieces."""
        raw = np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)
        wide = np.ones(len(out), np.int64)
        wide[foreign] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        of = np.repeat(np.arange(len(counts)), counts)
        is_raw = np.zeros(len(out), bool)
        is_raw[foreign] = True
        spread = np.repeat(out, wide)
        spread[np.repeat(is_raw, wide)] = self.model.byte_ids[raw]
        return spread, np.bincount(of, weights=wide, minlength=len(counts)).astype(np.int64)


@cache
def encoder(file: str, dropout: float, seed: int) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(file, dropout, seed)


@cache
def decoder(file: str) -> Decoder:
    return Decoder(file)


class Decoder:
    def __init__(self, file: str):
        spelt = Model(file).spelt
        self.sizes = np.array([len(x) for x in spelt], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        raw = self.flat[common.spread(self.starts[ids], self.sizes[ids])].tobytes()
        return raw[1:].decode("utf-8")


def encode(docs: DataFrame, file: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) with ids: their token ids as little-endian unsigned 16-bit integers (32-bit in a larger model).

    Null and empty texts have no ids. Every other column is dropped; repeated rows stay.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(file, dropout, seed)
        for batch in batches:
            for run in common.slices(batch):
                ids = known.ids(run.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([run.column(0).cast(pa.int64()), run.column(1), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "text", "ids"])

    common.bounded(docs)
    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, file: str, width: int = 2) -> DataFrame:
    """encoded(ids, ...) with decoded: the text of the ids, and n_tokens and ids_crc32 (of unsigned 32-bit ids)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = decoder(file)
        for batch in batches:
            for run in common.slices(batch, "ids"):
                ids = [np.frombuffer(x.as_buffer() if x.is_valid else b"", f"<u{width}") for x in run.column(run.schema.get_field_index("ids"))]
                yield pa.RecordBatch.from_arrays(
                    [*run.columns, pa.array([known.text(x) for x in ids], pa.string()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                    names=[*run.schema.names, "decoded", "n_tokens", "ids_crc32"],
                )

    return encoded.mapInArrow(decoded, ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string, n_tokens long, ids_crc32 long")
