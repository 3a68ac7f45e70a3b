"""Token ids by a public tokenizer file, through the tokenizers library, with a table of pieces already encoded.

Texts are cut where the tokenizer's own pre-tokenizer always cuts: at white space, and between a letter and a mark
such as a comma. The ids of the pieces, end to end, are the ids of the whole text, so that every distinct piece is
encoded once, by the library, and looked up by its 64-bit hash from then on. Cutting and looking up are done for
all pieces of a slice of text at once.
"""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tessera.llm import common
from tessera.llm.common import mixed, spread
from tessera.llm.words import prefix_hashes

#: Distinct pieces kept by a worker; beyond it those that came once are forgotten, which changes no result.
KEPT = 500_000
#: Classes of bytes: white space of ASCII, letters (ASCII, and of two bytes below U+0100), marks, and all else.
SPACE, LETTER, MARK, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[list(b",.!?;:")] = MARK
#: Bytes of letters below U+0100 in UTF-8 (of other characters too, of which isalpha() tells them).
_LETTERS = bytes([*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)])
#: How byte-level tokenizers spell the bytes that are no printable characters of their own, in order from U+0100 on.
_SPELT = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Ids by 64-bit key, in an open-addressing table that is probed for many keys at once."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.bits = kept, max(8, int(3 * kept).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.slot_key = np.zeros(1 << self.bits, np.uint64)
        self.slot_entry = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.first, self.counts, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for unknown ones."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slot_entry[at]
        rest = np.flatnonzero((out >= 0) & (self.slot_key[at] != keys))
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[rest] = self.slot_entry[at]
            more = (out[rest] >= 0) & (self.slot_key[at] != keys[rest])
            rest, at = rest[more], at[more]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New entries, of keys that differ and are unknown."""
        n = len(self.keys)
        if n + len(keys) > 1 << (self.bits - 1):
            self.bits = int(n + len(keys)).bit_length() + 1
            self.slot_key, self.slot_entry = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._place(self.keys, np.arange(n))
        self._place(keys, n + np.arange(len(keys)))
        ends = np.cumsum(counts)
        self.first = np.concatenate([self.first, len(self.flat) + ends - counts])
        self.flat = np.concatenate([self.flat, ids])
        self.keys, self.counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        self.used = np.concatenate([self.used, np.zeros(len(keys), np.int64)])

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        at, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.slot_entry[at[left]] < 0]
            self.slot_entry[at[free]] = entries[free]
            self.slot_key[at[free]] = keys[free]
            left = left[self.slot_entry[at[left]] != entries[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def get(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries end to end, and how many each has. The table forgets rare entries afterwards if it is full."""
        counts = self.counts[entries]
        ids = self.flat[spread(self.first[entries], counts)]
        self.used += np.bincount(entries, minlength=len(self.keys))
        if len(self.keys) > self.kept:
            keep = np.flatnonzero(self.used > 1)
            keep = keep if len(keep) <= self.kept // 2 else keep[np.argsort(-self.used[keep], kind="stable")[: self.kept // 2]]
            keys, flat, each = self.keys[keep], self.flat[spread(self.first[keep], self.counts[keep])], self.counts[keep]
            self._clear()
            self.add(keys, flat, each)
        return ids, counts


class Encoder:
    """ids(texts) gives the ids of many texts end to end and the number of each."""

    def __init__(self, file: str, drops_space: bool, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        #: How all strings begin that the library takes as one token before anything else. A text with it is one piece.
        self.special = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()]).encode()
        self.drops_space = drops_space
        self.table = Table(kept)

    def _classes(self, raw: np.ndarray) -> np.ndarray:
        classes = _CLASS[raw]
        two = np.flatnonzero(raw[:-1] == 0xC3)
        two = two[(raw[two + 1] != 0x97) & (raw[two + 1] != 0xB7)]  # signs of multiplication and division
        classes[two] = classes[two + 1] = LETTER
        return classes

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts end to end: first byte and end of every piece, and the pieces of each text."""
        n = len(raw)
        self.classes = classes = self._classes(raw)
        before, now = classes[:-1], classes[1:]
        edge = np.zeros(n + 1, bool)
        edge[1:n] = (before ^ now) == (LETTER ^ MARK)  # of these classes only those two differ so, beside space and other
        edge[1:n] &= (before != SPACE) & (now != SPACE)
        from_space = (before == SPACE) != (now == SPACE)
        if self.drops_space:
            edge[1:n] |= from_space
        else:
            to_space = from_space & (now == SPACE)
            # other white space, of two or three bytes, belongs to the space behind it
            odd = np.flatnonzero(to_space & (raw[:-1] >= 0x80)) + 1
            two, three = raw[odd - 2], raw[np.maximum(odd - 3, 0)]
            to_space[odd[(two == 0xC2) | ((two < 0xC0) & (three >= 0xE1) & (three <= 0xE3))] - 1] = False
            edge[1:n] |= to_space
        edge[at[at < n]] = True
        body = raw.tobytes() if self.special else b""
        whole = []
        k = body.find(self.special) if self.special else -1
        while k >= 0:
            text = int(np.searchsorted(at, k, side="right")) - 1
            whole.append(text)
            edge[at[text] + 1 : at[text + 1]] = False
            k = body.find(self.special, at[text + 1])
        starts = np.flatnonzero(edge[:n])
        ends = np.append(starts[1:], n)
        if self.drops_space:
            keep = classes[starts] != SPACE
            keep |= np.isin(starts, at[whole])
            starts, ends = starts[keep], ends[keep]
        return starts, ends, at[whole]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end and how many each has. Letters below U+0100 (in lower case, or behind a space) go
        straight to the library's model, as neither the normaliser nor the pre-tokenizer changes more than their
        spelling of bytes."""
        ids: list[list[int]] = [[]] * len(pieces)
        slow, tokenize = [], self.model.tokenize
        for i, piece in enumerate(pieces):
            stem = piece if self.drops_space or piece[:1] != b" " else piece[1:]
            if stem.isalpha():
                spelt = stem.decode() if len(stem) == len(piece) else "Ġ" + stem.decode()
            elif stem.translate(None, _LETTERS) or not (text := stem.decode()).isalpha() or (self.drops_space and text != text.lower()):
                slow.append(i)
                continue
            else:
                spelt = piece.decode("latin-1").translate(_SPELT)
            ids[i] = [t.id for t in tokenize(spelt)]
        for a in range(0, len(slow), 20_000):
            part = slow[a : a + 20_000]
            e = self.tokenizer.encode([pieces[i].decode() for i in part], is_pretokenized=True, add_special_tokens=False)
            found, of = e.ids, np.array(e.word_ids, np.int64)
            cuts = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
            for i, x, y in zip(part, cuts[:-1], cuts[1:], strict=True):
                ids[i] = found[x:y]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.array(list(chain.from_iterable(ids)), np.uint32), counts

    def ids(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        raw, at = common.utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        starts, ends, whole = self._pieces(raw, at)
        same = raw
        if self.drops_space:
            # such a tokenizer doesn't tell ASCII capitals, but for special tokens, and where a capital may be composed
            # with what follows and then has another lower case
            same = _LOWER[raw]
            odd = np.concatenate(([0], np.cumsum((raw >= 0x80) & (self.classes == OTHER), dtype=np.int32)))
            told = (odd[ends] > odd[starts]) | np.isin(starts, whole)
            place = spread(starts[told], ends[told] - starts[told])
            same[place] = raw[place]
        keys = np.maximum(prefix_hashes(same)(starts, ends), np.uint64(1))
        entries = self.table.find(keys)
        unknown = np.flatnonzero(entries < 0)
        if len(unknown):
            new, first = np.unique(keys[unknown], return_index=True)
            body, first = same.tobytes(), unknown[first]
            self.table.add(new, *self._learn([body[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            entries[unknown] = self.table.find(keys[unknown])
        ids, each = self.table.get(entries)
        total = np.concatenate(([0], np.cumsum(each)))
        edges = total[np.searchsorted(starts, at)]
        return ids, np.diff(edges)


@cache
def encoder(file: str, drops_space: bool) -> Encoder:
    """One for all tasks of a worker, so that a piece is encoded once."""
    return Encoder(file, drops_space)
