"""Cells of a worksheet as columns, by numpy over the bytes of its XML.

Only the plain forms of sheetData are read here: the tags row, c, v, f, is and t, in an order that the grammar below
allows. Anything else (comments, shared formulas, runs of rich text inside cells, ...) gives None, and the sheet is left
to an XML parser.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions.cells import number_text

#: Tags, by their first bytes: cell, end of cell, value, formula, inline string, text, row; EMPTY_ are closed at once.
CELL, CELL_END, V, V_END, F, F_END, IS, IS_END, T, T_END, ROW, ROW_END, EMPTY_CELL, EMPTY_ROW, BAD = range(1, 16)
_ENDS = {b"/c>": CELL_END, b"/v>": V_END, b"/f>": F_END, b"/is>": IS_END, b"/t>": T_END, b"/row>": ROW_END}
_ALLOWED = {
    0: (ROW, EMPTY_ROW), ROW: (CELL, EMPTY_CELL, ROW_END), EMPTY_ROW: (ROW, EMPTY_ROW), ROW_END: (ROW, EMPTY_ROW), EMPTY_CELL: (CELL, EMPTY_CELL, ROW_END), CELL_END: (CELL, EMPTY_CELL, ROW_END),
    CELL: (CELL_END, V, F, IS), V: (V_END,), V_END: (CELL_END,), F: (F_END,), F_END: (CELL_END, V), IS: (IS_END, T), T: (T_END,), T_END: (IS_END,), IS_END: (CELL_END,),
}
_NEXT = np.zeros((16, 16), bool)
for _a, _b in _ALLOWED.items():
    _NEXT[_a, list(_b)] = True
_ATTRIBUTES = re.compile(rb'(?: s="(\d+)"| t="([a-zA-Z]+)"| cm="\d+"| vm="\d+"| ph="[01]")*\s*')
#: Numbers that stand as they are shown: no zeros at the ends, ten decimals and fifteen digits at most.
_AS_SHOWN = r"^-?(0|[1-9][0-9]*)(\.[0-9]{0,9}[1-9])?$"
#: Kinds of cells.
NUMBER, SHARED, STRING, INLINE, BOOLEAN, ERROR = range(6)
_KINDS = {b"n": NUMBER, b"s": SHARED, b"str": STRING, b"inlineStr": INLINE, b"b": BOOLEAN, b"e": ERROR, b"d": STRING}


@dataclass
class Columns:
    """The cells of a sheet, in the order of the file: where things are in raw. A cell without a text has length 0."""

    raw: np.ndarray
    #: First byte and end of the address, of the value, of the formula (0, 0 without one).
    cell: tuple[np.ndarray, np.ndarray]
    value: tuple[np.ndarray, np.ndarray]
    formula: tuple[np.ndarray, np.ndarray]
    has_formula: np.ndarray
    kind: np.ndarray
    style: np.ndarray
    row: np.ndarray
    col: np.ndarray
    hidden_row: np.ndarray
    hidden_col: np.ndarray

    def __len__(self) -> int:
        return len(self.kind)

    def take(self, rows: np.ndarray) -> Columns:
        two = lambda x: (x[0][rows], x[1][rows])
        return Columns(self.raw, two(self.cell), two(self.value), two(self.formula), *(x[rows] for x in (self.has_formula, self.kind, self.style, self.row, self.col, self.hidden_row, self.hidden_col)))

    def shared(self) -> np.ndarray:
        """The numbers of shared strings; -1 for other cells and what is no number."""
        out = np.full(len(self), -1, np.int64)
        some = np.flatnonzero(self.kind == SHARED)
        out[some] = integers(self.raw, self.value[0][some], self.value[1][some])
        return out


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings at the given places."""
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)))
    data = raw[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    made = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    return made.cast(pa.large_string()).cast(pa.string())


def integers(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of up to nine digits at the given places, -1 for anything else."""
    size = end - start
    out, bad = np.zeros(len(start), np.int64), (size < 1) | (size > 9)
    for k in range(int(min(9, size.max())) if len(size) else 0):
        there = size > k
        digit = raw[np.where(there, start + k, 0)].astype(np.int64) - 48
        bad |= there & ((digit < 0) | (digit > 9))
        out = np.where(there, out * 10 + digit, out)
    out[bad] = -1
    return out


def _tags(raw: np.ndarray, at: np.ndarray, gt: np.ndarray) -> np.ndarray | None:
    """The kinds of the tags at `at`, which end at `gt`."""
    one, two, three = raw[at + 1], raw[at + 2], raw[at + 3]
    kind = np.full(len(at), BAD, np.uint8)
    empty = raw[gt - 1] == 47
    is_end = one == 47
    long = gt - at
    kind[(one == 99) & (two == 32)] = CELL
    kind[(one == 99) & (two == 32) & empty] = EMPTY_CELL
    row = (one == 114) & (two == 111) & (three == 119) & (raw[np.minimum(at + 4, gt)] != 47)
    kind[row] = ROW
    kind[row & empty] = EMPTY_ROW
    for letter, code in ((118, V), (102, F)):
        kind[(one == letter) & (long == 2)] = code
    kind[(one == 105) & (two == 115) & (long == 3)] = IS
    kind[(one == 116) & ((long == 2) | ((two == 32) & ~empty))] = T
    kind[is_end & (long == 3) & (two == 99)] = CELL_END
    kind[is_end & (long == 3) & (two == 118)] = V_END
    kind[is_end & (long == 3) & (two == 102)] = F_END
    kind[is_end & (long == 3) & (two == 116)] = T_END
    kind[is_end & (long == 4) & (two == 105) & (three == 115)] = IS_END
    kind[is_end & (long == 5) & (two == 114) & (three == 111)] = ROW_END
    if (kind == BAD).any():
        return None
    return kind


def columns(xml: bytes) -> Columns | None:
    """The cells of a worksheet part, or None if it isn't plain."""
    open_, close = xml.find(b"<sheetData>"), xml.rfind(b"</sheetData>")
    if open_ < 0 or close < 0 or xml[:2] in (b"\xff\xfe", b"\xfe\xff") or b"<!" in xml[:1000] or (b"encoding" in xml[:100] and b"utf-8" not in xml[:100].lower()):
        return None
    head, tail = xml[:open_], xml[close:].removeprefix(b"</sheetData>")
    try:
        away = [(int(e.get("min", 0)), int(e.get("max", 0))) for e in ET.fromstring(head.removeprefix(b"\xef\xbb\xbf") + tail).iter() if e.tag.rpartition("}")[2] == "col" and e.get("hidden") in ("1", "true", "on")]
    except ET.ParseError:
        return None
    raw = np.frombuffer(xml, np.uint8)[open_ + 11 : close]
    at, gts = np.flatnonzero(raw == 60), np.flatnonzero(raw == 62)
    if not len(at):
        return _nothing(raw)
    if len(at) != len(gts) or (gts < at).any() or (at[1:] < gts[:-1]).any() or at[-1] + 5 >= len(raw):
        return None
    kind = _tags(raw, at, gts)
    if kind is None or not _NEXT[np.concatenate(([0], kind[:-1])), kind].all() or kind[-1] not in (ROW_END, EMPTY_ROW):
        return None
    opens = np.flatnonzero((kind == CELL) | (kind == EMPTY_CELL))
    if not len(opens):
        return _nothing(raw)
    begin, stop = at[opens], gts[opens] - (kind[opens] == EMPTY_CELL)
    # <c r="AB12" and then other attributes
    first = begin + 6
    if (stop - begin < 9).any() or not ((raw[begin + 3] == 114) & (raw[begin + 4] == 61) & (raw[begin + 5] == 34)).all():
        return None
    quotes = np.flatnonzero(raw == 34)
    last = quotes[np.searchsorted(quotes, first)]
    letters, col = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for k in range(3):
        c = raw[first + k].astype(np.int64)
        more = (letters == k) & (c >= 65) & (c <= 90) & (first + k < last)
        letters += more
        col = np.where(more, col * 26 + c - 64, col)
    row = integers(raw, first + letters, last)
    if (letters == 0).any() or (row < 1).any() or (raw[first + letters] == 48).any() or (last >= stop).any():
        return None
    kinds, styles = _attributes(raw, last + 1, stop)
    if kinds is None:
        return None
    value, formula, has_formula = _parts(at, gts, kind, opens)
    has_inline = np.zeros(len(opens), bool)
    has_inline[np.searchsorted(opens, np.flatnonzero(kind == IS)) - 1] = True
    if (has_inline != (kinds == INLINE)).any():
        return None
    rows = np.flatnonzero((kind == ROW) | (kind == EMPTY_ROW))
    hidden = np.zeros(len(rows), bool)
    body = raw.tobytes() if b' hidden="' in xml else b""
    for m in re.finditer(rb' hidden="(?:1|true|on)"', body):
        k = int(np.searchsorted(at[rows], m.start(), side="right")) - 1
        if k >= 0 and m.start() < gts[rows[k]]:
            hidden[k] = True
    hidden_col = np.zeros(len(opens), bool)
    for a, b in away:
        hidden_col |= (col >= a) & (col <= b)
    return Columns(raw, (first, last), value, formula, has_formula, kinds, styles, row, col, hidden[np.searchsorted(rows, opens) - 1], hidden_col)


def _nothing(raw: np.ndarray) -> Columns:
    none = np.zeros(0, np.int64)
    return Columns(raw, (none, none), (none, none), (none, none), none.astype(bool), none, none, none, none, none.astype(bool), none.astype(bool))


def _attributes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The kinds and styles (-1 without one) of cells from what stands behind their addresses."""
    size = end - start
    kinds, styles = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
    shared = np.flatnonzero(size == 6)
    for k, c in enumerate(b' t="s"'):
        shared = shared[raw[start[shared] + k] == c]
    kinds[shared] = SHARED
    rest = np.ones(len(start), bool)
    rest[shared] = False
    rest &= size > 0
    some = np.flatnonzero(rest)
    if len(some):
        if size[some].max() > 64:
            return None, styles
        wide = np.zeros((len(some), 64), np.uint8)
        inside = np.arange(64) < size[some][:, None]
        wide[inside] = raw[(start[some][:, None] + np.arange(64))[inside]]
        found, of = np.unique(wide.view("S64").ravel(), return_inverse=True)
        for k, text in enumerate(found.tolist()):
            m = _ATTRIBUTES.fullmatch(text)
            kind = _KINDS.get(m[2] or b"n") if m else None
            if kind is None:
                return None, styles
            kinds[some[of == k]] = kind
            if m[1]:
                styles[some[of == k]] = int(m[1])
    return kinds, styles


def _parts(at: np.ndarray, gts: np.ndarray, kind: np.ndarray, opens: np.ndarray) -> tuple:
    """Of every cell where its value (or inline text) and its formula are, and whether it has one."""
    n = len(opens)
    value, formula, has = (np.zeros(n, np.int64), np.zeros(n, np.int64)), (np.zeros(n, np.int64), np.zeros(n, np.int64)), np.zeros(n, bool)
    for codes, out in (((V, T), value), ((F,), formula)):
        tags = np.flatnonzero(np.isin(kind, codes))
        cell = np.searchsorted(opens, tags) - 1
        out[0][cell], out[1][cell] = gts[tags] + 1, at[np.minimum(tags + 1, len(at) - 1)]
        if codes == (F,):
            has[cell] = True
    return value, formula, has


def number_texts(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts of numbers; most stand in the file as they are shown."""
    texts = spans(raw, start, end)
    as_shown = np.asarray(pc.match_substring_regex(texts, _AS_SHOWN)) & (np.asarray(pc.binary_length(texts)) <= 15) & ~np.asarray(pc.equal(texts, "-0"))
    rest = np.flatnonzero(~as_shown)
    if not len(rest):
        return texts
    spelt = texts.take(pa.array(rest)).to_pylist()
    return pc.replace_with_mask(texts, pa.array(~as_shown), pa.array([number_text(float(x)) if x else "" for x in spelt], pa.string()))
