"""Cells of .xlsx and .xlsm workbooks, by zipfile and an XML parser."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions.cells import a1, number_text, split_a1, time_text
from tessera.model import CACHED, COMMENT, DISPLAY, FORMULA
from tessera.sources import columns

_OLE = bytes.fromhex("d0cf11e0a1b11ae1")
#: Built-in number formats that are dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Texts of error codes.
_ERRORS = {"#DIV/0!": "#Div0", "#N/A": "#NA", "#NAME?": "#Name", "#NULL!": "#Null", "#NUM!": "#Num", "#REF!": "#Ref", "#VALUE!": "#Value", "#GETTING_DATA": "#GettingData"}


#: What numbers, dates and times are spelt with.
NUMERALS = frozenset("0123456789.-+ :infNaTZ")
#: Rows of an Arrow batch; comments come after the cells of all sheets.
BATCH, COMMENTS = 65_536, 1 << 58
_STRING = re.compile(rb'<si><t(?: xml:space="preserve")?>([^<]*)</t></si>')


class Encrypted(ValueError):
    pass


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ET.Element, name: str) -> str | None:
    """An attribute whatever its namespace."""
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _true(x: str | None) -> bool:
    return x in ("1", "true", "on")


def _plain_text(x: bytes) -> str:
    """Character data as a parser gives it."""
    if b"&" not in x and b"\r" not in x:
        return x.decode()
    return ET.fromstring(b"<t>" + x + b"</t>").text or ""


def _unescaped(x: bytes) -> str:
    """The same for text of cells, in which _xHHHH_ stands for a character."""
    t = _plain_text(x)
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), t) if "_x" in t else t


def _texts(e: ET.Element) -> str:
    """The text runs below an element, without phonetic ones."""
    out = []

    def walk(x: ET.Element) -> None:
        for child in x:
            kind = _local(child.tag)
            if kind == "t":
                out.append(child.text or "")
            elif kind != "rPh":
                walk(child)

    walk(e)
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(out))


class Workbook:
    def __init__(self, file):
        head = file.read(8)
        file.seek(0)
        if head == _OLE:
            raise Encrypted("the workbook is encrypted")
        self.zip = zipfile.ZipFile(file)
        self.names = {n.lower(): n for n in self.zip.namelist()}
        if "encryptedpackage" in self.names:
            raise Encrypted("the workbook is encrypted")
        book = self.xml("xl/workbook.xml")
        if book is None:
            raise ValueError("no xl/workbook.xml")
        targets = self.relations("xl/workbook.xml")
        self.epoch_1904, self.sheets = False, []
        for e in book.iter():
            if _local(e.tag) == "workbookPr":
                self.epoch_1904 = _true(_attribute(e, "date1904"))
            elif _local(e.tag) == "sheet":
                target = targets.get(e.get(next((k for k in e.attrib if k.endswith("}id")), "id"), ""))
                self.sheets.append((e.get("name", ""), target[0] if target else None, e.get("state", "visible") not in ("visible", "")))
        self._strings: list[str] | None = None
        self._dates: list[bool] | None = None

    def open(self, name: str):
        found = self.names.get(name.lower())
        return self.zip.open(found) if found else None

    def xml(self, name: str) -> ET.Element | None:
        stream = self.open(name)
        if stream is None:
            return None
        with stream:
            return ET.parse(stream).getroot()

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Identifier -> (part, type) of a part's relations; absolute targets begin at the root."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for e in root if root is not None else ():
            if e.get("TargetMode") != "External":
                target = e.get("Target", "")
                out[e.get("Id", "")] = (target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)), e.get("Type", ""))
        return out

    @property
    def strings(self) -> list[str]:
        if self._strings is None:
            stream = self.open("xl/sharedStrings.xml")
            raw = b""
            if stream is not None:
                with stream:
                    raw = stream.read()
            self._strings = _plain_strings(raw) if raw else []
            if self._strings is None:
                self._strings = []
                for _, e in ET.iterparse(io.BytesIO(raw)):
                    if _local(e.tag) == "si":
                        self._strings.append(_texts(e))
                        e.clear()
        return self._strings

    @property
    def dates(self) -> list[bool]:
        """Whether each cell style is a date or time."""
        if self._dates is None:
            self._dates = []
            root = self.xml("xl/styles.xml")
            own, styles = {}, None
            for e in root.iter() if root is not None else ():
                if _local(e.tag) == "numFmt":
                    own[e.get("numFmtId")] = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', "", e.get("formatCode", "").lower())
                elif _local(e.tag) == "cellXfs":
                    styles = e
            for xf in styles if styles is not None else ():
                number = xf.get("numFmtId", "0")
                self._dates.append(bool(re.search("[ymdhs]", own[number])) if number in own else number.isdigit() and int(number) in _DATE_FORMATS)
        return self._dates

    def time(self, serial: float) -> str:
        try:
            if not self.epoch_1904:
                serial -= serial < 60  # there was no 29 February 1900
            days = serial + 1462 if self.epoch_1904 else serial
            moment = datetime(1899, 12, 30) + timedelta(milliseconds=round((days + (0 if self.epoch_1904 else (serial < 59) * 2)) * 86_400_000))
            return time_text(moment.replace(microsecond=0))
        except (OverflowError, ValueError):
            return number_text(serial)

    def value(self, kind: str, style: str | None, v: str | None, inline: ET.Element | None) -> str:
        if kind == "inlineStr":
            return _texts(inline) if inline is not None else ""
        if v is None:
            return ""
        if kind == "s":
            return self.strings[int(v)]
        if kind == "b":
            return "true" if _true(v.strip()) else "false"
        if kind == "e":
            return _ERRORS.get(v, f"#{v.strip('#!?')}")
        if kind in ("str", "d"):
            return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), v)
        x = float(v)
        s = int(style) if style and style.isdigit() else -1
        return self.time(x) if 0 <= s < len(self.dates) and self.dates[s] else number_text(x)

    def part(self, name: str) -> bytes:
        stream = self.open(name)
        if stream is None:
            return b""
        with stream:
            return stream.read()

    def parsed_sheet(self, raw: bytes) -> Iterator[tuple[int, int, str, str, bool, bool]]:
        """(row, col, layer, text, hidden row, hidden column) in the order of the file; a formula comes before its value."""
        hidden_columns: list[tuple[int, int]] = []
        row, col, hidden = 0, 0, False
        shared: dict[str, str] = {}
        with io.BytesIO(raw) as stream:
            for event, e in ET.iterparse(stream, ("start", "end")):
                name = _local(e.tag)
                if event == "start":
                    if name == "row":
                        row, col, hidden = int(e.get("r") or row + 1), 0, _true(e.get("hidden"))
                elif name == "col":
                    if _true(e.get("hidden")):
                        hidden_columns.append((int(e.get("min", 0)), int(e.get("max", 0))))
                elif name == "c":
                    at = split_a1(e.get("r") or "")
                    col = at[1] if at else col + 1
                    line = at[0] if at else row
                    formula = v = inline = None
                    for child in e:
                        kind = _local(child.tag)
                        if kind == "v":
                            v = child.text or ""
                        elif kind == "is":
                            inline = child
                        elif kind == "f":
                            formula = child.text or ""
                            if child.get("t") == "shared":
                                formula = shared.setdefault(child.get("si", ""), formula) or formula
                    text = self.value(e.get("t", "n"), e.get("s"), v, inline)
                    if text:
                        away = any(a <= col <= b for a, b in hidden_columns)
                        if formula is None:
                            yield line, col, DISPLAY, text, hidden, away
                        else:
                            if formula:
                                yield line, col, FORMULA, formula, hidden, away
                            yield line, col, CACHED, text, hidden, away
                    e.clear()
                elif name == "row":
                    e.clear()

    def comments(self, part: str) -> list[tuple[str, str]]:
        """(address, text) of a sheet's notes; none if they can't be read."""
        try:
            target = next((t for t, _ in self.relations(part).values() if "comments" in t.lower() and "threaded" not in t.lower()), None)
            root = self.xml(target) if target else None
            found = [(e.get("ref", ""), _texts(e)) for e in (root.iter() if root is not None else ()) if _local(e.tag) == "comment"]
            return [(ref, text) for ref, text in found if text]
        except (ET.ParseError, KeyError, zipfile.BadZipFile):
            return []


def _plain_strings(raw: bytes) -> list[str] | None:
    """The shared strings of a part that has nothing but plain ones; else None."""
    begin, end = raw.find(b"<si>"), raw.rfind(b"</sst>")
    if b"encoding" in raw[:100] and b"utf-8" not in raw[:100].lower() or begin < 0 or end < 0:
        return None
    found = _STRING.findall(raw, begin, end)
    if len(found) != raw.count(b"<si") - raw.count(b"<si/") or raw.count(b"<", begin, end) != 4 * len(found) or raw.count(b">", begin, end) != 4 * len(found) + sum(x.count(b">") for x in found):
        return None
    body = b"\x00".join(found)
    if b"&" in body or b"\r" in body or b"_x" in body:
        return [_unescaped(x) for x in found]
    return body.decode().split("\x00") if found else []


class Screen:
    """What a search looks for in a workbook: found(text) tells of a hit, numerals whether a number or date may be one.
    With whole, every cell of a sheet with a hit is wanted."""

    def __init__(self, found: Callable[[str], bool], numerals: bool, whole: bool = False):
        self.found, self.numerals, self.whole = found, numerals, whole


class Reader:
    """Cells of a workbook as Arrow batches of (sheet, sheet_idx, row, col, cell, layer, text, seq, hidden_sheet, hidden_row,
    hidden_col). A sheet gives all its batches or fails."""

    def __init__(self, file, wanted_sheet=None, layers=frozenset({DISPLAY, CACHED, COMMENT}), hidden: bool = True, screen: Screen | None = None):
        self.book, self.layers, self.hidden, self.screen = Workbook(file), layers, hidden, screen
        self.sheets = [(i, *s) for i, s in enumerate(self.book.sheets) if s[1] and (wanted_sheet is None or wanted_sheet(s[0])) and (hidden or not s[2])]
        self._string_hits: np.ndarray | None = None

    def strings(self) -> pa.Array:
        if not hasattr(self, "_string_array"):
            self._string_array = pa.array(self.book.strings, pa.string())
        return self._string_array

    def string_hits(self) -> np.ndarray:
        if self._string_hits is None:
            found = self.screen.found
            self._string_hits = np.fromiter((bool(t) and found(t) for t in self.book.strings), bool, len(self.book.strings))
        return self._string_hits

    def batches(self) -> Iterator[pa.RecordBatch]:
        for sheet in self.sheets:
            yield from self.sheet(*sheet)

    def sheet(self, i: int, name: str, part: str, away: bool) -> list[pa.RecordBatch]:
        """All batches of a sheet, its comments too. With a screen, the cells with a hit, or one row without a text for a sheet
        that has cells but no hit."""
        raw = self.book.part(part)
        comments = self.book.comments(part) if COMMENT in self.layers else []
        if self.screen and not any(self.screen.found(t) for _, t in comments) and self._no_hit(raw):
            return [self._mark(i, name, away)] if comments or re.search(rb"<v>[^<]", raw) else []
        plain = columns.columns(raw)
        out, count, hit = self._columns(plain, i, name, away) if plain is not None else self._parsed(raw, i, name, away)
        if comments:
            wanted = [(k, ref, t) for k, (ref, t) in enumerate(comments) if not self.screen or self.screen.whole or self.screen.found(t)]
            count, hit = count + len(comments), hit or any(self.screen.found(t) for _, _, t in wanted) if self.screen else True
            if wanted:
                place = [split_a1(ref) or (None, None) for _, ref, _ in wanted]
                out.append(self._batch(i, name, away, [p[0] for p in place], [p[1] for p in place], [r for _, r, _ in wanted], COMMENT, [t for *_, t in wanted], [COMMENTS + (i << 32) + k for k, *_ in wanted], False, False))
        if self.screen and not hit:
            return [self._mark(i, name, away)] if count else []
        return out

    def _no_hit(self, raw: bytes) -> bool:
        """Whether it is plain that no cell of a sheet has a hit: no shared string has, numbers can't, and there is nothing else."""
        if self.screen.numerals or b"encoding" in raw[:100] and b"utf-8" not in raw[:100].lower() or raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return False
        if b"str" in raw or b"Str" in raw or (FORMULA in self.layers and b"<f" in raw) or re.search(rb"\st\s*=\s*['\"][be]['\"]", raw):
            return False
        return not self.string_hits().any() and all(self.book.strings)

    def _columns(self, c: columns.Columns, i: int, name: str, away: bool) -> tuple[list[pa.RecordBatch], int, bool]:
        """Batches, the number of cells (of parts of them, if there is no need to know more than whether there are any) and
        whether one has a hit."""
        size = c.value[1] - c.value[0]
        numbers = np.arange(len(c))
        keep = size > 0
        ids = c.shared()
        if (ids[c.kind == columns.SHARED] >= len(self.book.strings)).any() or (ids[(c.kind == columns.SHARED) & keep] < 0).any():
            raise ValueError("a shared string that isn't there")
        if not self.hidden:
            keep &= ~(c.hidden_row | c.hidden_col)
        value = keep & np.where(c.has_formula, CACHED in self.layers, DISPLAY in self.layers)
        formula = keep & c.has_formula & (FORMULA in self.layers) & (c.formula[1] > c.formula[0])
        shared = c.kind == columns.SHARED
        if shared.any() and not all(self.book.strings):
            full = np.append(np.asarray(pc.binary_length(self.strings())) > 0, False)[ids]
            value &= ~shared | full
            formula &= ~shared | full
        count = int(value.sum() + formula.sum())
        hit = False
        if self.screen:
            if shared.any():
                hit_ids = np.append(self.string_hits(), False)[ids]
                may = value & (~shared | hit_ids)
            else:
                may = value.copy()
            if not self.screen.numerals:
                may &= c.kind != columns.NUMBER
            rows = np.flatnonzero(may)
            found = shared[rows].copy()
            rest = np.flatnonzero(~found)
            if len(rest):
                found[rest] = [bool(t) and self.screen.found(t) for t in self._texts(c.take(rows[rest]), ids[rows[rest]]).to_pylist()]
            hits = np.zeros(len(c), bool)
            hits[rows[found]] = True
            rows = np.flatnonzero(formula)
            formula_hits = np.zeros(len(c), bool)
            if len(rows):
                formula_hits[rows] = [self.screen.found(t) for t in self._formulas(c.take(rows)).to_pylist()]
            hit = bool(hits.any() or formula_hits.any())
            if not hit or not self.screen.whole:
                value, formula = hits, formula_hits
        # a formula comes before its value
        place = np.concatenate([2 * np.flatnonzero(formula), 2 * np.flatnonzero(value) + 1])
        place.sort()
        out = []
        for a in range(0, len(place), BATCH):
            part = place[a : a + BATCH]
            of, is_value = part >> 1, (part & 1).astype(bool)
            these = c.take(of)
            texts = pa.concat_arrays([self._texts(these.take(np.flatnonzero(is_value)), ids[of[is_value]]), self._formulas(these.take(np.flatnonzero(~is_value)))])
            order = np.empty(len(part), np.int64)
            order[np.concatenate([np.flatnonzero(is_value), np.flatnonzero(~is_value)])] = np.arange(len(part))
            layer = pa.array([DISPLAY, CACHED, FORMULA]).take(pa.array(np.where(is_value, these.has_formula.astype(int), 2)))
            made = self._batch(i, name, away, pa.array(these.row), pa.array(these.col.astype(np.int32)), columns.spans(c.raw, *these.cell), layer, texts.take(pa.array(order)), pa.array((i << 40) + 2 * numbers[of] + is_value), pa.array(these.hidden_row), pa.array(these.hidden_col))
            out.append(made.filter(pc.greater(pc.binary_length(made.column(6)), 0)))
        return out, count, hit

    def _formulas(self, c: columns.Columns) -> pa.Array:
        return self._unescaped(columns.spans(c.raw, *c.formula), False)

    @staticmethod
    def _unescaped(texts: pa.Array, cell: bool) -> pa.Array:
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, "[&\r]|_x" if cell else "[&\r]")))
        if not len(odd):
            return texts
        all_ = texts.to_pylist()
        for k in odd.tolist():
            all_[k] = (_unescaped if cell else _plain_text)(all_[k].encode())
        return pa.array(all_, pa.string())

    def _texts(self, c: columns.Columns, ids: np.ndarray) -> pa.Array:
        """The texts of cells."""
        parts, places = [], []

        def of(mask: np.ndarray, made: Callable[[np.ndarray], pa.Array]) -> None:
            rows = np.flatnonzero(mask)
            if len(rows):
                parts.append(made(rows))
                places.append(rows)

        dates = np.zeros(len(c), bool)
        if (c.style >= 0).any():
            known = np.append(np.array(self.book.dates, bool), False)
            dates = (c.kind == columns.NUMBER) & known[np.where(c.style < len(known) - 1, c.style, -1)] & (c.style >= 0)
        spelt = lambda rows: columns.spans(c.raw, c.value[0][rows], c.value[1][rows])
        of(c.kind == columns.SHARED, lambda rows: self.strings().take(pa.array(ids[rows])))
        of((c.kind == columns.NUMBER) & ~dates, lambda rows: columns.number_texts(c.raw, c.value[0][rows], c.value[1][rows]))
        of(dates, lambda rows: pa.array([self.book.time(float(x)) for x in spelt(rows).to_pylist()], pa.string()))
        of((c.kind == columns.STRING) | (c.kind == columns.INLINE), lambda rows: self._unescaped(spelt(rows), True))
        for kind, name in ((columns.BOOLEAN, "b"), (columns.ERROR, "e")):
            of(c.kind == kind, lambda rows, name=name: pa.array([self.book.value(name, None, x, None) for x in spelt(rows).to_pylist()], pa.string()))
        if not parts:
            return pa.array([], pa.string())
        order = np.empty(len(c), np.int64)
        order[np.concatenate(places)] = np.arange(len(c))
        return pa.concat_arrays(parts).take(pa.array(order)) if len(parts) > 1 else parts[0]

    def _parsed(self, raw: bytes, i: int, name: str, away: bool) -> tuple[list[pa.RecordBatch], int, bool]:
        """_columns() for a sheet that isn't plain, by the XML parser."""
        rows, count, hit = [], 0, False
        for k, (row, col, layer, text, hidden_row, hidden_col) in enumerate(self.book.parsed_sheet(raw) if raw else ()):
            if layer in self.layers and (self.hidden or not (hidden_row or hidden_col)):
                count += 1
                found = self.screen is not None and self.screen.found(text)
                hit |= found
                if found or not self.screen or self.screen.whole:
                    rows.append((row, col, a1(row, col), layer, text, (i << 40) + k, hidden_row, hidden_col))
        out = []
        for a in range(0, len(rows), BATCH):
            row, col, cell, layer, text, seq, hidden_row, hidden_col = zip(*rows[a : a + BATCH], strict=True)
            out.append(self._batch(i, name, away, row, col, cell, layer, text, seq, hidden_row, hidden_col))
        return out, count, hit

    def _mark(self, i: int, name: str, away: bool) -> pa.RecordBatch:
        return self._batch(i, name, away, [None], [None], [None], [None], [None], [None], False, False)

    @staticmethod
    def _batch(i: int, name: str, away: bool, *rest) -> pa.RecordBatch:
        n = len(rest[0])
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        row, col, cell, layer, text, seq, hidden_row, hidden_col = (x if isinstance(x, pa.Array) else pa.repeat(pa.scalar(x, t), n) if isinstance(x, (str, bool)) else pa.array(x, t) for x, t in zip(rest, kinds, strict=True))
        one = [pa.repeat(pa.scalar(name, pa.string()), n), pa.repeat(pa.scalar(i, pa.int32()), n)]
        return pa.RecordBatch.from_arrays([*one, row, col, cell, layer, text, seq, pa.repeat(pa.scalar(away), n), hidden_row, hidden_col], names=["sheet", "sheet_idx", "row", "col", "cell", "layer", "text", "seq", "hidden_sheet", "hidden_row", "hidden_col"])
