"""Cells of delimited text: encodings, records, fields."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa

from tessera.functions.cells import a1
from tessera.model import DISPLAY, Fatal

#: Cells of an Arrow batch.
BATCH = 8_192
#: Labels of the web's encoding standard that Python's codecs don't know or know as another encoding.
_LABELS = {
    "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "x-unicode20utf8": "utf-8", "unicode11utf8": "utf-8", "unicode20utf8": "utf-8", "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "ucs-2": "utf-16-le", "unicode": "utf-16-le", "csunicode": "utf-16-le", "iso-10646-ucs-2": "utf-16-le", "unicodefeff": "utf-16-le",
    "utf-16be": "utf-16-be", "unicodefffe": "utf-16-be", "gbk": "gb18030", "gb2312": "gb18030", "gb_2312": "gb18030", "gb_2312-80": "gb18030", "chinese": "gb18030", "csgb2312": "gb18030", "x-gbk": "gb18030", "iso-ir-58": "gb18030", "csiso58gb231280": "gb18030",
    "latin1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "iso_8859-1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "ansi_x3.4-1968": "cp1252", "windows-1252": "cp1252", "x-cp1252": "cp1252", "cp819": "cp1252", "ibm819": "cp1252", "csisolatin1": "cp1252",
    "shift_jis": "cp932", "sjis": "cp932", "shift-jis": "cp932", "ms_kanji": "cp932", "windows-31j": "cp932", "x-sjis": "cp932", "csshiftjis": "cp932", "ms932": "cp932", "euc-kr": "cp949", "korean": "cp949", "ks_c_5601-1987": "cp949", "windows-949": "cp949", "ksc5601": "cp949", "ksc_5601": "cp949",
    "iso-8859-9": "cp1254", "latin5": "cp1254", "l5": "cp1254", "tis-620": "cp874", "iso-8859-11": "cp874", "dos-874": "cp874", "big5": "big5hkscs", "big5-hkscs": "big5hkscs", "cn-big5": "big5hkscs", "x-x-big5": "big5hkscs", "csbig5": "big5hkscs", "macintosh": "mac-roman", "x-mac-roman": "mac-roman", "mac": "mac-roman",
    "x-mac-cyrillic": "mac-cyrillic", "x-mac-ukrainian": "mac-cyrillic", "koi8-ru": "koi8-u", "logical": "iso-8859-8", "visual": "iso-8859-8", "x-euc-jp": "euc-jp",
}
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def codec(label: str) -> str:
    """Python's codec for an encoding label; Fatal for an unknown one."""
    name = label.strip().lower()
    name = _LABELS.get(name, name)
    try:
        found = codecs.lookup(name)
    except LookupError:
        raise Fatal(f"unknown encoding {label!r}") from None
    if not getattr(found, "_is_text_encoding", True) or name in ("idna", "punycode", "unicode_escape", "raw_unicode_escape", "utf-7", "utf-32", "undefined", "mbcs"):
        raise Fatal(f"unknown encoding {label!r}")
    return name


def _opened(file, label: str | None) -> io.TextIOWrapper:
    """Text of a file by the label given, else by a byte order mark, else UTF-8. Malformed parts become U+FFFD; a mark is
    dropped."""
    head = file.read(4)
    name = codec(label) if label else next((n for mark, n in _MARKS if head.startswith(mark)), "utf-8")
    file.seek(next((len(mark) for mark, n in _MARKS if head.startswith(mark) and n == name), 0))
    return io.TextIOWrapper(file, encoding=name, errors="replace", newline="")


def decoded(raw: bytes, label: str | None) -> str:
    return _opened(io.BytesIO(raw), label).read()


def batches(file, delimiter: str, encoding: str | None, found: Callable[[str], bool] | None = None, whole: bool = False, again: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Batches like workbook.Reader's, as the file is read: rows are records; blank lines are none. With found, the cells
    with a hit, or one row without a text if there are cells but none; with whole, all cells of a file with a hit, which
    again() opens once more."""
    csv.field_size_limit(1 << 30)
    row, n, hit = 0, 0, False
    held: list[tuple] = []
    if found and whole:  # whether there is a hit is to be known first
        if not any(b.column(6).null_count == 0 for b in batches(file, delimiter, encoding, found)):
            found = lambda _: False
        else:
            found = None
        file = again()
    for record in csv.reader(_opened(file, encoding), delimiter=delimiter):
        if not record:
            continue
        row += 1
        for k, text in enumerate(record, 1):
            if text:
                n += 1
                if found is None or found(text):
                    hit = True
                    held.append((row, k, a1(row, k), text, n))
        if len(held) >= BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)
    if found and n and not hit:
        yield _batch([(None,) * 5])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    row, col, cell, text, seq = zip(*rows, strict=True)
    n = len(rows)
    one = lambda x, t: pa.repeat(pa.scalar(x, t), n)
    return pa.RecordBatch.from_arrays(
        [one("", pa.string()), one(0, pa.int32()), pa.array(row, pa.int64()), pa.array(col, pa.int32()), pa.array(cell, pa.string()), one(DISPLAY if cell[0] else None, pa.string()), pa.array(text, pa.string()), pa.array(seq, pa.int64()), *(one(False, pa.bool_()) for _ in range(3))],
        names=["sheet", "sheet_idx", "row", "col", "cell", "layer", "text", "seq", "hidden_sheet", "hidden_row", "hidden_col"],
    )
