"""Cell addresses and the text of typed values, as column expressions and for readers."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_A1 = re.compile(r"([^0-9]+)([0-9]+)")


def a1(row: int, col: int) -> str:
    """The address of a row and column counted from 1."""
    letters = ""
    while col:
        col, k = divmod(col - 1, 26)
        letters = chr(65 + k) + letters
    return f"{letters}{row}"


def split_a1(cell: str) -> tuple[int, int] | None:
    """Row and column of an address such as AA17 (signs for absolute ones are dropped); None if it isn't one."""
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?([0-9]+)", cell)
    if not m or int(m[2]) == 0:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def row_of(cell: str) -> int | None:
    """The row of an address: letters and then a number above 0."""
    m = _A1.fullmatch(cell)
    return int(m[2]) if m and int(m[2]) else None


def a1_column(row: Column, col: Column) -> Column:
    """a1() for columns up to 18,278 (three letters)."""
    letter = lambda n: F.char((F.lit(65) + n).cast("long"))
    c = col - 1
    two, three = c - 26, c - 702
    letters = (
        F.when(c < 26, letter(c))
        .when(c < 702, F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.pmod(F.floor(three / 26), F.lit(26))), letter(F.pmod(three, F.lit(26)))))
    )
    return F.concat(letters, row.cast("string"))


def row_column(cell: Column) -> Column:
    """row_of() as an expression."""
    n = F.regexp_extract(cell, "^[^0-9]+([0-9]+)$", 1)
    return F.when(n.rlike("[1-9]"), n.cast("long"))


def number_text(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        return {True: "NaN"}.get(x != x, "inf" if x > 0 else "-inf")
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    return f"{x:.10f}".rstrip("0").rstrip(".")


def number_column(x: Column) -> Column:
    """Whole numbers below 1e15 without a point; else ten decimals without zeros at the end.

    The decimals are those of the fraction by itself, which has them exactly: Java spells a whole double from the
    shortest digits that tell it from others."""
    size = F.abs(x)
    fraction = F.format_string("%.10f", size - F.floor(size))
    digits = F.concat(F.when(x < 0, "-").otherwise(""), (F.floor(size).cast("long") + F.when(fraction.startswith("1"), 1).otherwise(0)).cast("string"), F.substring(fraction, 2, 11))
    spelt = F.when(size < 1e15, digits).otherwise(F.format_string("%.10f", x))
    spelt = F.regexp_replace(F.regexp_replace(spelt, "0+$", ""), "\\.$", "")
    finite = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(spelt)
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(finite)


def time_text(t: datetime | date) -> str:
    if not isinstance(t, datetime) or (t.hour, t.minute, t.second, t.microsecond) == (0, 0, 0, 0):
        return f"{t.year:04}-{t.month:02}-{t.day:02}"
    return f"{t.year:04}-{t.month:02}-{t.day:02} {t.hour:02}:{t.minute:02}:{t.second:02}"


def time_column(t: Column) -> Column:
    """The date of a midnight; else date and time, without parts of a second."""
    return F.when(t == F.date_trunc("day", t), F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))


def value_column(x: Column, kind: str) -> Column:
    """The text of a value of the given Spark type."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        return number_column(x.cast("double"))
    if kind.startswith("timestamp"):
        return time_column(x)
    if kind == "date":
        return F.date_format(x, "yyyy-MM-dd")
    return x.cast("string")
