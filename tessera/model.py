"""Schemas and options."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

DISPLAY, CACHED, FORMULA, COMMENT = "display", "cached", "formula", "comment"
LAYERS = frozenset({DISPLAY, CACHED, FORMULA, COMMENT})
DEFAULT_LAYERS = frozenset({DISPLAY, CACHED, COMMENT})
MAX_CONTEXT = 10_000

#: One row for each layer of a cell. seq is the reader's order inside a file; error is set on a row that stands for a file that can't be read.
CELLS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("file_seq", T.LongType()), T.StructField("sheet", T.StringType()), T.StructField("sheet_idx", T.IntegerType()),
    T.StructField("row", T.LongType()), T.StructField("col", T.IntegerType()), T.StructField("cell", T.StringType()), T.StructField("layer", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("hidden_sheet", T.BooleanType()), T.StructField("hidden_row", T.BooleanType()), T.StructField("hidden_col", T.BooleanType()),
    T.StructField("error", T.StringType()), T.StructField("error_class", T.StringType()),
])

SUBMATCHES = "array<struct<match: struct<text: string>, start: int, end: int>>"


class Fatal(ValueError):
    """A request that can't be run: exit status 2."""


@dataclass(frozen=True)
class ReadOptions:
    encoding: str | None = None
    layers: frozenset[str] = DEFAULT_LAYERS
    sheet_glob: str | None = None
    include_hidden: bool = True


@dataclass(frozen=True)
class SearchOptions:
    patterns: tuple[str, ...] = ()
    case: str = "smart"  # "smart", "sensitive" or "insensitive"
    fixed: bool = False
    word: bool = False
    invert: bool = False
    before: int = 0
    after: int = 0
    #: With context, every cell of a row with a hit is a match event; counts are of hits unless strict.
    row_promotion: bool = True
    strict: bool = False
    read: ReadOptions = field(default_factory=ReadOptions)

    def __post_init__(self):
        for name, n in (("before", self.before), ("after", self.after)):
            if not 0 <= n <= MAX_CONTEXT:
                raise Fatal(f"{name} context {n} is out of range (0 to {MAX_CONTEXT})")
        if not self.patterns:
            raise Fatal("no pattern")
        if self.case not in ("smart", "sensitive", "insensitive"):
            raise Fatal(f"unknown case mode {self.case!r}")
