"""Matching as column expressions: whether a text has a hit, and where.

Patterns that Java's backtracking engine takes in linear time stay in the JVM. Texts of more than LONG characters, for
patterns that may take polynomial time, and all texts for patterns that may take more go through Arrow batches and the
engine of linear.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import linear
from tessera.functions.patterns import Pattern
from tessera.model import SUBMATCHES

#: A cell of a workbook has no more characters.
LONG = 32_767
_KIND = pa.list_(pa.struct([("match", pa.struct([("text", pa.string())])), ("start", pa.int32()), ("end", pa.int32())]))


def _trusted(text: Column, pattern: Pattern, java: Callable[[Column], Column], kind: str, found: Callable[[linear.Engine, str], object], arrow: pa.DataType) -> Column:
    """java(text) where Java's engine can be trusted with the pattern, and what found() gives elsewhere."""
    if pattern.trust == "linear":
        return java(text)
    spelt = pattern.java

    @F.arrow_udf(kind)
    def engine(texts: pa.Array) -> pa.Array:
        known = linear.engine(spelt)
        return pa.array([None if t is None else found(known, t) for t in texts.to_pylist()], arrow)

    if pattern.trust == "none":
        return engine(text)
    long = F.length(text) > LONG
    return F.when(long, engine(F.when(long, text))).otherwise(java(text))


def has_hit(text: Column, pattern: Pattern) -> Column:
    if pattern.literal:
        return text.contains(pattern.literal)
    return _trusted(text, pattern, lambda t: t.rlike(pattern.java), "boolean", lambda e, t: e.search(t), pa.bool_())


def _as_submatches(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    return [{"match": {"text": text[a:b]}, "start": a, "end": b} for a, b in spans]


def submatches(text: Column, pattern: Pattern) -> Column:
    """Matches with character offsets, by one pass over the pieces between and in matches.

    For patterns that match no empty string; with_submatches() takes any."""

    def java(text: Column) -> Column:
        pairs = F.arrays_zip(F.split(text, pattern.java, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0)).alias("hit"))

        def on(state: Column, pair: Column) -> Column:
            gap, hit = pair["gap"], pair["hit"]
            start = state["at"] + F.length(gap)
            end = start + F.length(hit)
            one = F.struct(F.struct(hit.alias("text")).alias("match"), start.alias("start"), end.alias("end"))
            return F.when(hit.isNull(), F.struct(start.alias("at"), state["out"].alias("out"))).otherwise(F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).cast(SUBMATCHES).alias("out")))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SUBMATCHES).alias("out")), on, lambda s: s["out"])

    return _trusted(text, pattern, java, SUBMATCHES, lambda e, t: _as_submatches(t, e.find_all(t)), _KIND)


def spans_finder(pattern: Pattern) -> Callable[[str], list[tuple[int, int]]]:
    """A function of a text that gives the places of its matches, in Python: by the regex module where it can be trusted.
    An empty match right behind another one doesn't count."""
    spelt, java, trust = pattern.for_regex_module(), pattern.java, pattern.trust

    def plain(compiled, text: str) -> list[tuple[int, int]]:
        out, last = [], -1
        for m in compiled.finditer(text):
            if m.end() > m.start() or m.start() != last:
                out.append(m.span())
            last = m.end()
        return out

    if trust == "none" or pattern.may_be_empty:  # the regex module goes on after empty matches in a way of its own
        return linear.engine(java).find_all
    import regex

    compiled = regex.compile(spelt)
    if trust == "linear":
        return lambda t: plain(compiled, t)
    return lambda t: plain(compiled, t) if len(t) <= LONG else linear.engine(java).find_all(t)


def hit_finder(pattern: Pattern) -> Callable[[str], bool]:
    """A function of a text that tells whether it has a hit, in Python."""
    if pattern.literal:
        literal = pattern.literal
        return lambda t: literal in t
    if pattern.trust == "none":
        return linear.engine(pattern.java).search
    import regex

    search = regex.compile(pattern.for_regex_module()).search
    if pattern.trust == "linear":
        return lambda t: search(t) is not None
    return lambda t: search(t) is not None if len(t) <= LONG else linear.engine(pattern.java).search(t)


def with_submatches(df: DataFrame, pattern: Pattern, text: str = "text") -> DataFrame:
    """df with submatches of its text column. Patterns that can match an empty string go through Arrow batches."""
    if not pattern.may_be_empty:
        return df.withColumn("submatches", submatches(F.col(text), pattern))
    at = df.columns.index(text)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = spans_finder(pattern)
        for batch in batches:
            rows = [_as_submatches(t or "", spans(t or "")) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _KIND)], names=[*batch.schema.names, "submatches"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(found, f"{schema}, submatches {SUBMATCHES}")


def first_offset(text: Column, pattern: Pattern) -> Column:
    """The place of the first match, counted from 1; 1 without one."""

    def java(t: Column) -> Column:
        hit = t.contains(pattern.literal) if pattern.literal else t.rlike(pattern.java)
        return F.when(hit, F.length(F.element_at(F.split(t, pattern.java, 2), 1)) + 1).otherwise(F.lit(1))

    return _trusted(text, pattern, java, "int", lambda e, t: next((a + 1 for a, _ in e.find_all(t, 1)), 1), pa.int32())
