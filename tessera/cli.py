"""The command line: python -m tessera.cli PATTERN [PATH ...]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.functions.globs import glob_regex
from tessera.model import DEFAULT_LAYERS, FORMULA, Fatal, ReadOptions, SearchOptions
from tessera.plans.search import ORDER, Search, json_events, pretty_lines
from tessera.sources import delimited
from tessera.sources.files import discover


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Search the cells of spreadsheets and delimited files.")
    p.add_argument("pattern", nargs="?")
    p.add_argument("paths", nargs="*")
    p.add_argument("-e", "--regexp", action="append", default=[], help="a pattern; can be given several times, beside PATTERN")
    case = p.add_argument_group("case")
    case.add_argument("-i", "--ignore-case", action="store_true")
    case.add_argument("-s", "--case-sensitive", action="store_true")
    case.add_argument("-S", "--smart-case", action="store_true", help="the default")
    p.add_argument("-F", "--fixed-strings", action="store_true")
    p.add_argument("-w", "--word-regexp", action="store_true")
    p.add_argument("-v", "--invert-match", action="store_true")
    p.add_argument("-c", "--count", action="store_true")
    p.add_argument("-l", "--files-with-matches", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    p.add_argument("-j", "--threads", type=int, default=0, help="0: as many as CPUs")
    p.add_argument("--glob")
    p.add_argument("--formula", action="store_true")
    p.add_argument("--no-hidden", action="store_true")
    p.add_argument("--no-comments", action="store_true")
    p.add_argument("--sheet")
    p.add_argument("--layers", action="store_true")
    p.add_argument("-E", "--encoding")
    for flag, name in (("-A", "--after-context"), ("-B", "--before-context"), ("-C", "--context")):
        p.add_argument(flag, name, type=int, default=0)
    return p


def options_of(a: argparse.Namespace) -> tuple[SearchOptions, list[str]]:
    patterns = (*a.regexp, *([a.pattern] if a.pattern is not None else []))
    layers = (DEFAULT_LAYERS | ({FORMULA} if a.formula else set())) - ({"comment"} if a.no_comments else set())
    if a.encoding:
        delimited.codec(a.encoding)
    for g in (a.glob, a.sheet):
        if g:
            glob_regex(g)
    read = ReadOptions(a.encoding, frozenset(layers), a.sheet, not a.no_hidden)
    case = "insensitive" if a.ignore_case else "sensitive" if a.case_sensitive else "smart"
    if not 0 <= a.context <= 10_000:
        raise Fatal(f"context {a.context} is out of range (0 to 10000)")
    return SearchOptions(patterns, case, a.fixed_strings, a.word_regexp, a.invert_match, max(a.before_context, a.context), max(a.after_context, a.context), read=read), a.paths or ["."]


def run(argv: list[str], out=None, err=None, spark: SparkSession | None = None) -> int:
    """Exit status: 0 with a match, 1 without, 2 for a request that can't be run."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        a = parser().parse_intermixed_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        options, roots = options_of(a)
        files = discover(roots, a.glob)
        if spark is None:
            spark = SparkSession.builder.master(f"local[{a.threads or '*'}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        search = Search.over_files(spark, files, options)
    except Fatal as e:
        err.write(f"tessera: {e}\n")
        return 2
    if not files:
        return 1
    cells = search.cells.persist()
    search.cells = cells
    try:
        for r in cells.where("error is not null").orderBy("file_seq").toLocalIterator():
            err.write(f"{r.path}: {r.error}\n")
        listed = spark.createDataFrame(list(enumerate(files)), "file_seq long, path string")
        if a.json:
            lines = (r.value for r in json_events(search.events(listed)).orderBy(*ORDER).toLocalIterator())
        elif a.count:
            lines = (f"{r.path}:{r.n}" for r in search.counts().orderBy("file_seq").toLocalIterator())
        elif a.files_with_matches:
            lines = (r.path for r in search.files().orderBy("file_seq").toLocalIterator())
        else:
            colour = a.color == "always" or (a.color == "auto" and out.isatty())
            lines = (r.line for r in pretty_lines(search.events(listed), a.layers, colour).orderBy(*ORDER).toLocalIterator())
        try:
            for line in lines:
                out.write(line + "\n")
        except BrokenPipeError:
            return 0
        return search.exit_code()
    finally:
        cells.unpersist()


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
