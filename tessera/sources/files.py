"""Files as cells: discovery on the driver, and a Python data source that reads them on the executors."""

from __future__ import annotations

import os
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from xml.etree.ElementTree import ParseError

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import linear
from tessera.functions.globs import glob_python
from tessera.functions.matching import hit_finder
from tessera.functions.patterns import Pattern
from tessera.model import CELLS, ReadOptions
from tessera.sources import delimited, store, workbook

EXTENSIONS = {".xlsx": "workbook", ".xlsm": "workbook", ".csv": ",", ".tsv": "\t"}
#: Bytes of files that one task reads at most and, if there are so many, at least; and of a workbook from which its
#: sheets are tasks of their own.
TASK_BYTES, LEAST_BYTES, SPLIT_BYTES = 32 << 20, 256 << 10, 2 << 20


class _Ignore:
    """The rules of one ignore file: patterns relative to its folder, the last that fits decides."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.rules = folder, []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:].removeprefix("\\")
            only_folders = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = re.escape(line.lstrip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace(r"\[", "[").replace(r"\]", "]")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z"), negated, only_folders))

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        relative = os.path.relpath(path, self.folder).replace(os.sep, "/")
        for rule, negated, only_folders in reversed(self.rules):
            if (is_folder or not only_folders) and rule.match(relative):
                return not negated
        return None


@dataclass
class _Level:
    """What a folder says about files below it: .ignore files count always, .gitignore ones only inside a repository."""

    folder: str
    ignore: list[_Ignore]
    git: list[_Ignore]
    exclude: list[_Ignore]
    is_repository: bool


def _rules(folder: str, name: str, base: str | None = None) -> list[_Ignore]:
    try:
        with open(os.path.join(folder, name), errors="replace") as f:
            return [_Ignore(base or folder, f.readlines())]
    except OSError:
        return []


def _level(folder: str) -> _Level:
    return _Level(folder, _rules(folder, ".ignore"), _rules(folder, ".gitignore"), _rules(folder, ".git/info/exclude", folder), os.path.exists(os.path.join(folder, ".git")))


def _ignored(levels: list[_Level], path: str, is_folder: bool) -> bool | None:
    """The verdict of the nearest rule: of .ignore files before .gitignore files before what a repository and its user exclude."""
    said = lambda rules: next((v for r in rules if (v := r.verdict(path, is_folder)) is not None), None)
    found = said(r for x in reversed(levels) for r in x.ignore)
    if found is not None or not any(x.is_repository for x in levels):
        return found
    inside = levels[max(k for k, x in enumerate(levels) if x.is_repository) :]
    for rules in ([r for x in reversed(inside) for r in x.git], inside[0].exclude, _user_rules(inside[0])):
        found = said(rules)
        if found is not None:
            return found
    return None


def _user_rules(repository: _Level) -> list[_Ignore]:
    return _rules(os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git"), "ignore", repository.folder)


def discover(roots: list[str], glob: str | None = None, ignore_rules: bool = True) -> list[str]:
    """Supported files below the roots, in the order of the roots and of names; a file named twice comes twice.

    Below a local root (not a root itself) hidden names are passed over, and what .ignore files exclude; inside a git
    repository also what its .gitignore files (those of folders above a root too), its own exclude file and the user's
    do. Below a URI hidden names are passed over. Unreadable folders and missing roots give nothing. The extension must fit even for a
    root; so must the glob, on the whole path.
    """
    fits = re.compile(glob_python(glob)).match if glob else lambda _: True
    found: list[str] = []

    def wanted(path: str) -> bool:
        return os.path.splitext(path)[1].lower() in EXTENSIONS and bool(fits(path))

    def walk(folder: str, levels: list[_Level]) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        own = [*levels, _level(os.path.abspath(folder))] if ignore_rules else []
        for e in entries:
            is_folder = e.is_dir(follow_symlinks=False)
            if ignore_rules:
                verdict = _ignored(own, os.path.abspath(e.path), is_folder)
                if verdict or (e.name.startswith(".") and verdict is None):
                    continue
            if is_folder:
                walk(e.path, own)
            elif e.is_file() and wanted(e.path):
                found.append(e.path)

    for root in roots or ["."]:
        if store.is_remote(root):
            found += [x for x in store.listed(root) if wanted(x)]
            continue
        root = store.plain(root)
        if os.path.isdir(root):
            above, folder = [], os.path.abspath(root)
            while ignore_rules and folder != os.path.dirname(folder):
                folder = os.path.dirname(folder)
                above.append(_level(folder))
            walk(root, above[::-1])
        elif os.path.isfile(root) and wanted(root):
            found.append(root)
    return found


class Screen:
    """A search that the reader makes itself: of a sheet it gives the cells with a hit (with whole, all cells of a sheet with
    one), or one row without a text if there is none."""

    def __init__(self, pattern: Pattern, whole: bool = False):
        self.pattern, self.whole = pattern, whole

    def numerals(self) -> bool:
        """Whether a number or a date may have a hit."""
        p = self.pattern
        if p.literal:
            return all(c in workbook.NUMERALS for c in p.literal)
        return not linear.needs_other(linear.parsed(p.java), workbook.NUMERALS)

    def of_workbook(self) -> workbook.Screen:
        return workbook.Screen(hit_finder(self.pattern), self.numerals(), self.whole)


def _reader(file, options: ReadOptions, screen: Screen | None) -> workbook.Reader:
    fits = re.compile(glob_python(options.sheet_glob)).match if options.sheet_glob else None
    return workbook.Reader(file, fits, options.layers, options.include_hidden, screen.of_workbook() if screen else None)


def _cells(path: str, options: ReadOptions, screen: Screen | None, sheets: list[int] | None, opened=None) -> Iterator[pa.RecordBatch]:
    kind = EXTENSIONS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError("not a supported file")
    with opened or store.opened(path) as f:
        if kind == "workbook":
            reader = _reader(f, options, screen)
            reader.sheets = [s for s in reader.sheets if sheets is None or s[0] in sheets]
            # a file gives all its cells or fails; a sheet that is a task of its own does by itself
            yield from list(reader.batches())
        else:
            yield from delimited.batches(f, kind, options.encoding, hit_finder(screen.pattern) if screen else None, bool(screen and screen.whole), lambda: store.opened(path))


def file_batches(path: str, file_seq: int, options: ReadOptions, screen: Screen | None = None, sheets: list[int] | None = None, opened=None) -> Iterator[pa.RecordBatch]:
    """Batches of CELLS of one file (opened, if it is), or of sheets of it; a workbook that fails gives one row that says why,
    and no cells."""
    schema = to_arrow_schema(CELLS)

    def whole(batch: pa.RecordBatch | None, **one) -> pa.RecordBatch:
        n = batch.num_rows if batch is not None else 1
        one = {"path": path, "file_seq": file_seq, **one}
        there = batch.schema.names if batch is not None else ()
        return pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in there else pa.repeat(pa.scalar(one.get(f.name), f.type), n) for f in schema], schema=schema)

    try:
        for batch in _cells(path, options, screen, sheets, opened):
            yield whole(batch)
    except (workbook.Encrypted, zipfile.BadZipFile, zlib.error, ParseError, OSError, ValueError, KeyError, IndexError, NotImplementedError, RuntimeError, EOFError) as e:
        kind = "encrypted" if isinstance(e, workbook.Encrypted) else "io" if isinstance(e, OSError) else "parse"
        yield whole(None, error=f"{kind}: {e}", error_class=kind)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, list[int] | None]]):
        super().__init__(files)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.files = json.loads(options["files"])
        read, search = json.loads(options["read"]), json.loads(options["search"])
        self.options = ReadOptions(read["encoding"], frozenset(read["layers"]), read["sheet_glob"], read["include_hidden"])
        self.screen = Screen(Pattern(**search["pattern"]), search["whole"]) if search else None

    def _sheets(self, path: str) -> list[int]:
        try:
            with store.opened(path) as f:
                return [s[0] for s in _reader(f, self.options, None).sheets]
        except Exception:  # the task that reads the file says what is wrong with it
            return []

    def partitions(self) -> list[_Files]:
        """Small files packed in order into as many tasks as there are CPUs, or tasks of TASK_BYTES; sheets of a large workbook
        are tasks of their own, and so are other large files."""
        sizes = [store.size(path) for _, path in self.files]
        most = min(TASK_BYTES, max(LEAST_BYTES, -(-sum(sizes) // (2 * (os.cpu_count() or 1)))))
        out: list[_Files] = []
        room = 0
        for (seq, path), size in zip(self.files, sizes, strict=True):
            if size >= SPLIT_BYTES and EXTENSIONS.get(os.path.splitext(path)[1].lower()) == "workbook" and len(sheets := self._sheets(path)) > 1:
                out += [_Files([(seq, path, [s])]) for s in sheets]
                room = 0
                continue
            if not out or size > room:
                out.append(_Files([]))
                room = most
            out[-1].files.append((seq, path, None))
            room -= size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for seq, path, sheets in partition.files:
            yield from file_batches(path, seq, self.options, self.screen, sheets)


class CellsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self):
        return CELLS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_cells(spark: SparkSession, files: list[str], options: ReadOptions | None = None, screen: Screen | None = None) -> DataFrame:
    """The cells of files, with rows for those that can't be read (error is set). With a screen, those that it gives."""
    import json

    options = options or ReadOptions()
    if options.encoding:
        delimited.codec(options.encoding)
    spark.dataSource.register(CellsSource)
    read = {"encoding": options.encoding, "layers": sorted(options.layers), "sheet_glob": options.sheet_glob, "include_hidden": options.include_hidden}
    search = {"pattern": asdict(screen.pattern), "whole": screen.whole} if screen else None
    return spark.read.format("cells").option("files", json.dumps(list(enumerate(files)))).option("read", json.dumps(read)).option("search", json.dumps(search)).load()
