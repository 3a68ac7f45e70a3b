"""Files to events: readers, context, sinks, the command line, streams."""

import codecs
import io
import json
import os
import random
import re
from datetime import date, datetime

import pytest

from tessera import cli
from tessera.functions import matching
from tessera.functions.patterns import compile_pattern
from tessera.model import DEFAULT_LAYERS, LAYERS, Fatal, ReadOptions, SearchOptions
from tessera.operators.context import gaps
from tessera.plans.search import ORDER, Search, filter_cells, json_events
from tessera.sources import columns, delimited, workbook
from tessera.sources.files import Screen, discover, read_cells
from tessera.sources.writer import Error, Formula, Rich, Sheet, write_workbook


def records(spark, path, **options):
    rows = read_cells(spark, [str(path)], ReadOptions(**options)).orderBy("seq").collect()
    return [(r.sheet, r.cell, r.layer, r.text) for r in rows if r.error is None]


def run(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    return cli.run([str(a) for a in argv], out, err, spark), out.getvalue(), err.getvalue()


@pytest.fixture
def basic(tmp_path):
    path = tmp_path / "basic.xlsx"
    write_workbook(path, [Sheet("Sheet1", {(1, 1): "name", (1, 2): "amount", (2, 1): "张三", (2, 2): 100.0, (3, 1): "李四", (3, 2): 250.0}), Sheet("汇总", {(1, 1): "张三应收账款", (1, 2): Formula("100+250", 350)})])
    return path


def test_basic_workbook(spark, basic):
    assert records(spark, basic) == [("Sheet1", "A1", "display", "name"), ("Sheet1", "B1", "display", "amount"), ("Sheet1", "A2", "display", "张三"), ("Sheet1", "B2", "display", "100"), ("Sheet1", "A3", "display", "李四"), ("Sheet1", "B3", "display", "250"), ("汇总", "A1", "display", "张三应收账款"), ("汇总", "B1", "cached", "350")]
    code, out, _ = run(spark, "张三", basic)
    assert (code, out) == (0, f"{basic}\n  Sheet1!A2:1: 张三\n  汇总!A1:1: 张三应收账款\n")
    assert run(spark, "-c", "张三", basic)[1] == f"{basic}:2\n" and run(spark, "-l", "张三", basic)[1] == f"{basic}\n"
    assert run(spark, "--sheet", "汇*", "张三", basic)[1] == f"{basic}\n  汇总!A1:1: 张三应收账款\n"
    assert run(spark, "nothing", basic)[:2] == (1, "")
    assert run(spark, "--formula", "100\\+", basic)[1] == f"{basic}\n  汇总!B1:1: 100+250 [formula]\n"
    assert run(spark, "--color", "always", "三", basic)[1].splitlines()[1] == "  \x1b[34mSheet1\x1b[0m!\x1b[32mA2\x1b[0m:2: 张\x1b[1;33m三\x1b[0m"


@pytest.mark.parametrize("options", [{}, {"inline": True}, {"absolute_targets": True}, {"epoch_1904": True}])
def test_values(spark, tmp_path, options):
    path = tmp_path / "v.xlsx"
    cells = {(3, 2): date(2024, 5, 27), (3, 3): datetime(2024, 5, 27, 13, 5, 9), (4, 2): True, (4, 3): False, (5, 2): Error("#DIV/0!"), (5, 3): Rich(["张三", "应收账款"], "phonetic"), (6, 2): 0.1 + 0.2, (6, 3): 1e16, (7, 2): -0.0, (8, 2): "<v> & \"x\"", (9, 2): "", (10, 2): Formula("A1", None), (11, 28): "far"}
    write_workbook(path, [Sheet("S", cells, merged=["B3:C3"])], **options)
    assert {c: t for _, c, _, t in records(spark, path)} == {"B3": "2024-05-27", "C3": "2024-05-27 13:05:09", "B4": "true", "C4": "false", "B5": "#Div0", "C5": "张三应收账款", "B6": "0.3", "C6": "10000000000000000", "B7": "0", "B8": '<v> & "x"', "AB11": "far"}


def test_formula_layers_and_comments(spark, tmp_path):
    path = tmp_path / "f.xlsx"
    write_workbook(path, [Sheet("S", {(1, 1): "total", (1, 2): Formula("SUM(2,3)", 5), (2, 2): "data"}, {"B2": "张三留言: please verify", "C9": ""}), Sheet("T", {(1, 1): "x"}, {"A1": "second"})])
    assert records(spark, path, layers=LAYERS) == [("S", "A1", "display", "total"), ("S", "B1", "formula", "SUM(2,3)"), ("S", "B1", "cached", "5"), ("S", "B2", "display", "data"), ("T", "A1", "display", "x"), ("S", "B2", "comment", "张三留言: please verify"), ("T", "A1", "comment", "second")]
    assert run(spark, "verify", path)[1] == f"{path}\n  S!B2:14: 张三留言: please verify [comment]\n" and run(spark, "--no-comments", "verify", path)[0] == 1
    assert "[display]" in run(spark, "--layers", "total", path)[1]


def test_hidden(spark, tmp_path):
    path = tmp_path / "h.xlsx"
    write_workbook(path, [Sheet("Visible", {(1, 1): "open", (2, 1): "row", (1, 3): "col"}, {"A2": "note"}, hidden_rows={2}, hidden_columns={3}), Sheet("H", {(1, 1): "sheet"}, {"A1": "lost"}, state="hidden"), Sheet("V", {(1, 1): "very"}, state="veryHidden")])
    assert [t for *_, t in records(spark, path)] == ["open", "col", "row", "sheet", "very", "note", "lost"]
    assert [t for *_, t in records(spark, path, include_hidden=False)] == ["open", "note"]
    late = filter_cells(read_cells(spark, [str(path)]), ReadOptions(include_hidden=False, sheet_glob="V*"))
    assert [r.text for r in late.orderBy("seq").collect()] == ["open", "note"]


@pytest.mark.parametrize("raw,name,encoding,expected", [
    (b"a,b\nc,d\n", "x.csv", None, {"A1": "a", "B1": "b", "A2": "c", "B2": "d"}), (b"", "x.csv", None, {}), (codecs.BOM_UTF8 + b"header,value\n", "x.csv", None, {"A1": "header", "B1": "value"}), (b'"foo,bar",baz\n', "x.csv", None, {"A1": "foo,bar", "B1": "baz"}),
    (b"a\tb\nc\td\n", "x.TSV", None, {"A1": "a", "B1": "b", "A2": "c", "B2": "d"}), ("张三,李四\n".encode("gbk"), "x.csv", "gbk", {"A1": "张三", "B1": "李四"}), (b"a,b\r\nc,d\r\n", "x.csv", None, {"A1": "a", "B1": "b", "A2": "c", "B2": "d"}),
    (b'"two\nlines",x\n\n\nnext\n', "x.csv", None, {"A1": "two\nlines", "B1": "x", "A2": "next"}), (b"a,,b\n,\nz\n", "x.csv", None, {"A1": "a", "C1": "b", "A3": "z"}), (codecs.BOM_UTF16_LE + "é,x".encode("utf-16-le"), "x.csv", None, {"A1": "é", "B1": "x"}),
    (codecs.BOM_UTF16_BE + "é".encode("utf-16-be"), "x.csv", None, {"A1": "é"}), (b"\xff\xe9", "x.csv", None, {"A1": "��"}), (b"\xe9", "x.csv", "latin1", {"A1": "é"}), (b"a,b,c\nd\n", "x.csv", None, {"A1": "a", "B1": "b", "C1": "c", "A2": "d"}),
])
def test_delimited(spark, tmp_path, raw, name, encoding, expected):
    (tmp_path / name).write_bytes(raw)
    assert {c: t for _, c, _, t in records(spark, tmp_path / name, encoding=encoding)} == expected


def test_encodings():
    for label in ("utf-8", "GB2312", "big5", "euc-jp", "shift_jis", "windows-1251", "koi8-r", "utf-16le", "iso-8859-2", " Latin1 "):
        assert codecs.lookup(delimited.codec(label))
    for label in ("nonsense", "base64", "utf-7", "idna"):
        with pytest.raises(Fatal):
            delimited.codec(label)


def events(spark, path, pattern, before=0, after=0, **kw):
    search = Search(spark, read_cells(spark, [str(path)]), SearchOptions((pattern,), before=before, after=after, **kw))
    return search, search.events().orderBy(*ORDER).collect()


def column(tmp_path, n, at, name="c.csv"):
    (tmp_path / name).write_text("".join(("TARGET\n" if i in at else f"line{i}\n") for i in range(1, n + 1)))
    return tmp_path / name


@pytest.mark.parametrize("at,b,a,expected", [({2}, 0, 2, "M1C2"), ({4}, 2, 0, "M1C2"), ({5, 15}, 1, 1, "M2C4S1"), ({11}, 5, 10, "M1C15"), ({11}, 10, 3, "M1C13"), ({1}, 3, 0, "M1C0"), ({3, 4}, 1, 1, "M2C2"), ({2, 19}, 60, 60, "M2C18")])
def test_context(spark, tmp_path, at, b, a, expected):
    _, rows = events(spark, column(tmp_path, 21 if expected != "M2C18" else 20, at), "TARGET", b, a)
    kinds = [r.type for r in rows]
    made = f"M{kinds.count('match')}C{kinds.count('context')}" + (f"S{kinds.count('separator')}" if "separator" in kinds else "")
    assert made == expected and kinds[0] == "begin" and kinds[-1] == "end"


def test_context_in_two_sheets_with_comments_and_promotion(spark, tmp_path):
    path = tmp_path / "t.xlsx"
    cells = {(r, 1): "TARGET" if r == 3 else f"v{r}" for r in range(1, 6)}
    write_workbook(path, [Sheet("S1", cells), Sheet("S2", cells)])
    assert [r.type for r in events(spark, path, "TARGET", 0, 2)[1]] == ["begin", "match", "context", "context", "separator", "match", "context", "context", "end"]
    wide = tmp_path / "w.xlsx"
    write_workbook(wide, [Sheet("S", {(1, 1): "a", (1, 2): "HIT", (2, 1): "b", (4, 1): "c"}, {"A1": "HIT note"})])
    search, rows = events(spark, wide, "HIT", 1, 1)
    assert [(r.type, r.cell, len(r.submatches or [])) for r in rows if r.cell] == [("match", "A1", 0), ("match", "B1", 1), ("context", "A2", 0), ("match", "A1", 1)]
    assert not any(r.type == "separator" for r in rows)
    assert search.counts().first().n == 2 and rows[-1].matches == 2
    strict = Search(spark, read_cells(spark, [str(wide)]), SearchOptions(("HIT",), before=1, after=1, strict=True))
    assert strict.counts().first().n == 3
    plain, rows = events(spark, wide, "HIT", 1, 1, row_promotion=False)
    assert [r.type for r in rows if r.cell] == ["context", "match", "context", "match"]
    assert "C1" not in run(spark, "-C", "1", "HIT", wide)[1] and "[context]" in run(spark, "-C", "1", "HIT", wide)[1]


def test_json(spark, tmp_path, basic):
    column(tmp_path, 3, {2})
    code, out, _ = run(spark, "--json", "-e", "三", "TARGET", basic, tmp_path / "c.csv", "-A", 1)
    found = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and [x["type"] for x in found] == ["begin", "match", "match", "context", "context", "separator", "match", "match", "end", "begin", "match", "context", "end"]
    assert found[1]["data"] == {"path": str(basic), "sheet": "Sheet1", "cell": "A2", "layer": "display", "text": "张三", "submatches": [{"match": {"text": "三"}, "start": 1, "end": 2}]}
    assert found[5] == {"type": "separator"} and found[8]["data"]["stats"] == {"matches": 2, "sheets_scanned": 2} and "submatches" not in found[3]["data"]


def test_invert(spark, basic):
    code, out, _ = run(spark, "-v", "zzz", "--json", basic)
    assert code == 0 and sum(json.loads(x)["type"] == "match" for x in out.splitlines()) == 8
    assert run(spark, "-v", "-c", "张", basic)[1] == f"{basic}:6\n" and run(spark, "-v", ".", basic)[0] == 1
    assert ":1: " in run(spark, "-v", "张", basic)[1]


def test_errors_are_rows(spark, tmp_path, basic):
    (tmp_path / "corrupt.xlsx").write_bytes(bytes.fromhex("504b030400"))
    (tmp_path / "encrypted.xlsx").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 600)
    import zipfile

    with zipfile.ZipFile(tmp_path / "stub.xlsx", "w") as z:
        z.writestr("EncryptedPackage", b"\0")
    code, out, err = run(spark, "张三", tmp_path)
    assert code == 0 and str(basic) in out
    assert [x.split(": ")[0].rpartition("/")[2] + " " + x.split(": ")[1] for x in err.splitlines()] == ["corrupt.xlsx parse", "encrypted.xlsx encrypted", "stub.xlsx encrypted"]
    found = read_cells(spark, discover([str(tmp_path)]))
    kinds = [r.type for r in Search(spark, found, SearchOptions(("张三",))).events().orderBy(*ORDER).collect()]
    assert kinds.count("error") == 3 and kinds.count("begin") == kinds.count("end") == 4


def test_empty_and_missing(spark, tmp_path):
    write_workbook(tmp_path / "e.xlsx", [Sheet("S")])
    assert run(spark, "x", tmp_path / "e.xlsx")[:2] == (1, "") and run(spark, "x", tmp_path / "absent.xlsx")[:2] == (1, "")
    assert "begin" in run(spark, "--json", "x", tmp_path / "e.xlsx")[1]


@pytest.mark.parametrize("argv", [["-E", "nonsense", "x"], ["-A", "10001", "x"], ["-C", "-1", "x"], ["("], [], ["--glob", "[a", "x"], ["--sheet", "{a", "x"], ["--nonsense"]])
def test_fatal(spark, argv, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.csv").write_text("x\n")
    code, _, err = run(spark, *argv)
    assert code == 2


def test_discovery(tmp_path):
    for name in ("a.csv", "b.TSV", "c.txt", ".hidden.csv", "d/e.xlsx", "d/.x/f.csv", "skip/g.csv", "d/no.csv", "d/yes.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("# rules\nskip/\n*.csv\n!a.csv\n!yes.csv\n")
    names = lambda found: [os.path.relpath(x, tmp_path) for x in found]
    assert names(discover([str(tmp_path)])) == ["a.csv", "b.TSV", "d/e.xlsx", "d/no.csv", "d/yes.csv", "skip/g.csv"]  # no repository
    (tmp_path / ".ignore").write_text("*.TSV\n")
    assert names(discover([str(tmp_path)])) == ["a.csv", "d/e.xlsx", "d/no.csv", "d/yes.csv", "skip/g.csv"]
    (tmp_path / ".ignore").unlink()
    (tmp_path / ".git" / "info").mkdir(parents=True)
    assert names(discover([str(tmp_path)])) == ["a.csv", "b.TSV", "d/e.xlsx", "d/yes.csv"]
    assert names(discover([str(tmp_path / "d")])) == ["d/e.xlsx", "d/yes.csv"]  # rules from above
    (tmp_path / ".git" / "info" / "exclude").write_text("*.xlsx\n")
    assert names(discover([str(tmp_path / "d")])) == ["d/yes.csv"]
    (tmp_path / "d" / ".ignore").write_text("!e.xlsx\n")
    assert names(discover([str(tmp_path / "d")])) == ["d/e.xlsx", "d/yes.csv"]
    (tmp_path / "d" / ".git").mkdir()
    assert names(discover([str(tmp_path)])) == ["a.csv", "b.TSV", "d/e.xlsx", "d/no.csv", "d/yes.csv"]  # a repository of its own
    (tmp_path / "d" / ".git").rmdir()
    (tmp_path / ".git" / "info" / "exclude").unlink()
    assert names(discover([str(tmp_path)], "*/d/*")) == ["d/e.xlsx", "d/yes.csv"]
    assert len(discover([str(tmp_path)], ignore_rules=False)) == 8
    assert names(discover([str(tmp_path / "a.csv"), str(tmp_path / "a.csv"), str(tmp_path / "c.txt"), str(tmp_path / "none")])) == ["a.csv", "a.csv"]


def test_files_behind_a_uri(tmp_path):
    from tessera.sources import store

    for name in ("b.csv", "a/c.csv", ".x/d.csv"):
        with store.created(f"file://{tmp_path}/{name}") as f:
            f.write(b"text")
    assert discover([f"file://{tmp_path}"]) == [f"{tmp_path}/a/c.csv", f"{tmp_path}/b.csv"]
    was, store.plain = store.plain, lambda path: path  # as if they were remote
    try:
        assert discover([f"file://{tmp_path}"]) == [f"file://{tmp_path}/a/c.csv", f"file://{tmp_path}/b.csv"]
        assert store.size(f"file://{tmp_path}/b.csv") == 4 and store.opened(f"file://{tmp_path}/b.csv").read() == b"text"
    finally:
        store.plain = was


def test_full_scan_agrees_with_filters_in_the_reader(spark, basic):
    late = filter_cells(read_cells(spark, [str(basic)], ReadOptions(layers=LAYERS)), ReadOptions(sheet_glob="Sheet*"))
    early = read_cells(spark, [str(basic)], ReadOptions(sheet_glob="Sheet*"))
    assert sorted(r.text for r in late.collect()) == sorted(r.text for r in early.collect())


def test_many_files_pack_into_tasks(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i:02}.csv").write_text(f"row {i}\n" * 3)
    df = read_cells(spark, discover([str(tmp_path)]))
    assert df.count() == 60 and df.rdd.getNumPartitions() == 1
    assert run(spark, "-c", "row 1", tmp_path)[1].count(":3\n") == 11


def test_stream(spark, tmp_path):
    from tessera.streaming.watch import watch

    write_workbook(tmp_path / "b c.xlsx", [Sheet("S", {(1, 1): "needle", (2, 1): "hay"})])
    (tmp_path / "x.csv").write_text("hay,needle needle\n")
    (tmp_path / "y.txt").write_text("needle")
    q = watch(spark, str(tmp_path), SearchOptions(("needle",))).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.cell, len(r.submatches)) for r in spark.sql("select * from found").collect()) == [("A1", 1), ("B1", 2)]


def cells_of(path, columnar=True, screen=None, layers=LAYERS, hidden=True):
    """(sheet, row, col, cell, layer, text, hidden row, hidden column) of a workbook in order, by numpy or by the XML parser."""
    was = columns.columns
    try:
        if not columnar:
            columns.columns = lambda raw: None
        with open(path, "rb") as f:
            reader = workbook.Reader(f, None, layers, hidden, screen)
            rows = [r for b in reader.batches() for r in b.to_pylist()]
    finally:
        columns.columns = was
    rows.sort(key=lambda r: (r["seq"] is None, r["seq"] or 0))
    return [tuple(r[k] for k in ("sheet", "row", "col", "cell", "layer", "text", "hidden_row", "hidden_col")) for r in rows]


ODD_CELLS = {(1, 1): "a & <b>", (1, 2): 7, (2, 30): 0.25, (3, 1): True, (3, 2): date(2020, 1, 2), (3, 3): Formula("A1&\"x\"", "r & s"), (4, 1): Error("#N/A"), (5, 1): Rich(["x", "y"]), (6, 1): -12, (6, 2): 10**16, (7, 1): "line\nfeed", (8, 1): "_x0041_", (9, 4): 1e-11, (9, 5): 0.1 + 0.2, (9, 6): -0.0, (10, 1): Formula("B2*2", 84), (11, 1): "", (12, 703): "far", (13, 1): 123456789.125, (13, 2): 1e300}


def test_columnar_and_parsed_sheets_agree(tmp_path):
    path = tmp_path / "p.xlsx"
    for inline in (False, True):
        write_workbook(path, [Sheet("S", ODD_CELLS, {"B2": "note"}, hidden_rows={3, 9}, hidden_columns={2}), Sheet("empty"), Sheet("T", {(1, 1): 5}, state="hidden")], inline=inline)
        with open(path, "rb") as f:
            assert columns.columns(workbook.Workbook(f).part("xl/worksheets/sheet1.xml")) is not None
        for layers in (LAYERS, frozenset({"display"}), frozenset({"cached", "comment"})):
            for hidden in (True, False):
                got = cells_of(path, layers=layers, hidden=hidden)
                assert got == cells_of(path, False, layers=layers, hidden=hidden) and got
    cell = b'<worksheet><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>'
    assert len(columns.columns(cell)) == 1
    for was, now in ((b"<v>1</v>", b"<v>1<x/></v>"), (b' r="A1"', b""), (b"<row", b"<!-- --><row"), (b"</c>", b""), (b"<v>", b'<f t="shared" si="0"/><v>'), (b'r="A1"', b'r="A1" t="zz"'), (b'"A1"', b'"A0"'), (b'"A1"', b'"a1"')):
        assert columns.columns(cell.replace(was, now)) is None, now


@pytest.mark.parametrize("seed", [1, 3])
def test_a_screened_workbook_gives_what_a_full_scan_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    values = [*ODD_CELLS.values(), "HIT", "row-12345", "row-7", "2020", "true", Formula("HIT+1", "x"), Formula("A1", "HIT"), Formula("A1", 2.5)]
    sheets = [Sheet(f"S{k}", {(rng.randint(1, 30), rng.randint(1, 4)): rng.choice(values if k % 3 else ["plain", "words", 5, 6.5]) for _ in range(rng.choice([0, 1, 40]))}, {"A1": rng.choice(["HIT", "no"])} if rng.random() < 0.3 else {}, hidden_rows={2}) for k in range(6)]
    path = tmp_path / "w.xlsx"
    write_workbook(path, sheets, inline=bool(seed % 2), epoch_1904=seed == 3)
    for pattern, case in (("ZZZ_NEVER", "sensitive"), ("HIT", "sensitive"), (r"row-\d{4,}", "sensitive"), ("2020-01", "smart"), (r"^\d+$", "smart"), ("true", "smart"), ("#na", "smart"), (r"(x|y)*y", "smart"), ("", "smart"), ("e", "smart"), (r"\bHIT\b|0\.3", "sensitive")):
        compiled = compile_pattern(spark, [pattern], case)
        found = matching.hit_finder(compiled)
        for layers in (LAYERS, DEFAULT_LAYERS):
            for hidden in (True, False):
                full = cells_of(path, layers=layers, hidden=hidden)
                hits = [c for c in full if found(c[5])]
                for columnar in (True, False):
                    for whole in (False, True):
                        screen = Screen(compiled, whole).of_workbook()
                        got = cells_of(path, columnar, screen, layers, hidden)
                        with_hit = {c[0] for c in hits}
                        assert [c for c in got if c[5] is not None] == ([c for c in full if c[0] in with_hit] if whole else hits), (pattern, whole)
                        assert sorted(c[0] for c in got if c[5] is None) == sorted({c[0] for c in full} - with_hit), pattern
    for options in (SearchOptions(("HIT",)), SearchOptions(("HIT",), invert=True), SearchOptions(("row-",), before=1, after=2), SearchOptions(("no such",))):
        full, screened = Search(spark, read_cells(spark, [str(path)], options.read), options), Search.over_files(spark, [str(path)], options)
        key = ["type", "path", "sheet", "cell", "layer", "text", "submatches", "matches", "sheets_scanned", "message", "file_seq", "seq", "sub_seq"]
        assert sorted(map(str, (tuple(r[k] for k in key) for r in full.events().collect()))) == sorted(map(str, (tuple(r[k] for k in key) for r in screened.events().collect())))
        assert full.counts().collect() == screened.counts().collect() and full.exit_code() == screened.exit_code()


def test_sheets_of_a_large_workbook_are_tasks(spark, tmp_path, monkeypatch):
    from tessera.sources import files

    path = str(tmp_path / "big.xlsx")
    write_workbook(path, [Sheet(f"S{k}", {(r, 1): f"value {r} of {k}" for r in range(1, 300)}, {"A1": f"note {k}"}) for k in range(3)])
    whole = [(r.sheet, r.cell, r.text) for r in read_cells(spark, [path]).orderBy("seq").collect()]
    monkeypatch.setattr(files, "SPLIT_BYTES", 100)
    options = {"files": json.dumps([[0, path], [1, path]]), "read": json.dumps({"encoding": None, "layers": sorted(DEFAULT_LAYERS), "sheet_glob": None, "include_hidden": True}), "search": "null"}
    reader = files._Reader(options)
    parts = reader.partitions()
    assert [p.files for p in parts] == [[(k, path, [s])] for k in (0, 1) for s in range(3)]
    rows = sorted((r["seq"], r["sheet"], r["cell"], r["text"]) for p in parts[:3] for b in reader.read(p) for r in b.to_pylist())
    assert [r[1:] for r in rows] == whole and len(whole) == 3 * 300


def test_one_look_at_the_cells_gives_all_events(spark, sf_dir):
    from tessera.plans.queries import turn_cells

    events = Search(spark, turn_cells(spark, sf_dir), SearchOptions(("ion on the",))).events()
    assert {"begin", "end"} <= {r.type for r in events.collect()}
    plan = events._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 3 and plan.count("FileScan") == 1, plan


def test_gaps_equal_a_walk_over_the_cells(spark):
    rng = random.Random(5)
    rows, seq = [], 0
    for path in ("a", "b"):
        for sheet in ("S", "T", "U"):
            for row in sorted(rng.sample(range(1, 40), 14)):
                for col in (1, 2):
                    seq += 1
                    rows.append((path, 0 if path == "a" else 1, sheet, row, col, "display", seq))
        for sheet in ("T", "U"):
            for row in rng.sample(range(1, 40), 4):
                seq += 1
                rows.append((path, 0 if path == "a" else 1, sheet, row, 1, "comment", seq))
    rows.append(("c", 2, "S", 7, 1, "comment", seq + 1))
    df = spark.createDataFrame(rows, "path string, file_seq long, sheet string, row long, col int, layer string, seq long")
    expected, last = set(), {}
    for path, _, sheet, row, _, _, n in rows:
        if path in last and (last[path][0] != sheet or row > last[path][1] + 1):
            expected.add(n)
        last[path] = (sheet, row)
    got = gaps(df).collect()
    assert len(got) == len(rows) and {r.seq for r in got if r.gap_before} == expected

