"""A minimal workbook writer: for round trips and fixtures."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass, field
from datetime import date, datetime
from xml.sax.saxutils import escape, quoteattr

from tessera.functions.cells import a1

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


@dataclass
class Formula:
    text: str
    value: object = None


@dataclass
class Rich:
    runs: list[str]
    phonetic: str = ""


@dataclass
class Error:
    code: str


@dataclass
class Sheet:
    name: str
    cells: dict[tuple[int, int], object] = field(default_factory=dict)
    comments: dict[str, str] = field(default_factory=dict)
    state: str = "visible"
    hidden_rows: set[int] = field(default_factory=set)
    hidden_columns: set[int] = field(default_factory=set)
    merged: list[str] = field(default_factory=list)


def _serial(t: date, epoch_1904: bool) -> float:
    start = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
    t = t if isinstance(t, datetime) else datetime(t.year, t.month, t.day)
    return (t - start).total_seconds() / 86_400


def write_workbook(path, sheets: list[Sheet], epoch_1904: bool = False, inline: bool = False, absolute_targets: bool = False) -> None:
    strings: dict[str, int] = {}
    xml: list[str] = []

    def shared(body: str) -> int:
        if body not in strings:
            strings[body] = len(strings)
        return strings[body]

    def text(t: str) -> str:
        return f'<t xml:space="preserve">{escape(t)}</t>'

    def cell(ref: str, v: object) -> str:
        if isinstance(v, Formula):
            kind = ' t="str"' if isinstance(v.value, str) else ""
            return f'<c r="{ref}"{kind}><f>{escape(v.text)}</f>' + (f"<v>{escape(str(v.value))}</v>" if v.value is not None else "") + "</c>"
        if isinstance(v, Rich):
            body = "".join(f"<r>{text(r)}</r>" for r in v.runs) + (f'<rPh sb="0" eb="1">{text(v.phonetic)}</rPh>' if v.phonetic else "")
            return f'<c r="{ref}" t="s"><v>{shared(body)}</v></c>'
        if isinstance(v, Error):
            return f'<c r="{ref}" t="e"><v>{v.code}</v></c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (date, datetime)):
            return f'<c r="{ref}" s="1"><v>{_serial(v, epoch_1904)!r}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        if inline:
            return f'<c r="{ref}" t="inlineStr"><is>{text(str(v))}</is></c>'
        return f'<c r="{ref}" t="s"><v>{shared(text(str(v)))}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, s in enumerate(sheets, 1):
            lines: dict[int, list[tuple[int, object]]] = {}
            for (r, c), v in sorted(s.cells.items()):
                lines.setdefault(r, []).append((c, v))
            for r in s.hidden_rows:
                lines.setdefault(r, [])
            rows = "".join(f'<row r="{r}"' + (' hidden="1"' if r in s.hidden_rows else "") + ">" + "".join(cell(a1(r, c), v) for c, v in cs) + "</row>" for r, cs in sorted(lines.items()))
            cols = "".join(f'<col min="{c}" max="{c}" hidden="1"/>' for c in sorted(s.hidden_columns))
            xml.append(f'<worksheet xmlns="{MAIN}">' + (f"<cols>{cols}</cols>" if cols else "") + f"<sheetData>{rows}</sheetData>" + ("<mergeCells>" + "".join(f'<mergeCell ref="{m}"/>' for m in s.merged) + "</mergeCells>" if s.merged else "") + "</worksheet>")
            z.writestr(f"xl/worksheets/sheet{k}.xml", xml[-1])
            if s.comments:
                z.writestr(f"xl/comments{k}.xml", f'<comments xmlns="{MAIN}"><commentList>' + "".join(f"<comment ref={quoteattr(ref)} authorId=\"0\"><text>{text(t)}</text></comment>" for ref, t in s.comments.items()) + "</commentList></comments>")
                z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{REL}/comments" Target="../comments{k}.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{body}</si>" for body in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        book = "".join(f'<sheet name={quoteattr(s.name)} sheetId="{k}" state="{s.state}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(epoch_1904)}"/><sheets>{book}</sheets></workbook>')
        at = "/xl/" if absolute_targets else ""
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="rId{k}" Type="{REL}/worksheet" Target="{at}worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
