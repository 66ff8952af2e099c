"""Spreadsheet files without a library: the first sheet of a workbook as rows, and rows as a workbook of one sheet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST = 1_048_576
#: What XML can't hold.
CONTROL = re.compile(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _name(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node: ElementTree.Element) -> str:
    """All runs of a string, without its reading aids."""
    return "".join(t.text or "" for p in node for t in ([p] if p.tag == MAIN + "t" else p.findall(MAIN + "t") if p.tag == MAIN + "r" else []))


def read_rows(raw: bytes) -> list[list[str | None]]:
    """The first sheet's rows, cells as text (numbers as they are written, booleans as TRUE and FALSE), empty ones as None."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [_text(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[first.get(LINK)].lstrip("/")
        sheet = ElementTree.fromstring(z.read(target if target in names else f"xl/{target}"))
    out: list[list[str | None]] = []
    for row in sheet.iter(MAIN + "row"):
        cells: list[str | None] = []
        for c in row.findall(MAIN + "c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells.extend([None] * (at + 1 - len(cells)))
            kind, value, inner = c.get("t"), c.find(MAIN + "v"), c.find(MAIN + "is")
            if kind == "inlineStr":
                cells[at] = _text(inner) if inner is not None else None
            elif value is not None and value.text is not None and kind != "e":
                cells[at] = shared[int(value.text)] if kind == "s" else ("TRUE" if value.text == "1" else "FALSE") if kind == "b" else value.text
        number = int(row.get("r") or len(out) + 1)
        out.extend([[]] * (number - 1 - len(out)))
        out.append(cells)
    return out


def write_rows(header: Sequence[str], rows: Sequence[Sequence[object]]) -> bytes:
    """A workbook of one sheet; None is an empty cell, numbers stay numbers."""
    if len(rows) >= MOST:
        raise ValueError(f"a sheet holds {MOST - 1} rows below its header")

    def cell(value: object, at: str) -> str:
        if value is None or value != value:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(CONTROL.sub("", str(value)))}</t></is></c>'

    body = "".join(f'<row r="{k}">{"".join(cell(v, f"{_name(j)}{k}") for j, v in enumerate(r))}</row>' for k, r in enumerate([header, *rows], 1))
    base, kind = "http://schemas.openxmlformats.org", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{base}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="r1" Type="{base}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="r1" Type="{base}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>\n' + text)
    return out.getvalue()
