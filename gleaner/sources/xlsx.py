"""Report workbooks, written with the standard library."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
# The report's head and column widths.
HEAD, WIDTHS = ("Name", "Phone", "Link"), (30, 22, 70)


def _cell(ref: str, value: str, style: int = 0) -> str:
    return f'<c r="{ref}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def write_report(rows: Iterator[tuple[str, str, str]], path: str) -> int:
    """Sheet "Results" of (name, phone, link) rows as they come: links active, head frozen and filtered."""
    sheet, links = [], []
    n = 1
    for n, row in enumerate([HEAD, *rows], 1):
        name, phone, link = ("" if v is None else str(v) for v in row)
        live = n > 1 and link != ""
        sheet.append(f'<row r="{n}">{_cell(f"A{n}", name, n == 1)}{_cell(f"B{n}", phone, n == 1)}{_cell(f"C{n}", link, 2 if live else n == 1)}</row>')
        if live:
            links.append((f"C{n}", link))
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(WIDTHS, 1))
    hyper = "".join(f'<hyperlink ref="{ref}" r:id="rId{i}"/>' for i, (ref, _) in enumerate(links, 1))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Results" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="3"><font/><font><b/></font><font><u/><color rgb="FF0563C1"/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}" xmlns:r="{_REL}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f'<cols>{cols}</cols><sheetData>{"".join(sheet)}</sheetData><autoFilter ref="A1:C{n}"/>{f"<hyperlinks>{hyper}</hyperlinks>" if hyper else ""}</worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/hyperlink" Target={quoteattr(u)} TargetMode="External"/>' for i, (_, u) in enumerate(links, 1)) + "</Relationships>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
    return n - 1


def save_report(report: DataFrame, event: str, path: str) -> int:
    """Workbook of one event's report rows; they are streamed to the driver, a partition at a time."""
    rows = report.where(report.event_name == event).select("name", "phone", "link").toLocalIterator()
    return write_report(((r["name"], r["phone"], r["link"]) for r in rows), path)
