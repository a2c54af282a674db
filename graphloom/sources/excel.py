"""Sheets of an .xlsx workbook as rows of strings, read on the driver with the standard library."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Iterator

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))


def read_excel(path: str) -> dict[str, list[list[str]]]:
    """All sheets, by name. Cells are strings; missing ones are empty."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            body = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str]] = []
            for r in body.iter(f"{_MAIN}row"):
                while len(rows) < int(r.get("r", len(rows) + 1)) - 1:
                    rows.append([])
                cells: list[str] = []
                for c in r.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    value = c.find(f"{_MAIN}v")
                    if c.get("t") == "s":
                        cells.append(shared[int(value.text)])
                    elif c.get("t") == "inlineStr":
                        cells.append(_text(c))
                    else:
                        cells.append("" if value is None else value.text or "")
                rows.append(cells)
            out[sheet.get("name")] = rows
        return out


def stream_sheet(path: str, sheet: str, header_row: int = 0) -> Iterator[dict[str, str]]:
    """Rows below the header as dicts by trimmed header name."""
    rows = read_excel(path)[sheet]
    header = [h.strip() for h in rows[header_row]]
    for r in rows[header_row + 1 :]:
        yield dict(zip(header, [*r, *[""] * (len(header) - len(r))]))
