"""Workbooks (xlsx, xlsm, ods) and docx documents with the standard library only; other formats give an issue."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ODS = {"table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0", "office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0"}
MOST_COLUMNS = 16_384


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _xlsx(z: zipfile.ZipFile) -> list[tuple[str, bool, list[list[str]]]]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
        target = targets[sheet.get(R)].lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        rows: list[list[str]] = []
        for row in ET.fromstring(z.read(path)).iter(f"{S}row"):
            place = int(row.get("r", len(rows) + 1))
            while len(rows) < place - 1:
                rows.append([])
            cells: list[str] = []
            for c in row.iter(f"{S}c"):
                at = _column(c.get("r", "")) or len(cells) + 1
                cells += [""] * (min(at, MOST_COLUMNS) - 1 - len(cells))
                v, kind = c.find(f"{S}v"), c.get("t")
                if kind == "s" and v is not None:
                    value = shared[int(v.text)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif kind == "b" and v is not None:
                    value = "true" if v.text == "1" else "false"
                else:
                    value = (v.text or "") if v is not None else ""
                cells.append(value)
            rows.append(cells)
        out.append((sheet.get("name"), sheet.get("state") in ("hidden", "veryHidden"), rows))
    return out


def _ods(z: zipfile.ZipFile) -> list[tuple[str, bool, list[list[str]]]]:
    t, x = f"{{{ODS['table']}}}", f"{{{ODS['text']}}}"
    out = []
    for table in ET.fromstring(z.read("content.xml")).iter(f"{t}table"):
        rows: list[list[str]] = []
        for row in table.iter(f"{t}table-row"):
            cells: list[str] = []
            for c in row.iter(f"{t}table-cell"):
                times = min(int(c.get(f"{t}number-columns-repeated", "1")), MOST_COLUMNS)
                cells += ["\n".join("".join(p.itertext()) for p in c.iter(f"{x}p"))] * times
            while cells and not cells[-1]:
                cells.pop()
            times = int(row.get(f"{t}number-rows-repeated", "1"))
            rows += [cells] * (times if cells else min(times, 1))
        out.append((table.get(f"{t}name"), False, rows))
    return out


def sheets(content: bytes, extension: str, hidden: bool = True) -> tuple[list[tuple[str, list[list[str]]]], list[tuple[str, str]]]:
    """((sheet, rows) of each sheet with content, (sheet, issue code))."""
    if extension not in (".xlsx", ".xlsm", ".ods"):
        return [], [("", "EXCEL_CORRUPT")]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = _ods(z) if extension == ".ods" else _xlsx(z)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError):
        return [], [("", "EXCEL_CORRUPT")]
    tables, issues = [], []
    for name, is_hidden, rows in found:
        if is_hidden:
            issues.append((name, "EXCEL_HIDDEN_SHEET"))
            if not hidden:
                continue
        while rows and not any(c.strip() for c in rows[-1]):
            rows = rows[:-1]
        width = max((len(r) for r in rows), default=0)
        if width:
            tables.append((name, [r + [""] * (width - len(r)) for r in rows]))
        else:
            issues.append((name, "EXCEL_EMPTY_SHEET"))
    return tables, issues


def notes_text(rows: list[list[str]]) -> str:
    """A sheet of notes as text; rows of two cells become ``key: value``."""
    lines = []
    for row in rows:
        cells = [c.strip() for c in row if c.strip()]
        lines.append(": ".join(cells) if len(cells) == 2 else " ".join(cells))
    return "\n".join(lines)


def docx_lines(content: bytes) -> list[str] | None:
    """Paragraphs of a docx file, headings marked with ##; None if unreadable."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    out = []
    for p in root.iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        text = "".join(t.text or "" for t in p.iter(f"{W}t"))
        out.append(f"## {text}" if style is not None and (style.get(f"{W}val") or "").lower().startswith(("heading", "title")) else text)
    return out
