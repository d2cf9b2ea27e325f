"""Reading one sheet of an .xlsx or .xlsm workbook with the standard library."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from xml.etree import ElementTree as ET

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{NS['m']}}}t"))


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date(serial: float) -> str:
    moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=serial)
    moment = (moment + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(sep=" ")


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iterfind(".//m:numFmts/m:numFmt", NS) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    return {i for i, x in enumerate(root.iterfind("./m:cellXfs/m:xf", NS)) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def read_sheet(path: str, sheet: int | str = 0) -> list[list[str | None]]:
    """Rows of strings; empty cells are None. ValueError if the workbook or sheet can't be read."""
    if sheet is None:
        raise ValueError("Name one sheet, by place or by name.")
    try:
        with zipfile.ZipFile(path) as z:
            shared = [_text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", NS)] if "xl/sharedStrings.xml" in z.namelist() else []
            sheets = ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", NS)
            found = next((s for i, s in enumerate(sheets) if sheet in (i, s.get("name"))), None)
            if found is None:
                raise ValueError(f"Worksheet {sheet!r} not found.")
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            target = targets[found.get(REL)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            dates = _date_styles(z)
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ValueError(f"Not a readable workbook: {e}") from e
    rows: list[list[str | None]] = []
    for r in root.iterfind(".//m:sheetData/m:row", NS):
        row: list[str | None] = []
        for c in r.iterfind("m:c", NS):
            at = _column(c.get("r")) if c.get("r") else len(row)
            row += [None] * (at + 1 - len(row))
            kind, v = c.get("t", "n"), c.find("m:v", NS)
            if kind == "inlineStr":
                row[at] = _text(c)
            elif v is not None and v.text is not None:
                if kind == "s":
                    row[at] = shared[int(v.text)]
                elif kind == "b":
                    row[at] = "True" if v.text == "1" else "False"
                elif kind == "n" and int(c.get("s", -1)) in dates:
                    row[at] = _date(float(v.text))
                else:
                    row[at] = v.text
        rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]
