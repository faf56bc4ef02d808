"""XLSX workbooks: read the head of each sheet without unpacking the rest, and write simple ones."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from html import escape
from typing import NamedTuple

from docweir.functions.chars import PY_SPACE, PY_WS
from docweir.functions.numbers import NUMERIC, short_number

from .archive import Archive, TextPull, pack_files
from .markdown import table_lines

MAX_SHEETS, MAX_ROWS, MAX_COLUMNS, DIMENSION_WINDOW = 5, 1000, 16_384, 256 * 1024
_NUMBER = re.compile(NUMERIC, re.ASCII)
_ENTITY = re.compile(r"&(?:(lt|gt|amp|quot|apos)|#(\d+)|#[xX]([0-9A-Fa-f]+));")
_NAMES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_CELL = re.compile(r"<c(?=[\s/>])([^>]*?)(?:/>|>(.*?)</c>)", re.DOTALL)
_VALUE = re.compile(r"<v(?:\s[^>]*)?>(.*?)</v>", re.DOTALL)
_TEXT = re.compile(r"<t(?=[\s/>])[^>]*?(?:/>|>(.*?)</t>)", re.DOTALL)
_PHONETIC = re.compile(r"<rPh(?=[\s/>])[^>]*?(?:/>|>.*?</rPh>)", re.DOTALL)
_INLINE = re.compile(r"<is(?:\s[^>]*)?>(.*?)</is>", re.DOTALL)
_LETTERS = re.compile("[A-Za-z]+")


class Unreadable(ValueError):
    """The strict reader cannot be sure; the lenient one may try."""


def entities(s: str) -> str:
    """Named and numeric character references, each once; code points out of range stay as they are."""

    def one(m: re.Match) -> str:
        if m[1]:
            return _NAMES[m[1]]
        n = int(m[2]) if m[2] else int(m[3], 16)
        return chr(n) if n <= 0x10FFFF else m[0]

    return _ENTITY.sub(one, s) if "&" in s else s


def attribute(tag: str, name: str) -> str | None:
    m = re.search(rf'\s{re.escape(name)}\s*=\s*"([^"]*)"', tag)
    return m[1] if m else None


def units(pull: TextPull, tag: str) -> Iterator[str]:
    """The insides of each <tag> in turn; what has been passed is let go of."""
    start = re.compile(rf"<{tag}(?=[\s/>])[^>]*>")
    end = f"</{tag}>"
    while True:
        m = start.search(pull.pending)
        if m is None:
            keep = pull.pending.rfind("<")
            pull.pending = pull.pending[keep:] if keep >= 0 else ""
            if not pull.more():
                return
            continue
        if m[0].endswith("/>"):
            pull.pending = pull.pending[m.end() :]
            yield ""
            continue
        at = pull.pending.find(end, m.end())
        while at < 0:
            seen = max(m.end(), len(pull.pending) - len(end))
            if not pull.more():
                return
            at = pull.pending.find(end, seen)
        body, pull.pending = pull.pending[m.end() : at], pull.pending[at + len(end) :]
        yield body


def strings_in(xml: str) -> str:
    """The text of a string item, without phonetic readings."""
    return "".join(entities(m[1] or "") for m in _TEXT.finditer(_PHONETIC.sub("", xml)))


class Cell(NamedTuple):
    ref: str
    kind: str
    style: str
    value: str


def cells_of(row: str) -> list[Cell]:
    out = []
    for m in _CELL.finditer(row):
        tag, body = " " + m[1], m[2] or ""
        kind = attribute(tag, "t") or ""
        if kind == "inlineStr":
            inner = _INLINE.search(body)
            value = strings_in(inner[1]) if inner else ""
        else:
            v = _VALUE.search(body)
            value = v[1] if v else ""
        out.append(Cell(attribute(tag, "r") or "", kind, attribute(tag, "s") or "", value))
    return out


def column_of(ref: str) -> int:
    """0-based column of a reference, -1 if it has none."""
    m = _LETTERS.match(ref)
    n = 0
    for ch in m[0].upper() if m else "":
        n = n * 26 + ord(ch) - 64
        if n > MAX_COLUMNS:
            return -1
    return n - 1


def serial_date(serial: float, late: bool) -> str:
    s = int(serial // 1)
    start = date(1904, 1, 1) if late else date(1899, 12, 30)
    try:
        return (start + timedelta(days=s + (not late and 1 <= s <= 60))).isoformat()
    except OverflowError:
        return str(serial)


def date_styles(xml: str | None) -> list[bool]:
    """For each cell style whether it shows a date."""
    if xml is None:
        return []
    lo, hi = xml.find("<cellXfs"), xml.find("</cellXfs>")
    if lo < 0 or hi < 0:
        raise Unreadable("styles without cellXfs")
    codes = {}
    for tag in re.findall(r"<numFmt\s[^>]*>", xml):
        number, code = attribute(tag, "numFmtId"), attribute(tag, "formatCode")
        if number and code is not None:
            codes[number] = entities(code)
    out = []
    for tag in re.findall(r"<xf\s[^>]*>", xml[lo:hi]):
        number = attribute(tag, "numFmtId") or "0"
        n = int(number) if number.isdigit() else 0
        built_in = 14 <= n <= 22 or 27 <= n <= 36 or 45 <= n <= 47 or 50 <= n <= 58
        own = bool(re.search("[ymdhs]", re.sub(r"\[[^\]]*(\]|$)", "", codes.get(number, "")), re.IGNORECASE))
        out.append(n != 0 and (built_in or own))
    return out


@dataclass
class Sheet:
    name: str | None
    rows: list[list[str]]
    scanned: int = 0
    truncated: bool = False


@dataclass
class Workbook:
    sheets: list[Sheet]
    n_sheets: int
    engine: str
    warnings: list[str] = field(default_factory=list)
    unpacked: int = 0

    @property
    def truncated(self) -> bool:
        return self.n_sheets > len(self.sheets) or any(s.truncated for s in self.sheets)

    @property
    def n_rows(self) -> int:
        return sum(s.scanned for s in self.sheets)

    def markdown(self) -> str:
        parts = [f"### Sheet: {'Sheet1' if s.name is None else s.name}\n\n{sheet_table(s.rows)}" for s in self.sheets]
        if self.n_sheets > len(self.sheets):
            parts.append(f"> {self.n_sheets - len(self.sheets)} more sheets not read (at most {MAX_SHEETS})")
        return "\n\n".join(parts).strip(PY_WS)

    def all_warnings(self) -> list[str]:
        if not self.truncated:
            return self.warnings
        more = f", {self.n_sheets - len(self.sheets)} sheets not read" if self.n_sheets > len(self.sheets) else ""
        return [*self.warnings, f"TRUNCATED: first {len(self.sheets)} sheets, {self.n_rows} rows (at most {MAX_ROWS} a sheet{more})"]


def sheet_table(rows: list[list[str]]) -> str:
    clean = [[PY_SPACE.sub(" ", c).strip(PY_WS).replace("|", "\\|") for c in r] for r in rows]
    return table_lines(clean) if clean and max(map(len, clean)) else "(empty sheet)"


def sheet_targets(book: Archive) -> tuple[list[tuple[str, str]], bool]:
    """Name and part of each sheet in the order of the tabs, by relation and never by number; and whether dates start in 1904."""
    xml, rels = book.text("xl/workbook.xml"), book.text("xl/_rels/workbook.xml.rels")
    if xml is None or rels is None:
        raise Unreadable("no workbook or relations")
    parts = {attribute(t, "Id"): attribute(t, "Target") for t in re.findall(r"<Relationship\s[^>]*>", rels)}
    out = []
    for tag in re.findall(r"<sheet\s[^>]*>", xml):
        name, rid = attribute(tag, "name"), attribute(tag, "r:id")
        if name is None or rid is None or not parts.get(rid):
            raise Unreadable("a sheet without name or part")
        out.append((entities(name), part_name(parts[rid])))
    if not out:
        raise Unreadable("no sheets")
    return out, starts_1904(xml)


def starts_1904(xml: str) -> bool:
    """Whether a workbook counts days from 1904."""
    return re.search(r"""date1904\s*=\s*["'](1|true)["']""", xml) is not None


def part_name(target: str) -> str:
    clean = re.sub(r"^(/|\./|\.\./)+", "", target)
    return clean if clean.startswith("xl/") else f"xl/{clean}"


def _shared(book: Archive, upto: int) -> list[str]:
    """Shared strings up to the greatest index asked for."""
    chunks = book.chunks("xl/sharedStrings.xml") if upto >= 0 else None
    out: list[str] = []
    if chunks is not None:
        for body in units(TextPull(chunks), "si"):
            out.append(strings_in(body))
            if len(out) > upto:
                break
    return out


def _index(cell: Cell) -> int:
    return int(cell.value) if cell.value.strip().isdigit() else -1


def shown(cell: Cell, strings: list[str], dates: list[bool], late: bool) -> str:
    """What a cell shows."""
    v = cell.value
    match cell.kind:
        case "s":
            i = _index(cell)
            return strings[i] if 0 <= i < len(strings) else ""
        case "inlineStr":
            return v
        case "str":
            return entities(v)
        case "b":
            return {"1": "true", "0": "false"}.get(v.strip(), entities(v))
        case "d":
            return v[:10] if re.match(r"\d{4}-\d{2}-\d{2}", v) else entities(v)
    if not _NUMBER.match(v):
        return entities(v)
    if cell.style.isdigit() and int(cell.style) < len(dates) and dates[int(cell.style)]:
        return serial_date(float(v), late)
    return short_number(v)


def placed(cells: Iterable[tuple[str, str]]) -> list[str]:
    """Texts at the columns of their references; without one, after the last."""
    out: list[str] = []
    for ref, text in cells:
        at = column_of(ref)
        at = len(out) if at < 0 else at
        out += [""] * (at + 1 - len(out))
        out[at] = text
    return out


def _strict(book: Archive, max_sheets: int, max_rows: int) -> Workbook:
    targets, late = sheet_targets(book)
    dates = date_styles(book.text("xl/styles.xml"))
    read: list[tuple[str, list[list[Cell]]]] = []
    for name, part in targets[:max_sheets]:
        chunks = book.chunks(part)
        if chunks is None:
            raise Unreadable(f"no part {part}")
        rows: list[list[Cell]] = []
        for body in units(TextPull(chunks), "row"):
            rows.append(cells_of(body))
            if len(rows) > max_rows:
                break
        read.append((name, rows))
    strings = _shared(book, max((_index(c) for _, rows in read for r in rows for c in r if c.kind == "s"), default=-1))
    sheets = []
    for name, rows in read:
        texts = [placed((c.ref, shown(c, strings, dates, late)) for c in r) for r in rows]
        sheets.append(Sheet(name, texts[:max_rows], len(texts), len(texts) > max_rows))
    return Workbook(sheets, len(targets), "xlsx-stream", [], book.unpacked)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _lenient(book: Archive, max_sheets: int, max_rows: int) -> Workbook:
    """By an XML parser, whatever quotes and prefixes the file uses, within the area that each sheet declares."""

    def tree(name: str | None) -> ET.Element | None:
        data = book.read(name) if name else None
        try:
            return None if data is None else ET.fromstring(data)
        except ET.ParseError:
            return None

    warnings = []
    top, rels = tree("xl/workbook.xml"), tree("xl/_rels/workbook.xml.rels")
    parts = {r.get("Id"): r.get("Target") for r in rels} if rels is not None else {}
    listed: list[tuple[str | None, str | None]] = []
    for e in top.iter() if top is not None else ():
        if _local(e.tag) == "sheet":
            rid = next((v for k, v in e.attrib.items() if _local(k) == "id"), None)
            listed.append((e.get("name"), part_name(parts[rid]) if parts.get(rid) else None))
    late = any(e.get("date1904") in ("1", "true") for e in top.iter()) if top is not None else False
    sheet_parts = sorted((m for m in book.members if re.fullmatch(r"xl/worksheets/[^/]+\.xml", m)), key=lambda m: (len(m), m))
    if not listed:
        listed = [(None, sheet_parts[0])] if sheet_parts else []
    elif len(listed) == 1 and listed[0][1] is None and len(sheet_parts) == 1:
        listed = [(listed[0][0], sheet_parts[0])]
    styles = book.text("xl/styles.xml")
    try:
        dates = date_styles(styles)
    except Unreadable:
        dates = []
        warnings.append("DATE_STYLE_RISK")
    shared = tree("xl/sharedStrings.xml")
    joined = lambda e: "".join(t.text or "" for t in _without_phonetics(e))
    strings = [joined(si) for si in shared if _local(si.tag) == "si"] if shared is not None else []
    sheets = []
    for name, part in listed[:max_sheets]:
        sheet = tree(part)
        if sheet is None:
            raise Unreadable(f"no readable part for sheet {name}")
        declared, rows = None, []
        for e in sheet.iter():
            if _local(e.tag) == "dimension":
                declared = area(e.get("ref") or "")
            elif _local(e.tag) == "row":
                texts = []
                for c in e:
                    if _local(c.tag) == "c":
                        value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                        kind = c.get("t") or ""
                        if kind == "inlineStr":
                            value = "".join(joined(x) for x in c if _local(x.tag) == "is")
                        texts.append((c.get("r") or "", shown(Cell("", kind, c.get("s") or "", value), strings, dates, late)))
                rows.append(placed(texts))
        if declared:
            wide, high = declared
            has = rows[:max_rows]
            lost = max(0, max(map(len, has), default=0) - wide), max(0, len(has) - high)
            if any(lost):
                warnings.append(f"AREA_LOSS: {name or 'Sheet1'}: {lost[0]} columns, {lost[1]} rows")
            rows = [r[:wide] for r in rows[:high]]
        sheets.append(Sheet(name, rows[:max_rows], len(rows), len(rows) > max_rows))
    if not sheets:
        raise Unreadable("damaged, or not an Office document")
    return Workbook(sheets, len(listed), "xlsx-lenient", warnings, book.unpacked)


def _without_phonetics(e: ET.Element) -> Iterator[ET.Element]:
    for c in e:
        if _local(c.tag) == "t":
            yield c
        elif _local(c.tag) != "rPh":
            yield from _without_phonetics(c)


def area(ref: str) -> tuple[int, int] | None:
    """Columns and rows that a reference reaches."""
    found = [re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)?", c.strip()) for c in ref.split(":")[:2]]
    if not all(found) or any(column_of(m[1]) < 0 for m in found):
        return None
    return max(column_of(m[1]) + 1 for m in found), max(int(m[2] or 1) for m in found)


def read_workbook(data: bytes, max_sheets: int = MAX_SHEETS, max_rows: int = MAX_ROWS) -> Workbook:
    """The first rows of the first sheets. Reading stops where the limits are reached, so the bytes unpacked do not grow with the
    file. Where the strict reader is unsure, the lenient one reads, and says what may be lost."""
    import zlib

    try:
        return _strict(Archive(data), max_sheets, max_rows)
    except (Unreadable, zlib.error):
        return _lenient(Archive(data), max_sheets, max_rows)


def write_workbook(sheets: list[tuple[str, list[list[str | float | None]]]], shared: bool = True) -> bytes:
    """A workbook of text and number cells; texts as shared or inline strings."""
    index: dict[str, int] = {}
    parts = []
    for _, rows in sheets:
        lines = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                ref = f"{letters(c)}{r}"
                if v is None:
                    continue
                if not isinstance(v, str):
                    cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
                elif shared:
                    cells.append(f'<c r="{ref}" t="s"><v>{index.setdefault(v, len(index))}</v></c>')
                else:
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    tabs = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
                   f'Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in index)
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    files = [
        ("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'),
        ("xl/workbook.xml", head + '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
         f'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{tabs}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'),
        ("xl/sharedStrings.xml", head + f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{items}</sst>'),
        *((f"xl/worksheets/sheet{i}.xml", head + p) for i, p in enumerate(parts, 1)),
    ]
    return pack_files([(n, x.encode()) for n, x in files])


def letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out
