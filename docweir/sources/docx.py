"""DOCX documents as Markdown, with formulas as LaTeX and images as assets."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

from docweir.functions.chars import PY_WS

from .archive import Archive, pack_files
from .htmltree import Element
from .markdown import Writer, fold, trim

# Name spaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PIC = "{http://schemas.openxmlformats.org/drawingml/2006/picture}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Raised and lowered characters, and what they are raised and lowered from.
_RAISED = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹ⁿᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻ", "0123456789nabcdefghijklmoprstuvwxyz", strict=True))
_LOWERED = dict(zip("₀₁₂₃₄₅₆₇₈₉ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ", "0123456789aehijklmnoprstuvx", strict=True))
_TEX = str.maketrans({k: f"^{v}" for k, v in _RAISED.items()} | {k: f"_{v}" for k, v in _LOWERED.items()})
_OPEN, _CLOSE = "\ue000", "\ue001"  # around the number of a formula while the text is laid out
_OFF = ("false", "0", "off")


class Damaged(ValueError):
    pass


@dataclass
class Asset:
    name: str
    content: bytes
    type: str


@dataclass
class Converted:
    markdown: str
    warnings: list[str]
    assets: list[Asset]


def _texts(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter(M + "t"))


def _direct(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    """Children of the given names, also within content controls and marked changes, but not within other elements."""
    for c in e:
        match c.tag.rpartition("}")[2]:
            case name if name in names:
                yield c
            case "sdt" | "sdtContent" | "ins" | "smartTag" | "customXml":
                yield from _direct(c, *names)


class Formula:
    """LaTeX of an oMath element; what it has no form for stays as plain text, and is noted."""

    def __init__(self, e: ET.Element):
        self.plain = False
        self.latex = trim("".join(map(self._of, e)))
        self.raw = trim(fold("".join(e.itertext()).translate(_TEX)))
        self.plain = self.plain or (not self.latex and bool(self.raw))

    def _in(self, e: ET.Element | None) -> str:
        return "" if e is None else "".join(map(self._of, e))

    def _part(self, e: ET.Element, name: str) -> str:
        return self._in(e.find(M + name))

    def _of(self, e: ET.Element) -> str:
        match e.tag.removeprefix(M):
            case "t":
                return (e.text or "").translate(_TEX)
            case "r" | "oMath" | "oMathPara":
                return self._in(e)
            case "f":
                return rf"\frac{{{self._part(e, 'num')}}}{{{self._part(e, 'den')}}}"
            case "sSup":
                return f"{self._part(e, 'e')}^{{{self._part(e, 'sup')}}}"
            case "sSub":
                return f"{self._part(e, 'e')}_{{{self._part(e, 'sub')}}}"
            case "sSubSup":
                return f"{self._part(e, 'e')}_{{{self._part(e, 'sub')}}}^{{{self._part(e, 'sup')}}}"
            case "rad":
                degree = self._part(e, "deg")
                return rf"\sqrt{f'[{degree}]' if degree else ''}{{{self._part(e, 'e')}}}"
            case "d":
                pr = e.find(M + "dPr")
                given = lambda n, d: next((x.get(M + "val") or d for x in (pr if pr is not None else ()) if x.tag == M + n), e.get(M + n) or e.get(n) or d)
                return given("begChr", "(") + self._part(e, "e") + given("endChr", ")")
        text = trim(fold("".join(e.itertext()).translate(_TEX)))
        if text:
            self.plain = True
            return text
        return self._in(e)


class Document:
    """The parts of a package that text needs, and the tree they make."""

    def __init__(self, data: bytes, name: str):
        self.zip = Archive(data)
        if not self.zip.members:
            raise Damaged("DAMAGED_ARCHIVE")
        body = self._xml("word/document.xml")
        if body is None:
            raise Damaged("NO_DOCUMENT_PART" if "word/document.xml" not in self.zip.members else "DAMAGED_DOCUMENT_PART")
        self.body = body
        self.base = re.sub(r'[\\/:*?"<>|\s]+', "-", re.sub(r"\.docx$", "", name or "doc", flags=re.IGNORECASE))[:64] or "doc"
        rels = self._xml("word/_rels/document.xml.rels")
        self.rels = {r.get("Id"): r.get("Target") or "" for r in rels} if rels is not None else {}
        self.headings = self._headings(self._xml("word/styles.xml"))
        self.ordered = self._numbering(self._xml("word/numbering.xml"))
        self.formulas: list[tuple[Formula, bool]] = []
        self.assets: list[Asset] = []
        self.notes = 0

    def _xml(self, name: str) -> ET.Element | None:
        data = self.zip.read(name)
        try:
            return None if data is None else ET.fromstring(data)
        except ET.ParseError:
            return None

    def _headings(self, styles: ET.Element | None) -> dict[str, int]:
        out = {f"Heading{i}": i for i in range(1, 7)}
        for s in styles.iter(W + "style") if styles is not None else ():
            name = s.find(W + "name")
            m = re.fullmatch(r"heading ([1-6])", (name.get(W + "val") or "").lower()) if name is not None else None
            if m:
                out[s.get(W + "styleId") or ""] = int(m[1])
        return out

    def _numbering(self, xml: ET.Element | None) -> dict[tuple[str, str], bool]:
        """(list, level) -> whether it counts."""
        if xml is None:
            return {}
        kinds = {}
        for a in xml.findall(W + "abstractNum"):
            for lvl in a.findall(W + "lvl"):
                fmt = lvl.find(W + "numFmt")
                kinds[a.get(W + "abstractNumId"), lvl.get(W + "ilvl")] = fmt is not None and fmt.get(W + "val") not in ("bullet", "none")
        out = {}
        for n in xml.findall(W + "num"):
            a = n.find(W + "abstractNumId")
            out |= {(n.get(W + "numId"), lvl): v for (x, lvl), v in kinds.items() if a is not None and x == a.get(W + "val")}
        return out

    # -- paragraphs ----------------------------------------------------------------------------------------------------------------

    def tree(self) -> Element:
        top = Element("body")
        inner = self.body.find(W + "body")
        self._blocks(inner if inner is not None else self.body, top)
        return top

    def _blocks(self, of: ET.Element, to: Element) -> None:
        lists: list[Element] = []  # open lists, outermost first
        for e in of:
            if e.tag in (W + "sdt",):
                content = e.find(W + "sdtContent")
                if content is not None:
                    self._blocks(content, to)
                continue
            if e.tag == W + "tbl":
                lists.clear()
                to.append(self._table(e))
            elif e.tag == M + "oMathPara":
                lists.clear()
                p = Element("p")
                self._formula(e, p)
                to.append(p)
            elif e.tag == W + "p":
                style = e.find(f"{W}pPr/{W}pStyle")
                level = self.headings.get(style.get(W + "val") or "") if style is not None else None
                number, depth = (e.find(f"{W}pPr/{W}numPr/{W}{n}") for n in ("numId", "ilvl"))
                if level is None and number is not None and number.get(W + "val") != "0":
                    self._item(e, number.get(W + "val"), depth.get(W + "val") if depth is not None else "0", lists, to)
                    continue
                lists.clear()
                p = Element(f"h{level}" if level else "p")
                self._inlines(e, p)
                to.append(p)

    def _item(self, e: ET.Element, number: str, depth: str, lists: list[Element], to: Element) -> None:
        kind = "ol" if self.ordered.get((number, depth)) else "ul"
        at = int(depth) if depth.isdigit() else 0
        del lists[at + 1 :]
        if len(lists) == at + 1 and lists[-1].tag != kind:
            lists.pop()
        while len(lists) < at + 1:
            new = Element(kind)
            if lists and lists[-1].elements():
                lists[-1].elements()[-1].append(new)
            elif lists:
                li = Element("li")
                lists[-1].append(li)
                li.append(new)
            else:
                to.append(new)
            lists.append(new)
        li = Element("li")
        self._inlines(e, li)
        lists[-1].append(li)

    def _table(self, e: ET.Element) -> Element:
        table = Element("table")
        for tr in _direct(e, "tr"):
            row = Element("tr")
            for tc in _direct(tr, "tc"):
                span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
                cell = Element("td", {"colspan": span.get(W + "val") or "1"} if span is not None else {})
                if merge is not None:
                    cell.attrs["rowspan"] = "2"
                for part in _direct(tc, "p", "tbl"):
                    if cell.children:
                        cell.append(" ")
                    if part.tag == W + "tbl":  # the writer takes its text
                        cell.append(self._table(part))
                    else:
                        self._inlines(part, cell)
                row.append(cell)
            table.append(row)
        return table

    # -- runs ----------------------------------------------------------------------------------------------------------------------

    def _inlines(self, of: ET.Element, to: Element) -> None:
        for e in of:
            match e.tag.rpartition("}")[2]:
                case "r":
                    self._run(e, to)
                case "hyperlink":
                    link = Element("a", {"href": self.rels.get(e.get(R + "id") or "", "#" + (e.get(W + "anchor") or ""))})
                    self._inlines(e, link)
                    to.append(link)
                case "ins" | "smartTag" | "sdtContent" | "fldSimple":
                    self._inlines(e, to)
                case "sdt":
                    content = e.find(W + "sdtContent")
                    if content is not None:
                        self._inlines(content, to)
                case "oMath" | "oMathPara":
                    self._formula(e, to)

    def _on(self, pr: ET.Element | None, name: str) -> bool:
        found = pr.find(W + name) if pr is not None else None
        return found is not None and (found.get(W + "val") or "true").strip(PY_WS).lower() not in _OFF

    def _run(self, e: ET.Element, to: Element) -> None:
        pr = e.find(W + "rPr")
        for name, tag in (("b", "strong"), ("i", "em"), ("strike", "s"), ("dstrike", "s")):
            if self._on(pr, name) and not (name == "dstrike" and to.tag == "s"):
                # Neighbouring runs of one look are one element.
                last = to.children[-1] if to.children else None
                if isinstance(last, Element) and last.tag == tag:
                    to = last
                else:
                    new = Element(tag)
                    to.append(new)
                    to = new
        for c in e:
            match c.tag.rpartition("}")[2]:
                case "t":
                    to.append(c.text or "")
                case "tab":
                    to.append("\t")
                case "br" | "cr":
                    to.append(Element("br"))
                case "drawing" | "pict" | "object":
                    self._images(c, to)
                case "footnoteReference" | "endnoteReference" | "commentReference":
                    self.notes += 1

    def _images(self, e: ET.Element, to: Element) -> None:
        for blip in e.iter(A + "blip"):
            pic = next((p for p in e.iter(PIC + "cNvPr")), None)
            clean = lambda k: trim(fold(pic.get(k) or "")) if pic is not None else ""
            alt = re.sub(r"\.[A-Za-z0-9]{1,8}$", "", clean("descr") or clean("name"))
            part = self.rels.get(blip.get(R + "embed") or "", "")
            data = self.zip.read(part.lstrip("/") if part.startswith("/") else f"word/{part}") if part else None
            if not data:
                to.append(Element("img", {"src": "", "alt": ""}))
                continue
            ext = part.rpartition(".")[2].lower()
            kind = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "svg": "image/svg+xml"}.get(ext, f"image/{ext or 'png'}")
            ext = {"jpeg": "jpg", "tiff": "tif"}.get(ext, ext or "png")
            asset = Asset(f"assets/{self.base}-{len(self.assets) + 1}.{ext}", data, kind)
            self.assets.append(asset)
            to.append(Element("img", {"src": asset.name, "alt": alt}))

    def _formula(self, e: ET.Element, to: Element) -> None:
        """A display formula only if its paragraph holds just one."""
        found = [e] if e.tag == M + "oMath" else list(e.iter(M + "oMath"))
        for o in found:
            self.formulas.append((Formula(o), e.tag == M + "oMathPara" and len(found) == 1))
            to.append(f"{_OPEN}{len(self.formulas) - 1}{_CLOSE}")


def convert_docx(data: bytes, name: str = "") -> Converted:
    doc = Document(data, name)
    writer = Writer()
    blocks = writer.blocks(doc.tree())
    text = trim(re.sub(r"\n{3,}", "\n\n", "\n\n".join(b.md for b in blocks)))

    def formula(m: re.Match) -> str:
        f, display = doc.formulas[int(m[1])]
        mark = "$$" if display else "$"
        return f"{mark}{f.latex}{mark}" if f.latex else f.raw

    text = re.sub(f"{_OPEN}(\\d+){_CLOSE}", formula, text)
    warnings = list(writer.warnings)
    if plain := sum(f.plain for f, _ in doc.formulas):
        warnings.append(f"PLAIN_FORMULAS: {plain}")
    if doc.notes:
        warnings.append(f"APPROXIMATE_STYLES: {doc.notes}")
    if doc.assets:
        warnings.append(f"ASSETS: {len(doc.assets)}")
    return Converted(text, warnings, doc.assets)


def write_docx(paragraphs: list[str]) -> bytes:
    """A document of plain paragraphs."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p, quote=False)}</w:t></w:r></w:p>' for p in paragraphs)
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'
    return pack_files([("[Content_Types].xml", b'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'),
                       ("word/document.xml", xml.encode())])
