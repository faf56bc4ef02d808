"""A document tree as Markdown."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from docweir.functions.chars import PY_SPACE, PY_WS

from .htmltree import Element, parse_html

MAX_SPAN = 100
# Elements whose text is not content, and those that stand as blocks of their own.
SILENT = frozenset("script style noscript head template svg canvas object iframe embed audio video select option textarea button".split())
BLOCKS = frozenset(
    "h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote table pre hr div section article header footer main aside figure figcaption address nav".split())
WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "s": "~~", "del": "~~", "strike": "~~"}
# Targets that are dropped, and a text that is one image.
_BAD_SCHEME = re.compile(rf"[{PY_WS}]*(javascript|vbscript|data):", re.IGNORECASE)
_IMAGE = re.compile(rf"[{PY_WS}]*!\[[^\]]*\]\([^)]*\)[{PY_WS}]*\Z")
_INTEGER = re.compile(rf"[{PY_WS}]*([+-]?\d+)", re.ASCII)


class Piece(NamedTuple):
    """Inline Markdown, and whether the source has white space just inside its ends."""

    text: str
    before: bool = False
    after: bool = False


def fold(s: str) -> str:
    return PY_SPACE.sub(" ", s)


def trim(s: str) -> str:
    return s.strip(PY_WS)


def piece_of(raw: str, text: str) -> Piece:
    return Piece(text, raw[:1] in PY_WS and raw != "", raw[-1:] in PY_WS and raw != "")


def weave(pieces: list[Piece]) -> str:
    """Pieces on end; where the source has white space at a seam and neither side shows it, one space."""
    out, gap = "", False
    for p in pieces:
        if not p.text:
            continue
        seam = (gap or p.before) and out and out[-1] not in PY_WS and p.text[0] not in PY_WS
        out += (" " if seam else "") + p.text
        gap = p.after
    return out


def target(url: str) -> str:
    return re.sub(f"[{PY_WS}]", "%20", url.replace("(", "%28").replace(")", "%29"))


def fence_for(text: str, least: int) -> str:
    """Backticks enough to hold the text: one more than its longest run."""
    return "`" * max(least, max(map(len, re.findall("`+", text)), default=0) + 1)


def integer(s: str | None) -> int | None:
    m = _INTEGER.match(s or "")
    return int(m[1]) if m else None


@dataclass
class Block:
    kind: str
    md: str


@dataclass
class Writer:
    """Turns elements into blocks; notes what the reader should be warned of."""

    warnings: list[str] = field(default_factory=list)

    # -- inline -------------------------------------------------------------------------------------------------------------------

    def inline(self, e: Element, br: str) -> list[Piece]:
        """The children of an element as pieces; `br` is what a line break becomes."""
        out: list[Piece] = []
        for c in e.children:
            if isinstance(c, str):
                if c:
                    out.append(piece_of(c, fold(c)))
            else:
                out += self.inline_of(c, br)
        return out

    def line(self, e: Element, br: str) -> str:
        return trim(weave(self.inline(e, br)))

    def inline_of(self, e: Element, br: str) -> list[Piece]:
        match e.tag:
            case "br":
                return [Piece(br)]
            case "img":
                alt = fold(e.attrs.get("alt", "")).replace("]", "%5D")
                return [Piece(f"![{alt}]({target(e.attrs.get('src', ''))})")]
            case "code":
                body = trim(e.text)
                if not body:
                    return []
                fence = fence_for(body, 1)
                pad = " " if "`" in (body[0], body[-1]) else ""
                return [piece_of(e.text, fence + pad + body + pad + fence)]
            case "a":
                body = self.line(e, br)
                if not body:
                    return []
                href = e.attrs.get("href", "")
                href = "" if _BAD_SCHEME.match(href) else target(href)
                if not (_IMAGE.match(body) and any(x.tag == "img" for x in e.walk())):
                    body = body.replace("]", "\\]")
                return [piece_of(e.text, f"[{body}]({href})")]
            case tag if tag in WRAP:
                body = self.line(e, br)
                return [piece_of(e.text, WRAP[tag] + body + WRAP[tag])] if body else []
        return self.inline(e, br)

    # -- blocks -------------------------------------------------------------------------------------------------------------------

    def blocks(self, e: Element) -> list[Block]:
        """The content of a container: its block children, and the text between them as paragraphs."""
        out: list[Block] = []
        run: list[Piece] = []

        def paragraph() -> None:
            text = trim(weave(run))
            run.clear()
            if text:
                out.append(Block("paragraph", text))

        for c in e.children:
            if isinstance(c, str):
                if c:
                    run.append(piece_of(c, fold(c)))
            elif c.tag in BLOCKS:
                paragraph()
                out += self.block(c)
            else:
                run += self.inline_of(c, "\n")
        paragraph()
        return out

    def block(self, e: Element) -> list[Block]:
        match e.tag:
            case "h1" | "h2" | "h3" | "h4" | "h5" | "h6":
                text = self.line(e, "<br>")
                made = Block("heading", f"{'#' * int(e.tag[1])} {text}") if text else None
            case "p":
                made = Block("paragraph", self.line(e, "\n"))
            case "li":  # without a list around it
                text = self.line(e, "\n")
                made = Block("list", f"- {text}") if text else None
            case "ul" | "ol":
                made = Block("list", "\n".join(self.list_lines(e, 0)))
            case "blockquote":
                made = Block("quote", self.quote(e))
            case "table":
                made = Block("table", self.table(e))
            case "pre":
                text = e.text.removeprefix("\n").removesuffix("\n")
                fence = fence_for(text, 3)
                return [Block("code", f"{fence}\n{text}\n{fence}")]
            case "hr":
                return [Block("rule", "---")]
            case _:
                return self.blocks(e)
        return [made] if made and made.md else []

    def quote(self, e: Element) -> str:
        parts = ["\n".join(f"> {x}" if trim(x) else ">" for x in b.md.split("\n")) for b in self.blocks(e)]
        return "\n>\n".join(parts)

    def list_lines(self, e: Element, indent: int) -> list[str]:
        start = integer(e.attrs.get("start"))
        number = 1 if start is None else start
        out: list[str] = []
        for item in e.elements():
            if item.tag == "li":
                marker = f"{number}. " if e.tag == "ol" else "- "
                out += self.item_lines(item, indent, marker)
                number += 1
        return "\n".join(out).split("\n") if out else []

    def _item_parts(self, item: Element) -> list[list[Piece] | Element]:
        """The content of an item in turn: runs of inline pieces, and the elements that break them."""
        parts: list[list[Piece] | Element] = [[]]
        for c in item.children:
            if isinstance(c, Element) and c.tag in BLOCKS and c.tag != "li":
                parts += [c, []]
            elif isinstance(c, Element):
                parts[-1] += self.inline_of(c, "\n")
            elif c:
                parts[-1].append(piece_of(c, fold(c)))
        return parts

    def item_lines(self, item: Element, indent: int, marker: str) -> list[str]:
        """The first line after the marker; what follows a block is set off by an empty line and indented by the marker's width."""
        lead, cont = " " * indent, " " * (indent + len(marker))
        out: list[str] = []
        marked = had_list = had_block = False
        parts = self._item_parts(item)
        carried: list[Piece] = []
        for i, part in enumerate(parts):
            if isinstance(part, Element):
                if part.tag in ("ul", "ol"):
                    out += self.list_lines(part, indent + len(marker))
                    had_list = True
                    continue
                for b in self.block(part):
                    first, *more = b.md.split("\n")
                    out += ["", cont + first] if marked else [lead + marker + first]
                    out += [cont + x for x in more]
                    marked = had_block = True
                continue
            run = carried + part
            carried = []
            text = trim(weave(run))
            if i < len(parts) - 1:
                if text:
                    out.append(lead + marker + text)
                    marked = True
                elif parts[i + 1].tag not in ("ul", "ol"):
                    carried = run  # white space goes on to the text after the block
            elif text:
                first, *more = text.split("\n")
                out += [""] * had_block + [(cont if had_list or had_block else lead + marker) + first] + [cont + x for x in more]
        return out

    # -- tables -------------------------------------------------------------------------------------------------------------------

    def span(self, cell: Element, name: str) -> int:
        n = integer(cell.attrs.get(name)) or 1
        return min(max(n, 1), MAX_SPAN)

    def cells(self, row: Element) -> list[str]:
        out: list[str] = []
        for c in row.elements():
            if c.tag in ("td", "th"):
                wide = self.span(c, "colspan")
                if (wide > 1 or self.span(c, "rowspan") > 1) and "MERGED_CELLS" not in self.warnings:
                    self.warnings.append("MERGED_CELLS")
                out += [self.line(c, " ").replace("|", "\\|").replace("\n", " "), *[""] * (wide - 1)]
        return out

    def table(self, e: Element) -> str:
        rows = []
        for part in e.elements():
            rows += [part] if part.tag == "tr" else [r for r in part.elements() if r.tag == "tr"] if part.tag in ("thead", "tbody", "tfoot") else []
        return table_lines([c for c in map(self.cells, rows) if c])


def table_lines(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    head, *rest = (f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows)
    return "\n".join([head, f"| {' | '.join(['---'] * width)} |", *rest])


def html_blocks(html: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page in order, and warnings."""
    body = parse_html(html)
    for e in list(body.walk()):
        if e.tag in SILENT:
            e.detach()
    w = Writer()
    out = w.blocks(body)
    for b in out:
        if not (b.md.startswith("```") and b.md.rstrip(PY_WS).endswith("```")):
            b.md = re.sub(r"\n{3,}", "\n\n", b.md)
    return out, w.warnings


def html_to_markdown(html: str) -> tuple[str, list[str]]:
    blocks, warnings = html_blocks(html)
    return trim("\n\n".join(b.md for b in blocks)), warnings
