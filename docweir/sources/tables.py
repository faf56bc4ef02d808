"""One file to many rows: archive members, cells, text runs, blocks and segments as tables.

Each is a map over the documents that goes through their bytes once and keeps one document in memory. A document that cannot be read to its end gives
no rows, or with `errors` one row that holds nothing but the error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows an Arrow batch of results gathers.
BATCH = 5000


def explode_documents(docs: DataFrame, column: str, rows_of: Callable, schema: str, id_col: str = "doc_id", errors: bool = False) -> DataFrame:
    """(doc_id, rows of the document) for each value of a column; rows_of yields tuples. With `errors`, a last column error, which is null but in the only row
    of a document that cannot be read."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", *names, *["error"] * errors]
        for b in batches:
            held: list[tuple] = []
            for doc, value in zip(b["doc_id"], b["value"], strict=True):
                if value is None:
                    continue
                try:
                    own = [(doc, *row, *[None] * errors) for row in rows_of(value)]
                except Exception as e:  # noqa: BLE001  any damage in a file is that file's alone
                    own = [(doc, *[None] * len(names), f"{type(e).__name__}: {e}"[:200])] if errors else []
                held += own
                if len(held) >= BATCH:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=columns)

    given = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(column).alias("value")).mapInPandas(run, f"doc_id {given}, {schema}" + ", error string" * errors)


def zip_entries(docs: DataFrame, column: str = "content", id_col: str = "doc_id", errors: bool = False) -> DataFrame:
    """Members of archives by their directories; nothing is unpacked."""
    from .archive import directory

    rows = lambda data: ((i, m.name, m.method, m.packed, m.size, m.local) for i, m in enumerate(directory(data)))
    return explode_documents(docs, column, rows, "pos int, name string, method int, packed bigint, size bigint, local bigint", id_col, errors)


def workbook_cells(docs: DataFrame, column: str = "content", id_col: str = "doc_id", max_sheets: int = 5, max_rows: int = 1000, errors: bool = False) -> DataFrame:
    """Cells of the first rows of the first sheets as they are shown; reading stops at the limits."""
    from .workbook import read_workbook

    def rows(data: bytes) -> Iterator[tuple]:
        for p, s in enumerate(read_workbook(data, max_sheets, max_rows).sheets):
            for r, row in enumerate(s.rows):
                for c, v in enumerate(row):
                    yield p, s.name, r, c, v

    return explode_documents(docs, column, rows, "sheet_pos int, sheet string, row_idx int, col_idx int, value string", id_col, errors)


def workbook_sheets(docs: DataFrame, column: str = "content", id_col: str = "doc_id", max_sheets: int = 5, max_rows: int = 1000, errors: bool = False) -> DataFrame:
    """Sheets read, with the number of rows scanned (one over the limit if there are more) and the bytes unpacked for the document."""
    from .workbook import read_workbook

    def rows(data: bytes) -> Iterator[tuple]:
        book = read_workbook(data, max_sheets, max_rows)
        for p, s in enumerate(book.sheets):
            yield p, s.name, s.scanned, s.truncated, book.n_sheets, book.engine, book.unpacked

    return explode_documents(docs, column, rows, "sheet_pos int, sheet string, scanned int, truncated boolean, n_sheets int, engine string, unpacked bigint", id_col, errors)


def workbook_parts(docs: DataFrame, column: str = "content", id_col: str = "doc_id", max_sheets: int = 5, max_rows: int = 1000, errors: bool = False) -> DataFrame:
    """The tables inside a workbook, unjoined, as rows of a kind: book (flag dates from 1904), sheet (key relation, text name), relation (key, text part),
    string (num index, text), style (num index, flag date), cell (part, row_idx, cell_pos, key reference, kind, num style, text value as stated).

    Reading stops at the limits: cells of the first rows of the first sheets, and strings up to the last one that these cells name.
    """
    import re

    from .archive import Archive, TextPull
    from .workbook import attribute, cells_of, date_styles, entities, part_name, starts_1904, strings_in, units

    def rows(data: bytes) -> Iterator[tuple]:
        book = Archive(data)
        top, rels = book.text("xl/workbook.xml") or "", book.text("xl/_rels/workbook.xml.rels") or ""
        yield "book", None, None, None, None, None, None, None, starts_1904(top)
        wanted = []
        for i, tag in enumerate(re.findall(r"<sheet\s[^>]*>", top)):
            wanted.append(attribute(tag, "r:id"))
            yield "sheet", i, attribute(tag, "r:id"), entities(attribute(tag, "name") or ""), None, None, None, None, None
        parts = {}
        for tag in re.findall(r"<Relationship\s[^>]*>", rels):
            part = part_name(attribute(tag, "Target") or "")
            parts[attribute(tag, "Id")] = part
            yield "relation", None, attribute(tag, "Id"), part, None, None, None, None, None
        for i, flag in enumerate(date_styles(book.text("xl/styles.xml"))):
            yield "style", i, None, None, None, None, None, None, flag
        last = -1
        for part in dict.fromkeys(parts[w] for w in wanted[:max_sheets] if w in parts):
            chunks = book.chunks(part)
            for r, body in enumerate(units(TextPull(chunks), "row") if chunks is not None else ()):
                if r >= max_rows:
                    break
                for p, c in enumerate(cells_of(body)):
                    if c.kind == "s" and c.value.strip().isdigit():
                        last = max(last, int(c.value))
                    stated = c.value if c.kind == "inlineStr" else entities(c.value)
                    yield "cell", int(c.style) if c.style.isdigit() else None, c.ref, stated, part, r, p, c.kind, None
        chunks = book.chunks("xl/sharedStrings.xml") if last >= 0 else None
        for i, body in enumerate(units(TextPull(chunks), "si") if chunks is not None else ()):
            yield "string", i, None, strings_in(body), None, None, None, None, None
            if i >= last:
                break

    return explode_documents(docs, column, rows, "what string, num int, key string, text string, part string, row_idx int, cell_pos int, kind string, flag boolean", id_col, errors)


def pdf_text_runs(docs: DataFrame, column: str = "content", id_col: str = "doc_id", errors: bool = False) -> DataFrame:
    """Positioned text of PDF pages; `mono` tells the fonts that are monospace over the whole document, which is at hand here."""
    from .pdf import monospace_fonts, page_runs

    def rows(data: bytes) -> Iterator[tuple]:
        pages = page_runs(data)
        mono = monospace_fonts(pages)
        for runs in pages:
            for r in runs:
                yield (r.page, r.seq, r.str, float(r.x), float(r.y), float(r.sy), float(r.w), float(r.font_size), r.font_id, r.glyph_widths, r.ascii, r.letters, r.font_id in mono)

    return explode_documents(docs, column, rows, "page int, seq int, str string, x double, y double, sy double, w double, font_size double, font_id string, "
                             "glyph_widths array<double>, ascii int, letters int, mono boolean", id_col, errors)


def pdf_pages(docs: DataFrame, column: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_pages, error): one row per document, whatever its state."""
    from .pdf import Pdf, PdfError

    def rows(data: bytes) -> Iterator[tuple]:
        try:
            n = sum(1 for _ in Pdf(data).pages())
            yield n, None if n else "NO_PAGES"
        except PdfError as e:
            yield 0, str(e)
        except Exception as e:  # noqa: BLE001
            yield 0, f"DAMAGED_PDF: {type(e).__name__}"

    return explode_documents(docs, column, rows, "n_pages int, error string", id_col)


def html_block_rows(docs: DataFrame, column: str = "html", id_col: str = "doc_id", errors: bool = False) -> DataFrame:
    """Blocks of pages in order."""
    from .markdown import html_blocks

    return explode_documents(docs, column, lambda html: ((i, b.kind, b.md) for i, b in enumerate(html_blocks(html)[0])), "pos int, kind string, md string", id_col, errors)


def markdown_segments(docs: DataFrame, column: str = "markdown", id_col: str = "doc_id", limit: int = 256 * 1024, errors: bool = False) -> DataFrame:
    """Segments of texts that are cheap to show."""
    from docweir.operators.preview import segments

    rows = lambda text: ((i, a, b, note) for i, (a, b, note) in enumerate(segments(text, limit)))
    return explode_documents(docs, column, rows, "seg_no int, start int, `end` int, note string".replace("`", ""), id_col, errors)
