"""Functions and table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udf, udtf
from pyspark.sql.types import StringType


def register_all(spark: SparkSession) -> list[str]:
    """Registers the parsers for SQL and returns their names:

    md_from_html(html), text_of(content), md_from_docx(content), md_from_xlsx(content), md_from_pdf(content), and the table functions
    zip_entries(content), xlsx_cells(content, max_sheets, max_rows), pdf_text_runs(content), md_segments(text, limit).
    A damaged document gives null, or no rows.
    """

    def quiet(f):
        def run(x):
            try:
                return None if x is None else f(x)
            except Exception:  # noqa: BLE001  one document's damage is its own
                return None

        return udf(run, StringType(), useArrow=True)

    def html(x):
        from docweir.sources.markdown import html_to_markdown

        return html_to_markdown(x)[0]

    def text(x):
        from docweir.sources.charset import decode_text

        return decode_text(x)

    def docx(x):
        from docweir.sources.docx import convert_docx

        return convert_docx(x).markdown

    def xlsx(x):
        from docweir.sources.workbook import read_workbook

        return read_workbook(x).markdown()

    def pdf(x):
        from docweir.sources.pdf import document_markdown

        return document_markdown(x)[0]

    scalar = {"md_from_html": html, "text_of": text, "md_from_docx": docx, "md_from_xlsx": xlsx, "md_from_pdf": pdf}
    for name, f in scalar.items():
        spark.udf.register(name, quiet(f))

    class ZipEntries:
        def eval(self, content: bytes):
            from docweir.sources.archive import directory

            for i, m in enumerate(directory(content or b"")):
                yield i, m.name, m.method, m.packed, m.size, m.local

    class XlsxCells:
        def eval(self, content: bytes, max_sheets: int, max_rows: int):
            from docweir.sources.workbook import read_workbook

            try:
                book = read_workbook(content, max_sheets, max_rows)
            except Exception:  # noqa: BLE001
                return
            for p, s in enumerate(book.sheets):
                for r, row in enumerate(s.rows):
                    for c, v in enumerate(row):
                        yield p, s.name, r, c, v

    class PdfTextRuns:
        def eval(self, content: bytes):
            from docweir.sources.pdf import page_runs

            try:
                pages = page_runs(content)
            except Exception:  # noqa: BLE001
                return
            for runs in pages:
                for r in runs:
                    yield r.page, r.seq, r.str, float(r.x), float(r.sy), float(r.w), float(r.font_size), r.font_id

    class MdSegments:
        def eval(self, text: str, limit: int):
            from docweir.operators.preview import segments

            for i, (a, b, note) in enumerate(segments(text or "", limit)):
                yield i, a, b, note

    tables = {
        "zip_entries": (ZipEntries, "pos int, name string, method int, packed bigint, size bigint, local bigint"),
        "xlsx_cells": (XlsxCells, "sheet_pos int, sheet string, row_idx int, col_idx int, value string"),
        "pdf_text_runs": (PdfTextRuns, "page int, seq int, str string, x double, sy double, w double, font_size double, font_id string"),
        "md_segments": (MdSegments, "seg_no int, start_at int, end_at int, note string"),
    }
    for name, (cls, schema) in tables.items():
        spark.udtf.register(name, udtf(cls, returnType=schema))
    return [*scalar, *tables]
