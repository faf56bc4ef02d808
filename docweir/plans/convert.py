"""Files to Markdown: guard, sniff, route each type to its converter, and one row per document in the end."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType)

from docweir.functions.sniffing import HTML_TAGS, guard, looks_like_html, sniff, unsupported
from docweir.functions.text import normalize_text, truncation_notice
from docweir.operators.layout import arbitrate_ocr, assemble_pages, page_markdown, text_lines
from docweir.sources.tables import pdf_pages, pdf_text_runs

ASSETS = ArrayType(StructType([StructField("name", StringType()), StructField("content", BinaryType()), StructField("size", LongType()), StructField("type", StringType())]))
SCAN = StructType([StructField("bytes", LongType()), StructField("rows", LongType())])
RESULT = StructType([StructField("markdown", StringType()), StructField("warnings", ArrayType(StringType())), StructField("error", StringType()),
                     StructField("truncated", BooleanType()), StructField("assets", ASSETS), StructField("scan", SCAN), StructField("backend", StringType()), StructField("elapsed_ms", LongType())])
OWN = ["doc_id", "name", "size", "type", "detail", "ole2_subtype"]


def _html(name: str | None, content: bytes) -> dict:
    from docweir.sources.charset import decode_text
    from docweir.sources.markdown import html_to_markdown

    md, warnings = html_to_markdown(decode_text(content))
    return {"markdown": md, "warnings": warnings, "backend": "html"}


def _text(name: str | None, content: bytes) -> dict:
    """Text that is not plain UTF-8; what it says may turn out to be HTML."""
    from docweir.functions.chars import PY_WS
    from docweir.sources.charset import decode_text

    text = decode_text(content)
    if _HTML.search(text[:2000]):
        return _html(name, content)
    text = re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n")).strip(PY_WS)
    return {"markdown": text, "backend": "text"}


def _xlsx(name: str | None, content: bytes) -> dict:
    from docweir.sources.workbook import read_workbook

    book = read_workbook(content)
    return {"markdown": book.markdown(), "warnings": book.all_warnings(), "truncated": book.truncated, "backend": book.engine,
            "scan": {"bytes": book.unpacked, "rows": book.n_rows}}


def _docx(name: str | None, content: bytes) -> dict:
    from docweir.sources.docx import convert_docx

    out = convert_docx(content, name or "")
    return {"markdown": out.markdown, "warnings": out.warnings, "backend": "docx",
            "assets": [{"name": a.name, "content": a.content, "size": len(a.content), "type": a.type} for a in out.assets]}


def _pdf(name: str | None, content: bytes, recognise: Recogniser | None = None) -> dict:
    from docweir.sources.ocr import recognised
    from docweir.sources.pdf import document_markdown

    md, warnings, n_ocr = document_markdown(content, recognise and (lambda page: recognised(recognise(content, page)[0])))
    return {"markdown": md, "warnings": warnings, "backend": "pdf+ocr" if n_ocr else "pdf"}


def _image(name: str | None, content: bytes, recognise: Recogniser | None = None) -> dict:
    """A first attempt, and where it is poor a second one, turned; the better one counts."""
    from docweir.sources.ocr import best_attempt

    if recognise is None:
        raise ValueError("OCR_UNAVAILABLE")
    text, warnings = best_attempt(lambda attempt: recognise(content, attempt))
    return {"markdown": text, "warnings": warnings, "backend": "ocr"}


#: A recogniser of images: (content, page number or attempt) -> (text, confidence or None). None is installed here.
Recogniser = Callable[[bytes, int], tuple[str, int | None]]
_HTML = re.compile(HTML_TAGS)
#: route -> converter of one document's bytes; more can be registered.
REGISTRY: dict[str, Callable[..., dict]] = {"html": _html, "text": _text, "xlsx": _xlsx, "docx": _docx, "pdf": _pdf, "image": _image}


def _converter(registry: dict[str, Callable[..., dict]], recognise: Recogniser | None) -> Callable:
    """One function for all documents that need Python; a document's failure is its own."""

    @F.udf(RESULT, useArrow=True)
    def run(route, name, content):
        if content is None:
            return None
        more = {"recognise": recognise} if route in ("pdf", "image") else {}
        began = time.perf_counter()
        try:
            made = registry[route](name, content, **more)
        except Exception as e:  # noqa: BLE001
            said = str(e) if re.fullmatch("[A-Z_0-9]+", str(e)) else f"{type(e).__name__}: {e}"
            made = {"markdown": "", "error": said}
        return {"warnings": [], "error": None, "truncated": False, "assets": None, "scan": None, "backend": None,
                "elapsed_ms": round(1000 * (time.perf_counter() - began))} | made

    return run


def typed(files: DataFrame) -> DataFrame:
    """Files (doc_id, name, content) with size, type, detail, ole2_subtype and guard error.

    The type is generated as a row of its own, so that Spark works it out once and not again in each condition that asks for it.
    """
    size = F.col("length") if "length" in files.columns else F.octet_length("content").cast("bigint")
    return files.select("doc_id", "name", size.alias("size"), "content", F.explode(F.array(sniff(F.col("content")))).alias("_s")).select(
        "doc_id", "name", "size", "content", "_s.*", guard(F.col("size")).alias("_guard"))


def convert(files: DataFrame, registry: dict[str, Callable[..., dict]] | None = None, recognise: Recogniser | None = None) -> DataFrame:
    """documents_md: one row per file with its type, Markdown, warnings, assets or error; error and Markdown exclude each other. elapsed_ms is
    the time a document took in Python, null for others; it differs from run to run.

    One pass over the files, without a shuffle. Plain UTF-8 text is cleaned by Spark itself. All else goes through one Python function,
    which gets a null instead of the content of documents it has no part in, so their bytes do not leave the JVM.
    """
    registry = REGISTRY | (registry or {})
    rows = typed(files)
    error = F.coalesce("_guard", F.when(~F.col("type").isin(*registry), F.coalesce(unsupported(F.col("type"), F.col("ole2_subtype")), F.lit("UNSUPPORTED_TYPE"))))
    text = F.col("content").cast("string")
    plain = F.is_valid_utf8(text) & ~F.hex(F.substring("content", 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    html_name = F.coalesce(F.lower("name").rlike(r"\.html?$"), F.lit(False))
    html = html_name | (plain & looks_like_html(F.lit(None).cast("string"), text))
    route = F.when(error.isNotNull(), "error").when(F.col("type") != "text", F.col("type")).when(html, "html").when(plain, "plain").otherwise("text")
    routed = rows.withColumn("_route", F.explode(F.array(route)))
    python = ~F.col("_route").isin("error", "plain")
    result = _converter(registry, recognise)("_route", "name", F.when(python, F.col("content")))
    made = routed.select(*OWN, "_route", "_guard", F.when(F.col("_route") == "plain", normalize_text(text)).alias("_plain"), error.alias("_error"),
                         result.alias("_r"))
    failed = F.coalesce("_error", "_r.error")
    warnings = F.coalesce("_r.warnings", F.array().cast("array<string>"))
    md = F.coalesce("_plain", "_r.markdown", F.lit(""))
    cut = F.coalesce("_r.truncated", F.lit(False))
    return made.select(
        *OWN, F.when(failed.isNotNull(), "").when(cut, truncation_notice(md, warnings)).otherwise(md).alias("markdown"), warnings.alias("warnings"),
        failed.alias("error"), cut.alias("truncated"), F.col("_r.assets").alias("assets"), F.col("_r.scan").alias("scan"),
        F.coalesce(F.col("_r.backend"), F.when(F.col("_route") == "plain", "text")).alias("backend"), F.col("_r.elapsed_ms").alias("elapsed_ms"))


def convert_pdf_tables(docs: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown, warnings, n_ocr) of PDF documents by tables: runs, fonts of the whole document, lines, pages, and recognised pages
    (doc_id, page, ocr_text) where they are better. For layouts that are to be queried as well; `convert` does the same in one pass."""
    pages = pdf_pages(docs).where("n_pages > 0")
    each = pages.select("doc_id", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page"))
    layer = page_markdown(text_lines(pdf_text_runs(docs)))
    texts = each.join(layer, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    return assemble_pages(arbitrate_ocr(texts, ocr), pages.select("doc_id", "n_pages"))


def preflight(files: DataFrame) -> DataFrame:
    """(doc_id, unpacked, seconds): what archives hold by their directories, and how long at worst the larger ones may take."""
    from docweir.functions.numbers import worst_case_seconds
    from docweir.sources.tables import zip_entries

    return zip_entries(files).groupBy("doc_id").agg(F.sum("size").alias("unpacked")).withColumn("seconds", worst_case_seconds(F.col("unpacked")))


def meta_json(docs: DataFrame) -> DataFrame:
    """(doc_id, meta): the record of a conversion without its text, as JSON."""
    return docs.select("doc_id", F.to_json(F.struct("name", "size", "type", "detail", "ole2_subtype", "backend", "elapsed_ms", "truncated", "warnings", "error")).alias("meta"))


