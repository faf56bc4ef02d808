"""Text runs of pages to lines and Markdown: windows, joins and aggregations over a table of runs.

text_runs(doc_id, page, seq, str, x, y, sy, w, font_size, font_id, glyph_widths, ascii, letters)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.functions.chars import CJK, WS, trimmed
from docweir.functions.text import good_chars, needs_ocr

MONO_WIDTH, MONO_LETTERS, CODE_ASCII = 700, 1, 1
PAGE = ["doc_id", "page"]


def monospace_fonts(runs: DataFrame) -> DataFrame:
    """Fonts (doc_id, font_id) whose visible glyphs all have one width of at most MONO_WIDTH, over the whole document, and with letters.

    The letters of a run count once, however many widths it has: each run is reduced to its least and greatest width first.
    """
    seen = runs.where(F.size("glyph_widths") > 0)
    return (
        seen.groupBy("doc_id", "font_id")
        .agg(F.min(F.array_min("glyph_widths")).alias("least"), F.max(F.array_max("glyph_widths")).alias("most"), F.sum("letters").alias("letters"))
        .where((F.col("least") == F.col("most")) & (F.col("most") > 0) & (F.col("most") <= MONO_WIDTH) & (F.col("letters") >= MONO_LETTERS))
        .select("doc_id", "font_id")
    )


def number_lines(runs: DataFrame) -> DataFrame:
    """The runs with line_no: a new line starts where a run lies over half its font size from the run before it, top down."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("sy"), "seq")
    above = F.lag("sy").over(order)
    new = F.when(above.isNull() | (F.abs(F.col("sy") - above) > F.greatest(F.col("font_size"), F.lit(1.0)) / 2), 1).otherwise(0)
    return runs.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(order)).drop("_new")


def line_text(runs: Column) -> Column:
    """The text of a line from its runs (structs of x, seq, str, w, font_size): left to right, without overprints of the last run
    kept, with a space where the gap or the words call for one."""
    word = r"[A-Za-z0-9]"
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("str"), F.lit(0.0).alias("x"), F.lit(0.0).alias("w"), F.lit(0.0).alias("size"))

    def step(a: Column, r: Column) -> Column:
        gap = r.x - (a.x + a.w)
        over = (a.str == r.str) & (F.abs(r.x - a.x) < 0.5 * r.w / F.greatest(F.lit(1), F.length(r.str)))
        last, first = F.right(a.text, F.lit(1)), F.left(r.str, F.lit(1))  # single characters, so that no pattern scans a line
        cjk = last.rlike(f"[{CJK}]") & first.rlike(f"[{CJK}]")
        apart = (gap > F.greatest(a["size"], r.font_size) / 3) | ((gap > 0) & last.rlike(word) & first.rlike(word))
        space = a.str.isNotNull() & ~cjk & apart & ~a.text.endswith(" ") & ~r.str.startswith(" ")
        text = F.concat(a.text, F.when(F.coalesce(space, F.lit(False)), " ").otherwise(""), r.str)
        return F.when(F.coalesce(over, F.lit(False)), a).otherwise(
            F.struct(text.alias("text"), r.str.alias("str"), r.x.alias("x"), r.w.alias("w"), r.font_size.alias("size")))

    joined = F.when(F.size(runs) == 1, runs[0].str).otherwise(F.aggregate(F.array_sort(runs), start, step, lambda a: a.text))
    return F.regexp_replace(F.regexp_replace(joined, " {2,}", " "), f"[{WS}]+$", "")


def text_lines(runs: DataFrame) -> DataFrame:
    """text_lines(doc_id, page, line_no, text, is_code); a line is code if it has ASCII glyphs and all of them are from monospace fonts.

    A reader that has whole documents gives `mono` with the runs; other runs are joined to the fonts that are."""
    marked = number_lines(runs)
    if "mono" not in runs.columns:
        marked = marked.join(monospace_fonts(runs).withColumn("mono", F.lit(True)), ["doc_id", "font_id"], "left")
    other = F.max(((F.col("ascii") > 0) & ~F.coalesce(F.col("mono"), F.lit(False))).cast("int"))
    return marked.groupBy(*PAGE, "line_no").agg(
        line_text(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "seq", "str", F.col("w").cast("double").alias("w"),
                                          F.col("font_size").cast("double").alias("font_size")))).alias("text"),
        ((other == 0) & (F.sum("ascii") >= CODE_ASCII)).alias("is_code"))


def page_markdown(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): lines in order, each stretch of code lines in one fence with an empty line around it."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    before, after = F.coalesce(F.lag("is_code").over(order), F.lit(False)), F.coalesce(F.lead("is_code").over(order), F.lit(False))
    code = F.col("is_code")
    last = F.lead("line_no").over(order).isNull()
    md = F.concat(F.when(code & ~before, "\n```\n").otherwise(""), "text",
                  F.when(code & ~after, F.when(last, "\n```").otherwise("\n```\n")).otherwise(""))
    rows = lines.withColumn("_md", md)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_md"))), lambda r: r._md), "\n")
    return rows.groupBy(*PAGE).agg(trimmed(F.regexp_replace(joined, r"\n{3,}", "\n\n")).alias("text"))


def arbitrate_ocr(pages: DataFrame, ocr: DataFrame | None) -> DataFrame:
    """(doc_id, page, text, used_ocr, warning) of pages (doc_id, page, text) and recognised texts (doc_id, page, ocr_text).

    Only a page whose text layer is short or poor is put to OCR, and the result replaces it only with strictly more good
    characters; otherwise the text layer stays, with a warning; a page with neither goes.
    """
    if ocr is None:
        both = pages.withColumn("ocr_text", F.lit(None).cast("string"))
    else:
        both = pages.join(ocr.select(*PAGE, "ocr_text"), PAGE, "left")
    poor = needs_ocr(F.col("text"))
    better = poor & F.coalesce((F.col("ocr_text") != "") & (good_chars(F.col("ocr_text")) > good_chars(F.col("text"))), F.lit(False))
    warning = F.when(~poor | better, None).when(trimmed(F.col("text")) == "", "OCR_PAGE_SKIPPED").when(
        F.coalesce(F.col("ocr_text"), F.lit("")) != "", "OCR_NOT_BETTER").otherwise("OCR_UNAVAILABLE")
    return both.select(*PAGE, F.when(better, F.col("ocr_text")).otherwise(F.col("text")).alias("text"), better.alias("used_ocr"), warning.alias("warning"))


def assemble_pages(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, markdown, warnings, n_ocr) of arbitrated pages and page counts (doc_id, n_pages): pages in order under comments."""
    kept = F.coalesce(F.col("warning"), F.lit("")) != "OCR_PAGE_SKIPPED"
    rows = pages.join(counts, "doc_id")
    md = F.concat(F.lit("<!-- page "), F.col("page"), F.lit("/"), F.col("n_pages"), F.lit(" -->\n\n"), "text")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("page", c.alias("v"))))), lambda r: r.v)
    said = F.when(F.col("warning").isNotNull(), F.concat("warning", F.lit(": page "), F.col("page")))
    return rows.groupBy("doc_id").agg(
        trimmed(F.regexp_replace(F.array_join(ordered(F.when(kept, md)), "\n\n"), r"\n{3,}", "\n\n")).alias("markdown"), ordered(said).alias("warnings"),
        F.sum(F.col("used_ocr").cast("int")).alias("n_ocr"))


def pick_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of recognition attempts (keys, attempt, text, conf) the first, unless a later one scores strictly higher."""
    from docweir.functions.text import ocr_score, ocr_warnings

    scored = attempts.withColumn("score", ocr_score(F.col("text"), F.col("conf")))
    best = F.max_by(F.struct("attempt", "text", "conf", "score"), F.struct("score", -F.col("attempt")))
    out = scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
    return out.withColumn("warnings", ocr_warnings(F.col("text"), F.col("conf")))
