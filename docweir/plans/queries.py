"""Queries over the driver's tables, each with an operator of the library at its core, and SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.functions import numbers, sniffing, text
from docweir.functions.chars import folded
from docweir.functions.tables import gfm_table
from docweir.operators import export, history, layout
from docweir.plans import rule_queries  # noqa: F401  registers its queries
from docweir.plans.catalog import ORACLES, QUERIES, dealt as _dealt, query, read as _read  # noqa: F401
from docweir.plans.convert import convert, preflight, typed
from docweir.plans.workbook import resolved_cells
from docweir.sources import tables as exploded

def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as files: (doc_id, name, content)."""
    docs = _dealt(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    pages = _dealt(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("doc_id"), F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    return docs.unionByName(pages)


# -- guards and types -------------------------------------------------------------------------------------------------------------

@query("""SELECT doc_id, octet_length(encode(text)) AS n_bytes,
CASE WHEN octet_length(encode(text)) = 0 THEN 'EMPTY_FILE' WHEN octet_length(encode(text)) > 52428800 THEN 'FILE_TOO_LARGE' END AS outcome FROM documents""")
def size_guard(spark, sf_dir):
    n = F.octet_length("text").cast("bigint")
    return _read(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), sniffing.guard(n).alias("outcome"))


_MAGIC = [  # (name, bytes, type, detail, subtype)
    ("pdf", b"junk:%PDF-1.4\n1 0 obj\n<<>>\nendobj\n%%EOF\n", "pdf", None, None),
    ("pdf-mention", b"a text about %PDF-1.4 files", "text", None, None),
    ("mz", bytes.fromhex("4D5A90000300000004000000FFFF"), "unknown", "binary", None),
    ("zip", b"PK\x03\x04\x14\x00 data", "zip", None, None),
    ("docx", b"PK\x03\x04\x14\x00 word/document.xml", "docx", None, None),
    ("xlsx", b"PK\x03\x04\x14\x00 xl/workbook.xml", "xlsx", None, None),
    ("pptx", b"PK\x03\x04\x14\x00 ppt/slides", "pptx", None, None),
    ("empty", b"", "unknown", "empty", None),
    ("bm-text", b"BMW is a car maker, and this is text", "text", None, None),
    ("gif-text", b"GIF89a is a format\n", "text", None, None),
    ("gif", b"GIF89a\x01\x00\x01\x00\x00\x00\x00\x3b", "image", "gif", None),
    ("bmp", b"BM\x3a\x00\x00\x00\x00\x00\x00\x00\x36\x00\x00\x00" + bytes(44), "image", "bmp", None),
    ("png", bytes.fromhex("89504E470D0A1A0A") + bytes(8), "image", "png", None),
    ("jpeg", bytes.fromhex("FFD8FFE000104A464946"), "image", "jpeg", None),
    ("tiff", b"II*\x00" + bytes(8), "image", "tiff", None),
    ("webp", b"RIFF\x10\x00\x00\x00WEBPVP8 ", "image", "webp", None),
    ("ole2", bytes.fromhex("D0CF11E0A1B11AE1") + bytes(504), "doc", None, "unknown"),
    ("word97", bytes.fromhex("D0CF11E0A1B11AE1") + "WordDocument".encode("utf-16-le"), "doc", None, "word"),
    ("utf16", b"\xff\xfea\x00", "text", None, None),
]


def _sql_text(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else f"'{s}'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_sql_text(n)}, {_sql_text(t)}, {_sql_text(d)}, {_sql_text(s)})" for n, _, t, d, s in _MAGIC)
       + ") v(name, type, detail, ole2_subtype)")
def sniff_magic(spark, sf_dir):
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b, *_ in _MAGIC], "name string, content binary")
    return rows.select("name", sniffing.sniff(F.col("content")).alias("s")).select("name", "s.*")


@query("""SELECT type, name_kind, count(*) AS n FROM (
SELECT 'text' AS type, 'txt' AS name_kind FROM documents UNION ALL SELECT 'text', 'html' FROM pages) GROUP BY type, name_kind""")
def sniff_types(spark, sf_dir):
    return typed(corpus_files(spark, sf_dir)).groupBy("type", F.element_at(F.split("name", r"\."), -1).alias("name_kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id AS id, 'page' AS kind, regexp_matches(substring(html, 1, 2000), '(?i)<(!doctype|html|body|div|p|h[1-6]|table|ul|ol|section|article)\b') AS is_html FROM pages
UNION ALL SELECT doc_id, 'document', regexp_matches(substring(text, 1, 2000), '(?i)<(!doctype|html|body|div|p|h[1-6]|table|ul|ol|section|article)\b') FROM documents""")
def html_probe(spark, sf_dir):
    none = F.lit(None).cast("string")
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), sniffing.looks_like_html(none, F.col("html")).alias("is_html"))
    return pages.union(_read(spark, sf_dir, "documents").select("doc_id", F.lit("document"), sniffing.looks_like_html(none, F.col("text"))))


@query("""SELECT type, backend, count(*) AS n, CAST(0 AS BIGINT) AS failed FROM (
SELECT 'text' AS type, 'text' AS backend FROM documents UNION ALL SELECT 'text', 'html' FROM pages) GROUP BY type, backend""")
def registry_dispatch(spark, sf_dir):
    return convert(corpus_files(spark, sf_dir)).groupBy("type", "backend").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"))


# -- text -------------------------------------------------------------------------------------------------------------------------

@query(r"""WITH t AS (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10)) || chr(13) AS x FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')) AS digest FROM t""")
def text_normalize(spark, sf_dir):
    x = F.concat(F.replace("text", F.lit(". "), F.lit(".\r\n\r\n\n")), F.lit("\r"))
    return _dealt(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(x)).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, '. ', chr(9) || chr(160) || '  '), '[\t\n\x0B\f\r \x{A0}]+', ' ', 'g')) AS digest FROM documents")
def ws_fold(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(folded(F.replace("text", F.lit(". "), F.lit("\t   ")))).alias("digest"))


@query("SELECT page_id, replace(replace(replace(url || ' (a b)', '(', '%28'), ')', '%29'), ' ', '%20') AS escaped FROM pages")
def url_escape(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.escape_url(F.concat("url", F.lit(" (a b)"))).alias("escaped"))


@query(r"""SELECT p_partkey, coalesce(nullif(regexp_replace(x, '\.[^.]+$', ''), ''), 'document') AS base
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '.tar.gz' WHEN 1 THEN p_name WHEN 2 THEN '.hidden' ELSE p_name || '.' END AS x FROM part)""")
def base_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.concat("p_name", F.lit(".tar.gz"))).when(k == 1, F.col("p_name")).when(k == 2, ".hidden").otherwise(F.concat("p_name", F.lit(".")))
    return _read(spark, sf_dir, "part").select("p_partkey", text.base_name(x).alias("base"))


_CJK = [("人 工 智能", "人工智能"), ("第 3 章", "第3章"), ("中文 English 混排", "中文 English 混排"), ("1 2 3", "1 2 3"), ("50 % 以上", "50 %以上"), ("好　的\t吗", "好的吗"),
        ("上行\n 下行", "上行\n 下行"), ("你好 ， 世界", "你好，世界")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{b}')" for i, (_, b) in enumerate(_CJK)) + ") v(id, collapsed)")
def cjk_collapse(spark, sf_dir):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_CJK)], "id int, t string")
    return rows.select("id", text.collapse_cjk_spaces(F.col("t")).alias("collapsed"))


@query(r"""WITH t AS (SELECT doc_id, replace(text, 'q', chr(57345)) AS x FROM documents), c AS (
SELECT doc_id, x, len(regexp_extract_all(x, '[^\s\x0B\x{A0}\p{Co}\p{Cc}\x{FFFD}]')) AS good, len(regexp_extract_all(x, '[\p{Co}\x{FFFD}]')) AS garbage FROM t)
SELECT doc_id, CAST(good AS INT) AS good, CAST(garbage AS INT) AS garbage, round(CASE WHEN good + garbage > 0 THEN good / (good + garbage) ELSE 0 END, 9) AS ratio,
length(x) < 10 OR CASE WHEN good + garbage > 0 THEN good / (good + garbage) ELSE 0 END < 0.4 AS ocr FROM c""")
def quality_ratio(spark, sf_dir):
    x = F.replace("text", F.lit("q"), F.lit("\ue001"))
    return _dealt(spark, sf_dir, "documents").select("doc_id", text.good_chars(x).alias("good"), text.garbage_chars(x).alias("garbage"),
                                                    F.round(text.quality_ratio(x), 9).alias("ratio"), text.needs_ocr(x).alias("ocr"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS INT) AS latin, CAST(len(regexp_extract_all(replace(text, 'e', '中'), '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')) AS INT) AS cjk,
round(len(regexp_extract_all(replace(text, 'e', '中'), '[A-Za-z]')) / greatest(1, len(regexp_extract_all(replace(text, 'e', '中'), '[A-Za-z\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]'))), 9) AS ratio FROM documents""")
def latin_cjk_ratio(spark, sf_dir):
    x = F.replace("text", F.lit("e"), F.lit("中"))
    return _read(spark, sf_dir, "documents").select("doc_id", text.latin_chars(F.col("text")).alias("latin"), text.cjk_chars(x).alias("cjk"), F.round(text.latin_ratio(x), 9).alias("ratio"))


@query(r"""WITH a AS (SELECT d.doc_id, n.attempt, CASE WHEN n.attempt = 0 THEN d.text ELSE replace(d.text, 'a', '中') END AS t,
CASE WHEN n.attempt = 0 THEN 40 + 30 * l.quality ELSE 50 END AS conf FROM documents d JOIN labels l USING (doc_id), (VALUES (0), (1)) n(attempt)),
s AS (SELECT *, conf - 100 * (len(regexp_extract_all(t, '[A-Za-z]')) / greatest(1, len(regexp_extract_all(t, '[A-Za-z\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')))) AS score FROM a)
SELECT doc_id, CAST(attempt AS INT) AS attempt, CAST(conf AS INT) AS conf, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, attempt) = 1""")
def ocr_score(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    rows = d.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "doc_id", "attempt", F.when(F.col("attempt") == 0, F.col("text")).otherwise(F.replace("text", F.lit("a"), F.lit("中"))).alias("text"),
        F.when(F.col("attempt") == 0, 40 + 30 * F.col("quality")).otherwise(50).cast("int").alias("conf"))
    return layout.pick_attempt(rows, ["doc_id"]).select("doc_id", "attempt", "conf", F.round("score", 6).alias("score"))


@query(r"""WITH p AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN text || '!!' WHEN turn % 3 = 1 THEN '' END AS ocr, CASE WHEN turn % 2 = 0 THEN substring(text, 1, 8) ELSE text END AS layer FROM conversations),
g AS (SELECT *, len(regexp_extract_all(layer, '[^\s]')) AS a, len(regexp_extract_all(coalesce(ocr, ''), '[^\s]')) AS b, length(layer) < 10 AS poor FROM p)
SELECT conv_id AS doc_id, CAST(turn AS INT) AS page, poor AND b > a AS used_ocr, md5(CASE WHEN poor AND b > a THEN ocr ELSE layer END) AS digest,
CASE WHEN NOT poor OR b > a THEN NULL WHEN trim(layer) = '' THEN 'OCR_PAGE_SKIPPED' WHEN coalesce(ocr, '') <> '' THEN 'OCR_NOT_BETTER' ELSE 'OCR_UNAVAILABLE' END AS warning FROM g""")
def ocr_arbitration(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")
    layer = c.select("doc_id", "page", F.when(F.col("page") % 2 == 0, F.substring("text", 1, 8)).otherwise(F.col("text")).alias("text"))
    ocr = c.select("doc_id", "page", F.when(F.col("page") % 3 == 0, F.concat("text", F.lit("!!"))).when(F.col("page") % 3 == 1, "").alias("ocr_text"))
    return layout.arbitrate_ocr(layer, ocr).select("doc_id", "page", "used_ocr", F.md5("text").alias("digest"), "warning")


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'th', chr(65533)) ELSE text END AS x FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(x, '\x{FFFD}')) AS bad, len(regexp_extract_all(x, '[^\x00-\x7F]')) AS other FROM t)
SELECT doc_id, CAST(bad AS INT) AS bad, CAST(other AS INT) AS other, bad >= 3 AND other > 0 AND bad * 4 >= other AS gate FROM c""")
def fffd_gate(spark, sf_dir):
    x = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("th"), F.lit("\ufffd"))).otherwise(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", text.fffd_count(x).alias("bad"), text.non_ascii_units(x).alias("other"), text.worth_gb18030(x).alias("gate"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(CASE doc_id % 5 WHEN 0 THEN '- ' || text WHEN 1 THEN '  |' || text WHEN 2 THEN '```x' || chr(10) || text WHEN 3 THEN '2) **b** [l](u) ' || text ELSE text END, chr(10))) AS line FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(line, '^ {0,3}(`{3,}|~{3,})') THEN 'fence' WHEN regexp_matches(line, '^\s*\|') THEN 'table' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+') THEN 'list'
WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind, count(*) AS n, CAST(sum(len(string_split(line, '**')) - 1 + len(string_split(line, '](')) - 1) AS BIGINT) AS marks FROM l GROUP BY ALL""")
def line_classes(spark, sf_dir):
    k = F.col("doc_id") % 5
    t = (F.when(k == 0, F.concat(F.lit("- "), "text")).when(k == 1, F.concat(F.lit("  |"), "text")).when(k == 2, F.concat(F.lit("```x\n"), "text"))
         .when(k == 3, F.concat(F.lit("2) **b** [l](u) "), "text")).otherwise(F.col("text")))
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(t, "\n")).alias("line"))
    return lines.groupBy("doc_id", text.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"), F.sum(text.inline_marks(F.col("line"))).alias("marks"))


@query("SELECT doc_id, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT doc_id, length(text) AS n FROM documents) WHERE n > 0 GROUP BY doc_id")
def segments(spark, sf_dir):
    parts = exploded.markdown_segments(_dealt(spark, sf_dir, "documents"), "text", limit=1024)
    return parts.groupBy("doc_id").agg(F.sum((F.col("end") - F.col("start")).cast("bigint")).alias("chars"))


# -- numbers ----------------------------------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS shown, CAST(CAST(o_orderdate AS DATE) + 1462 AS VARCHAR) AS shown_1904 FROM orders""")
def excel_dates(spark, sf_dir):
    serial = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1899-12-30"))) + 0.75
    return _read(spark, sf_dir, "orders").select("o_orderkey", numbers.serial_to_date(serial).alias("shown"), numbers.serial_to_date(serial, True).alias("shown_1904"))


@query("""WITH n AS (SELECT doc_id, n_chars * CAST(power(10, doc_id % 8) AS BIGINT) AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024, 1)) || ' KB' ELSE printf('%.2f', round(n / 1048576, 2)) || ' MB' END AS ui,
CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CASE WHEN n / 1024 >= 10 THEN CAST(CAST(floor(n / 1024 + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', round(n / 1024, 1)) END || ' KB'
WHEN n < 1073741824 THEN CASE WHEN n / 1048576 >= 10 THEN CAST(CAST(floor(n / 1048576 + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', round(n / 1048576, 1)) END || ' MB'
ELSE CASE WHEN n / 1073741824 >= 10 THEN CAST(CAST(floor(n / 1073741824 + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', round(n / 1073741824, 1)) END || ' GB' END AS history,
CASE WHEN n <= 0 THEN '' WHEN n < 100 THEN n || ' ms' ELSE printf('%.1f', round(n / 1000, 1)) || ' s' END AS duration FROM n""")
def size_labels(spark, sf_dir):
    n = (F.col("n_chars") * F.pow(F.lit(10.0), F.col("doc_id") % 8).cast("bigint")).cast("bigint")
    return _read(spark, sf_dir, "documents").select("doc_id", numbers.size_label(n).alias("ui"), numbers.history_size_label(n).alias("history"), numbers.duration_label(n).alias("duration"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t, max(epoch_us(ts) // 1000) OVER () AS now FROM events), m AS (SELECT *, floor((now - t) / 60000) AS mi FROM e)
SELECT event_id, CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN CAST(mi AS BIGINT) || ' min ago' WHEN floor(mi / 60) < 24 THEN CAST(floor(mi / 60) AS BIGINT) || ' h ago'
WHEN floor(floor(mi / 60) / 24) < 7 THEN CAST(floor(floor(mi / 60) / 24) AS BIGINT) || ' d ago' ELSE strftime(make_timestamp(t * 1000), '%Y-%m-%d') END AS said FROM m""")
def relative_times(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    now = e.agg(F.max("t")).first()[0]
    return e.select("event_id", numbers.relative_time(F.col("t"), F.lit(now)).alias("said"))


@query(r"""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS price FROM lineitem), t AS (SELECT *, CAST(price AS VARCHAR) AS s FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN length(regexp_replace(replace(s, '.', ''), '^0+|0+$', '', 'g')) > 15 THEN regexp_replace(regexp_replace(printf('%.15g', price), '(\.[0-9]*[1-9])0+$', '\1'), '\.0*$', '') ELSE s END AS shown FROM t""")
def float_tail(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.shortened(price.cast("string")).alias("shown"))


@query("SELECT p_partkey, CAST((p_partkey * 7919) % 16384 AS INT) AS idx FROM part")
def column_refs(spark, sf_dir):
    i = ((F.col("p_partkey") * 7919) % 16384).cast("int")
    return _read(spark, sf_dir, "part").select("p_partkey", numbers.column_index(F.concat(numbers.column_letters(i), F.lit("7"))).alias("idx"))


# -- tables and formats -----------------------------------------------------------------------------------------------------------

@query("""SELECT r.r_name AS region, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n.n_name || ' \\| x | ' || n.n_nationkey || ' |', chr(10) ORDER BY n.n_nationkey) AS md
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
def gfm_tables(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(F.concat(r.n_name, F.lit(" |  x")), r.n_nationkey.cast("string")))
    head = F.array(F.array(F.lit("name"), F.lit("key")))
    return n.groupBy(F.col("r_name").alias("region")).agg(gfm_table(F.concat(head, rows)).alias("md"))


def order_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): a workbook for each 500 order keys, one sheet each."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from docweir.sources.workbook import write_workbook

        pdf = pdf.sort_values("o_orderkey")
        rows = [["key", "status", "price", "priority"], *([int(k), s, float(p), q] for k, s, p, q in zip(pdf.o_orderkey, pdf.o_orderstatus, pdf.o_totalprice, pdf.o_orderpriority, strict=True))]
        return pd.DataFrame({"doc_id": [int(pdf.doc_id.iloc[0])], "content": [write_workbook([("Orders & more", rows)])]})

    o = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") / 500).cast("bigint").alias("doc_id"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return o.groupBy("doc_id").applyInPandas(build, "doc_id bigint, content binary")


def _orders_from(cells: DataFrame) -> DataFrame:
    at = lambda i: F.max(F.when(F.col("col_idx") == i, F.col("value")))
    return cells.where("row_idx > 0").groupBy("doc_id", "row_idx").agg(*(at(i).alias(f"v{i}") for i in range(4))).select(
        F.col("v0").cast("bigint").alias("o_orderkey"), F.col("v1").alias("o_orderstatus"), F.col("v2").cast("double").alias("o_totalprice"), F.col("v3").alias("o_orderpriority"))


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def read_orders(books: DataFrame) -> DataFrame:
    return _orders_from(exploded.workbook_cells(books))


@query(_ORDERS)
def xlsx_roundtrip(spark, sf_dir):
    return read_orders(order_workbooks(spark, sf_dir))


@query(_ORDERS)
def xlsx_joined_parts(spark, sf_dir):
    return _orders_from(resolved_cells(exploded.workbook_parts(order_workbooks(spark, sf_dir))))


@query("""SELECT CAST(floor(p_partkey / 3000) AS BIGINT) AS doc_id, CAST(least(count(*), 1001) AS BIGINT) AS scanned, count(*) > 1000 AS truncated, CAST(7 AS BIGINT) AS n_sheets, CAST(5 AS BIGINT) AS n_read FROM part GROUP BY 1""")
def xlsx_limits(spark, sf_dir):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from docweir.sources.workbook import write_workbook

        rows = [[str(k)] for k in pdf.p_partkey]
        return pd.DataFrame({"doc_id": [int(pdf.doc_id.iloc[0])], "content": [write_workbook([("first", rows), *((f"s{i}", [["x"]]) for i in range(6))])]})

    p = _read(spark, sf_dir, "part").select((F.col("p_partkey") / 3000).cast("bigint").alias("doc_id"), "p_partkey")
    sheets = exploded.workbook_sheets(p.groupBy("doc_id").applyInPandas(build, "doc_id bigint, content binary"))
    first = lambda c: F.max(F.when(F.col("sheet_pos") == 0, F.col(c)))
    return sheets.groupBy("doc_id").agg(first("scanned").cast("bigint").alias("scanned"), first("truncated").alias("truncated"), F.max("n_sheets").cast("bigint").alias("n_sheets"), F.count("*").alias("n_read"))


def _binary_udf(f: Callable) -> Callable:
    from pyspark.sql.types import BinaryType

    return F.udf(f, BinaryType(), useArrow=True)


def _zip_of(text: str, n: int) -> bytes:
    from docweir.sources.archive import pack_files

    return pack_files([("body.txt", text.encode()), ("meta.json", b"{}"), (f"n/{n}.bin", bytes(int(n)))])


@query("SELECT doc_id, CAST(3 AS BIGINT) AS n, CAST(octet_length(encode(text)) + 2 + doc_id % 50 AS BIGINT) AS unpacked FROM documents")
def zip_directory(spark, sf_dir):
    d = _dealt(spark, sf_dir, "documents").select("doc_id", _binary_udf(_zip_of)("text", F.col("doc_id") % 50).alias("content"))
    return exploded.zip_entries(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("unpacked"))


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, "documents").select(F.col("doc_id"), F.lit("x.docx").alias("name"), _binary_udf(_docx_of)("text").alias("content"))


def read_docx(files: DataFrame) -> DataFrame:
    return convert(files).select("doc_id", F.md5("markdown").alias("digest"))


def _docx_of(text: str) -> bytes:
    from docweir.sources.docx import write_docx

    return write_docx(text.split("\n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
f AS (SELECT doc_id, i, trim(regexp_replace(line, '[\s\x{A0}]+', ' ', 'g')) AS x FROM l)
SELECT doc_id, md5(coalesce(string_agg(x, chr(10) || chr(10) ORDER BY i) FILTER (WHERE x <> ''), '')) AS digest FROM f GROUP BY doc_id""")
def docx_roundtrip(spark, sf_dir):
    return read_docx(docx_files(spark, sf_dir))


def _pdf_of(text: str) -> bytes:
    from docweir.sources.pdf import write_pdf

    lines = text.split("\n")
    return write_pdf([[(72, 760 - 18 * k, s) for k, s in enumerate(lines[i : i + 40])] for i in range(0, len(lines), 40)])


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
f AS (SELECT doc_id, i, rtrim(regexp_replace(line, ' {2,}', ' ', 'g')) AS x FROM l)
SELECT doc_id, CAST(floor(i / 40) + 1 AS INT) AS page, md5(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE x <> '')) AS digest, count(*) FILTER (WHERE x <> '') AS n FROM f GROUP BY 1, 2 HAVING count(*) FILTER (WHERE x <> '') > 0""")
def pdf_roundtrip(spark, sf_dir):
    return read_pdf(pdf_files(spark, sf_dir))


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, "documents").select("doc_id", _binary_udf(_pdf_of)("text").alias("content"))


def read_pdf(files: DataFrame) -> DataFrame:
    lines = layout.text_lines(exploded.pdf_text_runs(files)).where("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r.text), "\n")
    return lines.groupBy("doc_id", "page").agg(F.md5(joined).alias("digest"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS sy, lag(l_quantity) OVER w AS above FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber)),
n AS (SELECT *, CASE WHEN above IS NULL OR abs(sy - above) > 5 THEN 1 ELSE 0 END AS new FROM r)
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS seq, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY sy DESC, l_linenumber) AS BIGINT) AS line_no FROM n""")
def line_groups(spark, sf_dir):
    runs = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("sy"), F.lit(10.0).alias("font_size"))
    return layout.number_lines(runs).select("doc_id", "seq", "line_no")


@query("""SELECT CAST(l_suppkey AS BIGINT) AS doc_id, l_returnflag || l_linestatus AS font_id FROM lineitem GROUP BY 1, 2
HAVING count(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN 600 ELSE l_quantity * 10 END) = 1 AND max(CASE WHEN l_suppkey % 3 = 0 THEN 600 ELSE l_quantity * 10 END) <= 700 AND sum(l_linenumber % 2) >= 1""")
def mono_fonts(spark, sf_dir):
    width = F.when(F.col("l_suppkey") % 3 == 0, 600.0).otherwise(F.col("l_quantity") * 10)
    runs = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("font_id"),
                                                   F.array(width).alias("glyph_widths"), (F.col("l_linenumber") % 2).alias("letters"))
    return layout.monospace_fonts(runs)


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2), l AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS x, l_returnflag = 'N' AS code,
coalesce(lag(l_returnflag = 'N') OVER w, false) AS b, coalesce(lead(l_returnflag = 'N') OVER w, false) AS a, lead(l_linenumber) OVER w IS NULL AS last FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey AS doc_id, trim(regexp_replace(string_agg(CASE WHEN code AND NOT b THEN chr(10) || '```' || chr(10) ELSE '' END || x || CASE WHEN code AND NOT a THEN chr(10) || '```' || CASE WHEN last THEN '' ELSE chr(10) END ELSE '' END, chr(10) ORDER BY l_linenumber), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS md
FROM l GROUP BY l_orderkey""")
def code_islands(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    lines = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line_no"),
                                                    F.concat("l_returnflag", "l_linenumber").alias("text"), (F.col("l_returnflag") == "N").alias("is_code"))
    return layout.page_markdown(lines).select("doc_id", F.col("text").alias("md"))


@query()
def html_to_md(spark, sf_dir):
    pages = _dealt(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("page.html").alias("name"), F.encode("html", "UTF-8").alias("content"))
    return convert(pages).select("doc_id", "markdown", "warnings", "backend")


@query(r"""SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<ul[ >]')) AS BIGINT) AS lists FROM pages""")
def page_blocks(spark, sf_dir):
    blocks = exploded.html_block_rows(_dealt(spark, sf_dir, "pages"), "html", "page_id")
    return blocks.groupBy("doc_id").agg(F.count_if((F.col("kind") == "heading") & F.col("md").startswith("# ")).alias("headings"), F.count_if(F.col("kind") == "list").alias("lists"))


# -- packaging, history, streams in batches ---------------------------------------------------------------------------------------

@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'md' WHEN 2 * n_chars * 4000 > 20971520 THEN 'zip' ELSE 'embedded' END AS way FROM documents""")
def embed_router(spark, sf_dir):
    asset = F.struct((F.col("n_chars") * 4000).alias("size"))
    return _read(spark, sf_dir, "documents").select("doc_id", export.packaging(F.when(F.col("doc_id") % 3 != 0, F.array(asset, asset))).alias("way"))


@query("""SELECT conv_id, md5(CASE WHEN count(*) > 1 THEN string_agg('===== ' || role || ' =====' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) ELSE string_agg(text, '') END) AS digest FROM conversations GROUP BY conv_id""")
def batch_merge(spark, sf_dir):
    return export.merge_batch(_read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text").select("conv_id", F.md5("merged").alias("digest"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), "user_id",
                                                 F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.col("event_id").alias("ins_seq"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS created_at FROM events QUALIFY row_number() OVER (ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) <= 200""")
def history_top200(spark, sf_dir):
    return history.evict(_history(spark, sf_dir)).select("id", "created_at")


@query("""SELECT user_id, CAST(event_id AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS INT) AS place FROM events QUALIFY place <= 200""")
def history_by_user(spark, sf_dir):
    return history.listing(history.evict(_history(spark, sf_dir), keys=["user_id"]), ["user_id"]).select("user_id", "id", "place")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a1') OR contains(lower(p_name), 're')")
def name_filter(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.where(text.name_matches(F.col("p_name"), F.lit(" A1 ")) | text.name_matches(F.col("p_name"), F.lit("RE"))).select("p_partkey", "p_name")


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE n_chars >= 1000) AS ok, count(*) FILTER (WHERE n_chars < 1000) AS failed FROM documents GROUP BY source")
def status_summary(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").withColumn("error", F.when(F.col("n_chars") < 1000, "EMPTY_FILE"))
    return export.summary(d, ["source"])


@query("""WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) AS seq FROM events), m AS (SELECT event_id, user_id, seq, max(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT event_id, user_id, seq FROM m WHERE top IS NULL OR seq >= top""")
def latest_seq(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").cast("bigint").alias("seq"), F.struct("ts", "event_id").alias("arrival"))
    return history.latest_wins(e, ["user_id"]).select("event_id", "user_id", "seq")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'exists' END AS state FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def uri_check(spark, sf_dir):
    records = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("uri"))
    files = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path"))
    return history.check_uris(records, files).select("o_orderkey", "state")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'binary' WHEN text = '' THEN 'empty' END AS error, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE least(length(text), 500) END AS n, doc_id % 7 <> 0 AND length(text) > 500 AS truncated FROM documents""")
def external_open(spark, sf_dir):
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\0")))).otherwise(F.encode("text", "UTF-8"))
    got = text.external_open(content, chars=500)
    return _read(spark, sf_dir, "documents").select("doc_id", got.alias("g")).select("doc_id", "g.error", F.length("g.text").alias("n"), "g.truncated")


_REFUSED = {"mz": "UNSUPPORTED_TYPE", "zip": "UNSUPPORTED_ZIP", "pptx": "UNSUPPORTED_PPTX", "empty": "EMPTY_FILE", "ole2": "UNSUPPORTED_OLE2_UNKNOWN", "word97": "UNSUPPORTED_OLE2_WORD",
            "docx": "DAMAGED_ARCHIVE", "xlsx": "Unreadable: damaged, or not an Office document", **dict.fromkeys(("gif", "bmp", "png", "jpeg", "tiff", "webp"), "OCR_UNAVAILABLE"), "pdf": "NO_CATALOG"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {_sql_text(_REFUSED.get(n))}, {n not in _REFUSED})" for n, *_ in _MAGIC) + ") v(name, error, has_text)")
def refused_files(spark, sf_dir):
    rows = spark.createDataFrame([(n, n, bytearray(b)) for n, b, *_ in _MAGIC], "doc_id string, name string, content binary")
    return convert(rows).select("name", "error", (F.col("markdown") != "").alias("has_text"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id || '.zip' ELSE 'd' || doc_id || '.md' END AS name, doc_id % 2 = 0 AS is_zip, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS failed,
CASE WHEN doc_id % 2 = 0 THEN NULL ELSE md5(text || ' ![i](' || CASE WHEN doc_id % 5 = 0 THEN 'assets/i (1).png' ELSE 'data:image/png;base64,eHl6' END || ')') END AS digest FROM documents""")
def package_files(spark, sf_dir):
    content = F.when(F.col("doc_id") % 5 != 0, F.lit(bytearray(b"xyz")))
    name = F.when(F.col("doc_id") % 5 == 0, "assets/i (1).png").otherwise("assets/i.png")
    asset = F.struct(name.alias("name"), content.alias("content"), F.when(F.col("doc_id") % 2 == 0, 30_000_000).otherwise(3).cast("bigint").alias("size"), F.lit("image/png").alias("type"))
    docs = _dealt(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".docx")).alias("name"), F.concat("text", F.lit(" ![i]("), name, F.lit(")")).alias("markdown"), F.array(asset).alias("assets"))
    out = export.package(docs)
    is_zip = F.col("name").endswith(".zip")
    return out.select("doc_id", "name", is_zip.alias("is_zip"), F.size("failed").alias("failed"), F.when(~is_zip, F.md5("content")).alias("digest"))


_STATES = [("ok", '{"schemaVersion":1,"keepHistory":true,"records":[{"id":"a","name":"n","uri":"u","bytes":0,"kind":"md","createdAt":1}]}', None), ("json", "{nope", "corrupt"), ("array", "[]", "corrupt"),
           ("version", '{"schemaVersion":2,"keepHistory":true,"records":[]}', "schema"), ("flag", '{"schemaVersion":1,"keepHistory":"false","records":[]}', "corrupt"), ("none", None, "corrupt"),
           ("missing", '{"schemaVersion":1,"records":[]}', "corrupt"), ("list", '{"schemaVersion":1,"keepHistory":true}', "corrupt"), ("empty", '{"schemaVersion":1,"keepHistory":false,"records":[]}', None),
           ("twice", '{"schemaVersion":1,"keepHistory":true,"records":[' + ",".join(['{"id":"a","name":"n","uri":"u","bytes":3,"kind":"md","createdAt":1}'] * 2) + "]}", "corrupt"),
           ("kind", '{"schemaVersion":1,"keepHistory":true,"records":[{"id":"a","name":"n","uri":"u","bytes":0,"kind":"pdf","createdAt":1}]}', "corrupt")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {_sql_text(e)})" for n, _, e in _STATES) + ") v(name, error)")
def history_states(spark, sf_dir):
    rows = spark.createDataFrame([(n, s) for n, s, _ in _STATES], "name string, state string")
    return history.parse_state(rows).select("name", "error")


@query("""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS ins_seq, epoch_us(o_orderdate) // 1000 AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS bytes,
CASE WHEN o_orderkey % 3 = 0 THEN 'zip' WHEN o_orderkey % 3 = 1 THEN 'md' ELSE 'pdf' END AS kind, o_custkey % 2 AS fresh FROM orders)
SELECT id, bytes, CASE WHEN kind = 'zip' THEN 'application/zip' ELSE 'text/markdown' END AS mime FROM r WHERE kind <> 'pdf' ORDER BY created_at DESC, ins_seq DESC LIMIT 200""")
def history_append(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    o = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("u").alias("uri"), F.col("o_totalprice").alias("bytes"), F.lit("").alias("mime"),
        F.when(k == 0, "zip").when(k == 1, "md").otherwise("pdf").alias("kind"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.col("o_orderkey").alias("ins_seq"), "o_custkey")
    old = history.normalized(o.where("o_custkey % 2 = 0")).where("kind <> 'pdf'").drop("o_custkey")
    return history.append(old, o.where("o_custkey % 2 = 1").drop("o_custkey")).select("id", "bytes", "mime")


@query("SELECT * FROM (VALUES (0, NULL, false), (14, NULL, true), (22, NULL, true), (23, NULL, false), (57, NULL, true), (164, '0.00', false), (165, '[Red]0', false), (166, '[h]:mm', true), (167, 'yyyy\\-mm', true), (168, '[open ymd', false)) v(id, code, is_date)")
def date_formats(spark, sf_dir):
    rows = [(0, None), (14, None), (22, None), (23, None), (57, None), (164, "0.00"), (165, "[Red]0"), (166, "[h]:mm"), (167, "yyyy\\-mm"), (168, "[open ymd")]
    df = spark.createDataFrame(rows, "id int, code string")
    return df.select("id", "code", numbers.is_date_format(F.col("id"), F.col("code")).alias("is_date"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 5000 + 1 AS INT) AS width, CAST(l_suppkey + 1 AS INT) AS height,
CAST(CASE WHEN greatest(l_partkey % 5000 + 1, l_suppkey + 1) > 1500 THEN greatest(1, floor((l_suppkey + 1) * (1500.0 / greatest(l_partkey % 5000 + 1, l_suppkey + 1)) + 0.5)) ELSE l_suppkey + 1 END AS INT) AS turned_width FROM lineitem""")
def image_sizes(spark, sf_dir):
    """Headers of PNG images made from part and supplier numbers, read again, and their size for a recogniser."""
    four = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    w, h = (F.col("l_partkey") % 5000 + 1).cast("bigint"), (F.col("l_suppkey") + 1).cast("bigint")
    png = F.concat(F.lit(bytearray.fromhex("89504E470D0A1A0A0000000D49484452")), four(w), four(h), F.lit(bytearray(5)))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sniffing.image_size(png).alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "s.*")
    return rows.withColumn("turned_width", sniffing.ocr_size(F.col("width"), F.col("height"), turned=True)["width"])


@query("""SELECT o_custkey AS doc_id, CAST(sum(o_orderkey * 100) AS BIGINT) AS unpacked, CAST(CASE WHEN sum(o_orderkey * 100) >= 33554432 THEN greatest(1, floor(sum(o_orderkey * 100) / 4194304.0 + 0.5)) END AS BIGINT) AS seconds FROM orders GROUP BY o_custkey""")
def archive_preflight(spark, sf_dir):
    """Central directories that name large members, without the members."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import struct

        entries = b"".join(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 20, 20, 0, 8, 0, 0, 0, 1, int(k) * 100, 1, 0, 0, 0, 0, 0, 0) + b"x" for k in pdf.o_orderkey)
        end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, len(pdf) & 0xFFFF, len(pdf) & 0xFFFF, len(entries), 0, 0)
        return pd.DataFrame({"doc_id": [int(pdf.doc_id.iloc[0])], "content": [entries + end]})

    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("doc_id"), "o_orderkey")
    return preflight(o.groupBy("doc_id").applyInPandas(build, "doc_id bigint, content binary"))


@query()
def preview_html(spark, sf_dir):
    """The first segment of every page, as safe HTML."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    from docweir.operators.preview import render_preview

    shown = F.udf(lambda md: render_preview(md or ""), StructType([StructField("html", StringType()), StructField("notes", ArrayType(StringType()))]), useArrow=True)
    pages = _dealt(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("page.html").alias("name"), F.encode("html", "UTF-8").alias("content"))
    return convert(pages).select("doc_id", shown("markdown").alias("p")).select("doc_id", "p.html", "p.notes")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and pages converted, and what came of each type and backend."""
    return convert(corpus_files(spark, sf_dir)).groupBy("type", "backend").agg(
        F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum(F.length("markdown")).alias("chars"))
