"""Expressions, layout, history, preview, packaging, plans and streams."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docweir.functions import numbers, text
from docweir.functions.chars import utf16_length, utf16_prefix
from docweir.functions.registry import register_all
from docweir.operators import export, history, layout, preview
from docweir.plans.convert import convert, convert_pdf_tables, meta_json
from docweir.plans.workbook import resolved_cells, sheet_markdown
from docweir.sources import tables
from docweir.sources.docx import write_docx
from docweir.sources.files import read_files
from docweir.sources.heads import file_types
from docweir.sources.pdf import document_markdown, write_pdf
from docweir.sources.workbook import read_workbook, write_workbook
from docweir.streaming.ingest import convert_stream, history_sink, latest_by_seq, once_per_uri, read_history


def values(spark, f, *args):
    """A function of columns over literal rows."""
    width = len(args[0]) if isinstance(args[0], tuple) else 1
    rows = [a if isinstance(a, tuple) else (a,) for a in args]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *(f"c{k}" for k in range(width))])
    return [r.v for r in df.select("i", f(*(F.col(f"c{k}") for k in range(width))).alias("v")).orderBy("i").collect()]


def test_utf16(spark):
    assert values(spark, utf16_length, "𠀀a", "", "é") == [3, 0, 1]
    assert values(spark, lambda c: utf16_prefix(c, 3), "𠀀𠀀b", "abcd", "a𠀀b", "𠀀ab") == ["𠀀", "abc", "a𠀀", "𠀀a"]
    assert values(spark, lambda c: text.cut_preview(c, 2), "ab", "a𠀀") == ["ab", "a" + text.CUT_HINT]


def test_texts(spark):
    assert values(spark, text.normalize_text, "﻿ a\r\rb\r\n\n\nc　", "") == ["a\n\nb\n\nc", ""]
    assert values(spark, text.safe_href, " JavaScript:x", "https://x", "data:a") == ["", "https://x", ""]
    assert values(spark, text.docx_base, "a b/c.DOCX", "x" * 80 + ".docx", ".docx") == ["a-b-c", "x" * 64, "doc"]
    assert values(spark, text.alt_text, (" a\n b ", "n.png"), ("", "pic.jpeg"), (None, None)) == ["a b", "pic", ""]
    assert values(spark, text.mime_extension, "image/jpeg", "image/tiff", "image/svg+xml", "text/x", "IMAGE/PNG") == ["jpg", "tif", "svg+xml", "png", "png"]
    assert values(spark, text.strip_bracketed, "[h]:mm", "a[Red", "x") == [":mm", "a", "x"]
    assert values(spark, text.dstrike_off, " OFF ", "1", "false") == [True, False, True]
    assert values(spark, text.line_kind, "```x", "  | a", "12) b", "   ", "text") == ["fence", "table", "list", "blank", "text"]
    assert values(spark, text.longest_backtick_run, "a``b```c`", "none") == [3, 0]
    assert values(spark, text.data_uri_bytes, "data:image/png;base64,eHl6", "data:,eHk=") == [3, 2]
    assert values(spark, text.image_allowed, "data:image/png;base64,eHl6", "https://x", "data:image/svg+xml;base64,eA==") == [True, False, False]
    assert values(spark, text.text_cost, "ab data:image/png;base64,eHl6 c") == [5]
    assert values(spark, text.quality_ratio, "ab", "a\ue000", "  ", "\x00\x01ab") == [1.0, 0.5, 0.0, 0.5]
    assert values(spark, lambda t, c: text.ocr_warnings(t, c), ("中" * 30 + "x" * 40, 20), ("", 5), ("ok", 90)) == [["LOW_OCR_CONF", "MIXED_SCRIPT"], ["OCR_EMPTY"], []]
    noticed = spark.createDataFrame([("md", ["X", "TRUNCATED: 5 rows"]), ("md", ["X"])], "m string, w array<string>")
    assert [r.v for r in noticed.select(text.truncation_notice(F.col("m"), F.col("w")).alias("v")).collect()] == ["<!-- truncated: 5 rows -->\n\nmd", "md"]


def test_external_open(spark):
    rows = [b"abc", b"", b"a\0b", b"\xff\xfe\xfd", "中中中".encode(), None]
    df = spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(rows)], "i int, c binary")
    got = [r.v for r in df.select("i", text.external_open(F.col("c"), prefix=8).alias("v")).orderBy("i").collect()]
    assert [(g.error, g.text, g.truncated) for g in got] == [(None, "abc", False), ("empty", "", False), ("binary", "", False), ("binary", "", False), (None, "中中", True), ("no_access", "", False)]


def test_numbers(spark):
    assert values(spark, numbers.serial_to_date, 1.0, 59.0, 60.0, 61.0, 45292.75) == ["1900-01-01", "1900-02-28", "1900-03-01", "1900-03-01", "2024-01-01"]
    assert values(spark, numbers.column_index, "A1", "aa", "XFD9", "XFE1", "9", "ZZZZZZZZ") == [0, 26, 16383, -1, -1, -1]
    assert [tuple(x) if x else x for x in values(spark, numbers.dimension_size, "A1:$C$3", "B2", "1:2")] == [(3, 3), (2, 2), None]
    assert values(spark, numbers.significant_digits, "-0.00120", "1e9", "12.50", "x") == [2, 1, 3, None]
    assert values(spark, numbers.history_size_label, 5, 2048, 20_480, 3_000_000_000, -1) == ["5 B", "2.0 KB", "20 KB", "2.8 GB", ""]
    assert values(spark, numbers.chars_label, 10, 2048, 3_000_000) == ["10 chars", "2 KB", "2.9 MB"]
    assert values(spark, numbers.worst_case_seconds, 100, 64 << 20) == [None, 16]
    assert values(spark, numbers.iso_date, "2021-06-10T00", "x") == ["2021-06-10", "x"]


def test_pdf_tables_agree_with_one_pass(spark):
    r = random.Random(0)
    words = "alpha beta gamma 中文 delta-5 (x)".split()
    docs = []
    for i in range(12):
        pages = [[(r.choice([72, 72.2, 200]), 700 - 12 * k - r.random(), " ".join(r.choice(words) for _ in range(r.randrange(4)))) for k in range(r.randrange(6))] for _ in range(3)]
        docs.append((f"d{i}", bytearray(write_pdf(pages, font=r.choice(["Helvetica", "Courier"])))))
    df = spark.createDataFrame(docs, "doc_id string, content binary")
    got = {x.doc_id: (x.markdown, x.warnings) for x in convert_pdf_tables(df).collect()}
    assert got == {i: document_markdown(bytes(b))[:2] for i, b in docs}
    runs = tables.pdf_text_runs(df)
    assert sorted(layout.text_lines(runs).collect()) == sorted(layout.text_lines(runs.drop("mono")).collect())


def test_workbook_parts_agree_with_reader(spark):
    r = random.Random(1)
    books = []
    for i in range(5):
        sheets = [(f"s{k}", [[r.choice(["a|b", "x  y", None, 3, 2.5]) for _ in range(r.randrange(1, 5))] + ["end"] for _ in range(20)]) for k in range(3)]
        books.append((i, bytearray(write_workbook(sheets, shared=bool(i % 2)))))
    df = spark.createDataFrame(books, "doc_id bigint, content binary")
    got = {(x.doc_id, x.sheet): x.md for x in sheet_markdown(resolved_cells(tables.workbook_parts(df))).collect()}
    from docweir.sources.workbook import sheet_table

    assert got == {(i, s.name): sheet_table(s.rows) for i, b in books for s in read_workbook(bytes(b)).sheets}


def test_workbook_parts_are_read_once_and_their_size_is_not_guessed(spark):
    book, made = write_workbook([("s", [["a", "1"], ["b", "2"]]), ("t", [["c"]])]), spark.sparkContext.accumulator(0)

    def make(_):
        made.add(1)
        return book

    docs = spark.range(0, 300, 1, 3).select(F.col("id").alias("doc_id"), F.udf(make, "binary")("id").alias("content"))
    cells = resolved_cells(tables.workbook_parts(docs))
    assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()  # before it runs: by guess
    got = sorted((r.doc_id, r.sheet, r.row_idx, r.col_idx, r.value) for r in cells.collect())
    assert got == [(i, *x) for i in range(300) for x in (("s", 0, 0, "a"), ("s", 0, 1, "1"), ("s", 1, 0, "b"), ("s", 1, 1, "2"), ("t", 0, 0, "c"))]
    assert made.value == 300


def test_convert(spark):
    html = "<html><body><p>x<b>y</b></p>"
    files = {"a.txt": b"a\r\nb\n\n\n\nc", "b.html": html.encode(), "c.bin": html.encode("utf-16"), "d.txt": "汉字编码".encode("gbk"), "e.docx": write_docx(["p"]), "f.xlsx": write_workbook([("s", [[str(i)] for i in range(1500)])]),
             "g.pdf": write_pdf([[(72, 700, "a line of text")]]), "h.png": bytes.fromhex("89504E470D0A1A0A") + bytes(9), "i": b"", "j.xlsx": b"PK\x03\x04 xl/ broken", "k.zip": b"PK\x03\x04 plain", "l": bytes(range(9)) * 9}
    df = spark.createDataFrame([(n, n, bytearray(b)) for n, b in files.items()], "doc_id string, name string, content binary")
    got = {r.doc_id: r for r in convert(df).collect()}
    assert len(got) == len(files)
    assert {n: (r.markdown, r.backend) for n, r in got.items() if not r.error and n != "f.xlsx"} == {
        "a.txt": ("a\nb\n\nc", "text"), "b.html": ("x**y**", "html"), "c.bin": ("x**y**", "html"), "d.txt": ("汉字编码", "text"), "e.docx": ("p", "docx"), "g.pdf": ("<!-- page 1/1 -->\n\na line of text", "pdf")}
    assert got["f.xlsx"].truncated and got["f.xlsx"].markdown.startswith("<!-- truncated: first 1 sheets") and got["f.xlsx"].scan.rows == 1001
    assert {n: r.error for n, r in got.items() if r.error} == {"h.png": "OCR_UNAVAILABLE", "i": "EMPTY_FILE", "j.xlsx": "Unreadable: damaged, or not an Office document", "k.zip": "UNSUPPORTED_ZIP", "l": "UNSUPPORTED_TYPE"}
    assert all((r.markdown == "") == (r.error is not None) for r in got.values())
    seen = {r.doc_id: r for r in convert(df, recognise=lambda content, k: [("poor", 10), ("a better text", 80)][k] if k < 2 else ("", None)).collect()}
    assert seen["h.png"].markdown == "a better text" and seen["h.png"].backend == "ocr"
    own = convert(df.where("doc_id = 'k.zip'"), registry={"zip": lambda name, content: {"markdown": f"{len(content)} bytes", "backend": "own"}}).first()
    assert own.markdown == "10 bytes" and own.error is None
    assert json.loads(meta_json(convert(df.where("doc_id = 'a.txt'"))).first().meta)["type"] == "text"


def test_convert_keeps_bytes_out_of_python(spark):
    """Plain text is cleaned by Spark; the one Python function gets a null for it, and types are worked out once."""
    df = spark.createDataFrame([("a", "a.txt", bytearray(b"x"))], "doc_id string, name string, content binary")
    plan = convert(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Generate") == 2 and "Join" not in plan


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"hello")
    (tmp_path / "in" / "b.html").write_bytes(b"<p>x")
    df = read_files(spark, str(tmp_path / "in"))
    assert sorted((r.name, r.length) for r in df.select("name", "length").collect()) == [("a.txt", 5), ("b.html", 4)]
    plan = df.where("length > 4").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    q = convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    (tmp_path / "in" / "c.txt").write_bytes(b"later")
    convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.option("basePath", str(tmp_path / "out")).parquet(*(str(p) for p in (tmp_path / "out").iterdir()))
    assert sorted(r.markdown for r in out.collect()) == ["hello", "later", "x"]


def test_types_by_heads(spark, tmp_path):
    files = {"a.gif": b"GIF89a\x01\x00\x01\x00" + bytes(100_000) + b"\x3b", "b.txt": b"GIF89a is text", "c.bin": b"", "d.xlsx": write_workbook([("s", [["x"]])]), "e.pdf": write_pdf([[(1, 1, "x")]])}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    got = {r.path.rsplit("/", 1)[1]: r for r in file_types(spark, f"file://{tmp_path}").collect()}
    assert {n: (r.type, r.detail, r.length, r.error) for n, r in got.items()} == {
        "a.gif": ("image", "gif", 100_011, None), "b.txt": ("text", None, 14, None), "c.bin": ("unknown", "empty", 0, "EMPTY_FILE"), "d.xlsx": ("xlsx", None, len(files["d.xlsx"]), None),
        "e.pdf": ("pdf", None, len(files["e.pdf"]), None)}


def test_streams_of_requests(spark, tmp_path):
    (tmp_path / "e").mkdir()
    spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 1), (4, "a", 7), (2, "a", 9)], "n int, uri string, seq bigint").withColumn(
        "ts", F.timestamp_seconds("n")).write.parquet(str(tmp_path / "e"), mode="overwrite")
    source = spark.readStream.schema("n int, uri string, seq bigint, ts timestamp").parquet(str(tmp_path / "e"))
    for name, df, mode in (("latest", latest_by_seq(source, "uri"), "complete"), ("once", once_per_uri(source), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.uri, r.seq) for r in spark.table("latest").collect()} == {("a", 9), ("b", 1)}
    assert sorted(r.uri for r in spark.table("once").collect()) == ["a", "b"]


def test_history_sink(spark, tmp_path):
    write = history_sink(spark, str(tmp_path / "h"), limit=3)
    batch = lambda *ids: spark.createDataFrame([(i, "n", "u", 5.0, "", "md", int(i)) for i in ids], "id string, name string, uri string, bytes double, mime string, kind string, created_at bigint")
    write(batch("1", "4", "2"), 0)
    write(batch("3", "5"), 1)
    write(batch("9"), 1)  # delivered again: nothing changes
    assert sorted(r.id for r in read_history(spark, str(tmp_path / "h")).collect()) == ["3", "4", "5"]


def test_history(spark):
    rows = [Row(id=f"r{i}", name=f"Name {i}", uri="u", bytes=1, mime="", kind="md", created_at=100 if i < 2 else 50 + i, ins_seq=i) for i in range(6)]
    df = spark.createDataFrame(rows)
    assert [r.id for r in history.listing(df).orderBy("place").collect()] == ["r1", "r0", "r5", "r4", "r3", "r2"]
    assert {r.id for r in history.evict(df, 2).collect()} == {"r0", "r1"}
    assert {r.id for r in history.remove(df, spark.createDataFrame([("r3",)], "id string")).collect()} == {"r0", "r1", "r2", "r4", "r5"}
    assert [r.id for r in history.search(df, " NAME 4 ").collect()] == ["r4"] and history.search(df, None).count() == 6
    assert history.append(df, df.where("false"), keep=False).count() == 6
    bad = spark.createDataFrame([("", "n", "u", 1.0, "", "md", 1.0, 9), ("x", "n", "u", 0.0, "", "md", 1.0, 9), ("y", "n", "u", 2.7, "", "zip", 1.5, 9)], "id string, name string, uri string, bytes double, mime string, kind string, created_at double, ins_seq bigint")
    new = history.append(df, bad, limit=100).where("ins_seq = 9").collect()
    assert [(r.id, r.bytes, r.mime, r.created_at) for r in new] == [("y", 2, "application/zip", 1)]
    assert {r.state for r in history.check_uris(df, None).collect()} == {"unknown"}


def test_segments():
    blank = "para\n\n" * 2000
    parts = preview.segments(blank)
    assert "".join(blank[a:b] for a, b, _ in parts) == blank and len(parts) == 3 and all(blank[a:b].endswith("\n\n") for a, b, _ in parts[:-1])
    table = "| a | b |\n" * 1000
    parts = preview.segments(table)
    assert "".join(table[a:b] for a, b, _ in parts) == table and parts[0][2] == "SPLIT_TABLE" and len(parts) > 2
    fenced = "```\n" + "x\n\n" * 3000 + "```\n\nafter"
    assert preview.segments(fenced)[0][1] == len(fenced) or fenced[: preview.segments(fenced)[0][1]].count("```") == 2
    marks = "**a**" * 20_000
    assert [b - a for a, b, _ in preview.segments(marks)][0] < len(marks)
    lone = "![i](data:image/png;base64," + "A" * 600_000 + ")"
    assert preview.segments(lone) == [(0, len(lone), "")]
    emoji = "😀" * 300_000
    assert all(emoji[a:b] for a, b, _ in preview.segments(emoji)) and preview.segments("") == []
    r = random.Random(3)
    for _ in range(50):
        s = "\n".join(r.choice(["", "text " * 30, "| a |", "- x", "```", "# h"]) for _ in range(400))
        assert "".join(s[a:b] for a, b, _ in preview.segments(s, 1024)) == s


def test_preview_is_safe():
    html, notes = preview.render_preview("# T\n\n[a](javascript:x) ![i](https://x/y.png) <video src=q></video><script>z</script>\n\n- [x] done\n\n| a | b |\n| --- | --- |\n| **c** | `d` |\n\n```\n<b>\n```\n\n[ref]\n\n[ref]: https://r")
    assert "javascript" not in html and "<video" not in html and "<script" not in html and "src=" not in html and not notes
    for part in ("<h1>T</h1>", "<a>a</a>", "[external image: i]", 'type="checkbox" disabled checked', "<th>a</th>", "<td><strong>c</strong></td>", "<code>d</code>", "<pre><code>&lt;b&gt;\n</code></pre>", 'href="https://r" target="_blank"'):
        assert part in html, part
    assert preview.definitions("[a]: x\n```\n[b]: y\n```\n  [c]: z") == "[a]: x\n  [c]: z\n"
    assert preview.cut_source("a😀b", 2) == ("a", True) and preview.cut_source("ab", 2) == ("ab", False)
    assert preview.image_html("data:image/png;base64," + "A" * (3 << 20), "x") == '<span class="md-image">[large image: x]</span>'


def test_new_records(spark):
    files = spark.createDataFrame([("a.md", "/x/a.md", 5, "md"), ("b.zip", "/x/b.zip", 6, "zip"), ("c.txt", "/x/c", 7, "txt")], "name string, path string, length bigint, kind string")
    new = history.new_records(files)
    empty = history.normalized(new.where("false"))
    got = history.append(empty, new).orderBy("ins_seq").collect()
    assert [(r.name, r.bytes, r.mime) for r in got] == [("a.md", 5, "text/markdown"), ("b.zip", 6, "application/zip")] and all(len(r.id) == 36 for r in got)


def test_packaging(spark, tmp_path):
    assert export.embed("![i](assets/a%20b.png) [l](x)", [("assets/a b.png", b"xyz", "image/png"), ("gone", None, "t")]) == ("![i](data:image/png;base64,eHl6) [l](x)", ["gone"])
    data, failed = export.archive("md", "d.md", [("assets/a.png", b"1", "t"), ("no", None, "t")])
    from docweir.sources.archive import Archive

    assert Archive(data).read("assets/a.png") == b"1" and failed == ["no"]
    files = spark.createDataFrame([("a.md", bytearray(b"x")), ("b/../../c", bytearray(b"y")), ("none/x", bytearray(b"z"))], "name string, content binary")
    got = {r.name: r.error for r in export.save_files(files, f"file://{tmp_path}/saved").collect()}
    assert got == {"a.md": None, "none/x": "BAD_NAME", "b/../../c": "BAD_NAME"} and (tmp_path / "saved/a.md").read_bytes() == b"x"


def test_no_file_is_lost(spark, tmp_path):
    """Files of one name, in any case, each get a name of their own that no other has."""
    files = [("a.md", b"1"), ("a.md", b"22"), ("A.md", b"333"), ("a (1).md", b"4444"), ("b", b"5"), ("b", b"66"), (".x", b"7"), (".x", b"88"), ("none.md", None), ("..", b"9"), (None, b"0")]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files], "name string, content binary").repartition(3)
    got = export.save_files(df, f"file://{tmp_path}/saved").collect()
    saved = {r.saved_as for r in got if r.error is None}
    assert len(got) == len(files) and len(saved) == 8 and len({x.lower() for x in saved}) == 8
    assert {"a (1).md", "b", "b (1)"} <= saved and sorted(p.name for p in (tmp_path / "saved").iterdir()) == sorted(saved)
    assert sorted(p.read_bytes() for p in (tmp_path / "saved").iterdir()) == sorted(c for n, c in files if c and n not in ("..", None))
    assert {(r.name, r.error) for r in got if r.error} == {("none.md", "NO_CONTENT"), ("..", "BAD_NAME"), (None, "BAD_NAME")}


def test_damaged_documents_give_no_rows(spark):
    """What a document yields before it turns out to be damaged does not stay."""
    from docweir.sources.tables import explode_documents, workbook_cells

    def some(value):
        yield 1, "a"
        if value == "bad":
            raise ValueError("broken")
        yield 2, "b"

    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "doc_id int, v string")
    assert sorted(map(tuple, explode_documents(docs, "v", some, "n int, s string").collect())) == [(1, 1, "a"), (1, 2, "b")]
    got = sorted(map(tuple, explode_documents(docs, "v", some, "n int, s string", errors=True).collect()), key=repr)
    assert got == [(1, 1, "a", None), (1, 2, "b", None), (2, None, None, "ValueError: broken")]
    book = write_workbook([("s", [["x"] * 50] * 400)])
    cut = spark.createDataFrame([(1, bytearray(book[:100]))], "doc_id int, content binary")
    assert [(r.value, r.error is None) for r in workbook_cells(cut, errors=True).collect()] == [(None, False)] and workbook_cells(cut).count() == 0


def test_large_members_are_refused():
    from docweir.sources.archive import Archive, pack_files

    a = Archive(pack_files([("zeros", bytes(300_000)), ("x", b"1")]))
    assert a.read("zeros", 300_000) == bytes(300_000) and a.read("x") == b"1"
    with pytest.raises(ValueError, match="MEMBER_TOO_LARGE"):
        a.read("zeros", 299_999)


def test_history_changes(spark):
    states = history.parse_state(spark.createDataFrame([('{"schemaVersion":1,"keepHistory":true,"records":[{"id":"a","name":"n","uri":"u","bytes":3,"mime":"m","kind":"md","createdAt":1}]}',), ("no",)], "state string"))
    assert [(r.keep_history, len(r.records), r.error) for r in history.clear(states).collect()] == [(True, 0, None), (True, 0, None)]
    off = history.set_keep(states, F.lit(False)).where("error is null")
    again = history.parse_state(off.select(history.state_text(off).alias("state"))).first()
    assert again.error is None and again.keep_history is False and again.records[0].id == "a"
    records = spark.createDataFrame([("a",), ("b",)], "id string")
    ids = spark.createDataFrame([("b",), ("c",), ("c",)], "id string")
    assert sorted((r.id, r.error) for r in history.removals(records, ids).collect()) == [("b", None), ("c", "not-found")]
    assert [r.id for r in history.remove(records, ids).collect()] == ["a"]


def test_history_sink_goes_on_after_a_new_checkpoint(spark, tmp_path):
    sc, top = spark.sparkContext, tmp_path / "h"
    write = history_sink(spark, str(top))
    batch = lambda i: spark.createDataFrame([(i, "n", "u", 1.0, "", "md", int(i))], "id string, name string, uri string, bytes double, mime string, kind string, created_at bigint")
    try:
        for query, number, i in (("q1", 0, "1"), ("q1", 1, "2"), ("q1", 1, "9"), ("q2", 0, "3"), ("q2", 1, "4")):
            sc.setLocalProperty("sql.streaming.queryId", query)
            write(batch(i), number)
    finally:
        sc.setLocalProperty("sql.streaming.queryId", None)
    assert sorted(r.id for r in read_history(spark, str(top)).collect()) == ["1", "2", "3", "4"]
    assert len(list(top.glob("v=*"))) == 2


def test_places_without_keys(spark):
    r = random.Random(1)
    records = spark.createDataFrame([(i, r.randrange(50), i) for i in range(500)], "id int, created_at int, ins_seq int").repartition(5)
    got = {x.id: x.place for x in history.listing(records).collect()}
    want = sorted(records.collect(), key=lambda x: (-x.created_at, -x.ins_seq))
    assert [got[x.id] for x in want] == list(range(1, 501))


def test_places_of_more_rows_than_the_sample_of_their_ranges(spark):
    rows = spark.range(0, 40_000, 1, 4).select(F.col("id").cast("string").alias("id"), (F.xxhash64("id") % 5000).alias("created_at"), F.col("id").alias("ins_seq"), F.lit("x" * 50).alias("name"))
    want = [r.id for r in sorted(rows.collect(), key=lambda x: (-x.created_at, -x.ins_seq))]
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merged)
    spark.conf.set(merged, "false")  # so few rows would be one range
    try:
        placed = history.listing(rows)
        assert [r.id for r in sorted(placed.collect(), key=lambda x: x.place)] == want
        assert sorted(r.place for r in placed.select("place").collect()) == list(range(1, 40_001))
        assert history.listing(rows.where("id < 0")).collect() == [] and [r.place for r in history.listing(rows.where("id = '7'")).collect()] == [1]
    finally:
        spark.conf.set(merged, before)


def test_chosen(spark):
    docs = spark.createDataFrame([(1, None, True), (2, "E", True), (3, None, False), (4, None, None)], "doc_id int, error string, sel boolean")
    assert [r.doc_id for r in export.chosen(docs, F.col("sel")).collect()] == [1] and export.chosen(docs).count() == 3


def test_layout_rules(spark):
    run = lambda s, x, w, size=12.0: (x, 0, s, w, size)
    lines = [[run("Hello", 50.0, 45.0), run("world", 96.0, 40.0)], [run("世", 0.0, 10.0), run("界", 30.0, 10.0)], [run("质量", 0.0, 20.0), run("chain", 30.0, 20.0)],
             [run("DUP", 10.0, 30.0), run("DUP", 10.3, 30.0), run("DUP", 12.0, 30.0)], [run("a ", 0.0, 5.0), run("b", 50.0, 5.0)], [run("x", 0.0, 5.0), run("y", 5.0, 5.0)]]
    df = spark.createDataFrame([(i, [(x, k, s, w, z) for k, (x, _, s, w, z) in enumerate(line)]) for i, line in enumerate(lines)],
                               "i int, runs array<struct<x:double,seq:int,str:string,w:double,font_size:double>>")
    got = [r.t for r in df.select("i", layout.line_text(F.col("runs")).alias("t")).orderBy("i").collect()]
    assert got == ["Hello world", "世界", "质量 chain", "DUP", "a b", "xy"]


def test_sql_functions(spark):
    names = register_all(spark)
    assert len(names) == 9
    assert spark.sql("SELECT md_from_html('<p>a<b>b') AS x").first().x == "a**b**"
    book = spark.createDataFrame([(bytearray(write_workbook([("s", [["a", 1], ["b", 2]])])),), (bytearray(b"no"),)], "content binary")
    book.createOrReplaceTempView("books")
    assert spark.sql("SELECT c.value FROM books, LATERAL xlsx_cells(content, 5, 1) c").count() == 2
    assert spark.sql("SELECT count(*) AS n FROM books, LATERAL zip_entries(content) z").first().n == 5
    assert spark.sql("SELECT md_from_xlsx(content) AS x FROM books WHERE content = X'6E6F'").first().x is None
