"""Readers of file formats, on files built here."""

import re
import zipfile

import pytest

from docweir.functions.numbers import js_number, short_number
from docweir.sources.archive import Archive, directory, pack_files
from docweir.sources.charset import decode_text
from docweir.sources.docx import M, W, Damaged, convert_docx, write_docx
from docweir.sources.ocr import best_attempt
from docweir.sources.pdf import Lexer, PdfError, document_markdown, page_runs, write_pdf
from docweir.sources.workbook import area, cells_of, column_of, entities, letters, placed, read_workbook, serial_date, write_workbook


@pytest.mark.parametrize("data, text", [
    (bytes.fromhex("D6D0CEC4B2E2CAD4"), "中文测试"),
    (b'<meta charset="gbk">' + "中".encode("gbk"), '<meta charset="gbk">中'),
    (b'<meta name="viewport"><META CHARSET=gb2312>' + "中".encode("gbk"), '<meta name="viewport"><META CHARSET=gb2312>中'),
    (b'<meta charset="big5">' + bytes.fromhex("A741A66E"), '<meta charset="big5">你好'),
    (b'<meta charset="windows-1252">\xe9', '<meta charset="windows-1252">�'),
    ("中文".encode()[:-1], "中�"),
    (b"a" * 5000 + "汉字编码".encode("gbk"), "a" * 5000 + "汉字编码"),
    (b"abc\xb0\xb0", "abc��"),
    ("中".encode() + b"\xb0\xb0", "中��"),
    (b"\xef\xbb\xbfx", "x"), ("x中".encode("utf-16"), "x中"), (b"\xfe\xff\x00x", "x"), (b"", ""), (None, ""),
])
def test_decode(data, text):
    assert decode_text(data) == text


@pytest.mark.parametrize("x, text", [(34.2, "34.2"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (1e-6, "0.000001"), (1e20, "1" + "0" * 20), (5e-324, "5e-324"), (100.0, "100"),
                                     (-2.5e22, "-2.5e+22"), (0.0, "0"), (123456789.125, "123456789.125")])
def test_js_number(x, text):
    assert js_number(x) == text


@pytest.mark.parametrize("literal, text", [("34.200000000000003", "34.2"), ("0.30000000000000004", "0.3"), ("12345678901234567890", "12345678901234567890"), ("1.0", "1.0"),
                                           ("1.5E2", "1.5E2"), ("46282.612731481495", "46282.6127314815"), ("1e-7", "1e-7")])
def test_short_number(literal, text):
    assert short_number(literal) == text


def test_archive():
    data = pack_files([("a.txt", b"x" * 500_000), ("b/c.bin", b"")])
    assert data == pack_files([("a.txt", b"x" * 500_000), ("b/c.bin", b"")])
    assert [(m.name, m.size) for m in directory(data)] == [("a.txt", 500_000), ("b/c.bin", 0)]
    a = Archive(data)
    chunks = a.chunks("a.txt")
    assert len(next(chunks)) <= 64 * 1024 and a.unpacked <= 64 * 1024
    assert a.read("nope") is None and Archive(b"PK").members == {} and directory(data[:-30]) == []
    far = bytearray(data)
    at = far.rfind(b"PK\x01\x02")
    far[at + 42 : at + 46] = (0x7FFFFF00).to_bytes(4, "little")
    assert Archive(bytes(far)).read("b/c.bin") is None


def rebuilt(data, **parts):
    """A workbook with some parts replaced or, for None, left out."""
    import io

    z = zipfile.ZipFile(io.BytesIO(data))
    names = {n: z.read(n) for n in z.namelist()}
    for n, x in parts.items():
        key = next((k for k in names if k.endswith(n.replace("__", "."))), n.replace("__", "."))
        names.pop(key, None)
        if x is not None:
            names["xl/" + key if "/" not in key else key] = x.encode()
    return pack_files(list(names.items()))


def test_workbook_basics():
    b = read_workbook(write_workbook([("A & b", [["h", "h|2"], ["x", 1.5], [None, 34.200000000000003]])]))
    assert b.markdown() == "### Sheet: A & b\n\n| h | h\\|2 |\n| --- | --- |\n| x | 1.5 |\n|  | 34.2 |" and b.engine == "xlsx-stream" and not b.all_warnings()
    assert read_workbook(write_workbook([("s", [["a"], ["b"]])], shared=False)).sheets[0].rows == [["a"], ["b"]]


def test_workbook_limits_and_early_stop():
    small, big = (write_workbook([("s", [[f"r{i}", i] for i in range(n)])] + [(f"t{i}", [[7]]) for i in range(6)]) for n in (3000, 60_000))
    a, b = read_workbook(small), read_workbook(big)
    assert a.sheets[0].scanned == b.sheets[0].scanned == 1001 and len(b.sheets[0].rows) == 1000 and b.n_sheets == 7 and len(b.sheets) == 5
    assert b.all_warnings()[-1].startswith("TRUNCATED") and "2 more sheets" in b.markdown()
    assert b.unpacked < 1.3 * a.unpacked  # does not grow with the file


def test_workbook_follows_relations():
    data = write_workbook([("one", [["first"]]), ("two", [["second"]])])
    rels = ('<Relationships><Relationship Id="rId1" Target="../worksheets/sheet2.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
    b = read_workbook(rebuilt(data, workbook__xml__rels=rels))
    assert [(s.name, s.rows) for s in b.sheets] == [("one", [["second"]]), ("two", [["first"]])]


def test_workbook_dates_and_kinds():
    sheet = ('<worksheet><sheetData><row><c r="A1" s="1"><v>45123</v></c><c r="B1" s="2"><v>45292.75</v></c><c r="C1" t="d"><v>2021-06-10T00:47:45Z</v></c>'
             '<c r="D1" t="b"><v>1</v></c><c r="E1" t="str"><v>a&amp;b &#x4e2d;</v></c><c r="F1" s="3"><v>45123</v></c><c r="G1" t="e"><v>#N/A</v></c></row><row/>'
             '<row><c r="C2"><v>3</v></c><c r="A2"><v>1</v></c><c><v>9</v></c></row></sheetData></worksheet>')
    styles = ('<styleSheet><numFmts><numFmt numFmtId="170" formatCode="[$-409]yyyy"/><numFmt numFmtId="171" formatCode="[Red]0.0"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
    data = rebuilt(write_workbook([("s", [["x"]])]), sheet1__xml=sheet)
    data = rebuilt(data, **{"styles__xml": styles})
    rows = read_workbook(data).sheets[0].rows
    assert rows == [["2023-07-16", "2024-01-01", "2021-06-10", "true", "a&b 中", "45123", "#N/A"], [], ["1", "", "3", "9"]]


def test_workbook_falls_back():
    sheet = '<worksheet><dimension ref="A1:B1"/><sheetData>' + "".join(f"<row><c r='A{i}'><v>{i}</v></c><c r='B{i}'><v>2</v></c><c r='C{i}'><v>3</v></c></row>" for i in (1, 2)) + "</sheetData></worksheet>"
    top = "<workbook xmlns:r='http://x/relationships'><sheets><sheet name='Q' r:id='rId1'/></sheets></workbook>"
    b = read_workbook(rebuilt(write_workbook([("s", [["x"]])]), sheet1__xml=sheet, workbook__xml=top))
    assert b.engine == "xlsx-lenient" and b.sheets[0].name == "Q" and b.sheets[0].rows == [["1", "2"]] and b.warnings == ["AREA_LOSS: Q: 1 columns, 1 rows"]
    data = rebuilt(write_workbook([("s", [["x"]])]), **{"styles__xml": "<styleSheet/>"})
    assert read_workbook(data).warnings == ["DATE_STYLE_RISK"]
    with pytest.raises(ValueError):
        read_workbook(b"PK\x05\x06" + bytes(18))


def test_workbook_cells():
    assert [c.value for c in cells_of('<c r="A1" t="inlineStr"><is><t>x</t><rPh><t>y</t></rPh><r><t>z</t></r></is></c><c r="B1"/>')] == ["xz", ""]
    assert [column_of(r) for r in ("A1", "aa7", "XFD1", "XFE1", "7", "ZZZZZZ")] == [0, 26, 16383, -1, -1, -1]
    assert placed([("B1", "b"), ("", "c"), ("A1", "a"), ("B1", "d")]) == ["a", "d", "c"]
    assert [letters(i) for i in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert area("$A$1:C3") == (3, 3) and area("B") == (2, 1) and area("1:2") is None
    assert [serial_date(s, False) for s in (1, 59, 60, 61, 45123.9)] == ["1900-01-01", "1900-02-28", "1900-03-01", "1900-03-01", "2023-07-16"]
    assert serial_date(0, True) == "1904-01-01" and entities("&lt;&#65;&#x1F600;&#x110000;&nope;") == "<A😀&#x110000;&nope;"


def docx(body, **parts):
    xml = f'<w:document xmlns:w="{W[1:-1]}" xmlns:m="{M[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>{body}</w:body></w:document>'
    return pack_files([("word/document.xml", xml.encode()), *((n.replace("__", "/"), x if isinstance(x, bytes) else x.encode()) for n, x in parts.items())])


def run(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t xml:space='preserve'>{text}</w:t></w:r>"


@pytest.mark.parametrize("body, md", [
    (f"<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr>{run('Title')}</w:p><w:p>{run('a ')}{run('b', '<w:b/>')}{run('c', '<w:b/><w:i/>')}</w:p>", "## Title\n\na **b*c***"),
    (f"<w:p>{run('x', '<w:strike/>')} {run('y', '<w:dstrike/>')}{run('z', '<w:dstrike w:val=%soff%s/>' % (chr(34), chr(34)))}</w:p>", "~~xy~~z"),
    (f"<w:tbl><w:tr><w:tc><w:p>{run('A')}</w:p></w:tc><w:tc><w:p>{run('B')}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run('1')}</w:p></w:tc></w:tr></w:tbl>", "| A | B |\n| --- | --- |\n| 1 |  |"),
    ("<w:p><m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath></w:p>", "$x^{2}$"),
    ("<w:p><m:oMath><m:d><m:e><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b²</m:t></m:r></m:den></m:f></m:e></m:d></m:oMath></w:p>", r"$(\frac{a}{b^2})$"),
    ("<w:p><m:oMathPara><m:oMath><m:rad><m:deg><m:r><m:t>3</m:t></m:r></m:deg><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad></m:oMath></m:oMathPara></w:p>", r"$$\sqrt[3]{x}$$"),
    ("<w:p><m:oMathPara><m:oMath><m:r><m:t>p</m:t></m:r></m:oMath><m:oMath><m:r><m:t>q</m:t></m:r></m:oMath></m:oMathPara></w:p>", "$p$$q$"),
    ("<w:p><m:oMath><m:sSup><m:sup><m:r><m:t>n</m:t></m:r></m:sup></m:sSup></m:oMath></w:p>", "$^{n}$"),
])
def test_docx(body, md):
    assert convert_docx(docx(body)).markdown == md


def test_docx_lists_links_images():
    item = lambda n, level, text: f"<w:p><w:pPr><w:numPr><w:ilvl w:val='{level}'/><w:numId w:val='{n}'/></w:numPr></w:pPr>{run(text)}</w:p>"
    numbering = (f'<w:numbering xmlns:w="{W[1:-1]}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl>'
                 '</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    image = ('<w:r><w:drawing><a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture">'
             '<pic:nvPicPr><pic:cNvPr name="photo.jpeg" descr="%s"/></pic:nvPicPr><pic:blipFill><a:blip r:embed="%s"/></pic:blipFill></pic:pic></a:graphic></w:drawing></w:r>')
    rels = '<Relationships><Relationship Id="r1" Target="https://x/y"/><Relationship Id="r2" Target="media/i.jpeg"/><Relationship Id="r3" Target="media/no.png"/></Relationships>'
    body = item(1, 0, "one") + item(1, 1, "sub") + item(1, 0, "two") + f"<w:p><w:hyperlink r:id='r1'>{run('link')}</w:hyperlink></w:p><w:p>{image % ('a&#10; b', 'r2')}{image % ('', 'r2')}{image % ('', 'r3')}</w:p>"
    out = convert_docx(pack_files([
        ("word/document.xml", zip_part(docx(body))), ("word/numbering.xml", numbering.encode()), ("word/_rels/document.xml.rels", rels.encode()), ("word/media/i.jpeg", b"JPEG")]), "my file.docx")
    assert out.markdown == "1. one\n   - sub\n2. two\n\n[link](https://x/y)\n\n![a b](assets/my-file-1.jpg)![photo](assets/my-file-2.jpg)![]()"
    assert [(a.name, a.type) for a in out.assets] == [("assets/my-file-1.jpg", "image/jpeg"), ("assets/my-file-2.jpg", "image/jpeg")] and out.warnings == ["ASSETS: 2"]


def zip_part(data):
    return Archive(data).read("word/document.xml")


def test_docx_damage():
    for data, code in ((b"no zip", "DAMAGED_ARCHIVE"), (pack_files([("x", b"")]), "NO_DOCUMENT_PART"), (pack_files([("word/document.xml", b"<w")]), "DAMAGED_DOCUMENT_PART")):
        with pytest.raises(Damaged, match=code):
            convert_docx(data)
    assert convert_docx(docx("<w:p><m:oMath><m:nary><m:e><m:r><m:t>∑ x</m:t></m:r></m:e></m:nary></m:oMath></w:p>")).warnings == ["PLAIN_FORMULAS: 1"]
    assert convert_docx(write_docx(["a <b>", "c & d"])).markdown == "a <b>\n\nc & d"


def pdf(content, font=b"/Type /Font /Subtype /Type1 /BaseFont /Courier", extra=b""):
    return (b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]/Resources<</Font<</F 4 0 R>>>>>> endobj 3 0 obj <</Type/Page/Parent 2 0 R/Contents 5 0 R>> endobj "
            b"4 0 obj <<" + font + b">> endobj 5 0 obj <</Length %d>> stream\n" % len(content) + content + b"\nendstream endobj " + extra + b"trailer <</Root 1 0 R>>")


def texts(data):
    return [(r.str, r.x, r.sy) for r in page_runs(data)[0]]


def test_pdf_text_state():
    assert texts(pdf(b"BT /F 10 Tf 1 0 0 -1 72 700 Tm (a) Tj 0 -20 Td (b) Tj ET")) == [("a", 72, -700), ("b", 72, -680)]
    assert texts(pdf(b"BT /F 10 Tf 14 TL 5 90 Td (a) Tj T* (b) Tj (c) ' 0 0 (d) \" ET BT (e) Tj ET")) == [("a", 5, 90), ("b", 5, 76), ("c", 5, 62), ("d", 5, 48), ("e", 0, 0)]
    assert texts(pdf(b"BT /F 280 Tf 0.05 0 0 -0.05 10 20 Tm (a) Tj 280 0 TD (b) Tj ET"))[1][1] == pytest.approx(24)
    assert page_runs(pdf(b"BT /F 10 Tf [(ab) 100 (c)] TJ ET"))[0][0].w == pytest.approx(18 + 1)
    assert texts(pdf(rb"BT /F 1 Tf (\(x\)\101\n) Tj <4142> Tj ET"))[0][0] == "(x)A" and texts(pdf(b"BT /F 1 Tf <4142> Tj ET"))[0][0] == "AB"


def test_pdf_fonts():
    cmap = b"6 0 obj <</Length 200>> stream\n1 begincodespacerange <0000><FFFF> endcodespacerange 1 beginbfchar <0001><D840DC00> endbfchar 1 beginbfrange <0002><0003><4E2D> endbfrange\nendstream endobj "
    wide = b"/Type /Font /Subtype /Type0 /ToUnicode 6 0 R /DescendantFonts [<</DW 500 /W [1 [900]]>>]"
    r = page_runs(pdf(b"BT /F 10 Tf <000100020009> Tj ET", wide, cmap))[0][0]
    assert r.str == "\U00020000中�" and r.w == pytest.approx(19)
    r = page_runs(pdf(b"BT /F 10 Tf (AB) Tj ET", b"/Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding<</Differences[65/uniE050/eacute.x/comma]>>"))[0][0]
    assert r.str[0] == "\ue050"


def test_pdf_layout():
    lines = [(72, 700, "Title"), (72, 680, "left"), (300, 680, "right"), (72, 650, "word"), (101, 650, "s")]
    md, warnings, _ = document_markdown(write_pdf([lines]))
    assert md == "<!-- page 1/1 -->\n\nTitle\nleft right\nword s" and not warnings
    assert document_markdown(write_pdf([[(72, 700, "# not a heading"), (72, 680, "import x")]], font="Courier"))[0] == "<!-- page 1/1 -->\n\n```\n# not a heading\nimport x\n```"
    assert document_markdown(pdf(b"BT /F 12 Tf (TOKEN-TOKEN) Tj 0.3 0 Td (TOKEN-TOKEN) Tj 0.6 0 Td (TOKEN-TOKEN) Tj ET"))[0].count("TOKEN-TOKEN") == 1


def test_pdf_ocr():
    poor = write_pdf([[(72, 700, "ab")], [], [(72, 700, "a page that is long enough")]])
    assert document_markdown(poor)[1] == ["OCR_UNAVAILABLE: page 1", "OCR_PAGE_SKIPPED: page 2"]
    md, warnings, n = document_markdown(poor, lambda page: {1: "n", 2: "scanned text"}[page])
    assert n == 1 and "scanned text" in md and warnings == ["OCR_NOT_BETTER: page 1"]


def test_pdf_damage():
    with pytest.raises(PdfError):
        document_markdown(b"%PDF-1.4 nothing")
    with pytest.raises(PdfError, match="ENCRYPTED"):
        page_runs(pdf(b"").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))
    assert Lexer(b"<< /A [1 0 R (x] /B").next() is not None
    assert texts(pdf(b"BT /F 10 Tf (kept) Tj [/X] Tm (x) Tj ET"))[0][0] == "kept"


def test_best_attempt():
    assert best_attempt(lambda k: [("good text", 88), ("", None)][k]) == ("good text", [])
    assert best_attempt(lambda k: [("bad", 22), ("中文中文", 70)][k]) == ("中文中文", [])
    assert best_attempt(lambda k: [("中" * 25 + "x" * 25, 70), ("a", 50)][k]) == ("中" * 25 + "x" * 25, ["MIXED_SCRIPT"])
    assert best_attempt(lambda k: ("", None)) == ("", ["OCR_EMPTY"])


def test_no_needless_backtracking():
    assert re.sub("x", "", read_workbook(write_workbook([("s", [["<" * 50_000]])])).sheets[0].rows[0][0]) == "<" * 50_000


def test_raised_and_lowered_characters():
    """Every character that Unicode names as a raised or lowered letter or digit and that a formula may hold."""
    import unicodedata

    from docweir.sources.docx import _LOWERED, _RAISED, _TEX

    assert len(_RAISED) + len(_LOWERED) == 62
    for table, mark in ((_RAISED, "^"), (_LOWERED, "_")):
        for c, plain in table.items():
            assert unicodedata.normalize("NFKC", c) == plain and c.translate(_TEX) == mark + plain


def test_docx_tables_in_cells_and_names_of_images():
    from docweir.functions.text import alt_text  # noqa: F401
    from docweir.sources.archive import pack_files
    from docweir.sources.docx import A, PIC, R, W, convert_docx

    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    inner = f"<w:tbl><w:tr><w:tc>{p('in')}</w:tc><w:tc>{p('ner')}</w:tc></w:tr></w:tbl>"
    control = f"<w:sdt><w:sdtContent><w:tr><w:tc>{p('c')}</w:tc><w:tc>{p('d')}</w:tc></w:tr></w:sdtContent></w:sdt>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}{inner}{p('z')}</w:tc><w:tc>{p('b')}</w:tc></w:tr>{control}</w:tbl>"
    image = lambda k: f'<w:p><w:r><w:drawing><pic:cNvPr {k}/><a:blip r:embed="i"/></w:drawing></w:r></w:p>'
    body = table + image('name="n.png" descr="photo.png"') + image('name="pic.jpeg" descr=" "')
    xml = f'<w:document xmlns:w="{W[1:-1]}" xmlns:a="{A[1:-1]}" xmlns:pic="{PIC[1:-1]}" xmlns:r="{R[1:-1]}"><w:body>{body}</w:body></w:document>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="i" Target="media/x.png"/></Relationships>'
    got = convert_docx(pack_files([("word/document.xml", xml.encode()), ("word/_rels/document.xml.rels", rels.encode()), ("word/media/x.png", b"x")]), "d.docx")
    assert got.markdown.startswith("| a inner z | b |\n| --- | --- |\n| c | d |")
    assert "![photo](assets/d-1.png)" in got.markdown and "![pic](assets/d-2.png)" in got.markdown


def test_joined_workbook_shows_what_the_reader_shows(spark):
    """Dates of both systems, long numbers, entities, booleans and strings, by the reader and by the joins."""
    from docweir.plans.workbook import resolved_cells
    from docweir.sources.archive import pack_files
    from docweir.sources.tables import workbook_cells, workbook_parts

    def book(late):
        cells = ['<c r="A1" s="1"><v>45123.7</v></c>', '<c r="B1"><v>34.200000000000003</v></c>', '<c r="C1" t="str"><v>a&amp;b</v></c>', '<c r="D1" t="b"><v> 1 </v></c>', '<c r="E1" t="s"><v>1</v></c>',
                 '<c r="F1"><v>1e5</v></c>', '<c r="G1"><v>12345678901234567890</v></c>', '<c t="inlineStr"><is><t>x &lt; y</t></is></c>', '<c r="J1" s="1"><v>59</v></c>', '<c r="K1" t="e"><v>#N/A</v></c>']
        return pack_files([
            ("xl/workbook.xml", f'<workbook><workbookPr{" date1904=" + chr(34) + "1" + chr(34) if late else ""}/><sheets><sheet name="a &amp; b" r:id="r1"/></sheets></workbook>'.encode()),
            ("xl/_rels/workbook.xml.rels", b'<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/><Relationship Id="r2" Target="worksheets/unused.xml"/></Relationships>'),
            ("xl/styles.xml", b'<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'),
            ("xl/sharedStrings.xml", b"<sst><si><t>zero</t></si><si><t>one</t></si><si><t>two</t></si></sst>"),
            ("xl/worksheets/s.xml", f'<worksheet><sheetData><row>{"".join(cells)}</row></sheetData></worksheet>'.encode()),
            ("xl/worksheets/unused.xml", b'<worksheet><sheetData><row><c r="A1"><v>7</v></c></row></sheetData></worksheet>')])

    docs = spark.createDataFrame([(1, bytearray(book(False))), (2, bytearray(book(True)))], "doc_id int, content binary")
    read = {(r.doc_id, r.col_idx): r.value for r in workbook_cells(docs).collect() if r.value}
    parts = workbook_parts(docs)
    joined = {(r.doc_id, r.col_idx): r.value for r in resolved_cells(parts).collect()}
    assert joined == read and read[1, 0] == "2023-07-16" and read[2, 0] == "2027-07-17" and read[1, 1] == "34.2" and read[1, 2] == "a&b"
    assert [r.text for r in parts.where("doc_id = 1 and what = 'string'").orderBy("num").collect()] == ["zero", "one"]  # none after the last one named
    assert parts.where("what = 'cell' and part like '%unused%'").count() == 0


def test_pages_in_one_pass_and_by_tables_agree(spark):
    """The line rules as one pass over a document and as windows over a table of runs, on runs at random places."""
    import random

    from docweir.plans.convert import convert, convert_pdf_tables
    from docweir.sources.pdf import write_pdf

    r = random.Random(6)
    words = ["alpha", "beta ", " gamma", "x", "12", "(a)", "naïve", "end."]
    books = []
    for k in range(40):
        pages = [[(72 + r.choice([0, 0.2, 20, 31, 60, 140]) * r.randrange(1, 4), 700 - 7 * r.randrange(12), r.choice(words)) for _ in range(r.randrange(1, 25))] for _ in range(r.randrange(1, 4))]
        books.append((k, "a.pdf", bytearray(write_pdf(pages, r.choice(["Helvetica", "Courier"])))))
    files = spark.createDataFrame(books, "doc_id int, name string, content binary")
    one = {x.doc_id: (x.markdown, x.warnings) for x in convert(files).collect()}
    by_tables = {x.doc_id: (x.markdown, x.warnings) for x in convert_pdf_tables(files).collect()}
    assert one == by_tables
