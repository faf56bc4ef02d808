"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from docweir.functions.numbers import js_number, short_number
from docweir.operators.preview import cut_source, render_preview, segments, units
from docweir.sources.archive import Archive, directory, pack_files
from docweir.sources.charset import decode_text
from docweir.sources.htmltree import parse_html
from docweir.sources.markdown import html_to_markdown
from docweir.sources.pdf import Lexer, PdfError, page_runs, write_pdf
from docweir.sources.workbook import column_of, letters, read_workbook, write_workbook

tags = st.sampled_from("p b i a em strong ul ol li table tr td th thead div span h1 pre code blockquote br hr img script title nobr button object caption".split())
markup = st.lists(st.one_of(tags.map(lambda t: f"<{t}>"), tags.map(lambda t: f"</{t}>"), st.sampled_from(["x", " ", "&amp;", "<!-- c -->", "\n"]))).map("".join)
few = settings(max_examples=150, deadline=None)


@few
@given(markup)
def test_any_markup_makes_a_sound_tree(html):
    body = parse_html(html)
    for e in body.walk():
        assert all(isinstance(c, str) or c.parent is e for c in e.children)
        assert e.tag != "td" or e.parent.tag == "tr"
    html_to_markdown(html)


@few
@given(st.text())
def test_any_text_as_html(s):
    md, _ = html_to_markdown(s)
    render_preview(md)


@few
@given(st.text(alphabet="ab `~|-*\n#é😀[](:", max_size=400), st.integers(1, 3000))
def test_segments_lose_nothing(s, limit):
    parts = segments(s, limit)
    assert "".join(s[a:b] for a, b, _ in parts) == s and all(a < b for a, b, _ in parts)


@few
@given(st.text(), st.integers(0, 50))
def test_cut_source(s, most):
    cut, was = cut_source(s, most)
    assert s.startswith(cut) and units(cut) <= max(most, 0) or not was and cut == s


@few
@given(st.binary(max_size=300))
def test_any_bytes_decode(data):
    assert isinstance(decode_text(data), str)
    assert isinstance(directory(data), list)
    Lexer(data).next()
    for read in (page_runs, read_workbook):
        try:
            read(data)
        except (PdfError, ValueError):
            pass


@few
@given(st.text())
def test_utf8_is_kept(s):
    data = s.encode("utf-8", "ignore")
    if not data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        assert decode_text(data) == data.decode()


@few
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(x):
    assert float(js_number(x)) == x
    assert abs(x) > 1e300 or abs(float(short_number(repr(x))) - x) <= abs(x) * 1e-14


@few
@given(st.integers(0, 16_383))
def test_columns(i):
    assert column_of(letters(i) + "1") == i


@few
@given(st.lists(st.tuples(st.text("abc/", min_size=1, max_size=5), st.binary(max_size=50)), max_size=5, unique_by=lambda x: x[0]))
def test_archives_read_back(files):
    a = Archive(pack_files(files))
    assert [(n, a.read(n)) for n in a.members][::-1] == files or {n: a.read(n) for n in a.members} == dict(files)


@few
@given(st.lists(st.lists(st.one_of(st.text("ab<&\"' é", max_size=6), st.integers(-999, 999)), min_size=1, max_size=4), min_size=1, max_size=6), st.booleans())
def test_workbooks_read_back(rows, shared):
    got = read_workbook(write_workbook([("s", rows)], shared)).sheets[0].rows
    assert got == [[str(v) for v in r] for r in rows]


@few
@given(st.lists(st.text("ab ()\\é", min_size=1, max_size=12), min_size=1, max_size=6))
def test_pdfs_read_back(texts):
    runs = page_runs(write_pdf([[(72, 700 - 20 * i, s) for i, s in enumerate(texts)]]))[0]
    assert [r.str for r in runs] == texts
