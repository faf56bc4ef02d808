"""HTML to Markdown: structure, spacing, and the rules of tree construction."""

import pytest

from docweir.sources.htmltree import parse_html
from docweir.sources.markdown import html_blocks, html_to_markdown

CASES = [
    ("<p>Hello <b>world</b>.</p>", "Hello **world**."),
    ("<p>这是<b>重点</b>内容。</p>", "这是**重点**内容。"),
    ("<p>The <em>quick</em> brown fox <code>jumps</code>.</p>", "The *quick* brown fox `jumps`."),
    ("<p>foo<span>bar</span>baz</p>", "foobarbaz"),
    ("<p>IP<sub>v6</sub></p>", "IPv6"),
    ("<p>a<b> b </b>c</p>", "a **b** c"),
    ("<p><s>x</s><del>y</del></p>", "~~x~~~~y~~"),
    ("<ol><li>one<ol><li>1.1</li><li>1.2</li></ol></li><li>two</li></ol>", "1. one\n   1. 1.1\n   2. 1.2\n2. two"),
    ("<ul><li><b>x</b> and <a href='https://x'>link</a></li></ul>", "- **x** and [link](https://x)"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td><b>x</b> A<br>B</td><td>C</td></tr></table>", "| A | B |\n| --- | --- |\n| **x** A B | C |"),
    ("<table><tr><td colspan=2>a<td>b</table>", "| a |  | b |\n| --- | --- | --- |"),
    ("<table><tr><td>a|b<table><tr><td>in</table></table>", "| a\\|bin |\n| --- |"),
    ("<table><caption>gone</caption><tr><td>x</table>", "| x |\n| --- |"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
    ("<a href='https://x/y.png'><img src='z.png' alt='q'></a>", "[![q](z.png)](https://x/y.png)"),
    ("<h1>A<br>B</h1>", "# A<br>B"),
    ("<ul><li><p>one</p><p>two</p></li></ul>", "- one\n\n  two"),
    ("<ul><li><div>d1</div><div>d2</div>tail</li></ul>", "- d1\n\n  d2\n\n  tail"),
    ("<ul><li>a<br>b</li></ul>", "- a\n  b"),
    ("<pre>l1\n\n\n\nl2</pre>", "```\nl1\n\n\n\nl2\n```"),
    ("<pre>```x</pre>", "````\n```x\n````"),
    ("<p><code>x`y</code> <code>`</code></p>", "``x`y`` `` ` ``"),
    ("<ol start='0'><li>a<li>b</ol>", "0. a\n1. b"),
    ("<a href='javascript:x'>l]k</a>", "[l\\]k]()"),
    ("<a href='x'></a>y", "y"),
    ("<img src='a (1).png' alt='a\n b]'>", "![a b%5D](a%20%281%29.png)"),
    ("<p>a<br>b</p>", "a\nb"),
    ("<form><p>a</p><p>b</p></form>", "ab"),
    ("<dl><dt>t<dd>d</dl>", "t\n\nd"),
    ("<p>x<hr>y", "x\n\n---\n\ny"),
    ("<label>name <input></label><button>go</button><script>p</script>", "name"),
    ("<title>head</title><p>x", "x"),
    ("&copy; &#8364; &amp;lt;", "© € &lt;"),
    ("<p><b>x<p>y", "**x**\n\n**y**"),
    ("a</p>b", "a\n\nb"),
    ("<table><tr>out<td>in</table>", "out\n\n| in |\n| --- |"),
    ("<p>1<b>2<i>3</b>4</i>5", "1**2*3****4*5"),
    ("<ul><li>a<ul><li>b</ul>c</ul>", "- a\n  - b\n  c"),
    ("", ""),
]


@pytest.mark.parametrize("html, want", CASES)
def test_case(html, want):
    assert html_to_markdown(html)[0] == want


def test_merged_cells_warn_once():
    assert html_to_markdown("<table><tr><td rowspan=2>a<td colspan=3>b</table>")[1] == ["MERGED_CELLS"]


def test_formats_reopen_at_most_three_times():
    body = parse_html("<p><b><b><b><b>x<p>y")
    second = [e for e in body.walk() if e.tag == "p"][1]
    assert sum(e.tag == "b" for e in second.walk()) == 3


def test_kinds():
    kinds = [b.kind for b in html_blocks("<h2>h</h2><p>p</p><ul><li>l</ul><table><tr><td>t</table><pre>c</pre><blockquote>q</blockquote><hr>")[0]]
    assert kinds == ["heading", "paragraph", "list", "table", "code", "quote", "rule"]


def test_deep_nesting_of_inline_markup():
    assert html_to_markdown("<span>" * 300 + "x")[0] == "x"
