"""Queries that hold single rules of the converters against SQL: each makes documents of the driver's tables, converts them, and states in SQL over the same tables what
has to come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from docweir.functions import numbers, sniffing, text
from docweir.operators import export, history, layout
from docweir.plans.catalog import dealt, query, read
from docweir.plans.convert import convert
from docweir.plans.workbook import resolved_cells
from docweir.sources import tables as exploded


def _markdown(rows: DataFrame, key: str, html: Column) -> DataFrame:
    """(key, md) of HTML made of rows."""
    files = rows.select(F.col(key).alias("doc_id"), F.lit("x.html").alias("name"), F.encode(html, "UTF-8").alias("content"))
    return convert(files).select(F.col("doc_id").alias(key), F.col("markdown").alias("md"), F.col("warnings"), "error")


def _html(template: str) -> Column:
    """HTML with columns in braces, as an expression."""
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.col(piece).cast("string") if i % 2 else F.lit(piece))
    return F.concat(*parts)


# -- types and small rules, over contents made of the tables ------------------------------------------------------------------------

@query(r"""SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN 'docx' WHEN 5 THEN 'xlsx' WHEN 6 THEN 'zip' WHEN 7 THEN 'unknown' WHEN 8 THEN 'text' ELSE 'text' END AS type,
CASE p_size % 10 WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'tiff' WHEN 7 THEN 'binary' END AS detail FROM part""")
def sniff_made(spark, sf_dir):
    """Types of contents: a signature, and after it the words of the table; words that only look like one are text."""
    k = F.col("p_size") % 10
    words = F.encode(F.concat_ws(" ", "p_name", "p_type"), "UTF-8")
    start = lambda b: F.concat(F.lit(bytearray(b)), words)
    content = (F.when(k == 0, F.concat(start(b"%PDF-1.7\n"), F.lit(bytearray(b"\n1 0 obj\n<<>>\nendobj\n%%EOF")))).when(k == 1, start(bytes.fromhex("89504E470D0A1A0A"))).when(k == 2, start(bytes.fromhex("FFD8FFE0")))
               .when(k == 3, start(b"MM\x00*")).when(k == 4, F.concat(F.lit(bytearray(b"PK\x03\x04")), words, F.lit(bytearray(b" word/document.xml")))).when(k == 5, F.concat(F.lit(bytearray(b"PK\x03\x04")), words, F.lit(bytearray(b" xl/workbook.xml"))))
               .when(k == 6, start(b"PK\x03\x04")).when(k == 7, F.concat(words, F.lit(bytearray(b"\x00\x01\x02\x03" * 30)))).when(k == 8, start("中文 %PDF-1.7 ".encode())).otherwise(words))
    return read(spark, sf_dir, "part").select("p_partkey", sniffing.sniff(content).alias("s")).select("p_partkey", "s.type", "s.detail")


@query(r"""SELECT p_partkey, '第' || p_size || '章 ' || p_name || ' 中文，' || p_brand || '很好' || chr(10) || ' 下行' || p_size || ' ' || p_partkey AS collapsed FROM part""")
def cjk_made(spark, sf_dir):
    """Spaces between CJK characters, their punctuation and digits go; those at Latin words, between digits and across lines stay."""
    return read(spark, sf_dir, "part").select("p_partkey", text.collapse_cjk_spaces(_html("第 {p_size}　章 {p_name} 中 文 ，{p_brand} 很\t好\n 下行 {p_size} {p_partkey}")).alias("collapsed"))


@query(r"""SELECT p_partkey, p_size <> 0 AND (p_size BETWEEN 14 AND 22 OR p_size BETWEEN 27 AND 36 OR p_size BETWEEN 45 AND 47 OR p_size BETWEEN 50 AND 58
OR regexp_matches(regexp_replace(CASE p_partkey % 3 WHEN 0 THEN '[' || p_name || ']0.0' WHEN 1 THEN '0' || p_name ELSE '#,##0[open ' || p_name END, '\[[^\]]*(\]|$)', '', 'g'), '(?i)[ymdhs]')) AS is_date FROM part""")
def date_codes(spark, sf_dir):
    """Number formats that show dates: by number, or by a letter outside brackets."""
    k = F.col("p_partkey") % 3
    code = F.when(k == 0, _html("[{p_name}]0.0")).when(k == 1, _html("0{p_name}")).otherwise(_html("#,##0[open {p_name}"))
    return read(spark, sf_dir, "part").select("p_partkey", numbers.is_date_format(F.col("p_size"), code).alias("is_date"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 1 THEN 'schema' WHEN p_size % 5 IN (2, 3) OR p_partkey % 7 = 0 THEN 'corrupt' END AS error, CASE WHEN p_size % 5 IN (0, 4) AND p_partkey % 7 <> 0 THEN 2 ELSE 0 END AS n FROM part""")
def history_texts(spark, sf_dir):
    """States of a history as texts: of another version, damaged, with one record twice, or with one that is not valid."""
    one = lambda ident, kind: F.concat(F.lit('{"id":"'), ident, F.lit('","name":"'), F.col("p_name"), F.lit('","uri":"u","bytes":'), F.col("p_size").cast("string"), F.lit(',"kind":"'), kind, F.lit('","createdAt":1}'))
    k = F.col("p_size") % 5
    second = one(F.when(k == 2, F.lit("a")).otherwise(F.lit("b")), F.when(F.col("p_partkey") % 7 == 0, F.lit("pdf")).otherwise(F.lit("zip")))
    state = F.concat(F.lit('{"schemaVersion":'), F.when(k == 1, "2").otherwise("1"), F.lit(',"keepHistory":true,"records":['), one(F.lit("a"), F.lit("md")), F.lit(","), second, F.when(k == 3, "]").otherwise("]}"))
    out = history.parse_state(read(spark, sf_dir, "part").select("p_partkey", state.alias("state")))
    return out.select("p_partkey", "error", F.coalesce(F.size("records"), F.lit(0)).alias("n"))


# -- HTML -------------------------------------------------------------------------------------------------------------------------

@query("""SELECT p_partkey, 'a **' || p_name || '** *' || p_type || '* ~~' || p_brand || '~~ `' || p_size || '` [' || p_name || '](https://x/' || p_partkey || ') ![' || p_brand || '](p' || p_size || '.png) z' AS md FROM part""")
def html_inline(spark, sf_dir):
    """Bold, italic, struck, code, links and images in one paragraph."""
    html = _html("<p>a <b>{p_name}</b> <em>{p_type}</em> <del>{p_brand}</del> <code>{p_size}</code> <a href='https://x/{p_partkey}'>{p_name}</a> <img src='p{p_size}.png' alt='{p_brand}'> z</p>")
    return _markdown(dealt(spark, sf_dir, "part"), "p_partkey", html).select("p_partkey", "md")


@query("""SELECT p_partkey, p_name || '**' || p_type || '**' || p_brand || ' **' || p_size || '** ' || p_name || chr(10) || p_brand || p_type AS md FROM part""")
def html_spacing(spark, sf_dir):
    """White space moves out of marks, seams without any get none, and a line break is one."""
    html = _html("<p>{p_name}<strong>{p_type}</strong>{p_brand}<b>  {p_size} </b>\n\t{p_name}<br>{p_brand}<span>{p_type}</span></p>")
    return _markdown(dealt(spark, sf_dir, "part"), "p_partkey", html).select("p_partkey", "md")


@query("""SELECT p_partkey, repeat('#', CAST(p_size % 6 + 1 AS INT)) || ' ' || p_name || '<br>' || p_brand || chr(10) || chr(10) || '> ' || p_type || chr(10) || '>' || chr(10) || '> ' || p_name
|| chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'tail ' || p_size AS md FROM part""")
def html_blocks(spark, sf_dir):
    """Headings of each level with a break, quotes of paragraphs, rules, and text after a block."""
    level = (F.col("p_size") % 6 + 1).cast("string")
    html = F.concat(F.lit("<h"), level, F.lit(">"), _html("{p_name}<br>{p_brand}</h1>\n<blockquote><p>{p_type}</p><p>{p_name}</p></blockquote><p> </p><hr>tail {p_size}"))
    return _markdown(dealt(spark, sf_dir, "part").withColumn("n", level), "p_partkey", F.regexp_replace(html, "</h1>", F.concat(F.lit("</h"), level, F.lit(">")))).select("p_partkey", "md")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '````' || chr(10) || '```' || p_name || chr(10) || '````' ELSE '```' || chr(10) || p_name || chr(10) || chr(10) || chr(10) || chr(10) || '  ' || p_type || chr(10) || '```' END
|| chr(10) || chr(10) || CASE WHEN p_size % 2 = 0 THEN '``' || p_brand || '`' || p_size || '``' ELSE '`` `' || p_brand || ' ``' END AS md FROM part""")
def html_code(spark, sf_dir):
    """Code blocks and code spans, with more backticks than they hold; empty lines in code stay."""
    block = F.when(F.col("p_size") % 3 == 0, _html("<pre>```{p_name}</pre>")).otherwise(_html("<pre>\n{p_name}\n\n\n\n  {p_type}\n</pre>"))
    span = F.when(F.col("p_size") % 2 == 0, _html("<p><code>{p_brand}`{p_size}</code></p>")).otherwise(_html("<p><code> `{p_brand} </code></p>"))
    return _markdown(dealt(spark, sf_dir, "part"), "p_partkey", F.concat(block, span)).select("p_partkey", "md")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '[' || p_name || ']()' WHEN 1 THEN '[a\\]' || p_size || '](/q%20%28' || p_partkey || '%29)' WHEN 2 THEN '[![' || p_brand || '](i.png)](u' || p_partkey || ')'
ELSE p_name END AS md FROM part""")
def html_links(spark, sf_dir):
    """Script schemes, brackets in texts and targets, images in links, and links without a text."""
    k = F.col("p_size") % 4
    html = (F.when(k == 0, _html("<a href=' JavaScript:go({p_size})'>{p_name}</a>")).when(k == 1, _html("<a href='/q ({p_partkey})'>a]{p_size}</a>"))
            .when(k == 2, _html("<a href='u{p_partkey}'><img src='i.png' alt='{p_brand}'></a>")).otherwise(_html("<a href='gone{p_size}'> </a>{p_name}")))
    return _markdown(dealt(spark, sf_dir, "part"), "p_partkey", html).select("p_partkey", "md")


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT r_regionkey, string_agg((r_regionkey + i) || '. ' || n_name || chr(10) || repeat(' ', length(CAST(r_regionkey + i AS VARCHAR)) + 2) || '- x' || n_nationkey || chr(10)
|| repeat(' ', length(CAST(r_regionkey + i AS VARCHAR)) + 2) || '- **' || r_name || '**', chr(10) ORDER BY i) AS md FROM n JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def html_lists(spark, sf_dir):
    """Numbered lists that start anywhere, with lists in their items."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = _html("<li>{n_name}<ul><li>x{n_nationkey}</li><li><b>{r_name}</b></li></ul></li>")
    lists = rows.groupBy("r_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("h")))), lambda x: x.h), "\n").alias("items"))
    start = (F.col("r_regionkey") + 1).cast("string")
    return _markdown(lists, "r_regionkey", F.concat(F.lit("<ol start='"), start, F.lit("'>"), F.col("items"), F.lit("</ol>"))).select("r_regionkey", "md")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '- ' || p_name || chr(10) || chr(10) || '  ' || p_type WHEN 1 THEN '- ' || p_name || chr(10) || '  ' || p_brand ELSE '- ' || p_name || chr(10) || '  - ' || p_type || chr(10) || '  ' || p_brand END AS md FROM part""")
def html_list_items(spark, sf_dir):
    """Paragraphs, breaks, and text after an inner list in one item."""
    k = F.col("p_size") % 3
    html = (F.when(k == 0, _html("<ul><li><p>{p_name}</p><p>{p_type}</p></li></ul>")).when(k == 1, _html("<ul><li>{p_name}<br>{p_brand}</ul>"))
            .otherwise(_html("<ul><li>{p_name}<ul><li>{p_type}</ul>{p_brand}</ul>")))
    return _markdown(dealt(spark, sf_dir, "part"), "p_partkey", html).select("p_partkey", "md")


@query("""SELECT r_regionkey, '| ' || r_name || ' |  | k |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| a\\|' || n_name || ' in | ' || n_nationkey || ' |  |', chr(10) ORDER BY n_nationkey) AS md,
'MERGED_CELLS' AS warning FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def html_tables(spark, sf_dir):
    """Tables with spans, bars, breaks, short rows, a caption and a table in a cell."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = _html("<tr><td>a|{n_name}<br><table><tr><td>in</td></tr></table></td><td>{n_nationkey}</td></tr>")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("h")))), lambda x: x.h), "\n")
    made = rows.groupBy("r_regionkey", "r_name").agg(body.alias("body"))
    html = F.concat(_html("<table><caption>gone</caption><thead><tr><th colspan=2>{r_name}</th><th>k</th></tr></thead><tbody>{body}"), F.lit("</tbody></table>"))
    return _markdown(made, "r_regionkey", html).select("r_regionkey", "md", F.array_join("warnings", ",").alias("warning"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(body, '(?s)<a [^>]*>[^<]*[^<\s][^<]*</a>')) AS BIGINT) AS links, CAST(len(regexp_extract_all(body, '<img ')) AS BIGINT) AS images, CAST(len(regexp_extract_all(body, '<li[ >]')) AS BIGINT) AS items,
CAST(len(regexp_extract_all(body, '<tr[ >]')) + len(regexp_extract_all(body, '<table[ >]')) AS BIGINT) AS table_lines, CAST(len(regexp_extract_all(body, '<h[1-6][ >]')) AS BIGINT) AS headings, CAST(0 AS BIGINT) AS tags
FROM (SELECT page_id, regexp_replace(html, '(?s)<(script|style|noscript|head)[ >].*?</(script|style|noscript|head)>', '', 'g') AS body FROM pages)""")
def page_counts(spark, sf_dir):
    """Links, images, list items, table lines and headings of the Markdown of whole pages, by the tags of their HTML; and no tag of the structure is left."""
    out = _markdown(dealt(spark, sf_dir, "pages"), "page_id", F.col("html"))
    n = lambda pattern: F.regexp_count("md", F.lit(pattern)).cast("bigint")
    return out.select("page_id", n(r"(?<!\!)\[[^\]\n]+\]\(").alias("links"), n(r"!\[[^\]]*\]\(").alias("images"), n(r"(?m)^\s*(- |\d+\. )").alias("items"), n(r"(?m)^\|.*\|$").alias("table_lines"),
                      n(r"(?m)^#{1,6} ").alias("headings"), n(r"(?i)</?(p|div|table|td|tr|ul|li|section|body|script)\b[^>]*>").alias("tags"))


# -- text of any charset ----------------------------------------------------------------------------------------------------------

_WAYS = ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "gb18030", "gb18030-meta", "big5-meta"]


def _encoded(value: str, way: int) -> bytes:
    import codecs

    match _WAYS[way]:
        case "utf-16-le":
            return codecs.BOM_UTF16_LE + value.encode("utf-16-le")
        case "utf-16-be":
            return codecs.BOM_UTF16_BE + value.encode("utf-16-be")
        case "gb18030-meta":
            return b"<meta charset=GBK>" + value.encode("gb18030")
        case "big5-meta":
            return b"<META http-equiv=x content='text/html; charset=Big5'>" + value.encode("big5")
        case codec:
            return value.encode(codec)


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 5 THEN '<meta charset=GBK>' WHEN 6 THEN '<META http-equiv=x content=''text/html; charset=Big5''>' ELSE '' END || '中文' || p_name || '國語' || p_size || '文字' AS decoded FROM part""")
def charset_decode(spark, sf_dir):
    """One text in seven encodings: byte order marks, valid UTF-8, labels, and damage that tells of GB18030."""
    from docweir.sources.charset import decode_text

    encode = F.udf(lambda s, k: _encoded(s, k), BinaryType(), useArrow=True)
    decode = F.udf(lambda b: decode_text(bytes(b)), StringType(), useArrow=True)
    p = dealt(spark, sf_dir, "part").withColumn("s", _html("中文{p_name}國語{p_size}文字"))
    return p.select("p_partkey", decode(encode("s", (F.col("p_partkey") % 7).cast("int"))).alias("decoded"))


# -- DOCX -------------------------------------------------------------------------------------------------------------------------

def _docx(name: str, kind: str, brand: str, size: int) -> bytes:
    """A document with a heading, a list of two levels, formulas, an image, a table and marked runs."""
    from docweir.sources.archive import pack_files
    from docweir.sources.docx import A, M, PIC, R, W

    run = lambda t, pr="": f"<w:r><w:rPr>{pr}</w:rPr><w:t xml:space='preserve'>{t}</w:t></w:r>"
    item = lambda depth, t: f"<w:p><w:pPr><w:numPr><w:ilvl w:val='{depth}'/><w:numId w:val='1'/></w:numPr></w:pPr>{run(t)}</w:p>"
    math = lambda x: f"<m:r><m:t>{x}</m:t></m:r>"
    frac = f"<m:oMath><m:f><m:num>{math('a' + str(size))}</m:num><m:den>{math('bⁿ')}</m:den></m:f></m:oMath>"
    root = f"<m:oMathPara><m:oMath><m:rad><m:deg>{math(3)}</m:deg><m:e>{math('xᵢ')}</m:e></m:rad><m:sSup><m:e>{math('y')}</m:e><m:sup>{math(size)}</m:sup></m:sSup></m:oMath></m:oMathPara>"
    body = (f"<w:p><w:pPr><w:pStyle w:val='Heading{size % 6 + 1}'/></w:pPr>{run(name)}</w:p>" + item(0, kind) + item(1, brand) + item(0, "end")
            + f"<w:p>{run(name, '<w:b/>')}{run(' and ')}{run(kind, '<w:i/>')}{run(' or ')}{run(brand, '<w:dstrike/>')}{run('!', '<w:b w:val=' + chr(34) + '0' + chr(34) + '/>')}</w:p>"
            + f"<w:p>{run('is ')}{frac}</w:p><w:p>{root}</w:p>"
            + f"<w:p><w:r><w:drawing><pic:cNvPr name='x.png' descr=' {brand}  pic.jpeg '/><a:blip r:embed='i'/></w:drawing></w:r></w:p>"
            + f"<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p>{run(name)}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run('l')}</w:p></w:tc><w:tc><w:p>{run(size)}</w:p></w:tc></w:tr></w:tbl>")
    xml = f'<w:document xmlns:w="{W[1:-1]}" xmlns:m="{M[1:-1]}" xmlns:a="{A[1:-1]}" xmlns:pic="{PIC[1:-1]}" xmlns:r="{R[1:-1]}"><w:body>{body}</w:body></w:document>'
    lists = (f'<w:numbering xmlns:w="{W[1:-1]}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
             '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="i" Target="media/x.jpeg"/></Relationships>'
    return pack_files([("word/document.xml", xml.encode()), ("word/numbering.xml", lists.encode()), ("word/_rels/document.xml.rels", rels.encode()), ("word/media/x.jpeg", name.encode())])


@query(r"""SELECT p_partkey, repeat('#', CAST(p_size % 6 + 1 AS INT)) || ' ' || p_name || chr(10) || chr(10) || '1. ' || p_type || chr(10) || '   - ' || p_brand || chr(10) || '2. end' || chr(10) || chr(10)
|| '**' || p_name || '** and *' || p_type || '* or ~~' || p_brand || '~~!' || chr(10) || chr(10) || 'is $\frac{a' || p_size || '}{b^n}$' || chr(10) || chr(10) || '$$\sqrt[3]{x_i}y^{' || p_size || '}$$' || chr(10) || chr(10)
|| '![' || p_brand || ' pic](assets/My-' || p_partkey || '-1.jpg)' || chr(10) || chr(10) || '| ' || p_name || ' |  |' || chr(10) || '| --- | --- |' || chr(10) || '| l | ' || p_size || ' |' AS md,
'MERGED_CELLS,ASSETS: 1' AS warnings, md5(p_name) AS asset FROM part""")
def docx_rules(spark, sf_dir):
    """Headings, lists, marks, formulas, images and tables of documents, and their assets."""
    make = F.udf(_docx, BinaryType(), useArrow=True)
    p = dealt(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").alias("doc_id"), _html("My {p_partkey}.docx").alias("name"), make("p_name", "p_type", "p_brand", "p_size").alias("content"))
    return convert(files).select(F.col("doc_id").alias("p_partkey"), F.col("markdown").alias("md"), F.array_join("warnings", ",").alias("warnings"), F.md5(F.col("assets")[0]["content"]).alias("asset"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(' ' || p_name || '.' || p_brand || chr(10) || ' x.' || CASE WHEN p_size % 2 = 0 THEN 'JPEG' ELSE 'toolongending' END, '[\s]+', ' ', 'g'), '\.[A-Za-z0-9]{1,8}$', '')) AS alt,
coalesce(nullif(substring(regexp_replace(regexp_replace(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name || ': a/b' END || CASE WHEN p_size % 3 = 0 THEN '.DOCX' ELSE '' END, '\.docx$', '', 'i'), '[\\/:*?"<>|\s]+', '-', 'g'), 1, 64), ''), 'doc') AS base,
CASE p_size % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'tif' WHEN 2 THEN 'svg+xml' ELSE 'png' END AS extension, lower(CASE p_size % 3 WHEN 0 THEN ' OFF' WHEN 1 THEN 'true' ELSE '0' END) <> 'true' AS no_strike FROM part""")
def docx_names(spark, sf_dir):
    """Alternative texts, base names of assets, endings by type, and switches of double strikes."""
    k, third = F.col("p_size") % 4, F.col("p_size") % 3
    descr = F.when(F.col("p_size") % 3 != 1, F.concat(F.lit(" "), "p_name", F.lit("."), "p_brand", F.lit("\n x."), F.when(F.col("p_size") % 2 == 0, "JPEG").otherwise("toolongending")))
    name = F.concat("p_name", F.lit("."), "p_brand", F.lit(" x."), F.when(F.col("p_size") % 2 == 0, "JPEG").otherwise("toolongending"))
    file = F.concat(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat("p_name", F.lit(": a/b"))), F.when(third == 0, ".DOCX").otherwise(""))
    mime = F.when(k == 0, "image/JPEG").when(k == 1, "image/tiff").when(k == 2, "image/svg+xml").otherwise("text/plain")
    switch = F.when(third == 0, " OFF").when(third == 1, "true").otherwise("0")
    return read(spark, sf_dir, "part").select("p_partkey", text.alt_text(descr, name).alias("alt"), text.docx_base(file).alias("base"), text.mime_extension(mime).alias("extension"), text.dstrike_off(switch).alias("no_strike"))


# -- workbooks --------------------------------------------------------------------------------------------------------------------

def _book(key: int, serial: float, price: float, name: str, flag: bool) -> bytes:
    from html import escape

    from docweir.sources.archive import pack_files

    late = ' date1904="1"' if key % 2 else ""
    cells = (f'<c r="A1" s="1"><v>{serial}</v></c><c r="B1"><v>{price!r}000000000003</v></c><c r="C1" t="str"><v>{escape(name)} &amp; &#60;x&#x3E;</v></c><c r="D1" t="b"><v>{int(flag)}</v></c>'
             f'<c r="E1" t="s"><v>{key % 3}</v></c><c t="inlineStr"><is><t>{escape(name)}</t><rPh><t>no</t></rPh></is></c><c r="H1" t="e"><v>#REF!</v></c><c r="H1"><v>{key}</v></c><c r="I1" t="d"><v>2024-02-0{key % 9 + 1}T10:00:00</v></c>')
    return pack_files([
        ("xl/workbook.xml", f'<workbook><workbookPr{late}/><sheets><sheet name="{escape(name)}" sheetId="9" r:id="r7"/></sheets></workbook>'.encode()),
        ("xl/_rels/workbook.xml.rels", b'<Relationships><Relationship Id="r1" Target="worksheets/other.xml"/><Relationship Id="r7" Target="/xl/worksheets/sheet3.xml"/></Relationships>'),
        ("xl/styles.xml", b'<styleSheet><numFmts><numFmt numFmtId="200" formatCode="[Red]yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="200"/></cellXfs></styleSheet>'),
        ("xl/sharedStrings.xml", b"<sst><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r><rPh><t>no</t></rPh></si></sst>"),
        ("xl/worksheets/other.xml", b'<worksheet><sheetData><row><c r="A1"><v>7</v></c></row></sheetData></worksheet>'),
        ("xl/worksheets/sheet3.xml", f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>".encode())])


_SHOWN = r"""SELECT p_partkey, p_name AS sheet, v.col_idx, v.value FROM part, LATERAL (VALUES
(0, strftime(CASE WHEN p_partkey % 2 = 1 THEN DATE '1904-01-01' ELSE DATE '1899-12-30' END + CAST(30000 + p_partkey AS INT), '%Y-%m-%d')),
(1, regexp_replace(regexp_replace(printf('%.15g', p_retailprice), '(\.[0-9]*[1-9])0+$', '\1'), '\.0*$', '')), (2, p_name || ' & <x>'), (3, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END),
(4, CASE p_partkey % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE '' END), (5, p_name), (7, CAST(p_partkey AS VARCHAR)), (8, '2024-02-0' || (p_partkey % 9 + 1))) v(col_idx, value) WHERE v.value <> ''"""


def _books(spark, sf_dir) -> DataFrame:
    make = F.udf(_book, BinaryType(), useArrow=True)
    price = F.when(F.col("p_retailprice") == F.floor("p_retailprice"), F.col("p_retailprice") + 0.0).otherwise(F.col("p_retailprice"))
    return dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), make("p_partkey", (F.col("p_partkey") + 30000.75).alias("s"), price, "p_name", (F.col("p_size") % 2 == 0).alias("f")).alias("content"))


@query(_SHOWN)
def xlsx_shown(spark, sf_dir):
    """Every kind of cell as the reader shows it: dates of both systems, long numbers, entities, switches, strings, phonetics, places."""
    return exploded.workbook_cells(_books(spark, sf_dir)).where("value <> ''").select(F.col("doc_id").alias("p_partkey"), "sheet", "col_idx", "value")


@query(_SHOWN)
def xlsx_joined_shown(spark, sf_dir):
    """The same from the workbook's own tables, joined."""
    return resolved_cells(exploded.workbook_parts(_books(spark, sf_dir))).where("value <> ''").select(F.col("doc_id").alias("p_partkey"), "sheet", "col_idx", "value")


@query(r"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS VARCHAR) || CASE l_linenumber % 3 WHEN 0 THEN '00000000004' WHEN 1 THEN '' ELSE 'E3' END AS literal FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(length(regexp_replace(replace(regexp_replace(literal, 'E.*$', ''), '.', ''), '^0+|0+$', '', 'g')) AS INT) AS digits FROM x""")
def literal_digits(spark, sf_dir):
    """Significant digits of decimal literals: neither leading and trailing zeros nor the exponent count."""
    k = F.col("l_linenumber") % 3
    literal = F.concat(F.col("l_extendedprice").cast("decimal(12,2)").cast("double").cast("string"), F.when(k == 0, "00000000004").when(k == 1, "").otherwise("E3"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.significant_digits(literal).alias("digits"))


@query("""SELECT p_partkey, CAST(p_partkey % 16384 + 1 AS INT) AS n_cols, CAST(p_partkey + 7 AS INT) AS n_rows FROM part""")
def sheet_extent(spark, sf_dir):
    """What a reference of two corners reaches, with or without dollar signs."""
    i = (F.col("p_partkey") % 16384).cast("int")
    corner = F.concat(F.lit("$B$2:$"), numbers.column_letters(i), F.lit("$"), (F.col("p_partkey") + 7).cast("string"))
    wide = numbers.dimension_size(corner)
    at_least = F.greatest(F.col("s.n_cols"), F.lit(1))
    return read(spark, sf_dir, "part").select("p_partkey", wide.alias("s")).select("p_partkey", F.when(F.col("p_partkey") % 16384 == 0, 1).otherwise(at_least).alias("n_cols"), F.col("s.n_rows").alias("n_rows"))


def _many_sheets(key: int, name: str, lenient: bool) -> bytes:
    """Seven sheets; or one with single quotes, prefixes, a declared area that is too small and no cell formats, which only the lenient reader takes."""
    from html import escape

    from docweir.sources.archive import pack_files
    from docweir.sources.workbook import write_workbook

    if not lenient:
        return write_workbook([(name, [["a|b", str(key)], ["x"]]), *((f"s{i}", [[str(i)]]) for i in range(2, 8))])
    sheet = (f"<x:worksheet xmlns:x='u'><x:dimension ref='A1:B1'/><x:sheetData><x:row><x:c r='A1' t='str'><x:v>{escape(name)}</x:v></x:c><x:c r='B1'><x:v>{key}</x:v></x:c><x:c r='C1'><x:v>9</x:v></x:c></x:row>"
             "<x:row><x:c r='A2'><x:v>8</x:v></x:c></x:row></x:sheetData></x:worksheet>")
    return pack_files([("xl/workbook.xml", b"<x:workbook xmlns:x='u' xmlns:q='r'><x:sheets><x:sheet name='only' q:id='r1'/></x:sheets></x:workbook>"),
                       ("xl/_rels/workbook.xml.rels", b"<Relationships><Relationship Id='r1' Target='worksheets/s.xml'/></Relationships>"),
                       ("xl/styles.xml", b"<styleSheet/>"), ("xl/worksheets/s.xml", sheet.encode())])


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '<!-- truncated: first 5 sheets, 6 rows (at most 1000 a sheet, 2 sheets not read) -->' || chr(10) || chr(10) || '### Sheet: ' || p_name || chr(10) || chr(10) || '| a\|b | ' || p_partkey || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| x |  |'
|| chr(10) || chr(10) || (SELECT string_agg('### Sheet: s' || i || chr(10) || chr(10) || '| ' || i || ' |' || chr(10) || '| --- |', chr(10) || chr(10) ORDER BY i) FROM range(2, 6) t(i)) || chr(10) || chr(10) || '> 2 more sheets not read (at most 5)'
ELSE '### Sheet: only' || chr(10) || chr(10) || '| ' || p_name || ' | ' || p_partkey || ' |' || chr(10) || '| --- | --- |' END AS md,
CASE WHEN p_partkey % 2 = 0 THEN 'xlsx-stream' ELSE 'xlsx-lenient' END AS backend, CASE WHEN p_partkey % 2 = 1 THEN 'DATE_STYLE_RISK,AREA_LOSS: only: 1 columns, 1 rows' END AS risks FROM part""")
def xlsx_markdown(spark, sf_dir):
    """Whole workbooks as Markdown: sheets in order, the note on those that are not read, the line on truncation, and what the lenient reader warns of."""
    make = F.udf(_many_sheets, BinaryType(), useArrow=True)
    files = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("b.xlsx").alias("name"), make("p_partkey", "p_name", (F.col("p_partkey") % 2 == 1).alias("l")).alias("content"))
    risks = F.array_join(F.filter("warnings", lambda w: ~w.startswith("TRUNCATED")), ",")
    return convert(files).select(F.col("doc_id").alias("p_partkey"), F.col("markdown").alias("md"), "backend", F.nullif(risks, F.lit("")).alias("risks"))


def _members(text_: str, key: int) -> bytes:
    """Members stored and deflated, and a directory that names one beyond the end."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored.txt", text_, zipfile.ZIP_STORED)
        z.writestr("deflated.txt", text_[::-1], zipfile.ZIP_DEFLATED)
        z.writestr("far.txt", str(key), zipfile.ZIP_STORED)
    data = out.getvalue()
    at = data.rfind(b"PK\x01\x02")
    return data[: at + 42] + (0x7FFFFFF0).to_bytes(4, "little") + data[at + 46 :]


@query("""SELECT doc_id, md5(text) AS stored, md5(reverse(text)) AS deflated, true AS far_is_missing, true AS other_is_missing FROM documents""")
def zip_members(spark, sf_dir):
    """Members by name, stored and deflated; one whose place is out of range, and one that is not there, are missing."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    from docweir.sources.archive import Archive

    def read_all(data: bytes) -> dict:
        a = Archive(bytes(data))
        return {"stored": a.text("stored.txt"), "deflated": a.text("deflated.txt"), "far": a.read("far.txt") is None, "other": a.read("Stored.txt") is None}

    kind = StructType([StructField("stored", StringType()), StructField("deflated", StringType()), StructField("far", BooleanType()), StructField("other", BooleanType())])
    made = dealt(spark, sf_dir, "documents").select("doc_id", F.udf(_members, BinaryType(), useArrow=True)("text", "doc_id").alias("content"))
    got = made.select("doc_id", F.udf(read_all, kind, useArrow=True)("content").alias("m"))
    return got.select("doc_id", F.md5("m.stored").alias("stored"), F.md5("m.deflated").alias("deflated"), F.col("m.far").alias("far_is_missing"), F.col("m.other").alias("other_is_missing"))


# -- lines of runs ----------------------------------------------------------------------------------------------------------------

@query("""WITH r AS (SELECT p_partkey, p_name AS a, p_brand AS b, CASE p_size % 4 WHEN 0 THEN ' ' WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE '' END AS gap, p_size % 4 = 3 AS twice FROM part)
SELECT p_partkey, CASE WHEN twice THEN a ELSE a || gap || b END AS line FROM r""")
def run_spacing(spark, sf_dir):
    """Runs on a line: a space for a wide gap or between words, none at a seam that touches, and a run that is printed twice counts once."""
    k = F.col("p_size") % 4
    w = (F.length("p_name") * 5).cast("double")
    second = F.when(k == 0, w + 100).when(k == 1, w).when(k == 2, w + 0.5).otherwise(F.lit(0.2))
    run = lambda x, seq, s, width: F.struct(x.alias("x"), F.lit(seq).alias("seq"), s.alias("str"), width.alias("w"), F.lit(12.0).alias("font_size"))
    runs = F.array(run(second, 2, F.when(k == 3, F.col("p_name")).otherwise(F.col("p_brand")), F.when(k == 3, w).otherwise(30.0)), run(F.lit(0.0), 1, F.col("p_name"), w))
    return read(spark, sf_dir, "part").select("p_partkey", layout.line_text(runs).alias("line"))


@query("""WITH r AS (SELECT c.conv_id, c.turn, max(c.turn) OVER (PARTITION BY c.conv_id) + 1 AS n, c.text, c.turn % 4 = 3 AS skipped FROM conversations c)
SELECT conv_id, md5(coalesce(trim(regexp_replace(string_agg('<!-- page ' || (turn + 1) || '/' || n || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE NOT skipped), '\\n{3,}', chr(10) || chr(10), 'g')), '')) AS digest,
coalesce(string_agg('OCR_PAGE_SKIPPED: page ' || (turn + 1), ',' ORDER BY turn) FILTER (WHERE skipped), '') AS warnings FROM r GROUP BY conv_id""")
def page_assembly(spark, sf_dir):
    """Pages in order under comments; those that were skipped only in the warnings."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    pages = c.select("doc_id", "page", "text", F.lit(False).alias("used_ocr"), F.when((F.col("page") - 1) % 4 == 3, "OCR_PAGE_SKIPPED").alias("warning"))
    counts = c.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    return layout.assemble_pages(pages, counts).select(F.col("doc_id").alias("conv_id"), F.md5("markdown").alias("digest"), F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT p_partkey, CAST(line_no AS BIGINT) AS line_no, line, code FROM part, LATERAL (VALUES (1, p_name || ' ' || p_brand, false), (2, p_name, true), (3, 'x ' || p_name, false)) v(line_no, line, code)""")
def code_lines(spark, sf_dir):
    """Lines of runs and fonts: a line is code if all of its ASCII is from fonts whose glyphs have one width over the whole document."""
    run = lambda seq, s, x, y, font, width, n: F.struct(F.lit(seq).alias("seq"), s.alias("str"), F.lit(x).alias("x"), F.lit(y).alias("sy"), F.lit(30.0).alias("w"), F.lit(10.0).alias("font_size"), F.lit(font).alias("font_id"),
                                                        F.array(*(F.lit(v) for v in width)).alias("glyph_widths"), F.lit(n).alias("ascii"), F.lit(n).alias("letters"))
    name, brand = F.col("p_name"), F.col("p_brand")
    runs = F.array(run(1, name, 0.0, 700.0, "serif", (500.0, 620.0), 4), run(2, brand, 90.0, 701.0, "serif", (400.0,), 4), run(3, name, 0.0, 650.0, "mono", (600.0, 600.0), 4),
                   run(4, F.lit("x"), 0.0, 600.0, "serif", (500.0,), 1), run(5, name, 60.0, 600.0, "mono", (600.0,), 4))
    flat = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(runs).alias("r")).select("doc_id", "page", "r.*")
    return layout.text_lines(flat).select(F.col("doc_id").alias("p_partkey"), "line_no", F.col("text").alias("line"), F.col("is_code").alias("code"))


@query("""SELECT p_partkey, '<!-- page 1/2 -->' || chr(10) || chr(10) || p_name || ' and ' || p_type || chr(10) || p_brand || chr(10) || chr(10) || '<!-- page 2/2 -->' || chr(10) || chr(10) || 'page two of ' || p_partkey AS md, 'pdf' AS backend FROM part""")
def pdf_pages(spark, sf_dir):
    """Documents of two pages as Markdown: lines of each page under a comment."""
    from docweir.sources.pdf import write_pdf

    make = F.udf(lambda a, b, c, k: write_pdf([[(72, 700, f"{a} and {b}"), (72, 670, c)], [(72, 700, f"page two of {k}")]]), BinaryType(), useArrow=True)
    files = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("a.pdf").alias("name"), make("p_name", "p_type", "p_brand", "p_partkey").alias("content"))
    return convert(files).select(F.col("doc_id").alias("p_partkey"), F.col("markdown").alias("md"), "backend")


def _recognise(content: bytes, page_or_attempt: int) -> tuple[str, int | None]:
    """Stands for a recogniser: the words after the header; at the first attempt, every second image gives Latin letters only, and little trust in them."""
    words = content[8:].decode()
    return ("abc", 10) if page_or_attempt == 0 and len(words) % 2 else (words, 90)


@query("""SELECT p_partkey, '图片' || p_partkey || '号 ' || p_name AS md, 'ocr' AS backend, '' AS warnings, 'OCR_UNAVAILABLE' AS without FROM part""")
def image_recognition(spark, sf_dir):
    """Images through a recogniser that is passed in, with a second attempt where the first is poor; and what becomes of them without one."""
    files = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("i.png").alias("name"),
                                                F.concat(F.lit(bytearray.fromhex("89504E470D0A1A0A")), F.encode(_html(" 图 片 {p_partkey} 号 {p_name}\n"), "UTF-8")).alias("content"))
    with_one = convert(files, recognise=_recognise).select(F.col("doc_id").alias("p_partkey"), F.col("markdown").alias("md"), "backend", F.array_join("warnings", ",").alias("warnings"))
    without = convert(files).select(F.col("doc_id").alias("p_partkey"), F.col("error").alias("without"))
    return with_one.join(without, "p_partkey")


# -- single functions -------------------------------------------------------------------------------------------------------------

@query(r"""WITH t AS (SELECT doc_id, replace(text, ' ', CASE doc_id % 3 WHEN 0 THEN chr(13) WHEN 1 THEN chr(13) || chr(10) ELSE ' [x] `' END) AS x FROM documents)
SELECT doc_id, md5(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS external, md5(regexp_replace(x, '\[[^\]]*(\]|$)', '', 'g')) AS unbracketed,
CAST(coalesce(list_max(list_transform(regexp_extract_all(x || '``a```', '`+'), lambda r: length(r))), 0) AS INT) AS ticks FROM t""")
def text_rules(spark, sf_dir):
    """Line ends of texts from outside, parts in square brackets, and the longest run of backticks."""
    k = F.col("doc_id") % 3
    x = F.replace("text", F.lit(" "), F.when(k == 0, "\r").when(k == 1, "\r\n").otherwise(" [x] `"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_external(x)).alias("external"), F.md5(text.strip_bracketed(x)).alias("unbracketed"),
                                                  text.longest_backtick_run(F.concat(x, F.lit("``a```"))).cast("int").alias("ticks"))


@query(r"""WITH u AS (SELECT p_partkey, p_size, p_name, CASE p_size % 5 WHEN 0 THEN 'data:image/png;base64,' WHEN 1 THEN 'DATA:image/JPEG;base64,' WHEN 2 THEN 'data:image/svg+xml;base64,' WHEN 3 THEN 'https://x/' ELSE 'data:text/plain;base64,' END || to_base64(encode(p_name)) AS uri FROM part)
SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS bytes, p_size % 5 IN (0, 1) AND length(p_name) <= 9 AS allowed, CASE WHEN p_size % 5 IN (0, 1, 2, 4) THEN '' ELSE uri END AS href FROM u""")
def data_uris(spark, sf_dir):
    """Decoded sizes of data URIs, which of them may be shown, and which targets are safe."""
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "data:image/png;base64,").when(k == 1, "DATA:image/JPEG;base64,").when(k == 2, "data:image/svg+xml;base64,").when(k == 3, "https://x/").otherwise("data:text/plain;base64,")
    uri = F.concat(kind, F.base64(F.encode("p_name", "UTF-8")))
    size = text.data_uri_bytes(F.when(k == 3, F.concat(F.lit("x,"), F.base64(F.encode("p_name", "UTF-8")))).otherwise(uri))
    return read(spark, sf_dir, "part").select("p_partkey", size.cast("bigint").alias("bytes"), text.image_allowed(uri, 9).alias("allowed"), text.safe_href(uri).alias("href"))


@query(r"""WITH x AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' ![i](data:image/png;base64,AAAA' || repeat('B', 40) || '==) **b** [l](u)' ELSE '' END AS t FROM documents)
SELECT doc_id, CAST(length(t) - CASE WHEN doc_id % 4 = 0 THEN 68 ELSE 0 END AS INT) AS cost, CAST(len(string_split(t, '**')) - 1 + len(string_split(t, '](')) - 1 AS INT) AS marks,
length(t) > 200 AS cut, md5(substring(t, 1, 200)) AS head FROM x""")
def preview_costs(spark, sf_dir):
    """What a text costs to show: its length without the payload of images, and its marks; and its first part."""
    t = F.concat("text", F.when(F.col("doc_id") % 4 == 0, F.lit(" ![i](data:image/png;base64,AAAA" + "B" * 40 + "==) **b** [l](u)")).otherwise(""))
    shown = text.cut_preview(t, 200)
    return read(spark, sf_dir, "documents").select("doc_id", text.text_cost(t).cast("int").alias("cost"), text.inline_marks(t).cast("int").alias("marks"),
                                                  shown.endswith(text.CUT_HINT).alias("cut"), F.md5(F.substring(shown, 1, 200)).alias("head"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '<!-- truncated: first ' || n_chars || ' rows -->' || chr(10) || chr(10) ELSE '' END || text) AS digest,
CASE WHEN doc_id % 3 = 0 THEN 'OCR_EMPTY' ELSE concat_ws(',', CASE WHEN doc_id % 100 < 60 THEN 'LOW_OCR_CONF' END, CASE WHEN doc_id % 3 = 1 AND len(regexp_extract_all(text, '[A-Za-z]')) > 0.4 * (25 + len(regexp_extract_all(text, '[A-Za-z]'))) THEN 'MIXED_SCRIPT' END) END AS ocr,
doc_id % 3 = 0 AS markdown_name FROM documents""")
def notices(spark, sf_dir):
    """The line that tells of truncation, the warnings of a recogniser's result, and names of Markdown files."""
    k = F.col("doc_id") % 3
    warnings = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A"), _html("TRUNCATED: first {n_chars} rows"))).otherwise(F.array(F.lit("A")))
    seen = F.when(k == 0, "").when(k == 1, F.concat("text", F.repeat(F.lit("中"), 25))).otherwise(F.col("text"))
    name = F.when(k == 0, "a.MarkDown").when(k == 1, "md").otherwise("a.md.txt")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncation_notice(F.col("text"), warnings)).alias("digest"),
                                                  F.array_join(text.ocr_warnings(seen, F.col("doc_id") % 100), ",").alias("ocr"), text.is_markdown_name(name).alias("markdown_name"))


@query("""WITH n AS (SELECT doc_id, n_chars * CAST(power(10, doc_id % 6) AS BIGINT) AS n, text FROM documents)
SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f', round(n / 1048576.0, 1)) || ' MB' WHEN n >= 1024 THEN CAST(floor(n / 1024.0 + 0.5) AS BIGINT) || ' KB' ELSE n || ' chars' END AS label,
md5(substring(text, 1, 50)) AS head, length(text) > 50 AS cut, md5(repeat('😀', 25)) AS wide FROM n""")
def source_cuts(spark, sf_dir):
    """Sizes in characters, and sources cut at a number of UTF-16 units, between characters."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    from docweir.operators.preview import cut_source

    kind = StructType([StructField("text", StringType()), StructField("cut", BooleanType())])
    cut = F.udf(lambda t: cut_source(t, 50), kind, useArrow=True)
    wide = F.udf(lambda t: cut_source("😀" * 40, 51), kind, useArrow=True)
    n = (F.col("n_chars") * F.pow(F.lit(10.0), F.col("doc_id") % 6).cast("bigint")).cast("bigint")
    rows = dealt(spark, sf_dir, "documents").select("doc_id", numbers.chars_label(n).alias("label"), cut("text").alias("c"), wide("text").alias("w"))
    return rows.select("doc_id", "label", F.md5("c.text").alias("head"), "c.cut", F.md5("w.text").alias("wide"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'd' || p_partkey || '.md' ELSE 'd' || p_partkey || '.zip' END AS name, CASE p_size % 3 WHEN 1 THEN '1 not saved: assets/b.png' WHEN 2 THEN '2 not saved: assets/a.png, assets/b.png' END AS report FROM part""")
def package_reports(spark, sf_dir):
    """Assets that cannot be read are named in the report."""
    asset = lambda name, there, size: F.struct(F.lit(f"assets/{name}.png").alias("name"), F.when(there, F.encode("p_name", "UTF-8")).alias("content"), F.lit(size).cast("bigint").alias("size"), F.lit("image/png").alias("type"))
    k = F.col("p_size") % 3
    assets = F.array(asset("a", k != 2, 30_000_000), asset("b", k == 0, 5))
    few = F.array(asset("a", k == 0, 5))
    docs = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _html("d{p_partkey}.pdf").alias("name"), F.col("p_type").alias("markdown"), F.when(k == 0, few).otherwise(assets).alias("assets"))
    return export.package(docs).select(F.col("doc_id").alias("p_partkey"), "name", "report")


# -- preview ----------------------------------------------------------------------------------------------------------------------

@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN '[r' || i || ']: http://x/' || doc_id WHEN 1 THEN '```' WHEN 2 THEN '[f' || i || ']: u' WHEN 3 THEN '```' ELSE line END AS x FROM l)
SELECT doc_id, coalesce(string_agg(x || chr(10), '' ORDER BY i) FILTER (WHERE i % 5 IN (0)), '') AS defs FROM m GROUP BY doc_id""")
def ref_defs(spark, sf_dir):
    """Definitions of reference links outside fences, in order."""
    from docweir.operators.preview import definitions

    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 5 == 0, F.concat(F.lit("[r"), (i + 1).cast("string"), F.lit("]: http://x/"), F.col("doc_id").cast("string")))
                        .when((i + 1) % 5 == 1, F.lit("```")).when((i + 1) % 5 == 2, F.concat(F.lit("[f"), (i + 1).cast("string"), F.lit("]: u"))).when((i + 1) % 5 == 3, F.lit("```")).otherwise(F.lit("t")))
    found = F.udf(lambda s: definitions(s), StringType(), useArrow=True)
    return dealt(spark, sf_dir, "documents").select("doc_id", found(F.array_join(lines, "\n")).alias("defs"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, length(text) AS n FROM documents),
w AS (SELECT doc_id, 0 AS k, n FROM p WHERE n > 0 UNION ALL SELECT doc_id, k + 1, n FROM w WHERE (k + 1) * 2040 < 60 * (n % 90 + 1))
SELECT doc_id, CAST(count(*) AS BIGINT) AS parts FROM w GROUP BY doc_id""")
def segment_count(spark, sf_dir):
    """Texts of paragraphs of 60 characters (58 and an empty line): a segment ends at the first empty line from 1,024 characters on, and so every 18 paragraphs at most."""
    from docweir.operators.preview import segments

    def count(n: int) -> int:
        paragraphs = n % 90 + 1
        source = "".join("x" * 58 + "\n\n" for _ in range(paragraphs))
        parts = segments(source, 2000)
        assert "".join(source[a:b] for a, b, _ in parts) == source
        return len(parts)

    counted = F.udf(count, "bigint", useArrow=True)
    return dealt(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", counted(F.length("text")).alias("parts"))


@query(r"""SELECT p_partkey, '<h2>' || p_name || '</h2>' || chr(10) || '<p>a <strong>' || p_type || '</strong> <code>&lt;' || p_size || '&gt;</code> <a href="https://x/' || p_partkey || '" target="_blank" rel="noopener noreferrer">' || p_brand || '</a></p>' || chr(10)
|| '<p><a>bad</a> <span class="md-image">[external image: ' || p_brand || ']</span></p>' || chr(10) || '<table><thead><tr><th>n</th><th>v</th></tr></thead><tbody><tr><td>' || p_name || '</td><td>' || p_size || '</td></tr></tbody></table>' || chr(10)
|| '<ul><li><input type="checkbox" disabled' || CASE WHEN p_size % 2 = 0 THEN ' checked' ELSE '' END || '> ' || p_name || '</li><li><input type="checkbox" disabled> x</li></ul>' || chr(10) || '<pre><code>&lt;b&gt;' || p_brand || chr(10) || '</code></pre>' AS html FROM part""")
def preview_rules(spark, sf_dir):
    """Markdown as safe HTML: headings, marks, links, images, tables, tasks, code, and tags that are left out."""
    from docweir.operators.preview import render_segment

    md = F.concat(_html("## {p_name}\n\na **{p_type}** `<{p_size}>` [{p_brand}](https://x/{p_partkey})<script></script>\n\n[bad](javascript:x) ![{p_brand}](https://x/i.png)\n\n| n | v |\n| --- | --- |\n| {p_name} | {p_size} |\n\n- ["),
                  F.when(F.col("p_size") % 2 == 0, "x").otherwise(" "), _html("] {p_name}\n- [ ] x\n\n```\n<b>{p_brand}\n```\n"))
    shown = F.udf(lambda s: render_segment(s), StringType(), useArrow=True)
    return dealt(spark, sf_dir, "part").select("p_partkey", shown(md).alias("html"))


# -- saving, history and streams --------------------------------------------------------------------------------------------------

@query("""WITH f AS (SELECT p_partkey, p_size || '.md' AS name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_size) AS n FROM part)
SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT CASE WHEN k = 0 THEN name ELSE replace(name, '.md', ' (' || k || ').md') END) AS BIGINT) AS names, CASE WHEN max(n) > 1 THEN replace(name, '.md', ' (1).md') END AS second FROM f GROUP BY name""")
def saved_names(spark, sf_dir):
    """Files of one name each get a name of their own."""
    files = read(spark, sf_dir, "part").select(F.concat("p_size", F.lit(".md")).alias("name"), F.encode("p_partkey", "UTF-8").alias("content"))
    out = export.saved_names(files)
    second = F.max(F.when(F.col("saved_as").endswith(" (1).md"), F.col("saved_as")))
    return out.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("saved_as").alias("names"), second.alias("second"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS INT) AS place FROM events""")
def history_places(spark, sf_dir):
    """The place of every record in one list, worked out in many tasks."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.col("event_id").alias("ins_seq"))
    return history.listing(e).select("id", "place")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey >= 100 THEN 'not-found' END AS error, o_orderkey < 100 AND o_orderkey % 3 <> 0 AS stays FROM orders WHERE o_orderkey < 200 AND (o_orderkey >= 100 OR o_orderkey % 3 = 0)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, true FROM orders WHERE o_orderkey < 100 AND o_orderkey % 3 <> 0""")
def history_removals(spark, sf_dir):
    """Records that go, ids that no record has, and records that stay."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"))
    records, ids = o.where("o_orderkey < 100").select("id"), o.where("o_orderkey < 200 and (o_orderkey >= 100 or o_orderkey % 3 = 0)").select("id")
    gone = history.removals(records, ids).select("id", "error", F.lit(False).alias("stays"))
    return gone.unionByName(history.remove(records, ids).select("id", F.lit(None).cast("string").alias("error"), F.lit(True).alias("stays")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring')""")
def history_search(spark, sf_dir):
    """Records whose name holds the words, whatever their case."""
    return history.search(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")), " RING").select("id", "name")


@query("""SELECT s_suppkey, s_suppkey % 2 = 0 AS keeps, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS n FROM supplier""")
def history_switches(spark, sf_dir):
    """States that are cleared or switched, written as text and read again."""
    record = F.concat(F.lit('{"id":"'), "s_name", F.lit('","name":"n","uri":"u","bytes":3,"mime":"m","kind":"md","createdAt":1}'))
    raw = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('{"schemaVersion":1,"keepHistory":true,"records":['), record, F.lit("]}")).alias("state"))
    states = history.set_keep(history.parse_state(raw), F.col("s_suppkey") % 2 == 0)
    some = states.where("s_suppkey % 3 <> 0").unionByName(history.clear(states.where("s_suppkey % 3 = 0")))
    again = history.parse_state(some.select("s_suppkey", history.state_text(some).alias("state")))
    return again.where("error is null").select("s_suppkey", F.col("keep_history").alias("keeps"), F.size("records").alias("n"))


def _shared(spark, name: str) -> str:
    """A new folder that all executors share."""
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top if '://' in top else 'file://' + top.removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


@query("""SELECT user_id, max(CAST(floor(value) AS BIGINT)) AS seq, count(*) AS deliveries FROM events GROUP BY user_id""")
def stream_latest(spark, sf_dir):
    """Events that arrive twice, read as a stream and counted once, and the newest of each user, until the stream is at its end."""
    from docweir.streaming.ingest import once_per_uri

    out, schema = _shared(spark, "latest"), read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/event[s].parquet")
    twice = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("bigint").alias("seq"), F.col("event_id").cast("string").alias("uri"),
                          F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    users = once_per_uri(twice, within="3650 days").groupBy("user_id").agg(F.max("seq").alias("seq"), F.count("*").alias("deliveries"))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows")
    users.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("""SELECT n_nationkey || '-' || n_name || '.html' AS name, '# ' || n_name || chr(10) || chr(10) || 'n **' || n_regionkey || '**' AS md, CAST(1 AS BIGINT) AS times FROM nation""")
def stream_ingest(spark, sf_dir):
    """Files that arrive in a folder in two lots, converted by a stream that is run after each of them; each file once."""
    from docweir.streaming.ingest import convert_stream

    top = _shared(spark, "ingest")
    files = read(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws("-", "n_nationkey", F.concat("n_name", F.lit(".html"))).alias("name"),
                                                F.encode(_html("<h1>{n_name}</h1><p>n <b>{n_regionkey}</b></p>"), "UTF-8").alias("content"))
    for part in (0, 1):
        export.save_files(files.where(F.col("n_nationkey") % 2 == part), f"{top}/in").collect()
        convert_stream(spark, f"{top}/in", f"{top}/out", f"{top}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{top}/out")
    return done.groupBy("name").agg(F.max("markdown").alias("md"), F.count("*").alias("times"))
