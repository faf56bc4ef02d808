"""What a file is, from its bytes; all expressions that Spark can plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes looked at, how far a PDF signature may be from the start, the sample for control characters and the share that makes it binary.
HEAD, PDF_WITHIN, SAMPLE, BINARY_SHARE = 65_536, 1024, 4096, 0.30
MAX_BYTES = 50 * 1024 * 1024

# Stream names in OLE2 directories, in the order they are asked for.
OLE2_STREAMS = {
    "encrypted": ["EncryptedPackage", "EncryptionInfo"],
    "word": ["WordDocument"],
    "excel": ["Workbook", "Book"],
    "ppt": ["PowerPoint Document"],
}


def latin1_head(content: Column, n: int = HEAD) -> Column:
    """One character for each of the first bytes."""
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def _begins(content: Column, hexed: str) -> Column:
    n = len(hexed) // 2
    return F.coalesce(F.hex(F.substring(content, 1, n)) == hexed, F.lit(False))


def _little(content: Column, at: int, n: int) -> Column:
    """An unsigned little-endian integer at a 0-based place."""
    each = [F.hex(F.substring(content, at + i + 1, 1)) for i in reversed(range(n))]
    return F.conv(F.concat(*each), 16, 10).cast("bigint")


def is_pdf(head: Column) -> Column:
    """The first %PDF- lies near the start, has a version, and the head has the marks of a document."""
    at = F.locate("%PDF-", head)
    version = F.substring(head, at, F.lit(8)).rlike(r"^%PDF-\d\.\d")
    return (at > 0) & (at <= PDF_WITHIN + 1) & version & (head.contains("obj") | head.contains("%%EOF"))


def ole2_subtype(head: Column) -> Column:
    """word, excel, ppt, encrypted or unknown, by stream names in ASCII or UTF-16."""
    out = F.lit("unknown")
    for kind, names in reversed(OLE2_STREAMS.items()):
        hit = F.lit(False)
        for n in names:
            hit = hit | head.contains(n) | head.contains("".join(c + "\0" for c in n))
        out = F.when(hit, kind).otherwise(out)
    return out


def image_kind(content: Column, total: Column | None = None, last: Column | None = None) -> Column:
    """png, jpeg, gif, bmp, tiff, webp or null. BMP goes by the two sizes of its header alone; GIF needs its last byte.

    With the length of the file and its last byte, the content may be its head only."""
    total = F.octet_length(content) if total is None else total
    last = F.substring(content, -1, 1) if last is None else last
    size, bits = _little(content, 2, 4), _little(content, 10, 4)
    whole = F.when(size == 0, total).otherwise(size)
    bmp = (total >= 14) & ((size == 0) | size.between(14, total)) & bits.between(F.lit(14), whole)
    gif = (_begins(content, "474946383761") | _begins(content, "474946383961")) & (total >= 10) & (_little(content, 6, 2) > 0) & (
        _little(content, 8, 2) > 0) & (F.hex(last) == "3B")
    webp = _begins(content, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    return (F.when(_begins(content, "89504E470D0A1A0A"), "png").when(_begins(content, "FFD8FF"), "jpeg").when(gif, "gif")
            .when(bmp, "bmp").when(_begins(content, "49492A00") | _begins(content, "4D4D002A"), "tiff").when(webp, "webp"))


def zip_kind(head: Column) -> Column:
    return (F.when(head.contains("word/"), "docx").when(head.contains("xl/"), "xlsx").when(head.contains("ppt/"), "pptx").otherwise("zip"))


def control_share(content: Column) -> Column:
    """Share of control bytes (other than tab to carriage return) in the sample."""
    sample = latin1_head(content, SAMPLE)
    return F.regexp_count(sample, F.lit(r"[\x00-\x08\x0E-\x1F]")) / F.greatest(F.length(sample), F.lit(1))


def sniff(content: Column, total: Column | None = None, last: Column | None = None) -> Column:
    """struct(type, detail, ole2_subtype): pdf, doc, image, docx, xlsx, pptx, zip, text or unknown (empty, binary)."""
    head = latin1_head(content)
    image = image_kind(content, total, last)
    packed = _begins(content, "504B03") | _begins(content, "504B05") | _begins(content, "504B07")
    bom = _begins(content, "EFBBBF") | _begins(content, "FFFE") | _begins(content, "FEFF")
    none = F.lit(None).cast("string")

    def kind(t, detail=none, sub=none) -> Column:
        return F.struct((F.lit(t) if isinstance(t, str) else t).alias("type"), detail.alias("detail"), sub.alias("ole2_subtype"))

    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), kind("unknown", F.lit("empty")))
        .when(is_pdf(head), kind("pdf"))
        .when(_begins(content, "D0CF11E0A1B11AE1"), kind("doc", sub=ole2_subtype(head)))
        .when(image.isNotNull(), kind("image", image))
        .when(packed, kind(zip_kind(head)))
        .when(bom, kind("text"))
        .when(control_share(content) > BINARY_SHARE, kind("unknown", F.lit("binary")))
        .otherwise(kind("text"))
    )


def guard(length: Column) -> Column:
    """EMPTY_FILE or FILE_TOO_LARGE, else null; goes by the length, so that a scan need not read the content."""
    return F.when(F.coalesce(length, F.lit(0)) == 0, "EMPTY_FILE").when(length > MAX_BYTES, "FILE_TOO_LARGE")


def unsupported(kind: Column, sub: Column) -> Column:
    """Why a known type is refused."""
    return (
        F.when(kind == "pptx", "UNSUPPORTED_PPTX").when(kind == "zip", "UNSUPPORTED_ZIP")
        .when(kind == "doc", F.concat(F.lit("UNSUPPORTED_OLE2_"), F.upper(F.coalesce(sub, F.lit("unknown")))))
        .when(kind == "unknown", "UNSUPPORTED_TYPE")
    )


# Fixed value: tags that make a text HTML.
HTML_TAGS = r"(?i)<(!doctype|html|body|div|p|h[1-6]|table|ul|ol|section|article)\b"


def looks_like_html(name: Column, text: Column, pattern: str = HTML_TAGS) -> Column:
    """By the name, or by a tag among the first 2,000 characters."""
    return F.coalesce(F.lower(name).rlike(r"\.html?$"), F.lit(False)) | F.coalesce(F.substring(text, 1, 2000).rlike(pattern), F.lit(False))


def _big(content: Column, at: int, n: int) -> Column:
    """An unsigned big-endian integer at a 0-based place."""
    return F.conv(F.hex(F.substring(content, at + 1, n)), 16, 10).cast("bigint")


def image_size(content: Column) -> Column:
    """struct(width, height) from the header of a PNG, GIF, BMP or (simple) WEBP image; null for others."""
    kind = image_kind(content)
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    webp = F.substring(content, 13, 4)
    return (
        F.when(kind == "png", size(_big(content, 16, 4), _big(content, 20, 4))).when(kind == "gif", size(_little(content, 6, 2), _little(content, 8, 2)))
        .when(kind == "bmp", size(_little(content, 18, 4), _little(content, 22, 4)))
        .when((kind == "webp") & (F.hex(webp) == "56503820"), size(_little(content, 26, 2) % 16_384, _little(content, 28, 2) % 16_384)))


def ocr_size(width: Column, height: Column, long_edge: int = 1500, turned: bool = False) -> Column:
    """struct(width, height) an image is given to a recogniser in: its long edge at most 1,500, never enlarged; turned by a quarter on request."""
    edge = F.greatest(width, height)
    scale = F.when(edge > long_edge, F.lit(float(long_edge)) / edge).otherwise(F.lit(1.0))
    w, h = (F.greatest(F.lit(1), F.floor(x * scale + 0.5).cast("int")) for x in (width, height))
    return F.struct(*(x.alias(n) for x, n in zip((h, w) if turned else (w, h), ("width", "height"), strict=True)))
