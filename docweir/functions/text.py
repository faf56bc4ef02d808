"""Cleaning, measuring and naming of texts, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import CJK_IDEOGRAPHS, GARBAGE, WS, count, folded, trimmed, utf16_length, utf16_prefix

MIB = 1024 * 1024
#: Gates: a page with fewer characters, or a lower share of good ones, is put to OCR; OCR confidence, CJK count and Latin share of its warnings.
PAGE_CHARS, PAGE_QUALITY, OCR_CONFIDENCE, OCR_CJK, OCR_LATIN = 10, 0.40, 60, 20, 0.4
CUT_HINT = "\n\n[preview cut; copy or save for the whole text]"

# CJK and its punctuation, between which OCR puts spaces that do not belong there.
_OCR_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"
_OCR_PUNCT = r"，。、；：！？（）《》「」『』【】〈〉·—…～\(\)\[\]\{\}%+"


_GAP = r"[ \t\x{3000}]+"
CJK_GAPS = (rf"(?<=[{_OCR_CJK}]){_GAP}(?=[{_OCR_CJK}{_OCR_PUNCT}0-9])|(?<=[{_OCR_PUNCT}]){_GAP}(?=[{_OCR_CJK}{_OCR_PUNCT}])"
            rf"|(?<=[0-9]){_GAP}(?=[{_OCR_CJK}])")


def normalize_text(c: Column) -> Column:
    """Line ends to line feeds, three or more of those to two, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def normalize_external(c: Column) -> Column:
    """Line ends to line feeds, nothing else; null gives an empty text."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")


def collapse_cjk_spaces(c: Column) -> Column:
    """Without the spaces, tabs and ideographic spaces that OCR puts between CJK characters, their punctuation and digits; never
    across lines, and not between CJK and Latin or between digits."""
    return F.regexp_replace(c, CJK_GAPS, "")


def good_chars(c: Column) -> Column:
    return count(c, f"[^{WS}{GARBAGE}]")


def garbage_chars(c: Column) -> Column:
    return count(c, f"(?=[{GARBAGE}])[^{WS}]")


def quality_ratio(c: Column) -> Column:
    """Share of good characters among those that are not white space; 0 if there are none."""
    good, bad = good_chars(c), garbage_chars(c)
    return F.when(good + bad > 0, good / (good + bad)).otherwise(F.lit(0.0))


def needs_ocr(c: Column) -> Column:
    return (utf16_length(c) < PAGE_CHARS) | (quality_ratio(c) < PAGE_QUALITY)


def cjk_chars(c: Column) -> Column:
    return count(c, f"[{CJK_IDEOGRAPHS}]")


def latin_chars(c: Column) -> Column:
    return count(c, "[A-Za-z]")


def latin_ratio(c: Column) -> Column:
    return latin_chars(c) / F.greatest(F.lit(1), cjk_chars(c) + latin_chars(c))


def ocr_score(text: Column, confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(0)) - 100 * latin_ratio(text)


def ocr_warnings(text: Column, confidence: Column) -> Column:
    """OCR_EMPTY alone, or LOW_OCR_CONF and MIXED_SCRIPT as they hold; a result with any is worth another attempt."""
    low = F.when(confidence < OCR_CONFIDENCE, "LOW_OCR_CONF")
    mixed = F.when((cjk_chars(text) >= OCR_CJK) & (latin_ratio(text) > OCR_LATIN), "MIXED_SCRIPT")
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, F.array(F.lit("OCR_EMPTY"))).otherwise(F.array_compact(F.array(low, mixed)))


def fffd_count(c: Column) -> Column:
    return count(c, r"\x{FFFD}")


def non_ascii_units(c: Column) -> Column:
    """UTF-16 code units over 0x7F."""
    return count(c, r"[^\x00-\x7F]") + count(c, r"[\x{10000}-\x{10FFFF}]")


def worth_gb18030(c: Column) -> Column:
    """Whether a text decoded as UTF-8 is damaged enough to try GB18030: three replacement characters, a quarter of what is not ASCII."""
    bad, other = fffd_count(c), non_ascii_units(c)
    return (bad >= 3) & (other > 0) & (bad * 4 >= other)


def escape_url(c: Column) -> Column:
    """Round brackets and white space as percent codes, so that a Markdown target does not end early."""
    steps = ((r"\(", "%28"), (r"\)", "%29"), (f"[{WS}]", "%20"))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def safe_href(c: Column) -> Column:
    """Empty for script and data schemes."""
    return F.when(c.rlike(f"(?i)^[{WS}]*(javascript|vbscript|data):"), "").otherwise(F.coalesce(c, F.lit("")))


def base_name(c: Column, default: str = "document") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c, r"\.[^.]+$", ""), F.lit("")), F.lit(default))


def docx_base(c: Column) -> Column:
    """A base name for assets: no .docx, no character that file systems refuse, 64 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(c, r"(?i)\.docx$", ""), r'[\\/:*?"<>|\s]+', "-")
    return F.coalesce(F.nullif(F.substring(clean, 1, 64), F.lit("")), F.lit("doc"))


def alt_text(descr: Column, name: Column) -> Column:
    """The description of an image, else its name, without an extension, white space folded."""
    clean = lambda c: trimmed(folded(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.coalesce(F.nullif(clean(descr), F.lit("")), clean(name)), r"\.[A-Za-z0-9]{1,8}$", "")


def mime_extension(c: Column) -> Column:
    sub = F.lower(F.regexp_extract(c, r"(?i)^image/([\w.+-]+)$", 1))
    return F.when(sub == "", "png").when(sub == "jpeg", "jpg").when(sub == "tiff", "tif").otherwise(F.coalesce(sub, F.lit("png")))


def strip_bracketed(c: Column) -> Column:
    """Without [..] parts; one that is not closed takes the rest."""
    return F.regexp_replace(c, r"\[[^\]]*(\]|$)", "")


def dstrike_off(c: Column) -> Column:
    return F.lower(trimmed(c)).isin("false", "0", "off")


def is_markdown_name(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"\.(md|markdown)$"), F.lit(False))


def name_matches(name: Column, query: Column) -> Column:
    """Case-insensitive part of a name; an empty query matches all."""
    q = F.lower(trimmed(F.coalesce(query, F.lit(""))))
    return (q == "") | F.contains(F.lower(name), q)


def line_kind(c: Column) -> Column:
    """fence, table, list, blank or text."""
    return (
        F.when(c.rlike(r"^ {0,3}(`{3,}|~{3,})"), "fence").when(c.rlike(rf"^[{WS}]*\|"), "table")
        .when(c.rlike(rf"^[{WS}]*([-*+]|\d+[.)])[{WS}]+"), "list").when(trimmed(c) == "", "blank").otherwise("text")
    )


def inline_marks(c: Column) -> Column:
    return count(c, r"\*\*") + count(c, r"\]\(")


def text_cost(c: Column) -> Column:
    """Length without the payload of inline images."""
    return utf16_length(F.regexp_replace(c, r"(?i)data:image/[a-z0-9.+-]+;base64,[a-z0-9+/=]+", ""))


def longest_backtick_run(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))


def data_uri_bytes(c: Column) -> Column:
    """Decoded size of a base64 data URI."""
    body = F.regexp_replace(c, "^[^,]*,", "")
    return F.floor(F.length(body) * 3 / 4) - F.length(F.regexp_extract(body, r"(={0,2})$", 1))


def image_allowed(c: Column, most: int = 2 * MIB) -> Column:
    return F.coalesce(c.rlike(r"(?i)^data:image/(png|jpe?g|gif|webp);base64,") & (data_uri_bytes(c) <= most), F.lit(False))


def cut_preview(c: Column, units: int = MIB) -> Column:
    """At most so many UTF-16 units, and a hint when cut."""
    return F.when(utf16_length(c) > units, F.concat(utf16_prefix(c, units), F.lit(CUT_HINT))).otherwise(c)


def truncation_notice(markdown: Column, warnings: Column) -> Column:
    """The text with a first line that tells of truncation, if a warning does (TRUNCATED: detail)."""
    said = F.element_at(F.filter(warnings, lambda w: w.startswith("TRUNCATED")), 1)
    detail = F.regexp_replace(said, r"^TRUNCATED:? ?", "")
    return F.when(F.size(F.filter(warnings, lambda w: w.startswith("TRUNCATED"))) > 0,
                  F.concat(F.lit("<!-- truncated: "), detail, F.lit(" -->\n\n"), markdown)).otherwise(markdown)


def external_open(content: Column, most: int = 50 * MIB, prefix: int = 16 * MIB, chars: int = 4 * MIB) -> Column:
    """struct(text, size, truncated, error) of a text handed over from outside: strict UTF-8 on a prefix."""
    size = F.octet_length(content)
    head = F.substring(content, 1, prefix)
    # Of a character that the prefix cuts in two, the bytes before the cut are left out.
    tail = F.hex(F.substring(head, -3, 3))
    cut = F.when(tail.rlike("(F[0-7]|E.)(8|9|A|B).$"), 2).when(tail.rlike("(F[0-7])([89AB].){2}$"), 3).when(tail.rlike("[C-F].$"), 1).otherwise(0)
    head = F.when(size > prefix, F.substring(head, F.lit(1), F.octet_length(head) - cut)).otherwise(head)
    text = F.try_validate_utf8(head.cast("string"))
    error = (
        F.when(content.isNull(), "no_access").when(size == 0, "empty").when(size > most, "too_large")
        .when(F.hex(head).rlike("^(..)*00") | text.isNull(), "binary")
    )
    plain = normalize_external(text)
    return F.struct(
        F.when(error.isNull(), utf16_prefix(plain, chars)).otherwise("").alias("text"), size.alias("size"),
        (error.isNull() & ((size > prefix) | (utf16_length(plain) > chars))).alias("truncated"), error.alias("error"))
