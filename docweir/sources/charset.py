"""Bytes of a text file to a string, when nothing but the bytes says how."""

from __future__ import annotations

import codecs
import re

_META = re.compile(rb"<meta[^>]*>", re.IGNORECASE)
_LABEL = re.compile(rb"charset\s*=\s*[\"' ]*([^\"'\s;/>]+)", re.IGNORECASE)
# Labels that are followed, and how they are read.
LABELS = {"gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs"}
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
META_WINDOW, LEAST_DAMAGE, DAMAGE_RATIO = 4096, 3, 4


def _gb18030(data: bytes, errors: str) -> str:
    """GB18030 as on the web: a lone byte 0x80 is the euro sign."""
    try:
        return data.decode("gb18030", errors="strict")
    except UnicodeDecodeError:
        if errors == "strict" and b"\x80" not in data:
            raise

    def euro(e: UnicodeError) -> tuple[str, int]:
        if data[e.start] == 0x80:
            return "€", e.start + 1
        if errors == "strict":
            raise e
        return "\ufffd", e.end

    codecs.register_error("docweir-gb18030", euro)
    return data.decode("gb18030", errors="docweir-gb18030")


def _try(data: bytes, codec: str) -> str | None:
    try:
        return _gb18030(data, "strict") if codec == "gb18030" else data.decode(codec)
    except UnicodeDecodeError:
        return None


def labels(data: bytes) -> list[str]:
    """Codecs named by <meta> tags near the start, each once."""
    found = (LABELS.get(m[1].lower().decode("latin-1")) for tag in _META.findall(data[:META_WINDOW]) if (m := _LABEL.search(tag)))
    return list(dict.fromkeys(c for c in found if c))


def decode_text(data: bytes | None) -> str:
    """By byte order mark; else as UTF-8 if it is valid; else by the labels of the page; else as GB18030 if UTF-8 leaves many
    replacement characters and GB18030 fewer; else as UTF-8 with replacement characters."""
    data = data or b""
    for bom, codec in BOMS:
        if data.startswith(bom):
            return data[len(bom) :].decode(codec, "replace")
    text = _try(data, "utf-8")
    if text is not None:
        return text
    for codec in labels(data):
        text = _try(data, codec)
        if text is not None:
            return text
    loose = data.decode("utf-8", "replace")
    bad = loose.count("\ufffd")
    other = sum(1 + (c > "\uffff") for c in loose if c > "\x7f")
    if bad >= LEAST_DAMAGE and bad * DAMAGE_RATIO >= other:
        chinese = _gb18030(data, "replace")
        if chinese.count("\ufffd") < bad:
            return chinese
    return loose
