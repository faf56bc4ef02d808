"""Character classes that Spark, Python and DuckDB have to agree on."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ECMAScript counts as white space, for \s and for trimming.
WS = r"\t\n\x0B\f\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
PY_WS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PY_SPACE = re.compile(f"[{PY_WS}]+")

# CJK for joining text runs, CJK for counting, garbage in a text layer.
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
CJK_IDEOGRAPHS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
GARBAGE = r"\p{Co}\p{Cc}\p{Cn}\p{Cs}\x{FFFD}"


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def folded(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, f"[{WS}]+", " ")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units: characters beyond U+FFFF count twice."""
    return F.length(c) + count(c, r"[\x{10000}-\x{10FFFF}]")


def utf16_prefix(c: Column, units: int) -> Column:
    """The longest prefix of at most so many code units that splits no character."""
    # A prefix of that many characters holds at most that many too much; the usual text has no character beyond U+FFFF.
    start = F.substring(c, 1, units)
    walk = F.aggregate(
        F.split(start, ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("on")),
        lambda s, x: F.when(
            s.on & (s.n + utf16_length(x) <= units), F.struct((s.n + utf16_length(x)).alias("n"), (s.k + 1).alias("k"), F.lit(True).alias("on"))
        ).otherwise(F.struct(s.n.alias("n"), s.k.alias("k"), F.lit(False).alias("on"))),
        lambda s: s.k,
    )
    return F.when(utf16_length(start) <= units, start).otherwise(F.substring(c, F.lit(1), walk))
