"""Numbers, dates and sizes as a spreadsheet or a file list shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUMERIC = r"^[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?$"
MAX_COLUMN = 16_384


def serial_to_date(serial: Column, date1904: Column | bool = False) -> Column:
    """An Excel serial as YYYY-MM-DD. The 1900 system has a day that never was, so serials 1 to 60 move by one."""
    s = F.floor(serial).cast("int")
    moved = F.when(s.between(1, 60), s + 1).otherwise(s)
    late = F.lit(date1904) if isinstance(date1904, bool) else date1904
    return F.date_format(
        F.when(late, F.date_add(F.to_date(F.lit("1904-01-01")), s)).otherwise(F.date_add(F.to_date(F.lit("1899-12-30")), moved)), "yyyy-MM-dd")


def iso_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10)).otherwise(c)


def is_date_format(number: Column, code: Column) -> Column:
    """Built-in date formats by number, others by a date letter outside brackets."""
    from .text import strip_bracketed

    built_in = number.between(14, 22) | number.between(27, 36) | number.between(45, 47) | number.between(50, 58)
    return F.when(number.isNull() | (number == 0), False).otherwise(built_in | F.coalesce(strip_bracketed(code).rlike("(?i)[ymdhs]"), F.lit(False)))


def significant_digits(c: Column) -> Column:
    """Digits of a decimal literal between the first and the last that is not zero; the exponent does not count."""
    mantissa = F.regexp_replace(F.regexp_replace(F.trim(c), "^[+-]", ""), "[eE].*$", "")
    digits = F.regexp_replace(mantissa, r"\.", "")
    return F.when(digits.rlike("^[0-9]*$"), F.length(F.regexp_replace(digits, "^0+|0+$", "")))


def js_number(x: float) -> str:
    """A double as ECMAScript writes it: shortest digits, exponents below 1e-6 and from 1e21."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else ("Infinity" if x > 0 else "-Infinity")
    if x == 0:
        return "0"
    digits, exp = f"{abs(x)!r}", 0
    if "e" in digits:
        digits, e = digits.split("e")
        exp = int(e)
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    mark = len(whole) + exp
    digits = (whole + part).lstrip("0") if whole.strip("0") == "" else whole + part
    mark -= len(whole + part) - len(digits) if whole.strip("0") == "" else 0
    digits = digits.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if mark > 21 or mark < -5:
        e = mark - 1
        return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{'+' if e >= 0 else '-'}{abs(e)}"
    if mark <= 0:
        return sign + "0." + "0" * -mark + digits
    return sign + digits.ljust(mark, "0")[:mark] + ("." + digits[mark:] if len(digits) > mark else "")


def short_number(literal: str) -> str:
    """A literal with more than 15 significant digits and a point, cut to 15; anything else as it stands."""
    mantissa = literal.strip().lstrip("+-").lower().split("e")[0]
    digits = mantissa.replace(".", "")
    if not digits.isdigit() or len(digits.strip("0")) <= 15 or "." not in literal:
        return literal
    return js_number(float(f"{float(literal):.15g}"))


@F.udf(StringType(), useArrow=True)
def short_number_udf(literal: str | None) -> str | None:
    return None if literal is None else short_number(literal)


def shortened(c: Column) -> Column:
    """`short_number` of a column: only literals with a point and more than 15 significant digits leave Spark for it."""
    long = F.coalesce((significant_digits(c) > 15) & F.contains(c, F.lit(".")), F.lit(False))
    return F.coalesce(short_number_udf(F.when(long, c)), c)


def column_index(ref: Column) -> Column:
    """0-based column of a cell reference; -1 without letters or beyond the last column of a sheet."""
    letters = F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1))
    value = F.aggregate(F.split(letters, ""), F.lit(0).cast("bigint"),
                        lambda a, c: F.when(c == "", a).otherwise(F.least(a * 26 + F.ascii(c) - 64, F.lit(MAX_COLUMN + 1).cast("bigint"))))
    return F.when((letters == "") | (value > MAX_COLUMN), -1).otherwise(value - 1).cast("int")


def column_letters(index: Column) -> Column:
    """Letters of a 0-based column, up to three."""
    a = index.cast("int")
    one = lambda x: F.char(x + 65)
    third = F.when(a >= 702, one(((a - 702) / 676).cast("int"))).otherwise("")
    second = F.when(a >= 702, one(((a - 702) / 26).cast("int") % 26)).when(a >= 26, one(((a - 26) / 26).cast("int"))).otherwise("")
    return F.concat(third, second, one(a % 26))


def dimension_size(ref: Column) -> Column:
    """struct(n_cols, n_rows) reached by a reference like A1:C3, with or without $; null if it is none."""
    corners = F.split(F.trim(F.regexp_replace(ref, r"\$", "")), ":")
    fits = F.forall(corners, lambda c: c.rlike(r"^[A-Za-z]+\d*$") & (column_index(c) >= 0))
    rows = F.transform(corners, lambda c: F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("int"), F.lit(1)))
    cols = F.transform(corners, lambda c: column_index(c) + 1)
    return F.when(fits, F.struct(F.array_max(cols).alias("n_cols"), F.array_max(rows).alias("n_rows")))


def _fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.round(c.cast("double"), places))


def size_label(n: Column) -> Column:
    """Bytes as B, KB with one decimal, MB with two."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(_fixed(n / 1024, 1), F.lit(" KB"))).otherwise(
        F.concat(_fixed(n / 1024 / 1024, 2), F.lit(" MB")))


def history_size_label(n: Column) -> Column:
    """Bytes in steps of 1024 up to TB: one decimal below 10, whole numbers from 10 on; empty for negative or missing sizes."""
    out = F.when(n.isNull() | (n < 0), "").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / float(1024**i)
        label = F.concat(F.when(v >= 10, F.floor(v + 0.5).cast("string")).otherwise(_fixed(v, 1)), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (i + 1), label) if i < 4 else out.otherwise(label)
    return out


def chars_label(n: Column) -> Column:
    return F.when(n >= 1024 * 1024, F.concat(_fixed(n / (1024 * 1024), 1), F.lit(" MB"))).when(
        n >= 1024, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" chars")))


def duration_label(ms: Column) -> Column:
    return F.when(F.coalesce(ms, F.lit(0)) <= 0, "").when(ms < 100, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(
        F.concat(_fixed(ms / 1000, 1), F.lit(" s")))


def relative_time(then_ms: Column, now_ms: Column) -> Column:
    """just now, minutes, hours or days ago, or from a week on the date (UTC)."""
    minutes = F.floor(F.greatest(F.lit(0), now_ms - then_ms) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(F.floor(minutes / 60) / 24)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(then_ms.isNull() | (then_ms <= 0), "").when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "min")).when(hours < 24, ago(hours, "h"))
        .when(days < 7, ago(days, "d")).otherwise(F.date_format(F.timestamp_millis(then_ms), "yyyy-MM-dd")))


def worst_case_seconds(n_bytes: Column) -> Column:
    """How long a workbook may take at 4 MiB a second, 1 at least; null under 32 MiB."""
    return F.when(n_bytes >= 32 * 1024 * 1024, F.greatest(F.lit(1), F.floor(n_bytes / (4 * 1024 * 1024) + 0.5)))
