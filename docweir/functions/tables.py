"""Rows of cells as Markdown tables, and Markdown names and targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import folded, trimmed


def cell_text(c: Column) -> Column:
    """Text of a cell: null is empty, white space folded, bars escaped."""
    return trimmed(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"\|", r"\\|"))


def gfm_table(rows: Column, empty: str = "") -> Column:
    """An array of rows (arrays of strings) as a table: all as wide as the widest, the first is the header."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, cell_text), F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.concat(F.array(line(padded[0]), line(F.array_repeat(F.lit("---"), width))), F.transform(F.slice(padded, F.lit(2), F.size(padded)), line))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, empty).otherwise(F.array_join(lines, "\n"))
