"""A workbook's own tables, joined by Spark: sheets to parts, cells to strings and styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.functions.numbers import NUMERIC, column_index, iso_date, serial_to_date, shortened
from docweir.functions.tables import gfm_table
from docweir.session import fixed


def resolved_cells(parts: DataFrame, max_sheets: int = 5) -> DataFrame:
    """(doc_id, sheet_pos, sheet, row_idx, col_idx, value) from the rows of `workbook_parts`.

    Sheets find their parts by relation; cells find shared strings and styles by number, and a number that is not there gives an empty
    text. Dates count from 1904 where the workbook says so, and numbers of more than 15 digits are cut as they are shown. A cell without a place stands after the
    one before it; of cells at one place the last counts. Workbooks are read once, for all the joins. How much they unpack to is not known from their size: the joins go by
    what was read, or each table of all workbooks would pass for small and be sent through the driver.
    """
    parts = fixed(parts.repartition("doc_id"))
    of = lambda kind: parts.where(F.col("what") == kind)
    sheets = of("sheet").where(F.col("num") < max_sheets).select("doc_id", F.col("num").alias("sheet_pos"), "key", F.col("text").alias("sheet"))
    targets = of("relation").select("doc_id", "key", F.col("text").alias("part"))
    placed = sheets.join(targets, ["doc_id", "key"]).drop("key")
    strings = of("string").select("doc_id", F.col("num").alias("idx"), F.col("text").alias("string"))
    styles = of("style").select("doc_id", F.col("num").alias("num"), F.col("flag").alias("is_date"))
    cells = of("cell").select("doc_id", "part", "row_idx", "cell_pos", "key", "kind", "num", "text")
    cells = cells.withColumn("idx", F.when(F.col("kind") == "s", F.col("text").try_cast("int")))
    late = of("book").select("doc_id", F.col("flag").alias("late"))
    wide = cells.join(placed, ["doc_id", "part"]).join(strings, ["doc_id", "idx"], "left").join(styles, ["doc_id", "num"], "left").join(late, "doc_id", "left")
    number = F.col("text").rlike(NUMERIC)
    value = (
        F.when(F.col("kind") == "s", F.coalesce("string", F.lit(""))).when(F.col("kind").isin("inlineStr", "str"), F.col("text"))
        .when(F.col("kind") == "b", F.when(F.trim("text") == "1", "true").when(F.trim("text") == "0", "false").otherwise(F.col("text")))
        .when(F.col("kind") == "d", iso_date(F.col("text"))).when(number & F.coalesce("is_date", F.lit(False)), serial_to_date(F.col("text").try_cast("double"), F.coalesce("late", F.lit(False))))
        .when(number, shortened(F.col("text"))).otherwise(F.col("text"))
    )
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "sheet_pos", "row_idx").orderBy("cell_pos")
    own = column_index(F.coalesce("key", F.lit("")))
    # Places count from the last given one; cells without one follow it.
    group = F.sum(F.when(own >= 0, 1).otherwise(0)).over(order)
    rows = wide.select("doc_id", "sheet_pos", "sheet", "row_idx", "cell_pos", own.alias("own"), value.alias("value"), group.alias("grp"))
    after = Window.partitionBy("doc_id", "sheet_pos", "row_idx", "grp").orderBy("cell_pos")
    start = F.first("own").over(after)
    col = F.when(start >= 0, start).otherwise(0) + F.row_number().over(after) - 1
    at = rows.withColumn("col_idx", col)
    return at.groupBy("doc_id", "sheet_pos", "sheet", "row_idx", "col_idx").agg(F.max_by("value", "cell_pos").alias("value"))


def sheet_markdown(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_pos, sheet, md) of cells: rows are arrays with gaps filled, the table an expression over them."""
    row = F.map_from_entries(F.collect_list(F.struct("col_idx", "value")))
    rows = cells.groupBy("doc_id", "sheet_pos", "sheet", "row_idx").agg(row.alias("m"), F.max("col_idx").alias("last"))
    filled = F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", filled.alias("r")))), lambda x: x.r)
    return rows.groupBy("doc_id", "sheet_pos", "sheet").agg(gfm_table(ordered, "(empty sheet)").alias("md"))
