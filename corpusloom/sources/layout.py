"""Text items placed on pages to rows, tables and markdown, by windows over a page.

Items are (file, page, x, y, width, text), y upwards, as a page-layout reader gives them; a page is what a window holds at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances in points.
ROW_TOLERANCE, CELL_GAP, COLUMN_TOLERANCE, WORD_GAP = 2.0, 18.0, 12.0, 3.0


def page_rows(items: DataFrame) -> DataFrame:
    """(file, page, row, cells array<struct<x, text>>), from top to bottom.

    A row ends where y falls by more than the tolerance from one item to the next; a cell ends at a gap wider than ``CELL_GAP``.
    Items without text or place are left out.
    """
    page = ["file", "page"]
    clean = items.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> '' and x is not null and y is not null")
    down = Window.partitionBy(*page).orderBy(F.desc("y"), "x", "text")
    fall = F.coalesce((F.lag("y").over(down) - F.col("y") > ROW_TOLERANCE).cast("int"), F.lit(0))
    rows = clean.withColumn("_fall", fall).withColumn("row", F.sum("_fall").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*page, "row").orderBy("x", F.desc("y"), "text")
    gap = F.col("x") - F.max(F.col("x") + F.coalesce("width", F.lit(0.0))).over(across.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumn("_gap", gap).withColumn("_n", F.row_number().over(across)).withColumn("cell", F.sum(F.coalesce((F.col("_gap") > CELL_GAP).cast("int"), F.lit(0))).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.concat(F.when((F.col("_gap") > WORD_GAP) & (F.col("_gap") <= CELL_GAP), " ").otherwise(""), "text")
    cells = cut.groupBy(*page, "row", "cell").agg(F.min("x").alias("x"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", piece.alias("t")))), lambda p: p["t"]), "").alias("text"))
    return cells.groupBy(*page, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "x", "text"))), lambda c: F.struct(c["x"].alias("x"), c["text"].alias("text"))).alias("cells"))


def page_markdown(items: DataFrame) -> DataFrame:
    """(file, page, markdown): two or more rows in turn with two or more cells, as many and at the same places, are a table."""
    down = Window.partitionBy("file", "page").orderBy("row")
    before = F.lag("cells").over(down)
    close = F.forall(F.zip_with("cells", "_before", lambda a, b: F.abs(a["x"] - b["x"]) <= COLUMN_TOLERANCE), lambda near: near)
    joins = (F.size("cells") >= 2) & (F.size("cells") == F.size("_before")) & close
    blocks = page_rows(items).withColumn("_before", before).withColumn("_starts", 1 - F.coalesce(joins.cast("int"), F.lit(0))).withColumn("block", F.sum("_starts").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    g = blocks.groupBy("file", "page", "block").agg(F.array_sort(F.collect_list(F.struct("row", F.transform("cells", lambda c: c["text"]).alias("texts")))).alias("rows"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r["texts"], lambda t: F.replace(t, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    lines, rule = F.transform("rows", line), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.col("rows")[0]["texts"])))
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size("rows"))), "\n")
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r["texts"], " ")), "\n")
    shown = g.select("file", "page", "block", (F.size("rows") >= 2).alias("table"), F.when(F.size("rows") >= 2, table).otherwise(text).alias("text"))
    near = F.when(F.col("table") | F.lag("table", 1, False).over(Window.partitionBy("file", "page").orderBy("block")), "\n\n").otherwise("\n")
    parts = shown.withColumn("text", F.concat(near, "text")).groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("b"))
    return parts.select("file", "page", F.regexp_replace(F.array_join(F.transform("b", lambda x: x["text"]), ""), r"\A\n+", "").alias("markdown"))
