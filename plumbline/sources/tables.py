"""Pipe-separated and Markdown tables in texts, as one row per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_COLUMNS = ("table_no", "row_no", "col_no", "header", "raw", "title")


def _cells(line: Column) -> Column:
    """Cells of one line, without the outer bars."""
    body = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(body, r"\|", -1), lambda c: F.trim(c))


def _is_separator(line: Column) -> Column:
    """A line of dashes and colons between bars."""
    return line.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$") & line.contains("|")


def _title(lines: Column, at: Column) -> Column:
    """The nearest non-empty line that is no table row, among the four lines above."""
    first = F.greatest(at - 3, F.lit(1))
    above = F.filter(
        F.reverse(F.slice(lines, first, F.greatest(at - first + 1, F.lit(0)))),
        lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("|"))
    return F.regexp_replace(F.trim(F.try_element_at(above, F.lit(1))), r"^#{1,6}\s*", "")


def pipe_tables(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Cells of every table: ``(keys, table_no, row_no, col_no, header, raw, title)``.

    Only lines with a bar are shuffled.  Lines that follow each other form a run; separator lines cut
    a run into segments; a one-line segment heads the segment after it, and any other segment of two or
    more lines is a table headed by its first line.
    """
    keys = list(keys)
    lines = F.split(F.col(text), r"\r?\n")
    barred = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))),
        lambda x: x["line"].contains("|"))
    rows = docs.where(F.col(text).contains("|")).select(
        *keys, lines.alias("_lines"), F.explode(barred).alias("_l")).select(
        *keys, F.col("_l.line_no").alias("line_no"), F.col("_l.line").alias("line"),
        _title(F.col("_lines"), F.col("_l.line_no")).alias("title"))
    by_line = Window.partitionBy(*keys).orderBy("line_no")
    rows = rows.withColumns({
        "run": F.col("line_no") - F.row_number().over(by_line), "sep": _is_separator(F.col("line"))})
    in_run = Window.partitionBy(*keys, "run").orderBy("line_no")
    rows = rows.withColumn("segment", F.sum(F.col("sep").cast("int")).over(
        in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last_segment = F.max("segment").over(Window.partitionBy(*keys, "run"))
    body = rows.withColumn("_last", last_segment).where("not sep")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "run", "segment"))
    first = F.min("line_no").over(Window.partitionBy(*keys, "run", "segment"))
    body = body.withColumns({"_size": size, "_first": first})
    # a single line above a separator heads the next segment, unless it already is a body itself
    previous = Window.partitionBy(*keys, "run").orderBy("segment")
    segments = body.select(*keys, "run", "segment", "_size", "_first", "_last").distinct()
    segments = segments.withColumns({
        "_prev_size": F.when(F.lag("segment").over(previous) == F.col("segment") - 1,
                             F.lag("_size").over(previous)),
        "_prev_first": F.lag("_first").over(previous)})
    is_head = (F.col("_size") == 1) & (F.col("segment") < F.col("_last")) \
        & (F.coalesce("_prev_size", F.lit(0)) != 1)
    headed = F.coalesce(F.col("_prev_size") == 1, F.lit(False)) & ~is_head
    placed = segments.select(
        *keys, "run", "segment", is_head.alias("_head"), headed.alias("_headed"),
        F.when(headed, F.col("_prev_first")).otherwise(F.col("_first")).alias("_start"))
    full = body.join(placed, [*keys, "run", "segment"])
    table = Window.partitionBy(*keys, "_start").orderBy("line_no")
    whole = Window.partitionBy(*keys, "_start")
    full = full.withColumns({
        "row_no": F.row_number().over(table) - 2,
        "_header": F.first("line").over(table),
        "title": F.first("title").over(table),
        "_rows": F.count(F.lit(1)).over(whole)}).where("_rows >= 2")
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_start"))
    cells = full.withColumn("table_no", number).where("row_no >= 0").select(
        *keys, "table_no", "row_no", "title", _cells(F.col("_header")).alias("_h"),
        F.posexplode(_cells(F.col("line"))).alias("col_no", "raw"))
    return cells.select(
        *keys, F.col("table_no").cast("long").alias("table_no"),
        F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"),
        F.coalesce(F.try_element_at("_h", F.col("col_no") + 1), F.lit("")).alias("header"), "raw",
        "title")


def frame_cells(
    df: DataFrame, keys: Sequence[str], row_no: str, columns: dict[str, Column],
) -> DataFrame:
    """Cells of an already tabular frame: ``columns`` maps each header to the printed text.

    ``row_no`` is the column that orders the printed rows.
    """
    cells = F.array(*[
        F.struct(F.lit(i).cast("long").alias("col_no"), F.lit(h).alias("header"), c.alias("raw"))
        for i, (h, c) in enumerate(columns.items())])
    return df.select(*keys, F.lit(1).cast("long").alias("table_no"),
                     F.col(row_no).cast("long").alias("row_no"), F.inline(cells))
