"""Edits of tables held as cells: (tbl, row, col, row_span, col_span, text, hidden). One edit works on all tables at once.

Spans are expanded to slots for lookups, so every test is an equal join on the slot, never a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = ["tbl", "row", "col", "row_span", "col_span", "text", "hidden"]


def sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tbl").agg(F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_cols"))


def slots(cells: DataFrame) -> DataFrame:
    """A row for each slot that a cell covers: the cell's columns and r, c."""
    rows = F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)
    cols = F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)
    return cells.withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))


def normalise(cells: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """Cells with an empty one in every slot that none covers; those outside the table don't cover."""
    size = sizes(cells) if size is None else size
    grid = size.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))).select("tbl", "r", "c")
    empty = grid.join(slots(cells).select("tbl", "r", "c"), ["tbl", "r", "c"], "left_anti")
    return cells.select(*CELLS).unionByName(empty.select("tbl", F.col("r").alias("row"), F.col("c").alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit("").alias("text"), F.lit(False).alias("hidden")))


def _insert(cells: DataFrame, at: Column, pos: str, span: str) -> DataFrame:
    later = F.col(pos) >= at
    across = ~later & (F.col(pos) + F.col(span) > at)
    return cells.withColumns({pos: F.when(later, F.col(pos) + 1).otherwise(F.col(pos)), span: F.when(across, F.col(span) + 1).otherwise(F.col(span))})


def insert_row(cells: DataFrame, at: int) -> DataFrame:
    """An empty row before row ``at``; cells that reach across grow."""
    size = sizes(cells).withColumn("n_rows", F.col("n_rows") + 1)
    return normalise(_insert(cells, F.lit(at), "row", "row_span"), size)


def insert_column(cells: DataFrame, at: int) -> DataFrame:
    size = sizes(cells).withColumn("n_cols", F.col("n_cols") + 1)
    return normalise(_insert(cells, F.lit(at), "col", "col_span"), size)


def _delete(cells: DataFrame, size: DataFrame, at: int, pos: str, span: str, n: str) -> DataFrame:
    joined = cells.join(size, "tbl").withColumn("_at", F.least(F.lit(at), F.col(n) - 1)).withColumn("_one", F.col(n) <= 1)
    here = F.col("_one") | ~((F.col(pos) == F.col("_at")) & (F.col(span) == 1))
    later = ~F.col("_one") & (F.col(pos) > F.col("_at"))
    across = ~F.col("_one") & (F.col(pos) <= F.col("_at")) & (F.col(pos) + F.col(span) > F.col("_at"))
    kept = joined.where(here)
    kept = kept.select("tbl", *[F.when(later, F.col(c) - 1).otherwise(F.col(c)).alias(c) if c == pos else F.when(across, F.greatest(F.lit(1), F.col(c) - 1)).otherwise(F.col(c)).alias(c) if c == span else F.col(c) for c in CELLS[1:]])
    return normalise(kept, size.withColumn(n, F.greatest(F.lit(1), F.col(n) - 1)))


def delete_row(cells: DataFrame, at: int) -> DataFrame:
    """Without row ``at`` (the last, if there is none); cells that reach across shrink. A table keeps one row."""
    return _delete(cells, sizes(cells), at, "row", "row_span", "n_rows")


def delete_column(cells: DataFrame, at: int) -> DataFrame:
    return _delete(cells, sizes(cells), at, "col", "col_span", "n_cols")


def merge(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """One cell over a rectangle: its text is those in it, line by line; the others are hidden."""
    touched = slots(cells.where(~F.col("hidden"))).where(F.col("r").between(top, bottom) & F.col("c").between(left, right)).select("tbl", "row", "col").distinct().withColumn("_in", F.lit(True))
    marked = cells.join(touched, ["tbl", "row", "col"], "left")
    order = Window.partitionBy("tbl").orderBy(F.col("_in").desc_nulls_last(), "row", "col")
    marked = marked.withColumn("_no", F.row_number().over(order))
    text = marked.where("_in AND text <> ''").groupBy("tbl").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", "text"))), lambda x: x["text"]), "\n").alias("_text"))
    marked = marked.join(text, "tbl", "left")
    anchor = F.col("_in") & (F.col("_no") == 1)
    pick = lambda new, old: F.when(anchor, new).otherwise(F.col(old)).alias(old)
    other = F.col("_in") & (F.col("_no") > 1)
    return marked.select(
        "tbl", pick(F.lit(top), "row"), pick(F.lit(left), "col"), pick(F.lit(bottom - top + 1), "row_span"), pick(F.lit(right - left + 1), "col_span"),
        F.when(anchor, F.coalesce("_text", F.lit(""))).when(other, "").otherwise(F.col("text")).alias("text"), F.when(other, True).otherwise(F.col("hidden")).alias("hidden"),
    )


def split(cells: DataFrame) -> DataFrame:
    """Every merged cell in single ones: hidden cells come back, missing ones are made; the text stays in the first."""
    big = (F.col("row_span") > 1) | (F.col("col_span") > 1)
    freed = slots(cells.where(big & ~F.col("hidden"))).where("r <> row OR c <> col").select("tbl", F.col("r").alias("row"), F.col("c").alias("col")).distinct()
    shown = cells.join(freed.withColumn("_free", F.lit(True)), ["tbl", "row", "col"], "left")
    shown = shown.withColumn("hidden", F.col("hidden") & F.col("_free").isNull())
    shown = shown.withColumns({"row_span": F.when(big, 1).otherwise(F.col("row_span")), "col_span": F.when(big, 1).otherwise(F.col("col_span"))}).select(*CELLS)
    made = freed.join(cells.select("tbl", "row", "col"), ["tbl", "row", "col"], "left_anti")
    return shown.unionByName(made.select("tbl", "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit("").alias("text"), F.lit(False).alias("hidden")))


def validate(cells: DataFrame, size: DataFrame) -> DataFrame:
    """Violations (tbl, row, col, code): outside the table, spans below one, slots that two visible cells cover."""
    placed = cells.join(size, "tbl")
    outside = placed.where("row < 0 OR col < 0 OR row + row_span > n_rows OR col + col_span > n_cols").select("tbl", "row", "col", F.lit("outside_table").alias("code"))
    spans = cells.where("row_span < 1 OR col_span < 1").select("tbl", "row", "col", F.lit("span_below_one").alias("code"))
    twice = slots(cells.where("NOT hidden AND row_span >= 1 AND col_span >= 1")).groupBy("tbl", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.count("*").alias("n")).where("n > 1").select("tbl", "row", "col", F.lit("slot_covered_twice").alias("code"))
    return outside.unionByName(spans).unionByName(twice)
