"""Rows near rows with hits, and gaps between what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["path", "file_seq", "sheet"]
#: Up to so many rows of context, a hit's neighbours are listed; beyond it they are met in buckets.
LISTED = 64


def neighbours(cells: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """cells in rows from `before` above to `after` below a row of hits(path, file_seq, sheet, row) of the same sheet.

    A semi-join on the row, never a sort of a whole sheet: one large sheet spreads over all tasks. A table's rows may be
    0 or below, as its keys are.
    """
    rows = hits.select(*PLACE, "row").distinct()
    if before + after <= LISTED:
        near = rows.select(*PLACE, F.explode(F.sequence(F.col("row") - before, F.col("row") + after)).alias("row")).distinct()
        return cells.join(near, [*PLACE, "row"], "left_semi")
    width = before + after + 1
    low, high = F.floor((F.col("hit") - before) / width), F.floor((F.col("hit") + after) / width)
    spans = rows.withColumnRenamed("row", "hit").withColumn("bucket", F.explode(F.array_distinct(F.array(low, high))))
    c, s = cells.withColumn("bucket", F.floor(F.col("row") / width)).alias("c"), spans.alias("s")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) if k == "sheet" else F.col(f"c.{k}") == F.col(f"s.{k}") for k in [*PLACE, "bucket"]]
    inside = (F.col("c.row") >= F.col("s.hit") - before) & (F.col("c.row") <= F.col("s.hit") + after)
    return c.join(s, [*same, inside], "left_semi").drop("bucket")


def promoted(cells: DataFrame, hits: DataFrame) -> DataFrame:
    """cells with row_hit: whether their row has a hit."""
    rows = hits.select(*PLACE, "row").distinct().withColumn("row_hit", F.lit(True))
    return cells.join(rows, [*PLACE, "row"], "left").withColumn("row_hit", F.coalesce("row_hit", F.lit(False)))


def gaps(shown: DataFrame) -> DataFrame:
    """shown with gap_before: the sheet changes, or a row lies between this one and the one shown before.

    Cells come sheet by sheet and row by row, so a row begins a run if the row above it isn't shown: a hash join on rows
    tells, never a sort of a whole sheet. Only the first cell shown of a file has no gap. Comments come behind all cells,
    in an order of their own; they are looked at in that order, file by file.
    """
    comment = F.col("layer") == "comment"
    row = [*PLACE, "row"]
    heads = shown.where(~comment).groupBy(*row).agg(F.min("seq").alias("head"))
    above = heads.select(*PLACE, (F.col("row") + 1).alias("row"))
    first = shown.groupBy("path", "file_seq").agg(F.min("seq").alias("first"))
    begins = heads.join(above, row, "left_anti").join(first, ["path", "file_seq"]).where("head <> first").select(*row, "head")
    cells = shown.where(~comment).join(begins, row, "left").withColumn("gap_before", F.coalesce(F.col("seq") == F.col("head"), F.lit(False))).drop("head")
    last = shown.where(~comment).groupBy("path", "file_seq").agg(F.max(F.struct("seq", "sheet", "row")).alias("last"))
    order = Window.partitionBy("path", "file_seq").orderBy("seq")
    before = F.coalesce(F.lag(F.struct("seq", "sheet", "row")).over(order), F.col("last"))
    apart = (before["sheet"] != F.col("sheet")) | (F.col("row") > before["row"] + 1)
    comments = shown.where(comment).join(last, ["path", "file_seq"], "left").withColumn("gap_before", F.coalesce(apart, F.lit(False))).drop("last")
    return cells.select(*shown.columns, "gap_before").unionByName(comments.select(*shown.columns, "gap_before"))
