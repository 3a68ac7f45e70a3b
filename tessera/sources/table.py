"""Spark tables as cells: no file is opened, no Python runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import a1_column, value_column
from tessera.model import CELLS, DISPLAY


def cells_from_table(df: DataFrame, path: str, columns: list[str], row: Column, sheet: Column | None = None, file_seq: int = 0, layer: str = DISPLAY) -> DataFrame:
    """A cell for every non-empty value of the given columns.

    row numbers the rows by a unique key (rows of one key are one row of the sheet); seq follows it, so rows come in its order.
    """
    kinds = dict(df.dtypes)
    sheet = F.lit("") if sheet is None else F.coalesce(sheet, F.lit(""))
    if len(columns) == 1:  # no row is made of another, so that filters reach the scan
        flat = df.select(row.cast("long").alias("row"), sheet.alias("sheet"), F.lit(1).alias("col"), value_column(F.col(columns[0]), kinds[columns[0]]).alias("text")).where(F.length("text") > 0)
        return _complete(flat, path, file_seq, layer, 1)
    values = F.array(*(F.struct(F.lit(i + 1).alias("col"), value_column(F.col(c), kinds[c]).alias("text")) for i, c in enumerate(columns)))
    flat = df.select(row.cast("long").alias("row"), sheet.alias("sheet"), F.explode(values).alias("v"))
    flat = flat.select("row", "sheet", "v.col", "v.text").where(F.length("text") > 0)
    return _complete(flat, path, file_seq, layer, len(columns))


def _complete(flat: DataFrame, path: str, file_seq: int, layer: str, width: int) -> DataFrame:
    made = {
        "path": F.lit(path), "file_seq": F.lit(file_seq), "sheet_idx": F.lit(0), "cell": a1_column(F.col("row"), F.col("col")), "layer": F.lit(layer), "seq": F.col("row") * width + F.col("col"),
        "hidden_sheet": F.lit(False), "hidden_row": F.lit(False), "hidden_col": F.lit(False), "error": F.lit(None), "error_class": F.lit(None),
    }
    return flat.select(*((made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType).alias(f.name) for f in CELLS))
