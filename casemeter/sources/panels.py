"""Published score panels: text cells ``"87.4 ± 0.8 (n=3)"`` and their long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the format of a published cell.
CELL_PATTERN = r"^(\d+\.\d) ± (\d+\.\d) \(n=(\d+)\)$"


def parse_cell(cell: Column) -> Column:
    """Struct of mean, sd and n; null for text that is not a cell."""
    part = lambda i, t: F.regexp_extract(cell, CELL_PATTERN, i).cast(t)
    parsed = F.struct(part(1, "double").alias("mean"), part(2, "double").alias("sd"), part(3, "bigint").alias("n"))
    return F.when(cell.rlike(CELL_PATTERN), parsed)


def panel_cells(panel: DataFrame, dataset: str, models: Sequence[str], strict: bool = True) -> DataFrame:
    """Long table ``(dataset, model, mean, sd, n, display)``; a malformed cell is an error when strict."""
    long = panel.unpivot(dataset, list(models), "model", "display").where(F.col("display").isNotNull())
    cell = parse_cell(F.col("display"))
    if strict:
        bad = F.raise_error(F.concat(F.lit("malformed cell: "), F.col("display")))
        cell = F.when(F.col("display").rlike(CELL_PATTERN), cell).otherwise(bad.cast("struct<mean:double,sd:double,n:bigint>"))
    return long.withColumn("_c", cell).select(F.col(dataset).alias("dataset"), "model", "_c.*", "display")


def panel_gaps(panel: DataFrame, dataset: str, models: Sequence[str], n: int) -> DataFrame:
    """Cells that are missing, pending or from an incomplete set of seeds."""
    long = panel.select(dataset, *[F.coalesce(F.col(m), F.lit("missing")).alias(m) for m in models]).unpivot(dataset, list(models), "model", "display")
    cell = parse_cell(F.col("display"))
    problem = F.when(cell.isNull(), F.when(F.col("display").isin("missing", "pending"), F.col("display")).when(F.col("display").endswith(" INCOMPLETE"), "INCOMPLETE").otherwise("malformed")).when(
        cell["n"] != n, "incomplete seeds"
    )
    return long.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(F.col(dataset).alias("dataset"), "model", "problem")


def check_panel(long: DataFrame, expected_n: int | None) -> None:
    if expected_n is not None and long.where(F.col("n") != expected_n).limit(1).count():
        raise ValueError("a published cell does not cover every seed")
