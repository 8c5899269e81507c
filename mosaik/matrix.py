"""The canonical sparse matrix: a DataFrame of (row, col, value) entries and a shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matrix:
    """entries: row long, col long, value double, one row for each stored entry."""

    entries: DataFrame
    rows: int
    cols: int

    def with_entries(self, entries: DataFrame) -> Matrix:
        return Matrix(entries, self.rows, self.cols)

    def with_value(self, value) -> Matrix:
        """The same positions with a value computed from row, col and value."""
        return self.with_entries(self.entries.select("row", "col", value.cast("double").alias("value")))

    def all_rows(self) -> DataFrame:
        return self.entries.sparkSession.range(self.rows).select(F.col("id").alias("row"))
