"""Matrix times vector, from entries and from every encoding: a join on the column, one aggregation by row.

The vector is broadcast up to BROADCAST_ENTRIES entries, which its known length proves; beyond, both sides are
shuffled by column and AQE splits crowded columns. Rows are summed partially before they are shuffled, so long
rows need no treatment of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix

#: 16 bytes each.
BROADCAST_ENTRIES = 4_000_000


def products(e: DataFrame, x: DataFrame, cols: int, weight: Column | None = None) -> DataFrame:
    """(row, p): weight, by default the value, times the vector at the column."""
    x = F.broadcast(x) if cols <= BROADCAST_ENTRIES else x
    p = F.col("val") * (F.col("value") if weight is None else weight)
    return e.join(x, F.col("col") == F.col("idx")).select("row", p.alias("p"))


def summed(p: DataFrame, m: Matrix) -> DataFrame:
    """(row, y) for all rows of m."""
    sums = p.groupBy(F.col("row").alias("r")).agg(F.sum("p").alias("s"))
    return m.all_rows().join(sums, F.col("row") == F.col("r"), "left").select("row", F.coalesce("s", F.lit(0.0)).alias("y"))


def spmv(m: Matrix, x: DataFrame, weight: Column | None = None) -> DataFrame:
    """y = m x, dense."""
    return summed(products(m.entries, x, m.cols, weight), m)


def spmv_parts(m: Matrix, parts: list[DataFrame], x: DataFrame) -> DataFrame:
    """y of a matrix that comes in parts of entries: one aggregation over their union."""
    out = None
    for e in parts:
        p = products(e, x, m.cols)
        out = p if out is None else out.unionAll(p)
    return summed(out, m)


def spmv_two_pass(m: Matrix, parts: list[DataFrame], x: DataFrame) -> DataFrame:
    """As spmv_parts, each part aggregated on its own first."""
    out = None
    for e in parts:
        s = products(e, x, m.cols).groupBy("row").agg(F.sum("p").alias("p"))
        out = s if out is None else out.unionAll(s)
    return summed(out, m)
