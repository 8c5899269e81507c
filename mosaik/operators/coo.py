"""Normalising and checking entry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from .order import digits, running


def zero_based(e: DataFrame) -> DataFrame:
    return e.select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), "value")


def mirrored(e: DataFrame, symmetry: str) -> DataFrame:
    """Entries with those across the diagonal that symmetry implies; the diagonal stands alone."""
    if symmetry == "general":
        return e
    sign = -1 if symmetry == "skew-symmetric" else 1
    across = e.filter("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("value") * sign).alias("value"))
    return e.unionAll(across)


def coalesced(e: DataFrame) -> DataFrame:
    """One entry for each position, the sum of its duplicates."""
    return e.groupBy("row", "col").agg(F.sum("value").alias("value"))


def without_zeros(e: DataFrame) -> DataFrame:
    return e.filter("value <> 0")


def finite_nonzero(e: DataFrame) -> DataFrame:
    """Entries whose magnitude is a positive number."""
    return e.filter(~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") != 0))


def normalized(e: DataFrame, symmetry: str = "general") -> DataFrame:
    return without_zeros(coalesced(mirrored(e, symmetry)))


def load_counters(stored: DataFrame, symmetry: str) -> DataFrame:
    """One row: entries stored, after mirroring, after coalescing, and the difference of the last two."""
    expanded = mirrored(stored, symmetry)
    a, b, c = (x.agg(F.count("*").alias(n)) for x, n in ((stored, "stored"), (expanded, "expanded"), (without_zeros(coalesced(expanded)), "nnz")))
    return a.join(b).join(c).withColumn("coalesced", F.col("expanded") - F.col("nnz"))


def row_pointers(m: Matrix) -> DataFrame:
    """(row, nnz, row_ptr): entries of each row and before it, for all rows."""
    counts = m.entries.groupBy(F.col("row").alias("r")).agg(F.count("*").alias("nnz"))
    full = m.all_rows().join(counts, F.col("row") == F.col("r"), "left").select("row", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    return running(full, digits("row", m.rows), "row_ptr", F.col("nnz"))


def violations(m: Matrix) -> DataFrame:
    """(rule, n) of each broken rule of a normalised matrix; none if it is sound."""
    e = m.entries
    bad = [
        ("row outside", e.filter((F.col("row") < 0) | (F.col("row") >= m.rows))),
        ("column outside", e.filter((F.col("col") < 0) | (F.col("col") >= m.cols))),
        ("stored zero", e.filter("value = 0")),
        ("duplicate", e.groupBy("row", "col").count().filter("count > 1")),
    ]
    out = None
    for rule, rows in bad:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionAll(one)
    return out.filter("n > 0")
