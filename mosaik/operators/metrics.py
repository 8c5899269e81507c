"""Errors between results and gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-30


def _met(reference: DataFrame, got: DataFrame) -> DataFrame:
    return reference.select(F.col("row").alias("r"), F.col("y").alias("y0")).join(got, F.col("r") == F.col("row")).select("y0", "y", F.abs(F.col("y") - F.col("y0")).alias("d"))


def compared(reference: DataFrame, got: DataFrame) -> DataFrame:
    """One row: max_abs, max_rel (by element) and global_rel (by the greatest reference)."""
    return _met(reference, got).agg(
        F.max("d").alias("max_abs"), F.max(F.col("d") / F.greatest(F.abs("y0"), F.lit(TINY))).alias("max_rel"), (F.max("d") / F.greatest(F.max(F.abs("y0")), F.lit(TINY))).alias("global_rel")
    )


def relative_norms(reference: DataFrame, got: DataFrame) -> DataFrame:
    """One row: rel_maxrow and rel_l2."""
    return _met(reference, got).agg((F.max("d") / (F.max(F.abs("y0")) + TINY)).alias("rel_maxrow"), (F.sqrt(F.sum(F.col("d") * F.col("d"))) / (F.sqrt(F.sum(F.col("y0") * F.col("y0"))) + TINY)).alias("rel_l2"))


def exact_gate(absolute: float = 1e-9, relative: float = 1e-10) -> Column:
    """Either tolerance is enough."""
    return (F.col("max_abs") <= absolute) | (F.col("max_rel") <= relative)


def lossy_gate(most: float = 1e-2) -> Column:
    return F.col("global_rel") <= most


def value_errors(original: DataFrame, got: DataFrame) -> DataFrame:
    """One row: values changed, their share and the greatest errors, over entries."""
    b = got.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))
    d = original.join(b, (F.col("row") == F.col("r")) & (F.col("col") == F.col("c"))).withColumn("d", F.abs(F.col("v") - F.col("value")))
    n = F.sum(F.when(F.col("v") != F.col("value"), 1).otherwise(0))
    return d.agg(n.alias("changed"), (n / F.count("*")).alias("changed_ratio"), F.max("d").alias("max_abs_error"), F.max(F.col("d") / F.greatest(F.abs("value"), F.lit(TINY))).alias("max_rel_error"))


def ensemble(norms: DataFrame) -> DataFrame:
    """(codec, worst, mean) over vectors of (codec, rel); a result that is no number counts as infinite."""
    rel = F.when(F.isnan("rel") | F.col("rel").isNull(), F.lit(float("inf"))).otherwise(F.col("rel"))
    return norms.groupBy("codec").agg(F.max(rel).alias("worst"), F.avg(rel).alias("mean"))
