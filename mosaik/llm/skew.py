"""Joins of a table with the one row that each of its keys has in another, where some keys have very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys are hot from so many rows on, or from this share of all rows: at most MOST_HOT of them, whatever the data.
LEAST_HOT, MOST_HOT = 1000, 10_000


def hot_keys(left: DataFrame, key: str) -> DataFrame | None:
    """(hot, parts) of keys with so many rows that they are to be cut into parts; None where there are none."""
    counts = left.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("n"))
    least = max(LEAST_HOT, left.count() // MOST_HOT)
    rows = counts.filter(F.col("n") > least).select("hot", F.ceil(F.col("n") / least).cast("int").alias("parts")).collect()  # MOST_HOT rows, or LEAST_HOT-ths of a small table
    return left.sparkSession.createDataFrame(rows, f"hot {dict(left.dtypes)[key]}, parts int") if rows else None


def joined(left: DataFrame, right: DataFrame, key: str, other: str, spread: Column) -> DataFrame:
    """The columns of left and of right where left.key equals right.other; right has one row for each key.

    The rows of hot keys are dealt to parts by spread, and the row of right is copied to each part. left is
    read three times, so it should be a written table. Names of the two sides must differ."""
    hot = hot_keys(left, key)
    if hot is None:
        return left.join(right, F.col(key) == F.col(other))
    few = F.broadcast(hot)
    dealt = left.join(few, F.col(key) == F.col("hot"), "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("parts")).cast("int")))
    copied = right.join(few, F.col(other) == F.col("hot"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    a, b = dealt.drop("hot", "parts").alias("a"), copied.drop("hot", "parts").alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{other}")) & (F.col("part") == F.col("copy")))
    return met.drop("part", "copy")
