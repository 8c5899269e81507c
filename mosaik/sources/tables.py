"""Matrices and vectors derived from relational tables and formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extent(df: DataFrame, key: str) -> int:
    most = df.agg(F.max(key)).first()[0]
    return 0 if most is None else most + 1


#: Fixed value: rows of a task that aggregates them by keys that hardly repeat, some 200 bytes each.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df for an aggregation by keys that hardly repeat. While every core has at most TASK_ROWS of its rows it stays as it is; beyond, it is dealt by keys to
    partitions of so many. Otherwise a task takes what packs into a number of bytes, which for rows that compress well are millions."""
    rows = df.count()
    if rows <= TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // TASK_ROWS), *keys)


def part_by_supplier(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("l_partkey", "l_suppkey"), tile: tuple[int, int] | None = None) -> Matrix:
    """Quantity ordered of each part from each supplier; all values are whole numbers. by: what lines are dealt by where they are many; with
    the part alone a row lies in one task. tile: height and width of tiles by which lines are dealt instead; entries then carry their tile's br and bc."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    if tile:
        lines = lines.withColumns({"br": F.expr(f"l_partkey DIV {tile[0]}"), "bc": F.expr(f"l_suppkey DIV {tile[1]}")})
    at = ("br", "bc") if tile else ()
    e = dealt(lines, *(at or by)).groupBy(*at, F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("value"))
    return Matrix(e.filter("value <> 0"), _extent(table(spark, sf_dir, "part"), "p_partkey"), _extent(table(spark, sf_dir, "supplier"), "s_suppkey"))


def order_by_part(spark: SparkSession, sf_dir: str) -> Matrix:
    """Largest discount of each part in each order."""
    lines = table(spark, sf_dir, "lineitem")
    e = lines.groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.max("l_discount").alias("value"))
    return Matrix(e.filter("value <> 0"), _extent(table(spark, sf_dir, "orders"), "o_orderkey"), _extent(table(spark, sf_dir, "part"), "p_partkey"))


def user_by_hour(spark: SparkSession, sf_dir: str) -> Matrix:
    """Event value of each user in each hour since the start of 2024."""
    hour = F.expr("CAST(unix_timestamp(CAST(ts AS TIMESTAMP)) DIV 3600 AS BIGINT) - 473352")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row"), hour.alias("col")).agg(F.sum("value").alias("value")).filter("value <> 0")
    return Matrix(e, _extent(e, "row"), _extent(e, "col"))


def order_graph(spark: SparkSession, sf_dir: str) -> Matrix:
    """A symmetric positive definite matrix of orders: each line links its order to the one as many places on as the number of its
    part, by its discount; a diagonal entry is one more than the links of its order."""
    return _graph(table(spark, sf_dir, "lineitem"), "l_orderkey", _extent(table(spark, sf_dir, "orders"), "o_orderkey"), "l_discount", 1.0)


def supplier_graph(spark: SparkSession, sf_dir: str) -> Matrix:
    """The same of suppliers, by quantity."""
    return _graph(table(spark, sf_dir, "lineitem"), "l_suppkey", _extent(table(spark, sf_dir, "supplier"), "s_suppkey"), "l_quantity", 64.0)


def _graph(lines: DataFrame, key: str, n: int, weight: str, shift: float) -> Matrix:
    i, j = F.col(key), (F.col(key) + F.col("l_partkey")) % max(1, n)
    links = lines.select(i.alias("i"), j.alias("j"), F.col(weight).alias("v")).filter("i <> j AND v <> 0")
    sums = links.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return _with_diagonal(sums, n, F.abs("v"), shift)


def embedding_matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    """Vectors by dimension."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"))
    e = v.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double")).filter("value <> 0")
    return Matrix(e, _extent(e, "row"), _extent(e, "col"))


#: Measures of shipments.
MEASURES = ("quantity", "discount", "price", "lines")


def shipments(lines: DataFrame) -> DataFrame:
    """(year, field, row, col, value): for each year of shipping (0: no date) and each measure the matrix of parts by suppliers, without zeros."""
    lines = dealt(lines.select("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice"), "l_partkey")  # sums by part meet no second time
    t = lines.groupBy(F.coalesce(F.year("l_shipdate"), F.lit(0)).alias("year"), F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(
        F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.max("l_extendedprice").alias("price"), F.count("*").cast("double").alias("lines")
    )
    each = t.unpivot(["year", "row", "col"], list(MEASURES), "field", "value")
    return each.filter("value <> 0").select("year", "field", "row", "col", "value")


# --- vectors (idx, val) ---------------------------------------------------------------------------------


def _vector(spark: SparkSession, n: int, val: Column) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), val.cast("double").alias("val"))


def input_vector(spark: SparkSession, n: int) -> DataFrame:
    return _vector(spark, n, ((F.col("id") % 17) - 8) * F.lit(0.125))


def deterministic_vector(spark: SparkSession, n: int) -> DataFrame:
    return _vector(spark, n, ((F.col("id") % 17) + 1) / F.lit(17.0))


def legacy_vector(spark: SparkSession, n: int) -> DataFrame:
    return _vector(spark, n, F.lit(1.0) + (F.col("id") % 7) * F.lit(0.1))


def ones_vector(spark: SparkSession, n: int) -> DataFrame:
    return _vector(spark, n, F.lit(1.0))


def hashed(x: Column) -> Column:
    """A 32-bit mix of a whole number, as a non-negative long."""
    h = (x % F.lit(2147483648) * F.lit(2654435761) + F.lit(1013904223)) % F.lit(4294967296)
    return h.bitwiseXOR(F.shiftright(h, 16))


def probe_vector(spark: SparkSession, n: int) -> DataFrame:
    v = hashed(F.col("id")) % 2001 - 1000
    return _vector(spark, n, F.when(v == 0, F.lit(1)).otherwise(v) / F.lit(257.0))


def ensemble_values(idx: Column, seeds: int = 7) -> list[Column]:
    """The values at idx of seeds vectors of hashed values in [-1, 1), and then of as many of normal ones, of two hashed values each."""
    out = []
    for seed in range(2 * seeds):
        a, b = (hashed(idx * m + seed * s + 1) % 65536 for m, s in ((31, 7919), (37, 104729)))
        normal = F.sqrt(F.lit(-2.0) * F.log((a + 1) / F.lit(65536.0))) * F.cos(F.lit(2 * math.pi) * b / F.lit(65536.0))
        out.append(a / F.lit(32768.0) - 1 if seed < seeds else normal)
    return out


# --- synthetic symmetric positive definite matrices -----------------------------------------------------


def _pairs(spark: SparkSession, n: int, band: int) -> DataFrame:
    """Off-diagonal pairs i < j <= i + band."""
    i = spark.range(n).select(F.col("id").alias("i"))
    return i.select("i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + band)).alias("j")).filter(F.col("j") < n)


def banded_spd(spark: SparkSession, n: int, band: int, delta: float) -> Matrix:
    """Hashed values within a band; each diagonal exceeds its row's absolute sum by delta."""
    v = (hashed(F.col("i") * 4096 + F.col("j")) % 2001 - 1000) / F.lit(1024.0)
    return _with_diagonal(_pairs(spark, n, band).select("i", "j", v.alias("v")).filter("v <> 0"), n, F.abs("v"), delta)


def shifted_laplacian(spark: SparkSession, n: int, band: int, sigma: float) -> Matrix:
    """Degrees less hashed weights in [0.125, 1.125), shifted by sigma."""
    w = (hashed(F.col("i") * 4096 + F.col("j")) % 1024) / F.lit(1024.0) + F.lit(0.125)
    return _with_diagonal(_pairs(spark, n, band).select("i", "j", (-w).alias("v")), n, F.abs("v"), sigma)


def _with_diagonal(upper: DataFrame, n: int, weight: Column, shift: float) -> Matrix:
    spark = upper.sparkSession
    both = upper.select(F.col("i").alias("row"), F.col("j").alias("col"), F.col("v").alias("value")).unionAll(upper.select("j", "i", "v"))
    sums = both.groupBy(F.col("row").alias("r")).agg(F.sum(F.abs("value")).alias("s"))
    d = spark.range(n).join(sums, F.col("id") == F.col("r"), "left").select(F.col("id").alias("row"), F.col("id").alias("col"), (F.coalesce("s", F.lit(0.0)) + F.lit(shift)).alias("value"))
    return Matrix(both.unionAll(d), n, n)
