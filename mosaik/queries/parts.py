"""Pieces that queries and their SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators.tiles import BC, BR
from ..sources.tables import embedding_matrix, order_by_part, part_by_supplier, user_by_hour

Query = Callable[[SparkSession, str], DataFrame]

E = "e AS (SELECT l_partkey AS r, l_suppkey AS c, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 0)"
ORDERS = "e AS (SELECT l_orderkey AS r, l_partkey AS c, max(l_discount) AS v FROM lineitem GROUP BY ALL HAVING max(l_discount) <> 0)"
EMBED = "e AS (SELECT * FROM (SELECT CAST(vec_id AS BIGINT) AS r, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v <> 0)"
ROWS, COLS = "(SELECT max(p_partkey) + 1 FROM part)", "(SELECT max(s_suppkey) + 1 FROM supplier)"
TILES = "t AS (SELECT r // 8 AS br, c // 4 AS bc, CAST(bit_or(CAST(1 AS BIGINT) << CAST((r % 8) * 4 + c % 4 AS INTEGER)) AS BIGINT) AS bitmap, count(*) AS nnz FROM e GROUP BY ALL)"
X = f"x AS (SELECT i AS idx, ((i % 17) - 8) * CAST(0.125 AS DOUBLE) AS val FROM range({COLS}) q(i))"

#: The hash of a whole number, to be formatted with it.
HASH = "xor((({0}) % 2147483648 * 2654435761 + 1013904223) % 4294967296, ((({0}) % 2147483648 * 2654435761 + 1013904223) % 4294967296) >> 16)"

#: Value patterns over the positions of the first matrix: a Spark column and its SQL.
PATTERNS = {
    "all_one": (lambda: F.lit(1.0), "CAST(1 AS DOUBLE)"),
    "const_c": (lambda: F.lit(2.5), "CAST(2.5 AS DOUBLE)"),
    "sign2": (lambda: F.when((F.col("row") + F.col("col")) % 2 == 0, 1.0).otherwise(-1.0), "CASE WHEN (r + c) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE"),
    "sign2_scale": (lambda: F.when((F.col("row") + F.col("col")) % 2 == 0, 2.5).otherwise(-2.5), "CASE WHEN (r + c) % 2 = 0 THEN 2.5 ELSE -2.5 END::DOUBLE"),
    "binary01": (lambda: F.when((F.col("row") + F.col("col")) % 2 == 0, 1.0).otherwise(0.0), "CASE WHEN (r + c) % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE"),
    "dict2": (lambda: F.when((F.col("row") + F.col("col")) % 2 == 0, 2.0).otherwise(7.0), "CASE WHEN (r + c) % 2 = 0 THEN 2.0 ELSE 7.0 END::DOUBLE"),
    "dict4": (lambda: F.when((F.col("row") + F.col("col")) % 3 == 0, 2.0).when((F.col("row") + F.col("col")) % 3 == 1, -3.0).otherwise(5.0), "CASE (r + c) % 3 WHEN 0 THEN 2.0 WHEN 1 THEN -3.0 ELSE 5.0 END::DOUBLE"),
    "dict16": (lambda: ((F.col("row") + F.col("col")) % 13 + 1) * F.lit(0.5), "((r + c) % 13 + 1) * CAST(0.5 AS DOUBLE)"),
    "dict256": (lambda: F.col("value"), "v"),
    "dict65536": (lambda: F.col("value") + (F.col("row") % 64) * F.lit(0.25), "v + (r % 64) * CAST(0.25 AS DOUBLE)"),
}


def parts(spark: SparkSession, d: str) -> Matrix:
    return part_by_supplier(spark, d)


def parts_by_tile(spark: SparkSession, d: str) -> Matrix:
    """The same for 8 x 4 tiles: entries lie by tile and carry it."""
    return part_by_supplier(spark, d, tile=(BR, BC))


def parts_by_cell(spark: SparkSession, d: str, height: int, width: int) -> Matrix:
    """The same for windows: entries lie by the cell of half a window, and carry it."""
    return part_by_supplier(spark, d, tile=(height // 2, width // 2))


def pattern(spark: SparkSession, d: str, name: str) -> Matrix:
    return part_by_supplier(spark, d).with_value(PATTERNS[name][0]())


def pattern_sql(name: str) -> str:
    """Entries e with the pattern's values."""
    return f"{E.replace('e AS', 'e0 AS', 1)}, e AS (SELECT r, c, {PATTERNS[name][1]} AS v FROM e0)"


def spmv_sql(entries: str, x: str = X, rows: str = ROWS, digits: int | None = None) -> str:
    y = "coalesce(y, 0)" if digits is None else f"round(coalesce(y, 0), {digits}) + 0"
    return f"WITH {entries}, {x}, sums AS (SELECT r, sum(v * val) AS y FROM e JOIN x ON c = idx GROUP BY r) SELECT i AS \"row\", {y} AS y FROM range({rows}) q(i) LEFT JOIN sums ON r = i"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0 for c in columns})


def matrices_of(spark: SparkSession, d: str) -> dict[str, Matrix]:
    return {"parts": part_by_supplier(spark, d), "orders": order_by_part(spark, d), "users": user_by_hour(spark, d), "embed": embedding_matrix(spark, d)}
