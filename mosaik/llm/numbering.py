"""Gapless numbers and running sums within groups of any size, with DataFrame functions only.

A group is cut into CELLS cells by a hash of the ordering key, the cells of a group are summed, and only
within a cell are rows put in order. So a group that holds a third of all rows is still dealt to many
tasks, and what is carried over between cells is one row for each group and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

CELLS = 4096


def running_sum(df: DataFrame, group: list[str], key: list[str], amount: Column, name: str, cells: int = CELLS, tie: list[str] | None = None) -> DataFrame:
    """df with the sum of amount over the rows before each one in its group (null groups are groups, too).

    The order is that of a hash of the key, then of the key, then of tie; rows alike in all are in any order."""
    held = [F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group)]
    groups = [f"g{i}" for i in range(len(group))]
    ordered = [*key, *(tie or [])]
    order = [f"k{i}" for i in range(len(ordered))]
    placed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        *held,
        *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(ordered)],
        F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(cells)).cast("int").alias("cell"),
        amount.cast("long").alias("amount"),
    )
    sums = placed.groupBy(*groups, "cell").agg(F.sum("amount").alias("sum"))
    before = Window.partitionBy(*groups).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"o{g}") for g in groups], F.col("cell").alias("ocell"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*groups, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", F.coalesce(F.sum("amount").over(within), F.lit(0)).alias("local"))
    on = F.col("cell") == F.col("ocell")
    for g in groups:
        on &= F.col(g).eqNullSafe(F.col(f"o{g}"))
    return local.join(offsets, on).select(*[F.col("row").getField(c).alias(c) for c in df.columns], (F.col("local") + F.col("offset")).alias(name))


def sums_before(df: DataFrame, order: list[Column], amounts: dict[str, Column], small: bool) -> DataFrame:
    """df with the sum of each amount over the rows before each one, in an order that tells rows apart.

    Of few rows (small) one task does it. Any others are cut into ranges of the order, as many as a shuffle has
    partitions, and summed by range first; what one task then sees is a row for each range."""
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if small:
        return df.withColumns({name: F.coalesce(F.sum(a).over(earlier), F.lit(0)) for name, a in amounts.items()})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumns({f"_{name}": a for name, a in amounts.items()})
    # Ranges are drawn anew each time they are asked for, so they are written before two sides read them.
    cut = written(own.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(F.col("_range").alias("_of")).agg(*[F.sum(f"_{name}").alias(f"_sum_{name}") for name in amounts])
    ranges = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_of", *[F.coalesce(F.sum(f"_sum_{name}").over(ranges), F.lit(0)).alias(f"_to_{name}") for name in amounts])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"_in_{name}": F.coalesce(F.sum(f"_{name}").over(within), F.lit(0)) for name in amounts})
    met = local.join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    return met.select(*df.columns, *[(F.col(f"_in_{name}") + F.col(f"_to_{name}")).alias(name) for name in amounts])
