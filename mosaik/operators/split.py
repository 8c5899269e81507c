"""Hybrid splits of tiles and work items for balanced loads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from .order import digits, running


@dataclass(frozen=True)
class Costs:
    """A tile's cost as bitmap and as residual entries: a part for the tile and one for each entry."""

    bitmap_tile: float = 10.0
    bitmap_entry: float = 0.0
    residual_tile: float = 0.0
    residual_entry: float = 1.0


#: Fixed value: tiles of up to so many entries may become residual.
THRESHOLD = 32


def marked(shapes: DataFrame, threshold: int = THRESHOLD, costs: Costs | None = None) -> DataFrame:
    """shapes with small (within the threshold), residual (moved) and cost_skipped (small, but cheaper as a tile)."""
    small = F.col("nnz") <= threshold
    cheaper = F.lit(True)
    if costs:
        cheaper = F.lit(costs.residual_tile) + F.col("nnz") * costs.residual_entry < F.lit(costs.bitmap_tile) + F.col("nnz") * costs.bitmap_entry
    return shapes.withColumns({"small": small, "residual": small & cheaper, "cost_skipped": small & ~cheaper})


def parted(m: Matrix, shapes: DataFrame, br: int = 8, bc: int = 4) -> tuple[DataFrame, DataFrame]:
    """Entries in kept tiles and in residual ones, by marked shapes; one join on the tile."""
    key = shapes.select(F.col("br").alias("tbr"), F.col("bc").alias("tbc"), "residual")
    e = m.entries.join(key, (F.expr(f"row DIV {br}") == F.col("tbr")) & (F.expr(f"col DIV {bc}") == F.col("tbc")))
    return tuple(e.filter(f).select("row", "col", "value") for f in ("NOT residual", "residual"))


def totals(shapes: DataFrame, block_rows: int, rows: int) -> DataFrame:
    """One row of counts and position bits of a split, from marked shapes."""
    one = lambda c, n: F.coalesce(F.sum(F.when(F.col(c), n)), F.lit(0))
    t = shapes.agg(
        F.count("*").alias("full_blocks"),
        F.coalesce(F.sum(F.when(~F.col("residual"), 1)), F.lit(0)).alias("kept_blocks"),
        one("residual", F.lit(1)).alias("residual_blocks"),
        F.coalesce(F.sum(F.when(~F.col("residual"), F.col("nnz"))), F.lit(0)).alias("kept_nnz"),
        one("residual", F.col("nnz")).alias("residual_nnz"),
        one("cost_skipped", F.lit(1)).alias("cost_skipped_blocks"),
        one("cost_skipped", F.col("nnz")).alias("cost_skipped_nnz"),
    )
    # Pointers of block rows, then a column, a bitmap and a value pointer for each tile and one more pointer.
    tile_bits = lambda n: (F.lit(block_rows + 1) + F.col(n) * 3 + 1) * 32
    t = t.withColumns({"full_bits": tile_bits("full_blocks").cast("long"), "kept_bits": tile_bits("kept_blocks").cast("long"), "residual_bits": ((F.lit(rows + 1) + F.col("residual_nnz")) * 32).cast("long")})
    t = t.withColumn("split_bits", F.col("kept_bits") + F.col("residual_bits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return t.withColumns(
        {
            "split_vs_full": ratio("split_bits", "full_bits"),
            "residual_block_ratio": ratio("residual_blocks", "full_blocks"),
            "residual_position_ratio": ratio("residual_bits", "split_bits"),
            "residual_position_vs_full": ratio("residual_bits", "full_bits"),
            "residual_nnz_ratio": F.coalesce(F.try_divide(F.col("residual_nnz").cast("double"), (F.col("kept_nnz") + F.col("residual_nnz")).cast("double")), F.lit(0.0)),
        }
    )


def work_items(pointed: DataFrame, chunk: int, split_threshold: int) -> DataFrame:
    """(br, item, first, blocks, value_begin, shared) from shapes with val_ptr: block rows of more than split_threshold
    tiles are cut into chunks; the items of a cut row share its result."""
    sizes = pointed.groupBy(F.col("br").alias("b")).agg(F.count("*").alias("n"))
    t = running(pointed, digits("bc"), "rn", group=("br",)).withColumn("rn", F.col("rn").cast("int")).join(sizes, F.col("br") == F.col("b"))
    t = t.withColumn("item", F.when(F.col("n") > split_threshold, F.expr(f"rn DIV {chunk}")).otherwise(F.lit(0)).cast("long"))
    items = t.groupBy("br", "item").agg(F.min("rn").alias("first"), F.count("*").alias("blocks"), F.min("val_ptr").alias("value_begin"), F.max("n").alias("n"))
    return items.withColumn("shared", (F.col("n") > split_threshold) & (F.col("n") > chunk)).drop("n")


def work_items_with_empty(pointed: DataFrame, block_rows: int, chunk: int, split_threshold: int) -> DataFrame:
    """As work_items, with an item of no tiles for each block row without any; value_begin is null there."""
    items = work_items(pointed, chunk, split_threshold).withColumnRenamed("br", "b")
    every = pointed.sparkSession.range(block_rows).select(F.col("id").alias("br"))
    filled = every.join(items, F.col("br") == F.col("b"), "left")
    zero = F.lit(0).cast("long")
    return filled.select("br", F.coalesce("item", zero).alias("item"), F.coalesce("first", zero.cast("int")).alias("first"), F.coalesce("blocks", zero).alias("blocks"), "value_begin", F.coalesce("shared", F.lit(False)).alias("shared"))


def long_row_chunks(e: DataFrame, longer_than: int, chunk: int = 1024) -> DataFrame:
    """(row, chunk, n) of rows with more entries than longer_than."""
    long = e.groupBy(F.col("row").alias("r")).agg(F.count("*").alias("n")).filter(F.col("n") > longer_than).select("r")
    t = running(e.join(long, F.col("row") == F.col("r"), "left_semi"), digits("col"), "rn", group=("row",))
    return t.groupBy("row", F.expr(f"rn DIV {chunk}").alias("chunk")).agg(F.count("*").alias("n"))
