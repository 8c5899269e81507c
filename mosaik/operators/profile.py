"""Storage, fill and balance figures of tiled matrices, and statistics of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import distinct_upto
from ..matrix import Matrix
from .tiles import shapes


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def storage(m: Matrix, br: int = 8, bc: int = 4) -> DataFrame:
    """One row: position bits of compressed rows and of tiles, per entry and as ratios."""
    words, grid = -(-br * bc // 32), -(-m.rows // br)
    t = shapes(m, br, bc).agg(F.count("*").alias("blocks"), F.coalesce(F.sum("nnz"), F.lit(0)).alias("nnz"))
    t = t.withColumns({"csr_index_bits": F.col("nnz") * 32, "csr_bits": (F.col("nnz") + F.lit(m.rows + 1)) * 32})
    t = t.withColumn("tile_bits", (F.lit(grid + 1) + F.col("blocks") * (2 + words) + 1) * 32)
    return t.withColumns(
        {
            "avg_nnz_per_block": _ratio(F.col("nnz"), F.greatest(F.col("blocks"), F.lit(1))),
            "csr_bits_per_nnz": _ratio(F.col("csr_bits"), F.col("nnz")),
            "tile_bits_per_nnz": _ratio(F.col("tile_bits"), F.col("nnz")),
            "compression_ratio": _ratio(F.col("tile_bits"), F.col("csr_index_bits")),
            "position_ratio": _ratio(F.col("tile_bits"), F.col("csr_bits")),
        }
    )


def fill(s: DataFrame, cells: int = 32) -> DataFrame:
    """One row: tiles, their fill and how many are sparse or full, from shapes."""
    part = F.col("nnz") / F.lit(float(cells))
    return s.agg(
        F.count("*").alias("blocks"), (F.sum("nnz") / (F.count("*") * F.lit(float(cells)))).alias("fill_ratio"), F.count_if(part <= 0.25).alias("le25"), F.count_if(part <= 0.5).alias("le50"), F.count_if(F.col("nnz") == cells).alias("full")
    )


def blocks_per_row(s: DataFrame, block_rows: int) -> DataFrame:
    """(br, n): tiles of each block row, zero where there are none."""
    n = s.groupBy(F.col("br").alias("b")).agg(F.count("*").alias("c"))
    return s.sparkSession.range(block_rows).join(n, F.col("id") == F.col("b"), "left").select(F.col("id").alias("br"), F.coalesce("c", F.lit(0)).alias("n"))


def imbalance(s: DataFrame, block_rows: int) -> DataFrame:
    """One row: empty block rows, average, nearest-rank percentiles and maximum of tiles in a block row. The counts
    are counted, so percentiles come from few rows."""
    n = blocks_per_row(s, block_rows)
    p = [F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY n) AS BIGINT)").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)]
    t = n.agg(F.count_if(F.col("n") == 0).alias("empty_rows"), F.avg("n").alias("avg"), *p, F.max("n").alias("max"))
    return t.withColumns({"p99_over_avg": F.col("p99") / F.col("avg"), "max_over_avg": F.col("max") / F.col("avg")})


def column_deltas(s: DataFrame) -> DataFrame:
    """One row: block rows whose columns fit 8 or 16 bits beside a base, and the bits that takes."""
    r = s.groupBy("br").agg(F.count("*").alias("n"), (F.max("bc") - F.min("bc")).alias("d"))
    bits = lambda most, w: F.sum(F.when(F.col("d") <= most, F.least(F.col("n") * 32, F.lit(32) + F.col("n") * w)).otherwise(F.col("n") * 32))
    return r.agg(F.count_if(F.col("d") <= 255).alias("u8_rows"), F.count_if(F.col("d") <= 65535).alias("u16_rows"), F.max("d").alias("max_delta"), bits(255, 8).alias("u8_bits"), bits(65535, 16).alias("u16_bits"))


def position_bits(m: Matrix, br: int = 8, bc: int = 4) -> DataFrame:
    """One row: bits of six position models and three of active rows' tables."""
    s = shapes(m, br, bc)
    grid, words, cells = -(-m.rows // br), -(-br * bc // 32), br * bc
    t = s.agg(F.count("*").alias("blocks"), F.sum("nnz").alias("nnz"), F.count_distinct("br").alias("active")).join(column_deltas(s).select("u8_bits", "u16_bits"))
    rows, bitmap = F.lit(2 * (grid + 1) * 32), F.col("blocks") * (words * 32)
    local = F.col("nnz") * (cells - 1).bit_length() + F.col("blocks") * cells.bit_length()
    cols = {"abs": F.col("blocks") * 32, "u8": F.col("u8_bits"), "u16": F.col("u16_bits")}
    out = {f"{k}_bits": (rows + c + bitmap).cast("long") for k, c in cols.items()} | {f"local_{k}_bits": (rows + c + local).cast("long") for k, c in cols.items()}
    active = (F.col("active") + 1) * 64
    out |= {"active_abs_bits": active + F.col("active") * 32, "active_u8_bits": active + 32 + F.col("active") * 8, "active_u16_bits": active + 32 + F.col("active") * 16}
    return t.select("blocks", "nnz", *[v.alias(k) for k, v in out.items()])


def device_position_bits(m: Matrix) -> DataFrame:
    grid = -(-m.rows // 8)
    return shapes(m).agg(((F.lit(2 * (grid + 1) * 32) + F.count("*") * 64) / F.sum("nnz")).alias("bits_per_nnz"))


def mixedness(s: DataFrame, dense_from: float = 0.2, cells: int = 32) -> DataFrame:
    """One row: block rows whose average fill is dense, entries in tiles of the other kind, and fill percentiles."""
    tile_dense = F.col("nnz") / F.lit(float(cells)) >= dense_from
    r = s.groupBy("br").agg(F.sum("nnz").alias("nnz"), (F.sum("nnz") / (F.count("*") * F.lit(float(cells)))).alias("fill"), F.sum(F.when(tile_dense, F.col("nnz")).otherwise(0)).alias("dense_nnz"))
    other = F.when(F.col("fill") >= dense_from, F.col("nnz") - F.col("dense_nnz")).otherwise(F.col("dense_nnz"))
    return r.agg(F.count("*").alias("block_rows"), F.count_if(F.col("fill") >= dense_from).alias("dense_rows"), (F.sum(other) * 100.0 / F.sum("nnz")).alias("misplaced_pct"), *[F.expr(f"percentile(fill, {q})").alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


# --- values ---------------------------------------------------------------------------------------------


def value_stats(m: Matrix, cap: int = 16) -> DataFrame:
    distinct = distinct_upto(F.col("value"), cap)
    return m.entries.agg(
        F.count_if(F.col("value") == 0).alias("zeros"), F.bool_and(F.col("value") == 1).alias("all_one"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("is_binary"), F.bool_and(F.col("value").isin(-1.0, 0.0, 1.0)).alias("sign_only"),
        F.least(distinct, F.lit(cap)).alias("distinct_capped"), (distinct > cap).alias("overflow"), F.min("value").alias("low"), F.max("value").alias("high"),
    )


def histogram(m: Matrix) -> DataFrame:
    return m.entries.groupBy("value").agg(F.count("*").alias("n"))


def entropy(m: Matrix) -> DataFrame:
    """One row: bits of the exact values' distribution."""
    t = histogram(m).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return t.select((F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def magnitude_bin(v: Column) -> Column:
    """0 for zero, 17 for no number, else 1 to 16 by the binary exponent in steps of 8."""
    e = F.floor(F.log2(F.abs(v))) + 64
    step = F.when(e >= 0, F.floor(e / 8)).otherwise(F.ceil(e / 8))
    return F.when(v == 0, 0).when(F.isnan(v) | (F.abs(v) == float("inf")), 17).otherwise(F.greatest(F.lit(0), F.least(F.lit(15), step)) + 1).cast("int")


def magnitude_histogram(m: Matrix) -> DataFrame:
    return m.entries.groupBy(magnitude_bin(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def magnitude_entropy(m: Matrix) -> DataFrame:
    """One row: bits of the distribution over the magnitude bins; null without entries."""
    t = magnitude_histogram(m).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return t.select((F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def sorted_unique(m: Matrix, cap: int) -> DataFrame:
    return m.entries.select("value").distinct().orderBy("value").limit(cap + 1)


def concentration(m: Matrix, tops: tuple[int, ...] = (1, 16, 64, 256, 1024)) -> DataFrame:
    """One row: distinct values and the share of entries, in per cent, that the commonest hold. Ranks are found by
    counting counts, so no task sees all values."""
    h = histogram(m).groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = h.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))
    held = lambda t: F.sum(F.greatest(F.lit(0), F.least(F.col("k"), F.lit(t) - F.col("before"))) * F.col("n"))
    return ranked.agg(F.sum("k").alias("distinct_values"), *[(held(t) * 100.0 / F.sum(F.col("n") * F.col("k"))).alias(f"top{t}") for t in tops])


def tile_dictionaries(m: Matrix, br: int = 8, bc: int = 4) -> DataFrame:
    """One row: how few distinct values tiles hold, and local against global dictionary bytes."""
    t = m.entries.groupBy(F.expr(f"row DIV {br}").alias("br"), F.expr(f"col DIV {bc}").alias("bc")).agg(F.count_distinct("value").alias("u"), F.count("*").alias("n"))
    local = t.agg(F.count("*").alias("blocks"), F.count_if(F.col("u") == 1).alias("const"), F.count_if(F.col("u") <= 4).alias("le4"), F.sum("u").alias("su"), F.sum(F.col("u") * 8 + F.col("n")).alias("local_bytes"), F.sum("n").alias("nnz"))
    g = m.entries.agg(F.count_distinct("value").alias("global_u"))
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("global_u"), F.lit(2)))))
    return local.join(g).select(
        "blocks", (F.col("const") * 100.0 / F.col("blocks")).alias("const_pct"), (F.col("le4") * 100.0 / F.col("blocks")).alias("le4_pct"), "global_u", (F.col("su") / F.greatest(F.col("global_u"), F.lit(1))).alias("locality"),
        (F.col("local_bytes") * 100.0 / (F.col("nnz") * 8)).alias("local_pct"), ((F.col("global_u") * 8 + F.col("nnz") * bits / 8.0) * 100.0 / (F.col("nnz") * 8)).alias("global_pct"),
    )
