"""Queries on normalising, tiling, splitting and multiplying."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coo, metrics, profile, split, tiles
from ..operators.spmv import spmv, spmv_parts, spmv_two_pass
from ..sources.tables import banded_spd, deterministic_vector, input_vector, legacy_vector, order_by_part, probe_vector, shifted_laplacian, table
from .parts import COLS, HASH, ORDERS, ROWS, TILES, E, Query, X, parts, parts_by_tile, spmv_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Line items as entries that repeat positions, 1-based."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") + 1).alias("row"), (F.col("l_suppkey") + 1).alias("col"), F.col("l_quantity").alias("value"))


def _x(spark: SparkSession, m) -> DataFrame:
    return input_vector(spark, m.cols)


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))


RAW = "raw AS (SELECT l_partkey AS r, l_suppkey AS c, l_quantity AS v FROM lineitem)"
SQUARE = "sq AS (SELECT l_partkey % 64 AS r, l_suppkey % 64 AS c, l_quantity - 25 AS v FROM lineitem)"


def _square(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col"), (F.col("l_quantity") - 25).alias("value"))


@query(f"WITH {RAW} SELECT r, c, sum(v) AS v FROM raw GROUP BY ALL HAVING sum(v) <> 0")
def coo_normalize(spark, d):
    return _named(coo.normalized(coo.zero_based(_raw(spark, d))))


@query(f"WITH {SQUARE}, m AS (SELECT * FROM sq UNION ALL SELECT c, r, v FROM sq WHERE r <> c) SELECT r, c, sum(v) AS v FROM m GROUP BY ALL HAVING sum(v) <> 0")
def coo_mirror_symmetric(spark, d):
    return _named(coo.normalized(_square(spark, d), "symmetric"))


@query(f"WITH {SQUARE}, m AS (SELECT * FROM sq UNION ALL SELECT c, r, -v FROM sq WHERE r <> c) SELECT r, c, sum(v) AS v FROM m GROUP BY ALL HAVING sum(v) <> 0")
def coo_mirror_skew(spark, d):
    return _named(coo.normalized(_square(spark, d), "skew-symmetric"))


@query("SELECT l_orderkey AS r, l_linenumber::BIGINT AS c, l_discount AS v FROM lineitem WHERE l_discount <> 0")
def coo_drop_zeros(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("col"), F.col("l_discount").alias("value"))
    return _named(coo.without_zeros(e))


@query("SELECT event_id AS r, value AS v FROM events WHERE NOT isnan(value) AND abs(value) < 'Infinity'::DOUBLE AND value <> 0")
def coo_finite_nonzero(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row"), F.lit(0).cast("long").alias("col"), "value")
    return coo.finite_nonzero(e).select(F.col("row").alias("r"), F.col("value").alias("v"))


@query(f"WITH {SQUARE}, m AS (SELECT * FROM sq UNION ALL SELECT c, r, v FROM sq WHERE r <> c), n AS (SELECT count(*) AS nnz FROM (SELECT r, c FROM m GROUP BY ALL HAVING sum(v) <> 0)) SELECT (SELECT count(*) FROM sq) AS stored, (SELECT count(*) FROM m) AS expanded, nnz, (SELECT count(*) FROM m) - nnz AS coalesced FROM n")
def coo_load_counters(spark, d):
    return coo.load_counters(_square(spark, d), "symmetric")


@query(f'WITH {E}, n AS (SELECT i AS r, count(e.r) AS nnz FROM range({ROWS}) q(i) LEFT JOIN e ON e.r = i GROUP BY i) SELECT r AS "row", nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr FROM n')
def coo_row_ptr(spark, d):
    return coo.row_pointers(parts(spark, d))


@query(f"WITH {E} SELECT 'stored zero' AS rule, count(*) AS n FROM e WHERE v = 0 HAVING count(*) > 0")
def coo_validate(spark, d):
    return coo.violations(parts(spark, d))


@query(f"WITH {E}, {TILES} SELECT * FROM t")
def tile_8x4(spark, d):
    return tiles.shapes(parts(spark, d))


@query(f"WITH {E}, l AS (SELECT r // 8 AS br, c // 4 AS bc, list(v ORDER BY (r % 8) * 4 + c % 4) AS l FROM e GROUP BY ALL) SELECT br, bc, array_to_string(list_transform(l, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS cells FROM l")
def tile_values(spark, d):
    t = tiles.tiled(parts_by_tile(spark, d))
    return t.select("br", "bc", F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("cells"))


@query(f"WITH {E} SELECT r // 2 AS br, c // 2 AS bc, CAST(bit_or(CAST(1 AS BIGINT) << CAST((r % 2) * 2 + c % 2 AS INTEGER)) AS BIGINT) AS bitmap, count(*) AS nnz FROM e GROUP BY ALL")
def tile_2x2(spark, d):
    return tiles.shapes(parts(spark, d), 2, 2)


@query(f"WITH {E}, b AS (SELECT r // 8 AS br, c // 8 AS bc, CAST((r % 8) * 8 + c % 8 AS INTEGER) AS b FROM e) SELECT br, bc, b // 32 AS word, CAST(bit_or(CAST(1 AS BIGINT) << (b % 32)) AS BIGINT) AS bitmap, count(*) AS nnz FROM b GROUP BY ALL")
def tile_8x8_multiword(spark, d):
    return tiles.tiled_words(parts(spark, d), 8, 8)


_PACKED = "CASE WHEN bitmap >= 2147483648 THEN (bitmap - 4294967296) * 4294967296 + bc ELSE bitmap * 4294967296 + bc END"


@query(f"WITH {E}, {TILES} SELECT br, bc, {_PACKED} AS word FROM t")
def tile_pack_word(spark, d):
    return tiles.pack(tiles.shapes(parts(spark, d))).select("br", "bc", "word")


@query(f"WITH {E}, {TILES} SELECT br, bitmap AS u_bitmap, CAST(0 AS BIGINT) AS u_flag, bc AS u_bc FROM t")
def tile_unpack_word(spark, d):
    return tiles.unpack(tiles.pack(tiles.shapes(parts(spark, d)))).select("br", "u_bitmap", "u_flag", "u_bc")


@query(f"WITH {E}, {TILES} SELECT br, bc, CAST(1 AS BIGINT) AS marked, CAST(0 AS BIGINT) AS cleared FROM t")
def tile_flags(spark, d):
    t = tiles.pack(tiles.shapes(parts(spark, d)))
    a = tiles.unpack(t.withColumn("word", tiles.flagged(F.col("word")))).withColumnRenamed("u_flag", "marked").drop("u_bc", "u_bitmap")
    return tiles.unpack(a.withColumn("word", tiles.unflagged(F.col("word")))).select("br", "bc", "marked", F.col("u_flag").alias("cleared"))


@query(f"WITH {E} SELECT r, c, v FROM e")
def tile_decode(spark, d):
    return _named(tiles.decoded(tiles.tiled(parts_by_tile(spark, d))))


@query(f"WITH {E}, {TILES} SELECT br, bc, bitmap, nnz, CAST(coalesce(sum(bit_count(bitmap)) OVER (ORDER BY br, bc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS val_ptr FROM t")
def tile_val_ptr(spark, d):
    return tiles.value_pointers(tiles.shapes(parts(spark, d)))


@query(f"WITH {E} SELECT 'popcount' AS rule, count(*) AS n FROM e WHERE false HAVING count(*) > 0")
def tile_validate(spark, d):
    m = parts_by_tile(spark, d)
    return tiles.tile_violations(tiles.tiled(m), m)


SPLIT = f"{TILES}, s AS (SELECT *, nnz <= 32 AND nnz < 10 AS residual, nnz <= 32 AND nnz >= 10 AS skipped FROM t)"
RESIDUAL = "(SELECT e.* FROM e JOIN s ON r // 8 = br AND c // 4 = bc WHERE residual)"


def _split(spark, d):
    m = parts(spark, d)
    s = split.marked(tiles.shapes(m), 32, split.Costs())
    return m, s, *split.parted(m, s)


@query(f"WITH {E}, {SPLIT} SELECT r // 8 AS br, (c // 4) * 32 + (r % 8) * 4 + c % 4 AS packed, v AS value FROM {RESIDUAL}")
def blockrow_coo(spark, d):
    return tiles.blockrow_coo(_split(spark, d)[3])


@query(
    f"WITH {E}, {SPLIT}, k AS (SELECT r, c, v, row_number() OVER (PARTITION BY r ORDER BY c) - 1 AS k, r // 32 AS sl FROM {RESIDUAL}), w AS (SELECT sl, max(k) + 1 AS w FROM k GROUP BY sl), "
    f"g AS (SELECT sl, kk, lane FROM w, range(w.w) a(kk), range(32) b(lane) WHERE sl * 32 + lane < {ROWS}) "
    "SELECT g.sl AS slice, CAST(kk AS INTEGER) AS k, CAST(lane AS INTEGER) AS lane, coalesce(c, -1) AS col, coalesce(v, 0) AS value FROM g LEFT JOIN k ON k.sl = g.sl AND k.k = kk AND k.r % 32 = lane"
)
def sliced_sell(spark, d):
    m, _, _, residual = _split(spark, d)
    return tiles.sliced(m.with_entries(residual), 32)


@query(f"WITH {E}, {TILES} SELECT br, bc, nnz, nnz <= 8 AS residual FROM t")
def split_threshold(spark, d):
    return split.marked(tiles.shapes(parts(spark, d)), 8).select("br", "bc", "nnz", "residual")


@query(f"WITH {E}, {SPLIT} SELECT br, bc, nnz, residual, skipped AS cost_skipped FROM s")
def split_cost_gated(spark, d):
    return _split(spark, d)[1].select("br", "bc", "nnz", "residual", "cost_skipped")


@query(
    f"WITH {E}, {SPLIT}, a AS (SELECT count(*) AS full_blocks, count(*) FILTER (NOT residual) AS kept_blocks, count(*) FILTER (residual) AS residual_blocks, CAST(coalesce(sum(nnz) FILTER (NOT residual), 0) AS BIGINT) AS kept_nnz, "
    "CAST(coalesce(sum(nnz) FILTER (residual), 0) AS BIGINT) AS residual_nnz, count(*) FILTER (skipped) AS cost_skipped_blocks, CAST(coalesce(sum(nnz) FILTER (skipped), 0) AS BIGINT) AS cost_skipped_nnz FROM s), "
    f"b AS (SELECT *, (({ROWS} + 7) // 8 + 1 + 3 * full_blocks + 1) * 32 AS full_bits, (({ROWS} + 7) // 8 + 1 + 3 * kept_blocks + 1) * 32 AS kept_bits, ({ROWS} + 1 + residual_nnz) * 32 AS residual_bits FROM a), "
    "z AS (SELECT *, kept_bits + residual_bits AS split_bits FROM b) SELECT *, split_bits / full_bits AS split_vs_full, residual_blocks / full_blocks AS residual_block_ratio, residual_bits / split_bits AS residual_position_ratio, "
    "residual_bits / full_bits AS residual_position_vs_full, residual_nnz / (kept_nnz + residual_nnz) AS residual_nnz_ratio FROM z"
)
def split_stats(spark, d):
    m, s, _, _ = _split(spark, d)
    return split.totals(s, -(-m.rows // 8), m.rows)


ITEMS = f"{TILES}, p AS (SELECT *, CAST(coalesce(sum(nnz) OVER (ORDER BY br, bc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS val_ptr, count(*) OVER (PARTITION BY br) AS n, row_number() OVER (PARTITION BY br ORDER BY bc) - 1 AS rn FROM t), w AS (SELECT br, CASE WHEN n > 8 THEN rn // 8 ELSE 0 END AS item, CAST(min(rn) AS INTEGER) AS first, count(*) AS blocks, min(val_ptr) AS value_begin, max(n) > 8 AS shared FROM p GROUP BY ALL)"


@query(f"WITH {E}, {ITEMS} SELECT * FROM w")
def work_items(spark, d):
    return split.work_items(tiles.value_pointers(tiles.shapes(parts(spark, d))), 8, 8)


@query(f"WITH {E}, {ITEMS} SELECT i AS br, coalesce(item, 0) AS item, coalesce(first, 0) AS first, coalesce(blocks, 0) AS blocks, value_begin, coalesce(shared, false) AS shared FROM range(({ROWS} + 7) // 8) q(i) LEFT JOIN w ON br = i")
def work_items_with_empty(spark, d):
    m = parts(spark, d)
    return split.work_items_with_empty(tiles.value_pointers(tiles.shapes(m)), -(-m.rows // 8), 8, 8)


@query(f"WITH {E}, k AS (SELECT r, count(*) OVER (PARTITION BY r) AS n, row_number() OVER (PARTITION BY r ORDER BY c) - 1 AS rn FROM e) SELECT r AS \"row\", rn // 16 AS chunk, count(*) AS n FROM k WHERE n > 20 GROUP BY ALL")
def long_row_chunks(spark, d):
    return split.long_row_chunks(parts(spark, d).entries, 20, 16)


# --- products -------------------------------------------------------------------------------------------


@query(spmv_sql(E))
def spmv_csr(spark, d):
    m = parts(spark, d)
    return spmv(m, _x(spark, m))


@query(spmv_sql(E))
def spmv_bitbsr(spark, d):
    m = parts_by_tile(spark, d)
    return spmv(m.with_entries(tiles.decoded(tiles.tiled(m))), _x(spark, m))


@query(spmv_sql(E))
def spmv_split(spark, d):
    m, _, kept, residual = _split(spark, d)
    return spmv_parts(m, [tiles.decoded(tiles.tiled(m.with_entries(kept))), residual], _x(spark, m))


@query(spmv_sql(E))
def spmv_two_pass_hybrid(spark, d):
    m, _, kept, residual = _split(spark, d)
    return spmv_two_pass(m, [kept, residual], _x(spark, m))


@query(spmv_sql(f"{E.replace('e AS', 'e0 AS', 1)}, {SPLIT.replace('FROM e GROUP', 'FROM e0 GROUP')}, e AS (SELECT e0.* FROM e0 JOIN s ON r // 8 = br AND c // 4 = bc WHERE residual)"))
def spmv_blockrow_coo(spark, d):
    m, _, _, residual = _split(spark, d)
    return spmv(m.with_entries(tiles.from_blockrow_coo(tiles.blockrow_coo(residual))), _x(spark, m))


@query(spmv_sql(f"{E.replace('e AS', 'e0 AS', 1)}, {SPLIT.replace('FROM e GROUP', 'FROM e0 GROUP')}, e AS (SELECT e0.* FROM e0 JOIN s ON r // 8 = br AND c // 4 = bc WHERE residual)"))
def spmv_sell(spark, d):
    m, _, _, residual = _split(spark, d)
    return spmv(m.with_entries(tiles.from_sliced(tiles.sliced(m.with_entries(residual), 32), 32)), _x(spark, m))


@query(spmv_sql(ORDERS, X.replace(COLS, ROWS), "(SELECT max(o_orderkey) + 1 FROM orders)", 6))
def spmv_orders(spark, d):
    m = order_by_part(spark, d)
    return spmv(m, _x(spark, m)).select("row", (F.round("y", 6) + 0).alias("y"))


# --- vectors and generators, as long as there are parts ---------------------------------------------------


@query(f"SELECT i AS idx, ((i % 17) - 8) * CAST(0.125 AS DOUBLE) AS val FROM range({ROWS}) q(i)")
def x_input(spark, d):
    return input_vector(spark, parts(spark, d).rows)


@query(f"SELECT i AS idx, ((i % 17) + 1) / 17.0::DOUBLE AS val FROM range({ROWS}) q(i)")
def x_deterministic(spark, d):
    return deterministic_vector(spark, parts(spark, d).rows)


@query(f"SELECT i AS idx, 1.0::DOUBLE + (i % 7) * 0.1::DOUBLE AS val FROM range({ROWS}) q(i)")
def x_legacy(spark, d):
    return legacy_vector(spark, parts(spark, d).rows)


@query(f"SELECT i AS idx, CASE WHEN h % 2001 = 1000 THEN 1 ELSE h % 2001 - 1000 END / 257.0::DOUBLE AS val FROM (SELECT i, {HASH.format('i')} AS h FROM range({ROWS}) q(i))")
def x_probe(spark, d):
    return probe_vector(spark, parts(spark, d).rows)


@query(f"WITH {E}, x AS (SELECT i AS idx, CASE WHEN h % 2001 = 1000 THEN 1 ELSE h % 2001 - 1000 END / 257.0::DOUBLE AS val FROM (SELECT i, {HASH.format('i')} AS h FROM range({COLS}) q(i))), "
       "s AS (SELECT r, sum(v * val) AS y FROM e JOIN x ON c = idx GROUP BY r) "
       f"SELECT i AS \"row\", round(coalesce(y, 0), 9) + 0 AS y FROM range({ROWS}) q(i) LEFT JOIN s ON r = i")
def spmv_probe(spark, d):
    m = parts(spark, d)
    return spmv(m, probe_vector(spark, m.cols)).select("row", (F.round("y", 9) + 0).alias("y"))


#: Off-diagonals of the generated matrices.
BAND = 5


def _spd_sql(value: str, shift: str) -> str:
    pairs = f"p AS (SELECT i, j, {value} AS v FROM (SELECT i, i + k AS j, {HASH.format('i * 4096 + i + k')} AS h FROM range({ROWS}) a(i), range(1, {BAND + 1}) b(k) WHERE i + k < {ROWS}))"
    return (
        f"WITH {pairs}, b AS (SELECT i AS r, j AS c, v FROM p WHERE v <> 0 UNION ALL SELECT j, i, v FROM p WHERE v <> 0), s AS (SELECT r, sum(abs(v)) AS s FROM b GROUP BY r) "
        f"SELECT * FROM b UNION ALL SELECT i AS r, i AS c, coalesce(s, 0) + {shift}::DOUBLE AS v FROM range({ROWS}) q(i) LEFT JOIN s ON r = i"
    )


@query(_spd_sql("(h % 2001 - 1000) / 1024.0::DOUBLE", "0.5"))
def synth_spd(spark, d):
    return _named(banded_spd(spark, parts(spark, d).rows, BAND, 0.5).entries)


@query(_spd_sql("-((h % 1024) / 1024.0::DOUBLE + 0.125::DOUBLE)", "0.25"))
def synth_laplacian(spark, d):
    return _named(shifted_laplacian(spark, parts(spark, d).rows, BAND, 0.25).entries)


# --- storage and fill ------------------------------------------------------------------------------------


@query(
    f"WITH {E}, {TILES}, a AS (SELECT count(*) AS blocks, CAST(sum(nnz) AS BIGINT) AS nnz FROM t), b AS (SELECT *, nnz * 32 AS csr_index_bits, (nnz + {ROWS} + 1) * 32 AS csr_bits, (({ROWS} + 7) // 8 + 1 + blocks * 3 + 1) * 32 AS tile_bits FROM a) "
    "SELECT *, nnz / blocks AS avg_nnz_per_block, csr_bits / nnz AS csr_bits_per_nnz, tile_bits / nnz AS tile_bits_per_nnz, tile_bits / csr_index_bits AS compression_ratio, tile_bits / csr_bits AS position_ratio FROM b"
)
def storage_stats(spark, d):
    return profile.storage(parts(spark, d))


@query(f"WITH {E}, {TILES} SELECT count(*) AS blocks, sum(nnz) / (count(*) * 32) AS fill_ratio, count(*) FILTER (nnz <= 8) AS le25, count(*) FILTER (nnz <= 16) AS le50, count(*) FILTER (nnz = 32) AS \"full\" FROM t")
def tile_fill_profile(spark, d):
    return profile.fill(tiles.shapes(parts(spark, d)))


@query(
    f"WITH {E}, {TILES}, n AS (SELECT i AS br, count(t.br) AS n FROM range(({ROWS} + 7) // 8) q(i) LEFT JOIN t ON t.br = i GROUP BY i), a AS (SELECT count(*) FILTER (n = 0) AS empty_rows, avg(n) AS avg, quantile_disc(n, 0.5) AS p50, "
    "quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.99) AS p99, max(n) AS max FROM n) SELECT *, p99 / avg AS p99_over_avg, max / avg AS max_over_avg FROM a"
)
def blockrow_imbalance(spark, d):
    m = parts(spark, d)
    return profile.imbalance(tiles.shapes(m), -(-m.rows // 8))


DELTAS = "g AS (SELECT br, count(*) AS n, max(bc) - min(bc) AS d FROM t GROUP BY br), cd AS (SELECT count(*) FILTER (d <= 255) AS u8_rows, count(*) FILTER (d <= 65535) AS u16_rows, max(d) AS max_delta, CAST(sum(CASE WHEN d <= 255 THEN least(n * 32, 32 + n * 8) ELSE n * 32 END) AS BIGINT) AS u8_bits, CAST(sum(CASE WHEN d <= 65535 THEN least(n * 32, 32 + n * 16) ELSE n * 32 END) AS BIGINT) AS u16_bits FROM g)"


@query(f"WITH {E}, {TILES}, {DELTAS} SELECT * FROM cd")
def col_delta_bits(spark, d):
    return profile.column_deltas(tiles.shapes(parts(spark, d)))


@query(
    f"WITH {E}, {TILES}, {DELTAS}, a AS (SELECT count(*) AS blocks, CAST(sum(nnz) AS BIGINT) AS nnz, count(DISTINCT br) AS active, any_value(u8_bits) AS u8, any_value(u16_bits) AS u16, 2 * (({ROWS} + 7) // 8 + 1) * 32 AS base FROM t, cd) "
    "SELECT blocks, nnz, base + blocks * 64 AS abs_bits, base + u8 + blocks * 32 AS u8_bits, base + u16 + blocks * 32 AS u16_bits, base + blocks * 32 + nnz * 5 + blocks * 6 AS local_abs_bits, base + u8 + nnz * 5 + blocks * 6 AS local_u8_bits, "
    "base + u16 + nnz * 5 + blocks * 6 AS local_u16_bits, (active + 1) * 64 + active * 32 AS active_abs_bits, (active + 1) * 64 + 32 + active * 8 AS active_u8_bits, (active + 1) * 64 + 32 + active * 16 AS active_u16_bits FROM a"
)
def position_bits(spark, d):
    return profile.position_bits(parts(spark, d))


@query(f"WITH {E}, {TILES} SELECT (2 * (({ROWS} + 7) // 8 + 1) * 32 + count(*) * 64) / sum(nnz) AS bits_per_nnz FROM t")
def device_position_bits(spark, d):
    return profile.device_position_bits(parts(spark, d))


@query(
    f"WITH {E}, {TILES}, g AS (SELECT br, sum(nnz) AS nnz, sum(nnz) / (count(*) * 32) AS fill, coalesce(sum(nnz) FILTER (nnz / 32 >= 0.2::DOUBLE), 0) AS dense FROM t GROUP BY br) SELECT count(*) AS block_rows, count(*) FILTER (fill >= 0.2::DOUBLE) AS dense_rows, "
    "round(sum(CASE WHEN fill >= 0.2::DOUBLE THEN nnz - dense ELSE dense END) * 100.0::DOUBLE / sum(nnz), 9) AS misplaced_pct, round(quantile_cont(fill, 0.1), 9) AS p10, round(quantile_cont(fill, 0.5), 9) AS p50, round(quantile_cont(fill, 0.9), 9) AS p90 FROM g"
)
def blockrow_mixedness(spark, d):
    r = profile.mixedness(tiles.shapes(parts(spark, d)))
    return r.withColumns({c: F.round(c, 9) for c in ("misplaced_pct", "p10", "p50", "p90")})


@query(f"WITH {E}, {X}, y AS (SELECT r, sum(v * val) AS a, sum(CAST(CAST(v * 1.001::DOUBLE AS FLOAT) AS DOUBLE) * val) AS b FROM e JOIN x ON c = idx GROUP BY r) SELECT round(max(abs(b - a)), 6) AS max_abs, round(max(abs(b - a) / greatest(abs(a), 1e-30)), 6) AS max_rel, round(max(abs(b - a)) / greatest(max(abs(a)), 1e-30), 9) AS global_rel FROM y WHERE a <> 0")
def err_compare(spark, d):
    m = parts(spark, d)
    x = _x(spark, m)
    a, b = spmv(m, x).filter("y <> 0"), spmv(m.with_value((F.col("value") * 1.001).cast("float")), x)
    return metrics.compared(a, b).select(F.round("max_abs", 6).alias("max_abs"), F.round("max_rel", 6).alias("max_rel"), F.round("global_rel", 9).alias("global_rel"))


@query(f"WITH {E}, {X}, y AS (SELECT r, sum(v * val) AS a, sum(CAST(CAST(v * 1.001::DOUBLE AS FLOAT) AS DOUBLE) * val) AS b FROM e JOIN x ON c = idx GROUP BY r) SELECT round(max(abs(b - a)) / (max(abs(a)) + 1e-30), 9) AS rel_maxrow, round(sqrt(sum((b - a) * (b - a))) / (sqrt(sum(a * a)) + 1e-30), 9) AS rel_l2 FROM y")
def err_maxrow_l2(spark, d):
    m = parts(spark, d)
    x = _x(spark, m)
    r = metrics.relative_norms(spmv(m, x), spmv(m.with_value((F.col("value") * 1.001).cast("float")), x))
    return r.select(F.round("rel_maxrow", 9).alias("rel_maxrow"), F.round("rel_l2", 9).alias("rel_l2"))


@query(f"""WITH {E}, {X}, y AS (SELECT r, sum(v * val) AS a, sum(CAST(CAST(v * (1 + pow(10, -(r % 13))) AS FLOAT) AS DOUBLE) * val) AS b FROM e JOIN x ON c = idx GROUP BY r),
m AS (SELECT r, max(abs(b - a)) AS max_abs, max(abs(b - a) / greatest(abs(a), 1e-30)) AS max_rel FROM y WHERE a <> 0 GROUP BY r)
SELECT r AS k, (max_abs <= 1e-9 OR max_rel <= 1e-10) AS exact_ok, max_rel <= 1e-2 AS lossy_ok FROM m""")
def gate_verify(spark, d):
    """Both gates for each row of a product, against one whose values are a tenth, a hundredth, ... too great and of single precision."""
    m = parts(spark, d)
    x = _x(spark, m)
    off = (F.col("value") * (1 + F.pow(F.lit(10.0), -(F.col("row") % 13)))).cast("float").cast("double")
    a, b = spmv(m, x).filter("y <> 0"), spmv(m.with_value(off), x).select(F.col("row").alias("k"), F.col("y").alias("z"))
    gap = F.abs(F.col("z") - F.col("y"))
    rel = gap / F.greatest(F.abs("y"), F.lit(1e-30))
    t = a.join(b, F.col("row") == F.col("k")).select("k", gap.alias("max_abs"), rel.alias("max_rel"), rel.alias("global_rel"))
    return t.select("k", metrics.exact_gate().alias("exact_ok"), metrics.lossy_gate().alias("lossy_ok"))
