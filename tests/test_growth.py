"""Steps whose cost or result has to hold as tables grow."""

import pytest
from pyspark.sql import functions as F

from mosaik.functions import rounding
from mosaik.matrix import Matrix
from mosaik.operators import solvers, study, tiles
from mosaik.queries import studies
from mosaik.queries.parts import parts_by_tile
from mosaik.sources import tables as T


def test_the_gain_of_int8_is_over_four_shuffles(spark, sf_dir):
    got = studies.QUERIES["coreg_int8_gain"](spark, sf_dir).first()
    four = study.shuffled_gain(T.embedding_matrix(spark, sf_dir), 127, 4).first()
    assert (got.null_l1, got.gain) == (pytest.approx(four.null_l1, abs=1e-9), pytest.approx(four.gain, abs=1e-9))
    assert "range(1, 5)" in studies.SQL["coreg_int8_gain"]


def plain_permuted(x, n, seed):
    h = lambda v: (lambda y: y ^ (y >> 16))((v % 2147483648 * 2654435761 + 1013904223) % 4294967296)
    for i in range(study.ROUNDS):
        other = (h(h(seed * 1000003 + i)) % n - x) % n
        x = other if h(max(x, other) + seed * 7919 + i * 104729) >> 15 & 1 else x
    return x


@pytest.mark.parametrize("n", [1, 17, 5_000_000_000])
def test_permutations_work_on_batches_and_equal_their_formula(spark, n):
    t = spark.range(max(0, n - 40), n).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(3))).alias("seed"))
    moved = t.withColumn("at", study.permuted(F.col("k"), n, F.col("seed"), 3))
    assert all(r.at == plain_permuted(r.k, n, r.seed) for r in moved.collect())
    assert "ArrowEvalPython" in moved._jdf.queryExecution().executedPlan().toString()  # not a step of an interpreter for each row and round


def test_exponents_next_to_powers_of_two(spark):
    k = spark.range(-126, 128).select(F.col("id").cast("int").alias("k"), F.pow(F.lit(2.0), F.col("id").cast("double")).alias("p"))
    each = k.select("k", F.explode(F.array(*[F.col("p") * f for f in (1, 1 + 2.0**-23, 2 - 2.0**-23)])).alias("a"))
    assert each.filter(rounding.exponent(F.col("a")) != F.col("k")).count() == 0


def test_entries_of_many_lines_are_dealt_by_number(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, T.part_by_supplier(spark, sf_dir).entries.collect()))
    monkeypatch.setattr(T, "TASK_ROWS", 100)
    n = -(-T.table(spark, sf_dir, "lineitem").count() // 100)
    got = T.part_by_supplier(spark, sf_dir).entries
    assert got.rdd.getNumPartitions() == n
    assert sorted(map(tuple, got.collect())) == want


def test_tiles_of_many_lines_are_made_where_lines_are_dealt(spark, sf_dir, monkeypatch):
    got = lambda m: sorted(map(str, tiles.tiled(m).collect()))
    want = got(T.part_by_supplier(spark, sf_dir))
    assert got(parts_by_tile(spark, sf_dir)) == want
    monkeypatch.setattr(T, "TASK_ROWS", 100)
    m = parts_by_tile(spark, sf_dir)
    t = tiles.tiled(m)
    assert t.rdd.getNumPartitions() == -(-T.table(spark, sf_dir, "lineitem").count() // 100)
    assert got(m) == want
    plan = tiles.tile_violations(t, m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("FileScan") == 1  # lines by tile, and one row of a task to the sums


def test_all_rules_of_tiles_are_judged_in_one_pass(spark):
    rows = [(0, 0, 3, [1.0, 2.0])] * 2 + [(0, 1, 3, [1.0]), (1, 0, 1, [0.0]), (2, 0, 1, [1.0]), (0, -1, 1, [0.0])]
    t = spark.createDataFrame([(*r, 1) for r in rows], "br long, bc long, bitmap long, values array<double>, nnz long")
    got = {r.rule: r.n for r in tiles.tile_violations(t, Matrix(None, 16, 8)).collect()}
    assert got == {"popcount": 1, "grid": 2, "stored zero": 2, "duplicate": 1}
    assert tiles.tile_violations(t.limit(0), Matrix(None, 16, 8)).count() == 0


def test_windows_are_those_that_cover_an_entry(spark):
    at = [(r, c) for r in range(0, 70, 3) for c in range(0, 19, 2)]
    m = Matrix(spark.createDataFrame([(r, c, 1.0 + r) for r, c in at], "row long, col long, value double"), 70, 19)
    want = {}
    for r, c in at:
        for i in (0, 1):
            for j in (0, 1):
                corner = (r // 8 - i) * 8, (c // 4 - j) * 4
                if min(corner) >= 0:
                    want.setdefault(corner, []).append((r - corner[0], c - corner[1], 1.0 + r))
    assert {(r.top, r.left): r.n for r in study.windows(m, 16, 8).collect()} == {k: len(v) for k, v in want.items()}
    chosen = spark.createDataFrame([(8, 4), (64, 16), (-8, 0), (4, 4)], 'top long, left long')
    got = {}
    for x in study.window_of(m, 16, 8, chosen).collect():
        got.setdefault((x.top, x.left), []).append((x["row"], x["col"], x.value))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(want[k]) for k in ((8, 4), (64, 16))}
    plan = study.windows(m, 16, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # entries are counted by cells before these are dealt to windows


def test_a_coarse_matrix_is_written_once(spark, monkeypatch):
    m = T.banded_spd(spark, 12, 1, 2.0)
    m = m.with_entries(solvers.cut(m.entries))
    b, made, plain = solvers.cut(T.input_vector(spark, 12)), [], solvers.bucketed
    monkeypatch.setattr(solvers, "bucketed", lambda low: made.append(low) or plain(low))
    assert len(solvers.refined(m, solvers.times(m), b, inner=2, outer=3).residuals) == 3
    assert len(made) == 1
