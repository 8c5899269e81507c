import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaik.matrix import Matrix
from mosaik.operators import codecs, solvers
from mosaik.queries import studies
from mosaik.sources.tables import banded_spd, input_vector, order_graph, supplier_graph


def test_cg_iterations_ends_by_its_tolerances(spark, sf_dir):
    got = [r.relative_residual for r in studies.QUERIES["cg_iterations"](spark, sf_dir).orderBy("step").collect()]
    assert got[-1] <= min(solvers.TOLERANCES) < got[-2]


def test_refined_and_flexible_reach_the_solution(spark):
    m = banded_spd(spark, 6, 1, 2.0)
    m = m.with_entries(solvers.cut(m.entries))
    product, x = solvers.times(m), input_vector(spark, 6)
    b = solvers.cut(product(x))
    want = [r.val for r in x.orderBy("idx").collect()]
    for curve in (solvers.refined(m, product, b, inner=6, outer=5), solvers.flexible(m, product, b, inner=3, most=9)):
        assert curve.ended == "converged" and curve.residuals[-1] <= 1e-8
        assert all(abs(r.val - w) < 1e-6 for r, w in zip(curve.solution.orderBy("idx").collect(), want, strict=True))


def dense(m):
    a = np.zeros((m.rows, m.cols))
    for r in m.entries.collect():
        a[r["row"], r["col"]] += r["value"]
    return a


def dense_steps(a, b, steps):
    x, r, p = np.zeros_like(b), b, b
    for _ in range(steps):
        ap = a @ p
        if not p @ ap > 0:
            break
        alpha = r @ r / (p @ ap)
        x, after = x + alpha * p, r - alpha * ap
        if np.linalg.norm(after) <= solvers.ENOUGH * np.linalg.norm(b):
            break
        p, r = after + (after @ after) / (r @ r) * p, after
    return x


def dense_refined(low, a, b):
    x, out = np.zeros_like(b), []
    while not out or out[-1] > 1e-8:
        r = b - a @ x
        out.append(np.linalg.norm(r) / np.linalg.norm(b))
        x = x + dense_steps(low, r, 20)
    return out


def dense_flexible(low, a, b):
    r, out = b, []
    z = dense_steps(low, r, 5)
    p, rz = z, r @ z
    while not out or out[-1] > 1e-8:
        ap = a @ p
        after = r - rz / (p @ ap) * ap
        out.append(np.linalg.norm(after) / np.linalg.norm(b))
        z = dense_steps(low, after, 5)
        p, r = z + max(0.0, z @ (after - r) / rz) * p, after
        rz = r @ z
    return out


@pytest.mark.parametrize("name, plain", [("iterative_refinement", dense_refined), ("flexible_cg", dense_flexible)])
def test_queries_with_coarse_products_equal_numpy(spark, sf_dir, name, plain):
    m = supplier_graph(spark, sf_dir)
    a, low = dense(m), dense(codecs.bfp8(m))
    assert (a == a.T).all() and (low != a).any()
    got = [r.relative_residual for r in studies.QUERIES[name](spark, sf_dir).orderBy("step").collect()]
    want = plain(low, a, a @ (((np.arange(m.rows) % 17) - 8) * 0.125))
    assert len(got) > 1 and np.allclose(got, want, rtol=1e-4, atol=1e-9)


def dense_cg(a, b, steps, start=0.0):
    """Plain conjugate gradients: relative residuals of the recurrence, and the solution."""
    x = np.full(len(b), start)
    r = b - a @ x
    p, out = r.copy(), []
    for _ in range(steps):
        ap = a @ p
        alpha = r @ r / (p @ ap)
        x, after = x + alpha * p, r - alpha * ap
        out.append(np.linalg.norm(after) / np.linalg.norm(b))
        p, r = after + (after @ after) / (r @ r) * p, after
    return out, x


@pytest.mark.parametrize("start, sent", [(0.0, True), (0.5, False)])
def test_one_pass_steps_equal_plain_ones(spark, sf_dir, monkeypatch, start, sent):
    m = order_graph(spark, sf_dir)
    if not sent:
        monkeypatch.setattr(solvers, "BROADCAST_ENTRIES", 10)
    a = np.zeros((m.rows, m.cols))
    for r in m.entries.collect():
        a[r["row"], r["col"]] += r["value"]
    assert (a == a.T).all() and m.rows >= 1500
    x = input_vector(spark, m.rows)
    b = np.array([r.val for r in x.orderBy("idx").collect()])
    tables = len(spark.catalog.listTables())
    curve = solvers.recurrent(m, x, most=5, stop=0.0, start=start)
    want, solution = dense_cg(a, b, 5, start)
    assert np.allclose(curve.residuals, want, rtol=1e-9, atol=1e-12)
    assert np.allclose([r.val for r in curve.solution.orderBy("idx").collect()], solution, rtol=1e-9, atol=1e-12)
    assert len(spark.catalog.listTables()) == tables


def test_one_pass_steps_end(spark):
    e = spark.createDataFrame([(i, i, 2.0) for i in range(8)], "row long, col long, value double")
    x = input_vector(spark, 8)
    assert solvers.recurrent(Matrix(e, 8, 8), x).ended == "converged"
    assert solvers.recurrent(Matrix(e.selectExpr("row", "col", "-value AS value"), 8, 8), x).ended == "breakdown"
    assert solvers.recurrent(Matrix(e, 8, 8), x.selectExpr("idx", "0.0D AS val")).residuals == []


def test_a_step_shuffles_no_matrix(spark, sf_dir, capsys):
    m = order_graph(spark, sf_dir)
    with solvers._tables(spark) as make:
        a = make(m.entries.repartition("row"), "row")
        v = make(input_vector(spark, m.rows).repartition("idx"), "idx")
        w = a.join(F.broadcast(v), F.col("col") == F.col("idx")).groupBy("row").agg(F.sum("value").alias("w"))
        w.join(v.select(F.col("idx").alias("i")), F.col("row") == F.col("i")).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
