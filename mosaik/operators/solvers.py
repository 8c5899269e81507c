"""Iterative solvers as driver loops over distributed vectors.

Vectors are (idx, val) tables; each step is one product, two scalar products and three updates. The vectors of
a step are written to the shared folder, which cuts the lineage and survives lost executors; the scalars are all
that reaches the driver. recurrent() writes the matrix once, in buckets, and moves nothing but one vector in a step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..sources.scratch import scratch
from .spmv import BROADCAST_ENTRIES, spmv

Product = Callable[[DataFrame], DataFrame]
TOLERANCES = (1e-2, 1e-3, 1e-6, 1e-8)
#: Where inner steps end before their number: a coarse matrix tells no more.
ENOUGH = 1e-6


@dataclass
class Curve:
    """How a solve went: the relative residual after each step."""

    residuals: list[float] = field(default_factory=list)
    ended: str = "maxiter"
    solution: DataFrame | None = None

    @property
    def floor(self) -> float:
        return min(self.residuals, default=float("inf"))

    def steps_to(self, tolerance: float) -> int | None:
        """The first step at or below the tolerance, from 1."""
        return next((k for k, r in enumerate(self.residuals, 1) if r <= tolerance), None)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: neither its lineage nor what was inferred of its columns goes on."""
    path = scratch(df.sparkSession, "vector")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def times(m: Matrix) -> Product:
    return lambda x: spmv(m, x).select(F.col("row").alias("idx"), F.col("y").alias("val"))


def dot(a: DataFrame, b: DataFrame) -> float:
    return a.alias("a").join(b.alias("b"), "idx").agg(F.sum(F.col("a.val") * F.col("b.val"))).first()[0] or 0.0


def norm(a: DataFrame) -> float:
    return (a.agg(F.sum(F.col("val") * F.col("val"))).first()[0] or 0.0) ** 0.5


def combined(a: DataFrame, b: DataFrame, how: Callable[[Column, Column], Column]) -> DataFrame:
    return a.alias("a").join(b.alias("b"), "idx").select("idx", how(F.col("a.val"), F.col("b.val")).alias("val"))


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha x + y."""
    return combined(x, y, lambda a, b: a * F.lit(alpha) + b)


def scaled(alpha: float, x: DataFrame) -> DataFrame:
    return x.select("idx", (F.col("val") * F.lit(alpha)).alias("val"))


def conjugate_gradient(product: Product, b: DataFrame, most: int = 5000, stop: float = 1e-12, patience: int = 200, exact: Product | None = None, tolerances: tuple[float, ...] = TOLERANCES) -> Curve:
    """Solve with product; residuals are those of exact, by default the same product, computed anew at each step.

    Ends at stop, when all tolerances are met, after patience steps without gain, when a direction has no
    positive curvature, or after most steps."""
    exact = exact or product
    size = norm(b) or 1.0
    x, r, p = cut(scaled(0.0, b)), b, cut(b)
    rr, curve, best, since = dot(r, r), Curve(), float("inf"), 0
    for _ in range(most):
        ap = product(p)
        curvature = dot(p, ap)
        if not curvature > 0:
            curve.ended = "breakdown"
            break
        alpha = rr / curvature
        x, r = cut(axpy(alpha, p, x)), cut(axpy(-alpha, ap, r))
        curve.residuals.append(norm(axpy(-1.0, exact(x), b)) / size)
        gain = curve.residuals[-1] < best
        best, since = min(best, curve.residuals[-1]), 0 if gain else since + 1
        if best <= stop or all(best <= t for t in tolerances):
            curve.ended = "converged"
            break
        if since >= patience:
            curve.ended = "stalled"
            break
        rr, before = dot(r, r), rr
        p = cut(axpy(rr / before, p, r))
    curve.solution = x
    return curve


def refined(low: Matrix, exact: Product, b: DataFrame, inner: int = 20, outer: int = 20, stop: float = 1e-8) -> Curve:
    """Iterative refinement: corrections by inner steps of recurrent() with a coarse matrix, residuals with the exact product."""
    size, x, curve = norm(b) or 1.0, cut(scaled(0.0, b)), Curve()
    with bucketed(low) as matrix:
        for _ in range(outer):
            r = cut(axpy(-1.0, exact(x), b))
            curve.residuals.append(norm(r) / size)
            if curve.residuals[-1] <= stop:
                curve.ended = "converged"
                break
            step = recurrent(low, r, inner, ENOUGH, matrix=matrix).solution
            x = cut(axpy(1.0, step, x))
    curve.solution = x
    return curve


def flexible(low: Matrix, exact: Product, b: DataFrame, inner: int = 5, most: int = 100, stop: float = 1e-8) -> Curve:
    """Conjugate gradients whose preconditioner is a few inner steps of recurrent() with a coarse matrix; Polak-Ribiere, beta >= 0."""
    size, x, r, curve = norm(b) or 1.0, cut(scaled(0.0, b)), b, Curve()
    with bucketed(low) as matrix:
        inside = lambda v: recurrent(low, v, inner, ENOUGH, matrix=matrix).solution
        z = inside(r)
        p, rz = z, dot(r, z)
        for _ in range(most):
            ap = cut(exact(p))
            curvature = dot(p, ap)
            if not curvature > 0:
                curve.ended = "breakdown"
                break
            alpha = rz / curvature
            x, after = cut(axpy(alpha, p, x)), cut(axpy(-alpha, ap, r))
            curve.residuals.append(norm(after) / size)
            if curve.residuals[-1] <= stop:
                curve.ended = "converged"
                break
            z = inside(after)
            beta = max(0.0, dot(z, axpy(-1.0, r, after)) / rz)
            r, p = after, cut(axpy(beta, p, z))
            rz = dot(r, z)
    curve.solution = x
    return curve


# --- one job for each step --------------------------------------------------------------------------------


@contextmanager
def _tables(spark, kept: int):
    """Managed tables with names of their own: make(df, key) writes df in buckets of key; all but the last ones kept are dropped, at the end all."""
    made: list[str] = []
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def make(df: DataFrame, key: str) -> DataFrame:
        made.append(f"mosaik_{uuid.uuid4().hex}")
        df.write.bucketBy(buckets, key).saveAsTable(made[-1])
        while len(made) > kept:
            spark.sql(f"DROP TABLE {made.pop(0)}")
        return spark.table(made[-1])

    try:
        yield make
    finally:
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def bucketed(m: Matrix):
    """The entries of m as recurrent() multiplies them, written once for several solves: in buckets by row, by column beyond vectors that may be sent."""
    key = "row" if m.cols <= BROADCAST_ENTRIES else "col"
    with _tables(m.entries.sparkSession, 1) as make:
        yield make(m.entries.repartition(key), key)


def recurrent(m: Matrix, b: DataFrame, most: int = 5000, stop: float = 1e-8, start: float = 0.0, matrix: DataFrame | None = None) -> Curve:
    """Conjugate gradients whose residuals are those of the recurrence, with both scalars of a step from one pass over it.

    The matrix lies in buckets by row (by column, beyond vectors that may be sent) and all vectors in one table in buckets of the same
    number, so a step shuffles neither: it sends one vector, or moves partial sums of rows. The scalars are observed while the
    step is written. Ends at stop, or when a direction has no positive curvature. b has a value for each row; the first guess is start everywhere.
    matrix: what bucketed() gives for m, if it is written already. The last of most steps needs no product."""
    if matrix is None:
        with bucketed(m) as own:
            return recurrent(m, b, most, stop, start, own)
    spark, sent = m.entries.sparkSession, m.cols <= BROADCAST_ENTRIES
    with _tables(spark, 2) as make:  # the state before, the state now

        def ended(vectors: DataFrame) -> tuple[DataFrame, float, float]:
            """vectors without a product; (r, r) and none."""
            seen = Observation()
            return cut(vectors.observe(seen, F.sum(F.col("r") * F.col("r")).alias("rr"))), seen.get["rr"] or 0.0, 0.0

        def stepped(vectors: DataFrame) -> tuple[DataFrame, float, float]:
            """vectors with w, the product of the matrix and r, written; (r, r) and (w, r)."""
            r = vectors.select(F.col("idx").alias("j"), F.col("r").alias("rj"))
            w = matrix.join(F.broadcast(r) if sent else r, F.col("col") == F.col("j")).groupBy("row").agg(F.sum(F.col("value") * F.col("rj")).alias("w"))
            seen = Observation()
            both = vectors.join(w, F.col("idx") == F.col("row"), "left").select("idx", "x", "r", "p", "s", F.coalesce("w", F.lit(0.0)).alias("w"))
            done = make(both.observe(seen, F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("w") * F.col("r")).alias("wr")), "idx")
            return done, seen.get["rr"] or 0.0, seen.get["wr"] or 0.0

        zero = F.lit(0.0)
        first = b.select("idx", F.lit(start).alias("x"), F.col("val").alias("r"), zero.alias("p"), zero.alias("s"))
        if start:
            sums = m.entries.groupBy("row").agg(F.sum("value").alias("t"))
            first = first.join(sums, F.col("idx") == F.col("row"), "left").withColumn("r", F.col("r") - start * F.coalesce("t", zero)).drop("row", "t")
        state, rr, wr = stepped(first.repartition("idx"))
        size, curve, alpha, beta = norm(b) or 1.0, Curve(), None, 0.0
        for k in range(1, most + 1):
            curvature = wr if alpha is None else wr - beta * rr / alpha
            if rr == 0 or not curvature > 0:
                curve.ended = "converged" if rr == 0 else "breakdown"
                break
            alpha = rr / curvature
            moved = state.select("idx", "x", "r", (F.col("r") + F.lit(beta) * F.col("p")).alias("p"), (F.col("w") + F.lit(beta) * F.col("s")).alias("s"))
            moved = moved.select("idx", (F.col("x") + F.lit(alpha) * F.col("p")).alias("x"), (F.col("r") - F.lit(alpha) * F.col("s")).alias("r"), "p", "s")
            before = rr
            state, rr, wr = stepped(moved) if k < most else ended(moved)
            beta = rr / before
            curve.residuals.append(rr**0.5 / size)
            if curve.residuals[-1] <= stop:
                curve.ended = "converged"
                break
        curve.solution = cut(state.select("idx", F.col("x").alias("val")))
    return curve
