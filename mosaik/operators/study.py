"""Spatial coherence of values: spans in tiles against shuffled values, and dense windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..sources.tables import hashed
from .order import cells, digits, running
from .solvers import cut
from .tiles import _placed

#: Edges of the fill bins.
FILL_BINS = (0.0, 0.0625, 0.125, 0.1875, 0.25, 0.375, 0.5, 0.75, 1.0001)


def logs(m: Matrix) -> DataFrame:
    """(row, col, g): binary logarithms of magnitudes that are positive numbers."""
    a = F.abs("value")
    return m.entries.filter((a > 0) & (a < float("inf"))).select("row", "col", F.log2(a).alias("g"))


def spans(g: DataFrame, br: int = 8, bc: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, br, bc, n, span, fill) of each tile."""
    t = g.groupBy(*keys, F.expr(f"row DIV {br}").alias("br"), F.expr(f"col DIV {bc}").alias("bc"))
    return t.agg(F.count("*").alias("n"), (F.max("g") - F.min("g")).alias("span")).withColumn("fill", F.col("n") / F.lit(float(br * bc)))


#: Rounds of a permutation: each exchanges half of the pairs that it makes.
ROUNDS = 16


def _mixed(x):
    """hashed() of whole numbers, of Python or of an array."""
    h = (x % 2147483648 * 2654435761 + 1013904223) % 4294967296
    return h ^ (h >> 16)


def permuted(k: Column, n: int, seed: Column, seeds: int) -> Column:
    """Where a keyed permutation of the numbers 0 to n - 1 takes k: swap or not. A round pairs each number with the one
    that makes the round's sum modulo n, and a hash of the greater one says whether the two change places. Nothing is sorted. Sums depend on
    seed (1 to seeds) and round alone, so they are hashed once, here; a round is a few operations on arrays of a batch."""
    sums = np.array([[_mixed(_mixed(s * 1000003 + i)) % n for s in range(seeds + 1)] for i in range(ROUNDS)], np.int64)

    @F.pandas_udf("long")
    def at(k: pd.Series, seed: pd.Series) -> pd.Series:
        x, s = k.to_numpy(np.int64), seed.to_numpy(np.int64)
        for i in range(ROUNDS):
            other = sums[i][s] - x
            other += n * (other < 0)
            swaps = (_mixed(np.maximum(x, other) + (s * 7919 + i * 104729)) >> 15) & 1
            x = np.where(swaps == 1, other, x)
        return pd.Series(x)

    return at(k.cast("long"), seed.cast("int"))


def shuffled(g: DataFrame, seeds: int, rows: int, cols: int) -> DataFrame:
    """(seed, row, col, g): for seeds 1, 2, ... the same positions with the values of other positions. Entries are numbered once, in the order of
    rows and columns; each place takes the value at the permuted number, in one join for all seeds."""
    numbered = cut(running(g.select("row", "col", "g"), [*digits("row", rows), *digits("col", cols)], "k"))  # read three times
    n = max(1, numbered.count())
    # The permutation costs more than the move to as many tasks as a shuffle has.
    dealt = numbered.repartition(int(g.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    each = dealt.select("row", "col", "k", F.explode(F.array(*[F.lit(s) for s in range(1, seeds + 1)])).alias("seed"))
    places = each.select("seed", "row", "col", permuted(F.col("k"), n, F.col("seed"), seeds).alias("at"))
    return places.join(numbered.select("k", "g"), F.col("at") == F.col("k")).select("seed", "row", "col", "g")


def weighted_span(t: DataFrame, name: str) -> DataFrame:
    return t.agg((F.sum(F.col("n") * F.col("span")) / F.sum("n")).alias(name))


def coherence_gain(real: Column, null: Column) -> Column:
    return F.when(null > 1e-12, 1 - real / null).otherwise(F.lit(float("nan")))


def fill_bin(fill: Column) -> Column:
    out = F.lit(0)
    for edge in FILL_BINS[1:-1]:
        out = out + (fill >= edge).cast("int")
    return out.cast("int")


#: Tiles below which a rank correlation tells nothing, and tiles of a sample.
LEAST_TILES, MOST_TILES = 100, 200_000


def least_hashed(t: DataFrame, most: int, *keys: str) -> DataFrame:
    """Exactly most rows (all, if there are fewer), by the least hashes of whole numbers that tell rows apart: each task keeps a heap of
    that many, and reruns give the same ones."""
    h = F.lit(0).cast("long")
    for k in keys:
        h = hashed(h + F.col(k))
    return t.withColumn("_h", h).orderBy("_h", *keys).limit(most).drop("_h")


def sampled_spearman(t: DataFrame, a: str, b: str, *keys: str, most: int = MOST_TILES, least: int = LEAST_TILES) -> DataFrame:
    """One row (tiles, rho): rank correlation over a sample of most tiles; null where there are fewer than least."""
    picked = least_hashed(t, most, *keys)
    size = picked.agg(F.count("*").alias("tiles"))
    return size.join(spearman(picked, a, b)).select("tiles", F.when(F.col("tiles") >= least, F.col("rho")).alias("rho"))


def average_ranks(pairs: DataFrame, c: str, name: str) -> DataFrame:
    """pairs with the rank of c, the mean of their places for ties; n tells how many rows a pair stands for."""
    each = pairs.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("of"))
    placed = running(each, [cells(each, F.col("v")), F.col("v")], "place", F.col("of"))
    rank = placed.select("v", (F.col("place") + (F.col("of") + 1) / 2.0).alias(name))
    return pairs.join(rank, F.col(c) == F.col("v")).drop("v")


def spearman(t: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks for ties. Pairs of values are counted first, and ranked by their distinct values."""
    pairs = t.groupBy(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count("*").alias("n"))
    return _correlated(average_ranks(average_ranks(pairs, "a", "x"), "b", "y"))


def _correlated(t: DataFrame) -> DataFrame:
    """One row: the correlation of x and y over rows that stand for n each; null where one of them does not vary."""
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    s = t.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    return s.select(F.try_divide(n * F.col("xy") - x * y, F.sqrt(n * F.col("xx") - x * x) * F.sqrt(n * F.col("yy") - y * y)).alias("rho"))


def spearman_ordinal(t: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """Rank correlation where ties stand in the order of a whole number."""
    for c, name in ((a, "x"), (b, "y")):
        key = F.col(c).cast("double")
        t = running(t, [cells(t, key), key, *digits(tie, 1 << 36)], name)
    return _correlated(t.select((F.col("x") + 1.0).alias("x"), (F.col("y") + 1.0).alias("y"), F.lit(1).alias("n")))


def relative_l1(m: Matrix, levels: int, br: int = 8, bc: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of keys): relative error of whole numbers up to levels times each tile's exact maximum, ties to even."""
    most = F.max(F.abs("value")).over(Window.partitionBy(*keys, F.expr(f"row DIV {br}"), F.expr(f"col DIV {bc}")))
    e = m.entries.withColumn("s", most / F.lit(float(levels))).filter("s > 0")
    return e.groupBy(*keys).agg((F.sum(F.abs(F.rint(F.col("value") / F.col("s")) * F.col("s") - F.col("value"))) / F.sum(F.abs("value"))).alias("rel_l1"))


def shuffled_gain(m: Matrix, levels: int, seeds: int = 4) -> DataFrame:
    """One row: relative error of magnitudes in place, its mean over seeds shuffles of them, and the gain of the places."""
    a = m.entries.select("row", "col", F.abs("value").alias("g")).filter("g > 0")
    dealt = shuffled(a, seeds, m.rows, m.cols).withColumnRenamed("g", "value")
    nulls = relative_l1(m.with_entries(dealt), levels, keys=("seed",))
    real = relative_l1(m.with_entries(a.withColumnRenamed("g", "value")), levels)
    both = real.withColumnRenamed("rel_l1", "real_l1").join(nulls.agg(F.avg("rel_l1").alias("null_l1")))
    return both.withColumn("gain", 1 - F.try_divide("real_l1", "null_l1"))


def _cells(e: DataFrame, height: int, width: int) -> list[Column]:
    """The cell of an entry on the grid of half a window, which entries may carry as br and bc."""
    return [c.alias(name) for c, name in zip(_placed(e, height // 2, width // 2), ("a", "b"), strict=True)]


def _in_windows(m: Matrix, height: int, width: int, few: DataFrame) -> DataFrame:
    """The columns of few (top, left and more: a few rows, sent to all tasks), row, col and value: entries in each of its windows, which lie on a grid of half their size."""
    h, w = height // 2, width // 2
    corner = F.array(*[F.struct(F.expr(f"top DIV {h} + {i}").alias("_a"), F.expr(f"left DIV {w} + {j}").alias("_b")) for i in (0, 1) for j in (0, 1)])
    own = few.filter(f"top >= 0 AND left >= 0 AND top % {h} = 0 AND left % {w} = 0").select(*few.columns, F.explode(corner).alias("_z")).select(*few.columns, "_z._a", "_z._b")
    met = m.entries.select("row", "col", "value", *_cells(m.entries, height, width)).join(F.broadcast(own), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    return met.select(*few.columns, "row", "col", "value")


def _covering(cell: DataFrame, height: int, width: int) -> DataFrame:
    """The columns of cell (a, b and more) without its place, with top and left of each of the four windows that cover it, fewer at the edges."""
    h, w = height // 2, width // 2
    names = [c for c in cell.columns if c not in ("a", "b")]
    corner = F.array(*[F.struct(((F.col("a") - i) * h).alias("top"), ((F.col("b") - j) * w).alias("left")) for i in (0, 1) for j in (0, 1)])
    return cell.select(F.explode(corner).alias("z"), *names).select("z.top", "z.left", *names).filter("top >= 0 AND left >= 0")


def windows(m: Matrix, height: int, width: int, least: int = 1) -> DataFrame:
    """(top, left, n) of windows on a grid of half their size: an entry belongs to the four that cover it, fewer at the edges. Entries are
    counted by cells of the grid first, of which a window has four."""
    counted = m.entries.select(*_cells(m.entries, height, width)).groupBy("a", "b").agg(F.count("*").alias("n"))
    return _covering(counted, height, width).groupBy("top", "left").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


#: Fixed value: windows with this share of the entries of the densest at least are near it, and all of them are looked into.
NEAR_DENSEST = 0.6


def judged_windows(m: Matrix, height: int, width: int, levels: int = 127, share: float = NEAR_DENSEST, br: int = 8, bc: int = 4) -> DataFrame:
    """(top, left, n, median) of all windows near the densest: the median over their tiles of the relative error of whole numbers up to
    levels times the tile's greatest magnitude. Half a window is a whole number of tiles in both directions, so a tile lies in one cell of the
    grid: it is judged once, and a cell hands its few errors to the windows that cover it. Entries may carry br and bc of such cells."""
    if height // 2 % br or width // 2 % bc:
        raise ValueError("half a window has to hold whole tiles")
    a = F.abs("value")
    tile = ["a", "b", F.expr(f"row DIV {br}").alias("br"), F.expr(f"col DIV {bc}").alias("bc")]
    placed = m.entries.select("row", "col", "value", *_cells(m.entries, height, width)).select(*tile, F.when(a > 0, a).alias("v"))
    scaled = placed.withColumn("s", F.max("v").over(Window.partitionBy("a", "b", "br", "bc")))
    lost = F.abs(F.rint(F.col("v") / F.col("s") * levels) * F.col("s") / levels - F.col("v"))
    judged = scaled.groupBy("a", "b", "br", "bc").agg(F.count("*").alias("n"), (F.sum(lost) / F.sum("v")).alias("error"))
    cell = judged.groupBy("a", "b").agg(F.sum("n").alias("n"), F.collect_list("error").alias("errors"))
    each = _covering(cell, height, width).groupBy("top", "left").agg(F.sum("n").alias("n"), F.collect_list("errors").alias("errors"))
    top = windows(m, height, width).agg(F.max("n").alias("m"))
    near = each.join(F.broadcast(top), F.col("n") >= F.lit(share) * F.col("m"))
    known = near.select("top", "left", "n", F.sort_array(F.flatten("errors")).alias("errors")).filter(F.size("errors") > 0)
    middle = (F.get("errors", F.expr("(size(errors) - 1) DIV 2")) + F.get("errors", F.expr("size(errors) DIV 2"))) / 2
    return known.select("top", "left", "n", F.round(middle, 12).alias("median"))


def window_of(m: Matrix, height: int, width: int, chosen: DataFrame) -> DataFrame:
    """The entries within windows: chosen's columns, with row and col counted from the corner. chosen: a few rows with top and left, sent to all tasks."""
    names = [c for c in chosen.columns if c not in ("top", "left")]
    met = _in_windows(m, height, width, chosen)
    return met.select("top", "left", *names, (F.col("row") - F.col("top")).alias("row"), (F.col("col") - F.col("left")).alias("col"), "value")


def densest(m: Matrix, height: int, width: int, k: int) -> DataFrame:
    return windows(m, height, width).orderBy(F.desc("n"), "top", "left").limit(k)
