"""Running sums in the order of several keys, where neither a key nor a group need fit one task.

The order is given by levels, from coarse to fine: rows of equal coarse levels lie together. Rows are summed by
level first, and a window sees only what lies within one value of the level above: so with whole numbers cut into digits, a
group that holds half of all rows is still dealt to many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit.
DIGIT = 12
#: Cut points of an order of other values.
CUTS = 255


def digits(key: Column | str, largest: int = 1 << 24) -> list[Column]:
    """A whole number from 0 to largest as levels, each some 4096 times as fine as the one before."""
    key = F.col(key) if isinstance(key, str) else key
    shifts = range(DIGIT * max(0, (largest.bit_length() - 1) // DIGIT), 0, -DIGIT)
    return [*(F.shiftright(key.cast("long"), s) for s in shifts), key]


def cells(df: DataFrame, key: Column) -> Column:
    """A level above a key that can be ordered: how many of CUTS approximate quantiles lie below it."""
    found = df.agg(F.percentile_approx(key, [(k + 1) / (CUTS + 1) for k in range(CUTS)], 1000)).first()[0] or []
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(found))]).cast("array<double>")
    return F.size(F.filter(cuts, lambda c: c < key))


def running(df: DataFrame, levels: list[Column], name: str, amount: Column | None = None, group: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of amount (else the number) of the rows before each one of its group in the order of the levels, as a long."""
    keys = [f"_l{i}" for i in range(len(levels))]
    above = [*group, *keys[:-1]]
    t = df.withColumns({**dict(zip(keys, levels, strict=True)), "_n": (F.lit(1) if amount is None else amount).cast("long")})
    t = t.withColumn("_own", _before(above, keys[-1]))
    if not above:
        return t.select(*df.columns, F.col("_own").alias(name))
    bases = _bases(t.groupBy(*above).agg(F.sum("_n").alias("_n")), list(group), keys[:-1])
    held = bases.select(*(F.col(c).alias(f"_{c}") for c in above), "_base")
    met = t.join(held, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in above)))
    return met.select(*df.columns, (F.col("_own") + F.col("_base")).alias(name))


def _before(part: list[str], key: str) -> Column:
    return F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _bases(sums: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """sums with _base: what lies before each row in its group."""
    if not keys:
        return sums.withColumn("_base", F.lit(0).cast("long"))
    above = [*group, *keys[:-1]]
    own = sums.withColumn("_base", _before(above, keys[-1]))
    if len(keys) == 1:
        return own
    up = _bases(sums.groupBy(*above).agg(F.sum("_n").alias("_n")), group, keys[:-1])
    held = up.select(*(F.col(c).alias(f"_{c}") for c in above), F.col("_base").alias("_up"))
    met = own.join(held, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in above)))
    return met.select(*sums.columns, (F.col("_base") + F.col("_up")).alias("_base"))
