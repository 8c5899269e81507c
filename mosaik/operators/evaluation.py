"""All value codecs of many matrices at once: what each one takes, whether it applies, and what it changes.

Entries carry the names of their matrices in key columns. Two aggregations do the work, whatever the number of codecs and matrices: one of
the values (with a bounded sketch in place of a set of all distinct values), and one by row, which carries the product with a probe vector and what each
rounding codec adds to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import distinct_upto
from ..functions.rounding import bf16, fp16
from ..sources.tables import hashed
from .codecs import DICTIONARIES, MOST_DISTINCT
from .metrics import TINY

#: Fixed value: the relative error up to which a product passes.
GATE = 1e-6
ROUNDED: dict[str, Callable[[Column], Column]] = {"fp16": fp16, "bf16": bf16}
EXACT = ("original", "all_one", "const_c", "binary01", "sign2", "sign2_scale", *DICTIONARIES)


def value_facts(v: Column) -> dict[str, Column]:
    """Aggregates that decide which exact codecs apply."""
    return {
        "distinct": distinct_upto(v, MOST_DISTINCT),
        "low": F.min(v),
        "high": F.max(v),
        "binary": F.bool_and(v.isin(0.0, 1.0)),
        "signs": F.bool_and(v.isin(-1.0, 0.0, 1.0)) & F.bool_or(v == -1),
    }


def probe(col: Column) -> Column:
    """The hashed probe vector at a column: thousandths between -1 and 1 by 257, never zero."""
    v = hashed(col) % 2001 - 1000
    return F.when(v == 0, F.lit(1)).otherwise(v) / F.lit(257.0)


def _rules() -> dict[str, tuple[Column, Column]]:
    """Of each codec, whether it applies and its payload bits, from the facts."""
    nnz, distinct = F.col("nnz"), F.col("distinct")
    all_one = (F.col("low") == 1) & (F.col("high") == 1)
    out = {
        "original": (F.lit(True), nnz * 64),
        "all_one": (all_one, F.lit(0)),
        "const_c": (distinct == 1, F.lit(64)),
        "binary01": (F.col("binary") & ~all_one, nnz),
        "sign2": (F.col("signs"), nnz * 2),
        "sign2_scale": ((distinct == 2) & (F.col("low") == -F.col("high")), nnz + 64),
    }
    out |= {c: (distinct <= 2**bits, nnz * bits + distinct * 64) for c, bits in DICTIONARIES.items()}
    return out | {c: (F.lit(True), nnz * 16) for c in ROUNDED}


def evaluated(entries: DataFrame, keys: Sequence[str], gate: float = GATE) -> DataFrame:
    """A row for each matrix and codec: nnz, applicable, exact, payload_bits, values changed, the greatest errors of values (absolute
    and relative) and of the product (of a row by its own size, and by the largest), and whether it passes; exact codecs change nothing.

    Matrices without entries have no rows. A value that a form cannot hold has an infinite error."""
    v = F.col("value")
    facts = entries.groupBy(*keys).agg(F.count("*").alias("nnz"), *[c.alias(k) for k, c in value_facts(v).items()])
    x, by_row, whole = probe(F.col("col")), [F.sum(v * probe(F.col("col"))).alias("y")], [F.max(F.abs("y")).alias("most")]
    given = {c: how(v) for c, how in ROUNDED.items()}
    e = entries.select(*keys, "row", "col", "value", *[w.alias(f"v_{c}") for c, w in given.items()])
    for c in ROUNDED:
        w = F.col(f"v_{c}")
        lost = F.abs(w) == float("inf")
        d = F.when(lost, 0.0).otherwise(w - v)
        by_row += [F.sum(d * x).alias(f"d_{c}"), F.count_if(w != v).alias(f"n_{c}"), F.max(F.abs(w - v)).alias(f"a_{c}"), F.max(F.abs(w - v) / F.greatest(F.abs(v), F.lit(TINY))).alias(f"r_{c}"), F.bool_or(lost).alias(f"l_{c}")]
        own, inf = F.abs(f"d_{c}"), F.lit(float("inf"))
        whole += [
            F.sum(f"n_{c}").alias(f"n_{c}"),
            F.max(f"a_{c}").alias(f"a_{c}"),
            F.max(f"r_{c}").alias(f"r_{c}"),
            F.when(F.bool_or(f"l_{c}"), inf).otherwise(F.max(own / F.greatest(F.abs("y"), F.lit(TINY)))).alias(f"e_{c}"),
            F.when(F.bool_or(f"l_{c}"), inf).otherwise(F.max(own) / F.greatest(F.max(F.abs("y")), F.lit(TINY))).alias(f"g_{c}"),
        ]
    errors = e.groupBy(*keys, "row").agg(*by_row).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*whole)
    met = facts.join(errors, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    zero, rows = F.lit(0.0), []
    for c, (applies, bits) in _rules().items():
        n, a, r, worst, overall = [F.col(f"{p}_{c}") for p in "nareg"] if c in ROUNDED else [F.lit(0).cast("long"), zero, zero, zero, zero]
        values = {"codec": F.lit(c), "applicable": applies, "exact": F.lit(c in EXACT), "payload_bits": bits.cast("long"), "changed": n, "max_abs_error": a, "max_rel_error": r}
        values |= {"product_max_rel": worst, "product_global_rel": overall, "passes": applies & (worst <= gate)}
        rows.append(F.struct(*[w.alias(k) for k, w in values.items()]))
    return met.select(*keys, "nnz", F.explode(F.array(*rows)).alias("r")).select(*keys, "nnz", "r.*")


def chosen(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """report with chosen: the codec that passes with the fewest bits; of equal ones the first by name."""
    best = report.filter("passes").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct("payload_bits", "codec"))["codec"].alias("_best"))
    met = report.join(best, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return met.select(*report.columns, F.coalesce(F.col("codec") == F.col("_best"), F.lit(False)).alias("chosen"))
