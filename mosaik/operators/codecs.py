"""Value codecs: what each one stores, whether it applies, and the entries that it gives back.

Exact codecs keep values; lossy ones return entries whose values are those that decoding yields. Sums are
accumulated in double precision everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import distinct_upto
from ..functions.rounding import as_float, bf16, bf16_half_up, fp16, half_away
from ..matrix import Matrix
from .order import cells, running

#: Share of entries kept out of bulk encoding, and bytes of one of them.
OUTLIERS, OUTLIER_BYTES = 0.005, 16
#: Distinct values of the largest dictionary: whether there are more is all that is asked of larger numbers.
MOST_DISTINCT = 1 << 16
DICTIONARIES = {"dict2": 1, "dict4": 2, "dict16": 4, "dict256": 8, "dict65536": 16}
#: Order in which exact codecs are tried.
LADDER = ("all_one", "const_c", "sign2", "sign2_scale", *DICTIONARIES)
ALIASES = {"raw": "original", "none": "original", "one": "all_one", "const": "const_c", "dict256_u8": "dict256", "dict65536_u16": "dict65536", "unique4": "dict4", "unique16": "dict16", "half": "fp16"}


def codec_name(name: str) -> str:
    n = name.strip().lower().replace("-", "_")
    n = ALIASES.get(n, n)
    if n not in ("original", *LADDER, "fp16", "bf16", "bfp8", "bfp8_outlier", "bfp4", "codebook256", "logkmeans16", "logkmeans32", "logkmeans64", "logkmeans128"):
        raise ValueError(f"unknown codec: {name}")
    return n


def facts(m: Matrix, br: int = 8, bc: int = 4) -> DataFrame:
    """One row: nnz, distinct (up to MOST_DISTINCT + 1), low, high and tiles, which decide the exact codecs that apply."""
    return facts_each(m, {"": F.col("value")}, br, bc).drop("pattern")


def facts_each(m: Matrix, patterns: dict[str, Column], br: int = 8, bc: int = 4) -> DataFrame:
    """(pattern, nnz, distinct, low, high, tiles): facts of several columns of values over the same positions, in one aggregation of
    the values and one of the positions."""
    at = {k: f"v{i}" for i, k in enumerate(patterns)}
    values = m.entries.select(*[c.alias(at[k]) for k, c in patterns.items()])
    own = [F.struct(distinct_upto(F.col(v), MOST_DISTINCT).alias("distinct"), F.min(v).alias("low"), F.max(v).alias("high")).alias(v) for v in at.values()]
    f = values.agg(F.count("*").alias("nnz"), *own)
    t = m.entries.select(F.expr(f"row DIV {br}").alias("a"), F.expr(f"col DIV {bc}").alias("b")).distinct().agg(F.count("*").alias("tiles"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(v).alias("f")) for k, v in at.items()]))
    return f.join(t).select("nnz", "tiles", each.alias("e")).select("e.pattern", "nnz", "e.f.distinct", "e.f.low", "e.f.high", "tiles")


def applies(codec: str) -> Column:
    """Whether an exact codec can hold the values that facts() describes."""
    one, two = F.col("distinct") == 1, F.col("distinct") == 2
    rules = {
        "all_one": one & (F.col("low") == 1),
        "const_c": one,
        "sign2": two & (F.col("low") == -1) & (F.col("high") == 1),
        "sign2_scale": two & (F.col("low") == -F.col("high")),
    }
    return rules[codec] if codec in rules else F.col("distinct") <= 2 ** DICTIONARIES[codec]


def tile_bytes(codec: str) -> Column:
    """Bytes of a codec's payload in words of 32 cells for each tile, with its codebook."""
    words = {"all_one": 0, "const_c": 0, "sign2": 1, "sign2_scale": 1} | DICTIONARIES
    book = {"all_one": F.lit(0), "const_c": F.lit(8), "sign2": F.lit(0), "sign2_scale": F.lit(8)}.get(codec, F.col("distinct") * 8)
    return (F.col("tiles") * (4 * words[codec]) + book).cast("long")


def host_bits(codec: str) -> Column:
    """Bits of a codec's payload counted by entry."""
    nnz = F.col("nnz")
    fixed = {"original": nnz * 64, "all_one": F.lit(0), "const_c": F.lit(64), "sign2": nnz * 2, "sign2_scale": nnz + 64, "fp16": nnz * 16, "bf16": nnz * 16}
    return (fixed[codec] if codec in fixed else nnz * DICTIONARIES[codec] + F.col("distinct") * 64).cast("long")


def exact_report(m: Matrix) -> DataFrame:
    """(codec, applicable, tile_payload_bytes) of each exact codec."""
    f = facts(m)
    each = F.array(*[F.struct(F.lit(c).alias("codec"), applies(c).alias("applicable"), tile_bytes(c).alias("tile_payload_bytes")) for c in LADDER])
    return f.select(F.explode(each).alias("r")).select("r.*")


def auto_lossless(m: Matrix) -> DataFrame:
    """One row: the first exact codec that applies and saves bytes, else the original values."""
    return picked(facts(m).withColumn("pattern", F.lit(""))).drop("pattern")


def picked(f: DataFrame) -> DataFrame:
    """(pattern, codec, nnz, distinct, payload_bytes) of each row of facts."""
    raw = (F.col("nnz") * 8).cast("long")
    pick = F.lit(None).cast("string")
    for c in reversed(LADDER):
        pick = F.when(applies(c) & (tile_bytes(c) < raw), F.lit(c)).otherwise(F.coalesce(pick, F.lit("original")))
    size = raw
    for c in LADDER:
        size = F.when(F.col("codec") == c, tile_bytes(c)).otherwise(size)
    return f.withColumn("codec", F.when(F.col("nnz") == 0, F.lit("original")).otherwise(pick)).select("pattern", "codec", "nnz", "distinct", size.alias("payload_bytes"))


def dictionary(m: Matrix, most: int) -> tuple[DataFrame, DataFrame]:
    """Entries (row, col, id) and the codebook (id, value), ids dense in the order of values.

    The codebook has at most `most` values, which is checked; only it is ordered in one task, and broadcast."""
    values = m.entries.select("value").distinct()
    n = values.count()
    if n > most:
        raise ValueError(f"{n} distinct values do not fit a dictionary of {most}")
    book = values.select((F.dense_rank().over(Window.orderBy("value")) - 1).cast("long").alias("id"), "value")
    coded = m.entries.join(F.broadcast(book.withColumnRenamed("value", "v")), F.col("value") == F.col("v")).select("row", "col", "id")
    return coded, book


def from_dictionary(coded: DataFrame, book: DataFrame) -> DataFrame:
    return coded.join(F.broadcast(book), "id").select("row", "col", "value")


def sign_masks(m: Matrix, br: int = 8, bc: int = 4) -> DataFrame:
    """(br, bc, bitmap, sign): tiles with a mask of their positive cells."""
    bit = ((F.col("row") % br) * bc + F.col("col") % bc).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    e = m.entries.select(F.expr(f"row DIV {br}").alias("br"), F.expr(f"col DIV {bc}").alias("bc"), bit.alias("bit"), "value")
    return e.groupBy("br", "bc").agg(F.bit_or(one).alias("bitmap"), F.coalesce(F.bit_or(F.when(F.col("value") > 0, one)), F.lit(0)).alias("sign"))


def from_sign_masks(masks: DataFrame, high: Column, low: Column, br: int = 8, bc: int = 4) -> DataFrame:
    """Entries of tiles with masks: high where the sign bit is set, low in the other cells of the bitmap."""
    is_set = lambda mask: F.call_function("getbit", F.col(mask), F.col("bit")) == 1
    each = masks.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(br * bc - 1)))).filter(is_set("bitmap"))
    return each.select((F.col("br") * br + F.expr(f"bit DIV {bc}")).alias("row"), (F.col("bc") * bc + F.col("bit") % bc).alias("col"), F.when(is_set("sign"), high).otherwise(low).alias("value"))


def exact_coded(m: Matrix, codec: str) -> Matrix:
    """m as an exact codec of one or two values, or binary01, gives it back: the codec's constants are found from the values.

    Raises ValueError where the values do not suit the codec."""
    low, high, n = m.entries.agg(F.min("value"), F.max("value"), F.count_distinct("value")).first()
    suits = {"all_one": n == 1 and low == 1, "const_c": n == 1, "sign2": n == 2 and (low, high) == (-1, 1), "sign2_scale": n == 2 and low == -high, "binary01": n is not None and 0 < n <= 2 and {low, high} <= {0.0, 1.0}}
    if not suits[codec]:
        raise ValueError(f"the values do not suit {codec}")
    base = {"binary01": 0.0}.get(codec, low)
    return m.with_entries(from_sign_masks(sign_masks(m), F.lit(float(high)), F.lit(float(base))))


def rounded(m: Matrix, how: Callable[[Column], Column]) -> Matrix:
    return m.with_value(how(F.col("value")))


def _tile_window(br: int = 8, bc: int = 4) -> Window:
    return Window.partitionBy(F.expr(f"row DIV {br}"), F.expr(f"col DIV {bc}"))


def block_floating(m: Matrix, levels: int, scaled_by: Column | None = None) -> DataFrame:
    """(row, col, value, q, scale, decoded): whole numbers up to levels times a tile's scale, itself rounded to bf16."""
    most = F.max(F.abs(F.col("value") if scaled_by is None else scaled_by)).over(_tile_window())
    e = m.entries.withColumn("scale", most / F.lit(float(levels))).withColumn("scale", bf16(F.col("scale")))
    e = e.withColumn("scale", F.when(F.coalesce("scale", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("scale")))
    q = F.greatest(F.lit(-float(levels)), F.least(F.lit(float(levels)), half_away(F.col("value") / F.col("scale"))))
    return e.withColumn("q", q).withColumn("decoded", F.col("q") * F.col("scale"))


def bfp8(m: Matrix) -> Matrix:
    return m.with_entries(block_floating(m, 127).select("row", "col", F.col("decoded").alias("value")))


def bfp4(m: Matrix) -> Matrix:
    return m.with_entries(block_floating(m, 7).select("row", "col", F.col("decoded").alias("value")))


def outlier_threshold(m: Matrix, share: float = OUTLIERS) -> DataFrame:
    """One row (threshold): the magnitude at place floor((1 - share) * nnz) of all, ascending. Magnitudes are
    counted first; distinct ones are put in order within approximate quantiles."""
    sizes = m.entries.groupBy(F.abs("value").alias("a")).agg(F.count("*").alias("n"))
    total = m.entries.count()
    upto = running(sizes, [cells(sizes, F.col("a")), F.col("a")], "before", F.col("n"))
    return upto.filter(F.col("before") + F.col("n") > F.floor(F.lit(1 - share) * F.lit(total))).agg(F.min("a").alias("threshold"))


def bfp8_outlier(m: Matrix, share: float = OUTLIERS) -> tuple[DataFrame, DataFrame]:
    """Bulk entries as bfp8 decodes them, and the outliers, greater than the threshold, as they are."""
    e = m.entries.join(F.broadcast(outlier_threshold(m, share))).withColumn("out", F.abs("value") > F.col("threshold"))
    out = e.filter("out").select("row", "col", "value")
    bulk = block_floating(m.with_entries(e.filter("NOT out").select("row", "col", "value")), 127)
    return bulk.select("row", "col", F.col("decoded").alias("value")), out


def joint(kept: Matrix, residual: DataFrame) -> list[DataFrame]:
    """Entries of a hybrid split: bfp8 tiles and bf16 residual entries, ties away from zero."""
    return [bfp8(kept).entries, residual.select("row", "col", bf16_half_up(F.col("value")).alias("value"))]


# --- k-means codebooks ----------------------------------------------------------------------------------


def kmeans_centers(values: DataFrame, k: int, rounds: int = 16) -> list[float]:
    """Sorted centers of a column `value`: its distinct values if there are at most k, else means of equal-width
    bins moved by Lloyd rounds. The driver sees bins only, at most 4096, whatever the number of values."""
    f = values.agg(F.min("value"), F.max("value"), F.count("*"), F.approx_count_distinct("value")).first()
    low, high, n = f[0], f[1], f[2]
    if not n:
        return []
    few = [r.value for r in values.select("value").distinct().limit(k + 1).collect()]
    if len(few) <= k:
        return sorted(few)
    bins = max(16 * k, min(4096, n))
    width = (high - low) / bins
    at = F.least(F.floor((F.col("value") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    rows = values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).orderBy("bin").collect()
    mean, weight = np.array([r["mean"] for r in rows]), np.array([r["n"] for r in rows], float)
    share = (np.cumsum(weight) - weight / 2) / weight.sum()
    centers = np.interp((np.arange(k) + 0.5) / k, share, mean)
    for _ in range(rounds):
        own = np.searchsorted((centers[1:] + centers[:-1]) / 2, mean, "left")
        total, size = np.bincount(own, mean * weight, k), np.bincount(own, weight, k)
        centers = np.sort(np.where(size > 0, total / np.maximum(size, 1), centers))
    return centers.tolist()


def nearest(v: Column, centers: list[float]) -> Column:
    """The nearest of sorted centers, ties to the lower: as many centers lie before it as midpoints are less than v, which is
    found by halving, in as many steps as their number has bits."""
    array = F.array(*[F.lit(float(c)) for c in centers])
    middle = F.array(*[F.lit((a + b) / 2) for a, b in zip(centers, centers[1:], strict=False)]).cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(centers).bit_length()))]).cast("array<int>")
    further = lambda at, step: (at + step < len(centers)) & (F.get(middle, at + step - 1) < v)
    before = F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))
    return F.get(array, before)


def codebook256(m: Matrix) -> Matrix:
    return rounded(m, lambda v: nearest(v, kmeans_centers(m.entries, 256)))


def log_kmeans(m: Matrix, k: int) -> Matrix:
    """Values as their sign times two to the nearest of k centers of log2 magnitudes; zeros stay."""
    logs = m.entries.filter("value <> 0").select(F.log2(F.abs("value")).alias("value"))
    centers = kmeans_centers(logs, k)
    return rounded(m, lambda v: F.when(v == 0, v).otherwise(F.signum(v) * F.pow(F.lit(2.0), nearest(F.log2(F.abs(v)), centers))))


LOSSY: dict[str, Callable[[Matrix], Matrix]] = {
    "fp16": lambda m: rounded(m, fp16),
    "bf16": lambda m: rounded(m, bf16),
    "float": lambda m: rounded(m, as_float),
    "bfp8": bfp8,
    "bfp4": bfp4,
    "codebook256": codebook256,
    **{f"logkmeans{k}": (lambda m, k=k: log_kmeans(m, k)) for k in (16, 32, 64, 128)},
}
