"""Bitmap tiles of a matrix, 8 x 4 unless asked otherwise, and their packed and residual forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from .order import digits, running

BR, BC = 8, 4
FLAG = 1 << 31


def bit_of(br: int = BR, bc: int = BC) -> Column:
    """Place of an entry in its tile, row by row."""
    return (F.col("row") % br) * bc + F.col("col") % bc


def _tile(br: int, bc: int) -> list[Column]:
    return [F.expr(f"row DIV {br}").alias("br"), F.expr(f"col DIV {bc}").alias("bc")]


def _placed(e: DataFrame, br: int, bc: int) -> list[Column]:
    """br and bc of entries: those they carry, so that entries dealt by tile stay where they are, else computed."""
    return [F.col("br"), F.col("bc")] if {"br", "bc"} <= set(e.columns) else _tile(br, bc)


def tiled(m: Matrix, br: int = BR, bc: int = BC, keys: tuple[str, ...] = ()) -> DataFrame:
    """(br, bc, bitmap, nnz, values): one row for each tile with entries; values stand in bit order.

    Bitmaps of up to 63 bits fit a long; larger tiles take tiled_words. keys: columns that tell several matrices apart. Entries may carry br and bc of such tiles."""
    if br * bc > 63:
        raise ValueError("tiles of more than 63 cells need tiled_words")
    e = m.entries.select(*keys, *_placed(m.entries, br, bc), bit_of(br, bc).cast("int").alias("bit"), "value")
    t = e.groupBy(*keys, "br", "bc").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bitmap"), F.count("*").alias("nnz"), F.sort_array(F.collect_list(F.struct("bit", "value"))).alias("cells"))
    return t.select(*keys, "br", "bc", "bitmap", "nnz", F.transform("cells", lambda c: c["value"]).alias("values"))


def counted(places: DataFrame, bits: int = 62, keys: tuple[str, ...] = ()) -> DataFrame:
    """(br, bc, bitmap, nnz, values): 8 x 4 tiles of (row, col) places that may come repeatedly; a value is how often its place comes.

    A plain hash aggregate of counters of so many bits, as many in a long as it holds; no place may come 2^bits times. Places may carry br and bc."""
    each, cells = 62 // bits, BR * BC
    e = places.select(*keys, *_placed(places, BR, BC), bit_of().cast("int").alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % each * bits)
    sums = [F.sum(F.when(F.expr(f"bit DIV {each}") == i, one).otherwise(F.lit(0))).alias(f"_{i}") for i in range(-(-cells // each))]
    t = e.groupBy(*keys, "br", "bc").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bitmap"), *sums)
    counts = [F.shiftright(f"_{k // each}", k % each * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") for k in range(cells)]
    return t.select(*keys, "br", "bc", "bitmap", F.bit_count("bitmap").cast("long").alias("nnz"), F.array_remove(F.array(*counts), F.lit(0.0)).alias("values"))


def shapes(m: Matrix, br: int = BR, bc: int = BC) -> DataFrame:
    """(br, bc, bitmap, nnz) without values: a plain hash aggregate."""
    e = m.entries.select(*_tile(br, bc), bit_of(br, bc).cast("int").alias("bit"))
    return e.groupBy("br", "bc").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bitmap"), F.count("*").alias("nnz"))


def tiled_words(m: Matrix, br: int, bc: int) -> DataFrame:
    """(br, bc, word, bitmap, nnz): bitmaps in words of 32 bits."""
    bit = bit_of(br, bc)
    e = m.entries.select(*_tile(br, bc), (bit / 32).cast("int").alias("word"), (bit % 32).cast("int").alias("bit"))
    return e.groupBy("br", "bc", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bitmap"), F.count("*").alias("nnz"))


def pack(tiles: DataFrame) -> DataFrame:
    """tiles with word: the bitmap in bits 32 to 63, the block column in bits 0 to 30."""
    return tiles.withColumn("word", F.shiftleft("bitmap", 32).bitwiseOR(F.col("bc")))


def unpack(tiles: DataFrame) -> DataFrame:
    """tiles with the bitmap, flag and block column of their word."""
    return tiles.withColumns({
        "u_bitmap": F.shiftrightunsigned("word", 32),
        "u_flag": F.shiftright("word", 31).bitwiseAND(F.lit(1)),
        "u_bc": F.col("word").bitwiseAND(F.lit(FLAG - 1)),
    })


def flagged(word: Column) -> Column:
    return word.bitwiseOR(F.lit(FLAG))


def unflagged(word: Column) -> Column:
    return word.bitwiseAND(F.bitwise_not(F.lit(FLAG)))


def decoded(tiles: DataFrame, br: int = BR, bc: int = BC, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tiles back to entries: the k-th set bit has the k-th value."""
    each = tiles.select(*keys, "br", "bc", "bitmap", "values", F.explode(F.lit(list(range(br * bc)))).alias("bit")).filter(F.call_function("getbit", F.col("bitmap"), F.col("bit")) == 1)
    bit = F.col("bit")
    below = F.call_function("shiftleft", F.lit(1).cast("long"), bit) - 1
    value = F.get("values", F.bit_count(F.col("bitmap").bitwiseAND(below)))
    return each.select(*keys, (F.col("br") * br + F.floor(bit / bc)).alias("row"), (F.col("bc") * bc + bit % bc).cast("long").alias("col"), value.alias("value"))


def value_pointers(shapes_: DataFrame) -> DataFrame:
    """shapes with val_ptr, the entries in tiles before each, in the order of block rows and block columns."""
    return running(shapes_, [*digits("br"), *digits("bc")], "val_ptr", F.bit_count("bitmap"))


def blockrow_coo(e: DataFrame, br: int = BR, bc: int = BC) -> DataFrame:
    """(br, packed, value): entries with block column and place in one number."""
    return e.select(F.expr(f"row DIV {br}").alias("br"), (F.expr(f"col DIV {bc}") * (br * bc) + bit_of(br, bc)).alias("packed"), "value")


def from_blockrow_coo(p: DataFrame, br: int = BR, bc: int = BC) -> DataFrame:
    cells = br * bc
    return p.select(
        (F.col("br") * br + F.expr(f"(packed % {cells}) DIV {bc}")).alias("row"), (F.expr(f"packed DIV {cells}") * bc + F.col("packed") % cells % bc).alias("col"), "value"
    )


def sliced(m: Matrix, height: int) -> DataFrame:
    """(slice, k, lane, col, value): rows in slices of height, padded to the longest with col -1 and value 0, column by column."""
    slice_, lane = F.expr(f"row DIV {height}").alias("slice"), (F.col("row") % height).cast("int").alias("lane")
    inside = m.entries.filter(F.col("row") < m.rows)
    held = running(inside, digits("col", max(m.cols, 1)), "k", group=("row",)).select(slice_, F.col("k").cast("int").alias("k"), lane, "col", "value")
    # Only what pads a row up to its slice's longest is made; entries stay where they are.
    lengths = m.entries.groupBy("row").agg(F.count("*").alias("n")).select(slice_, lane, "n")
    cells = F.collect_list(F.struct("lane", "n"))
    of = lengths.groupBy("slice").agg(F.max("n").alias("width"), F.map_from_entries(cells).alias("held"))
    lanes = of.withColumn("lane", F.explode(F.lit(list(range(height))))).filter(F.col("slice") * height + F.col("lane") < m.rows)
    short = lanes.withColumn("n", F.coalesce(F.try_element_at("held", F.col("lane")), F.lit(0))).filter("n < width")
    pads = short.select("slice", F.explode(F.sequence(F.col("n").cast("int"), (F.col("width") - 1).cast("int"))).alias("k"), "lane", F.lit(-1).cast("long").alias("col"), F.lit(0.0).alias("value"))
    return held.unionAll(pads)


def from_sliced(s: DataFrame, height: int) -> DataFrame:
    return s.filter("col >= 0").select((F.col("slice") * height + F.col("lane")).alias("row"), "col", "value")


def tile_violations(tiles: DataFrame, m: Matrix, br: int = BR, bc: int = BC) -> DataFrame:
    """(rule, n) of each broken rule of a tile table."""
    bad = {
        "popcount": F.bit_count("bitmap") != F.size("values"),
        "grid": (F.col("br") < 0) | (F.col("bc") < 0) | (F.col("br") * br >= m.rows) | (F.col("bc") * bc >= m.cols),
        "stored zero": F.exists("values", lambda v: v == 0),
    }
    # All rules are judged in one pass; places are met where tiles were made.
    place = tiles.groupBy("br", "bc").agg(F.count("*").alias("duplicate"), *[F.count_if(rule).alias(name) for name, rule in bad.items()])
    n = place.agg(*[F.sum(name).alias(name) for name in bad], F.count_if(F.col("duplicate") > 1).alias("duplicate"))
    return n.unpivot([], [*bad, "duplicate"], "rule", "n").filter("n > 0")
