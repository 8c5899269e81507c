"""Payloads of bitmap tiles as bytes: a code word of 1, 2, 4, 8 or 16 bits for each of the 32 cells of an 8 x 4 tile.

The code of cell k takes the bits from k * bits on, counted from the lowest bit of the first byte; cells without an entry have code 0.
So a code is found by its bit offset, and a payload of a tile has 4 * bits bytes, with two more before them where the tile has a scale.
Aggregates of words of 32 bits make them, one for every bit of a code word, so a tile is packed while its entries are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import distinct_upto
from ..functions.rounding import bf16, fp16, from_word16, word16
from ..matrix import Matrix
from .codecs import MOST_DISTINCT, block_floating
from .tiles import BC, BR, bit_of

WIDTHS = (1, 2, 4, 8, 16)
#: Bytes of a scale, a bf16 number.
SCALE_BYTES = 2
_CELLS = BR * BC


def payload_bytes(bits: int, scaled: bool = False) -> int:
    """Bytes of the payload of one tile."""
    if bits not in WIDTHS:
        raise ValueError(f"code words have {WIDTHS} bits, not {bits}")
    return _CELLS * bits // 8 + (SCALE_BYTES if scaled else 0)


def width_of(n: int) -> int:
    """The narrowest code words for n codes."""
    for bits in WIDTHS:
        if n <= 1 << bits:
            return bits
    raise ValueError(f"{n} codes do not fit 16 bits")


def _swapped(word: Column, size: int) -> Column:
    """A number with its lowest size bytes the other way round."""
    out = F.lit(0).cast("long")
    for k in range(size):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, 8 * k).bitwiseAND(F.lit(255)), 8 * (size - 1 - k)))
    return out


def _bytes(words: list[Column], size: int = 4) -> Column:
    """Words as little-endian bytes, one after the other."""
    digits = lambda w: F.substring(F.hex(_swapped(w.cast("long"), size).bitwiseOR(F.lit(1 << 8 * size))), 2, 2 * size)  # noqa: E731 - a bit above keeps zeros
    return F.unhex(F.concat(*[digits(w) for w in words]))


def packed(entries: DataFrame, bits: int, keys: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """Entries (row, col, code: a whole number of that many bits) to tiles (keys, kept, br, bc, bitmap, payload); kept: columns that are
    alike in a tile."""
    payload_bytes(bits)
    per, cell = 32 // bits, bit_of().cast("int")
    e = entries.select(*keys, *kept, F.expr(f"row DIV {BR}").alias("br"), F.expr(f"col DIV {BC}").alias("bc"), cell.alias("cell"), F.col("code").cast("long").alias("code"))
    at = F.call_function("shiftleft", F.col("code"), (F.col("cell") % per * bits).cast("int"))
    words = [F.bit_or(F.when((F.col("cell") / per).cast("int") == w, at).otherwise(0)).alias(f"w{w}") for w in range(bits)]
    t = e.groupBy(*keys, "br", "bc").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell"))).alias("bitmap"), *words, *[F.first(c).alias(c) for c in kept])
    return t.select(*keys, *kept, "br", "bc", "bitmap", _bytes([F.col(f"w{w}") for w in range(bits)]).alias("payload"))


def _number(payload: Column, first: Column | int, size: int) -> Column:
    """size bytes from first on (counted from 1) as a number."""
    return _swapped(F.conv(F.hex(payload.substr(first if isinstance(first, Column) else F.lit(first), F.lit(size))), 16, 10).cast("long"), size)


def unpacked(tiles: DataFrame, bits: int, keys: tuple[str, ...] = (), skip: int = 0) -> DataFrame:
    """Tiles to entries (keys, row, col, code); skip: bytes of a payload before its codes."""
    payload_bytes(bits)
    # Tiles have few entries: a code is read where it lies, from the one or two bytes that hold it.
    each = tiles.withColumn("cell", F.explode(F.lit(list(range(_CELLS))))).filter(F.call_function("getbit", F.col("bitmap"), F.col("cell")) == 1)
    held = _number(F.col("payload"), F.shiftright(F.col("cell") * bits, 3) + (skip + 1), max(1, bits // 8))
    code = F.call_function("shiftrightunsigned", held, F.col("cell") * bits % 8).bitwiseAND(F.lit((1 << bits) - 1))
    rest = [c for c in tiles.columns if c not in (*keys, "br", "bc", "bitmap", "payload")]
    row, col = F.col("br") * BR + F.floor(F.col("cell") / BC), F.col("bc") * BC + F.col("cell") % BC
    return each.select(*keys, *rest, row.alias("row"), col.cast("long").alias("col"), code.alias("code"))


def violations(tiles: DataFrame, bits: int, scaled: bool = False) -> DataFrame:
    """(rule, n): tiles whose payload has another size than its code words take, or that have codes where they have no entry."""
    size = F.octet_length("payload") != payload_bytes(bits, scaled)
    own = F.bit_count("bitmap")
    full = unpacked(tiles.filter(~size).withColumn("bitmap", F.bitwise_not("bitmap").bitwiseAND(F.lit((1 << _CELLS) - 1))), bits, skip=SCALE_BYTES if scaled else 0)
    found = [("payload size", tiles.filter(size)), ("code without entry", full.filter("code <> 0")), ("empty tile", tiles.filter(own == 0))]
    out = None
    for rule, rows in found:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionAll(one)
    return out.filter("n > 0")


# --- numbers of 16 bits, block floating point ---------------------------------------------------------------------------------


def word_tiles(m: Matrix, form: str) -> DataFrame:
    """Tiles of fp16 or bf16 numbers: 64 bytes each, zero where there is no entry."""
    code = word16({"fp16": fp16, "bf16": bf16}[form](F.col("value")), form)
    return packed(m.entries.select("row", "col", code.alias("code")), 16)


def from_word_tiles(tiles: DataFrame, form: str) -> DataFrame:
    return unpacked(tiles, 16).select("row", "col", from_word16(F.col("code").cast("int"), form).alias("value"))


def floating_tiles(m: Matrix, bits: int) -> DataFrame:
    """Tiles whose payload is a bf16 scale and whole numbers of 4 or 8 bits, in two's complement."""
    e = block_floating(m, (1 << (bits - 1)) - 1)
    code = F.col("q").cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    tiles = packed(e.select("row", "col", code.alias("code"), "scale"), bits, kept=("scale",))
    return tiles.select("br", "bc", "bitmap", F.concat(_bytes([word16(F.col("scale"), "bf16")], 2), "payload").alias("payload"))


def from_floating_tiles(tiles: DataFrame, bits: int) -> DataFrame:
    """The entries of tiles of scaled whole numbers."""
    scaled = tiles.withColumn("scale", from_word16(_number(F.col("payload"), 1, 2).cast("int"), "bf16"))
    e = unpacked(scaled, bits, skip=SCALE_BYTES)
    half = 1 << (bits - 1)
    q = F.when(F.col("code") >= half, F.col("code") - 2 * half).otherwise(F.col("code"))
    return e.select("row", "col", (q * F.col("scale")).alias("value"))


# --- dictionaries by first sight --------------------------------------------------------------------------


def interned(parts: list[DataFrame]) -> tuple[list[DataFrame], DataFrame, int] | None:
    """Entries (row, col, id) of each part, the codebook (id, value) and its number of values; None where they are over MOST_DISTINCT.

    A value's id is its place among the first sights of all values: by part, then in the order of tiles (block row, block column) and of
    cells. Values are told apart by their bits, so 0.0 and -0.0 are two. Only the codebook is ordered in one task, and sent."""
    minus = F.when(F.col("value").cast("string") == "-0.0", 1).otherwise(0)
    each = [
        p.select("row", "col", "value", minus.alias("minus"), F.struct(F.lit(k).alias("part"), F.expr(f"row DIV {BR}").alias("br"), F.expr(f"col DIV {BC}").alias("bc"), bit_of().alias("cell")).alias("seen"))
        for k, p in enumerate(parts)
    ]
    whole = each[0]
    for p in each[1:]:
        whole = whole.unionAll(p)
    n = whole.agg(distinct_upto(F.concat_ws(":", F.col("value").cast("string"), "minus"), MOST_DISTINCT)).first()[0]
    if n > MOST_DISTINCT:
        return None
    firsts = whole.groupBy("value", "minus").agg(F.min("seen").alias("seen"))
    book = firsts.select((F.row_number().over(Window.orderBy("seen")) - 1).cast("long").alias("id"), "value", "minus")
    sent = F.broadcast(book.select("id", F.col("value").alias("v"), F.col("minus").alias("m")))
    coded = [p.join(sent, (F.col("value") == F.col("v")) & (F.col("minus") == F.col("m"))).select("row", "col", "id") for p in each]
    exact = F.when(F.col("minus") == 1, F.lit(-0.0)).otherwise(F.col("value"))
    return coded, book.select("id", exact.alias("value"), "minus"), n


def joint_form(n: int | None) -> str:
    """How both parts of a hybrid split keep their values: n distinct ones, None if they are too many for a dictionary."""
    return "bfp8" if n is None else "dict_u8" if n <= 256 else "dict_u16"
