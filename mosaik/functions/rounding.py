"""Columns rounded as narrower number formats would, by exact arithmetic on powers of two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_float(v: Column) -> Column:
    return v.cast("float").cast("double")


def exponent(f: Column) -> Column:
    """floor(log2(abs f)), exactly, for single-precision f other than 0: the next number below a power of two has a logarithm that
    is less by 8e-8, far more than a logarithm of double precision is wrong by. Short, as rounding uses it several times over."""
    return F.floor(F.log2(F.abs(f)) + F.lit(1e-10)).cast("int")


def _to_unit(f: Column, least: int, digits: int, half: str = "even") -> Column:
    u = F.pow(F.lit(2.0), F.greatest(exponent(f), F.lit(least)) - digits)
    q = f / u
    whole = F.rint(q) if half == "even" else F.signum(q) * F.floor(F.abs(q) + 0.5)
    return F.when(f == 0, f).otherwise(whole * u)


def bf16(v: Column) -> Column:
    """Nearest 8-bit significand with a float's range; ties to even."""
    return _to_unit(as_float(v), -126, 7)


def bf16_half_up(v: Column) -> Column:
    """As bf16, with ties away from zero."""
    return _to_unit(as_float(v), -126, 7, "away")


def fp16(v: Column) -> Column:
    """Nearest half-precision number; infinite from 65520."""
    f = as_float(v)
    return F.when(F.abs(f) >= 65520, F.signum(f) * F.lit(float("inf"))).otherwise(_to_unit(f, -14, 10))


#: Bits of the significand and the bias of the exponent of the 16-bit formats.
WORDS = {"fp16": (10, 15), "bf16": (7, 127)}


def word16(f: Column, form: str) -> Column:
    """The 16 bits of a number that is already rounded to the form, as a whole number."""
    digits, bias = WORDS[form]
    a, top = F.abs(f), 1 << digits
    x = exponent(f)
    normal = (x + bias) * top + (a / F.pow(F.lit(2.0), x) - 1) * top
    small = a * F.lit(2.0 ** (bias - 1 + digits))
    bits = F.when(a == 0, 0).when(a == float("inf"), (2 * bias + 1) * top).when(a < 2.0 ** (1 - bias), small).otherwise(normal)
    return bits.cast("int") + F.when(f < 0, 1 << 15).otherwise(0)


def from_word16(w: Column, form: str) -> Column:
    """The number that 16 bits stand for."""
    digits, bias = WORDS[form]
    top = 1 << digits
    e, rest = F.shiftright(w.bitwiseAND(F.lit(0x7FFF)), digits), w.bitwiseAND(F.lit(top - 1))
    a = F.when(e == 0, rest * F.lit(2.0 ** (1 - bias - digits))).when(e == 2 * bias + 1, F.lit(float("inf")))
    a = a.otherwise((rest / F.lit(float(top)) + 1) * F.pow(F.lit(2.0), (e - bias).cast("double")))
    return F.when(w >= 1 << 15, -a).otherwise(a)


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def ceil_log2(n: Column) -> Column:
    """Bits that number n things."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")
