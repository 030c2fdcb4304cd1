"""Unsigned fixed-width integers on BIGINT columns (widths up to 63 bits).

Values are kept in 0 .. 2^N - 1; every operation that can leave that range
wraps or saturates. All of it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WIDTH = 63
HASH_SEED = 2654435769
HASH_FACTOR = 1540483477  # under 2^31, so that no product passes 2^63


def full(width: int) -> int:
    """The largest value of a width."""
    if not 1 <= width <= MAX_WIDTH:
        raise ValueError(f"width {width} is not in 1..{MAX_WIDTH}")
    return (1 << width) - 1


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def mask(c: Column, width: int) -> Column:
    return c.bitwiseAND(long(full(width)))


def add(a: Column, b: Column, width: int = 32) -> Column:
    return mask(a + b, width)


def sub(a: Column, b: Column, width: int = 32) -> Column:
    return mask(a - b, width)


def neg(a: Column, width: int = 32) -> Column:
    return mask(-a, width)


def sat_add(a: Column, b: Column, width: int = 32) -> Column:
    return F.least(a + b, long(full(width)))


def sat_sub(a: Column, b: Column, width: int = 32) -> Column:
    return F.greatest(a - b, long(0))


def invert(a: Column, width: int = 32) -> Column:
    return mask(F.bitwise_not(a), width)


def shift_left(a: Column, n: int, width: int = 32) -> Column:
    return mask(F.shiftleft(a, n), width) if n < 64 else long(0)


def shift_right(a: Column, n: int) -> Column:
    return F.shiftrightunsigned(a, n) if n < 64 else long(0)


def bit_slice(a: Column, lo: int, hi: int) -> Column:
    """Bits lo..hi, both included, counted from the low end."""
    return mask(F.shiftrightunsigned(a, lo), hi - lo + 1)


def concat(a: Column, b: Column, b_width: int) -> Column:
    """The bits of a before those of b; results over 63 bits are refused where a program is checked."""
    return F.shiftleft(a, b_width).bitwiseOR(b)


def cast(a: Column, width: int) -> Column:
    return mask(a.cast("long"), width)


def ipv4_to_int(text: Column) -> Column:
    """Dotted quad to integer; null if it isn't one."""
    part = F.split(text, r"\.")
    byte = [part[i].cast("long") for i in range(4)]
    value = ((byte[0] * 256 + byte[1]) * 256 + byte[2]) * 256 + byte[3]
    whole = F.greatest(*byte) <= 255
    return F.when(text.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & whole, value)


def int_to_ipv4(value: Column) -> Column:
    return F.concat_ws(".", *(bit_slice(value, lo, lo + 7).cast("string") for lo in (24, 16, 8, 0)))


def mac_to_int(text: Column) -> Column:
    """A MAC address with any of ``: - .`` and white space between its digits."""
    return F.conv(F.regexp_replace(text, r"[:.\-\s]", ""), 16, 10).cast("long")


def in_prefixes(address: Column, prefixes: list[str]) -> Column:
    """Whether an integer address lies in one of the ``a.b.c.d/n`` prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        net, bits = p.split("/")
        keep = full(32) ^ ((1 << (32 - int(bits))) - 1)
        base = 0
        for part in net.split("."):
            base = base * 256 + int(part)
        hit = hit | (address.bitwiseAND(long(keep)) == base & keep)
    return hit


def hash32(seed: int, *keys: Column) -> Column:
    """A seeded 32-bit hash of integers (a null counts as 0): multiply and shift, in generated code, never over 63 bits."""
    h = long((seed * HASH_SEED + 1) & full(32))
    for k in keys:
        k = F.coalesce(k.cast("long"), long(0))
        for part in (mask(k, 32), F.shiftrightunsigned(k, 32)):
            h = mask(h.bitwiseXOR(part) * long(HASH_FACTOR), 32)
            h = h.bitwiseXOR(F.shiftrightunsigned(h, 15))
    return h


def slot(seed: int, bits: int, *keys: Column) -> Column:
    """A seeded hash of keys into 2^bits slots (32 bits at most)."""
    return F.shiftrightunsigned(hash32(seed, *keys), 32 - bits)
