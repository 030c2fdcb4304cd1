"""Match patterns: wildcard, value, bit pattern, inclusive range."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column
from pyspark.sql import functions as F

from .uint import long


@dataclasses.dataclass(frozen=True)
class Wild:
    def test(self, c: Column) -> Column:
        return F.lit(True)

    def holds(self, x) -> bool:
        return True

    def __str__(self) -> str:
        return "_"


@dataclasses.dataclass(frozen=True)
class Eq:
    value: object

    def test(self, c: Column) -> Column:
        return c.eqNullSafe(F.lit(self.value))

    def holds(self, x) -> bool:
        return x == self.value

    def __str__(self) -> str:
        return str(self.value)


@dataclasses.dataclass(frozen=True)
class Bits:
    """First digit is the highest bit; ``*`` matches both."""

    digits: str

    def __post_init__(self) -> None:
        if not self.digits or set(self.digits) - set("01*") or len(self.digits) > 63:
            raise ValueError(f"bad bit pattern {self.digits!r}")

    @property
    def mask(self) -> int:
        return int("".join("0" if d == "*" else "1" for d in self.digits), 2)

    @property
    def value(self) -> int:
        return int(self.digits.replace("*", "0"), 2)

    def test(self, c: Column) -> Column:
        return F.coalesce(c.bitwiseAND(long(self.mask)) == self.value, F.lit(False))

    def holds(self, x) -> bool:
        return x & self.mask == self.value

    def __str__(self) -> str:
        return "0b" + self.digits


@dataclasses.dataclass(frozen=True)
class Range:
    lo: int
    hi: int

    def test(self, c: Column) -> Column:
        return F.coalesce(c.between(self.lo, self.hi), F.lit(False))

    def holds(self, x) -> bool:
        return self.lo <= x <= self.hi

    def __str__(self) -> str:
        return f"{self.lo} .. {self.hi}"


def all_hold(columns: list[Column], patterns: list) -> Column:
    out = F.lit(True)
    for c, p in zip(columns, patterns, strict=True):
        if not isinstance(p, Wild):
            out = out & p.test(c)
    return out


def first_match(columns: list[Column], branches: list[tuple[list, Column]], otherwise: Column) -> Column:
    """The value of the first branch whose patterns all hold."""
    chain = None
    for patterns, value in branches:
        test = all_hold(columns, patterns)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return otherwise if chain is None else chain.otherwise(otherwise)
