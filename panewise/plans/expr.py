"""Expressions over unsigned fixed-width integers.

One tree serves three uses: a Spark column, a value of a Python event loop
(ordered folds), and text.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import uint

ARITH = ("+", "-", "|+|", "|-|", "&", "|", "^", "<<", ">>", "++")
COMPARE = ("==", "!=", "<", ">", "<=", ">=")
LOGIC = ("&&", "||")


class Expr:
    def children(self) -> Iterator[Expr]:
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Expr):
                yield v

    def names(self) -> set[str]:
        return set().union(*(c.names() for c in self.children()), {self.name} if isinstance(self, Var) else set())


@dataclasses.dataclass(frozen=True)
class Num(Expr):
    value: int
    width: int | None = None

    def __str__(self) -> str:
        return f"{self.value}w{self.width}" if self.width else str(self.value)


@dataclasses.dataclass(frozen=True)
class Var(Expr):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclasses.dataclass(frozen=True)
class Un(Expr):
    op: str  # - ~ !
    a: Expr

    def __str__(self) -> str:
        return f"{self.op}({self.a})"


@dataclasses.dataclass(frozen=True)
class Bin(Expr):
    op: str
    a: Expr
    b: Expr

    def __str__(self) -> str:
        return f"({self.a} {self.op} {self.b})"


@dataclasses.dataclass(frozen=True)
class Cond(Expr):
    test: Expr
    a: Expr
    b: Expr

    def __str__(self) -> str:
        return f"({self.a} if {self.test} else {self.b})"


@dataclasses.dataclass(frozen=True)
class Slice(Expr):
    a: Expr
    lo: int
    hi: int

    def __str__(self) -> str:
        return f"{self.a}[{self.lo}:{self.hi}]"


@dataclasses.dataclass(frozen=True)
class Cast(Expr):
    width: int
    a: Expr

    def __str__(self) -> str:
        return f"((int<{self.width}>) {self.a})"


def width_of(e: Expr, widths: Callable[[str], int]) -> int | None:
    """Width in bits; None for an untyped literal."""
    match e:
        case Num():
            return e.width
        case Var():
            return widths(e.name)
        case Slice():
            return e.hi - e.lo + 1
        case Cast():
            return e.width
        case Un("!", _) | Bin("==" | "!=" | "<" | ">" | "<=" | ">=" | "&&" | "||", _, _):
            return 1
        case Un():
            return width_of(e.a, widths)
        case Bin("++", a, b):
            return (width_of(a, widths) or 32) + (width_of(b, widths) or 32)
        case Bin("<<" | ">>", a, _):
            return width_of(a, widths)
        case Bin(_, a, b) | Cond(_, a, b):
            known = [w for w in (width_of(a, widths), width_of(b, widths)) if w]
            return max(known) if known else None
    raise TypeError(e)


def to_column(e: Expr, column: Callable[[str], Column], widths: Callable[[str], int]) -> Column:
    go = lambda x: to_column(x, column, widths)
    bits = width_of(e, widths) or 32
    match e:
        case Num():
            return uint.long(e.value)
        case Var():
            return column(e.name)
        case Slice():
            return uint.bit_slice(go(e.a), e.lo, e.hi)
        case Cast():
            return uint.cast(go(e.a), e.width)
        case Un("!", a):
            return ~go(a)
        case Un("-", a):
            return uint.neg(go(a), bits)
        case Un("~", a):
            return uint.invert(go(a), bits)
        case Cond(t, a, b):
            return F.when(go(t), go(a)).otherwise(go(b))
        case Bin("<<", a, Num(n)):
            return uint.shift_left(go(a), n, bits)
        case Bin(">>", a, Num(n)):
            return uint.shift_right(go(a), n)
        case Bin("<<" | ">>", a, b):
            name = "shiftleft" if e.op == "<<" else "shiftrightunsigned"
            moved = uint.mask(F.call_function(name, go(a), go(b).cast("int")), bits)
            return F.when(go(b) < bits, moved).otherwise(uint.long(0))
        case Bin("++", a, b):
            return uint.concat(go(a), go(b), width_of(b, widths) or 32)
        case Bin(op, a, b):
            x, y = go(a), go(b)
            return {
                "+": lambda: uint.add(x, y, bits), "-": lambda: uint.sub(x, y, bits),
                "|+|": lambda: uint.sat_add(x, y, bits), "|-|": lambda: uint.sat_sub(x, y, bits),
                "&": lambda: x.bitwiseAND(y), "|": lambda: x.bitwiseOR(y), "^": lambda: x.bitwiseXOR(y),
                "==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y,
                "&&": lambda: x & y, "||": lambda: x | y,
            }[op]()
    raise TypeError(e)


def evaluate(e: Expr, value: Callable[[str], int], widths: Callable[[str], int]) -> int | bool:
    go = lambda x: evaluate(x, value, widths)
    top = (1 << (width_of(e, widths) or 32)) - 1
    match e:
        case Num():
            return e.value
        case Var():
            return value(e.name)
        case Slice():
            return go(e.a) >> e.lo & top
        case Cast():
            return go(e.a) & top
        case Un("!", a):
            return not go(a)
        case Un("-", a):
            return -go(a) & top
        case Un("~", a):
            return ~go(a) & top
        case Cond(t, a, b):
            return go(a) if go(t) else go(b)
        case Bin("&&", a, b):
            return go(a) and go(b)
        case Bin("||", a, b):
            return go(a) or go(b)
        case Bin("++", a, b):
            return go(a) << (width_of(b, widths) or 32) | go(b)
        case Bin(op, a, b):
            x, y = go(a), go(b)
            match op:
                case "+":
                    return x + y & top
                case "-":
                    return x - y & top
                case "|+|":
                    return min(x + y, top)
                case "|-|":
                    return max(x - y, 0)
                case "&":
                    return x & y
                case "|":
                    return x | y
                case "^":
                    return x ^ y
                case "<<":
                    return x << y & top if y < 64 else 0
                case ">>":
                    return x >> y
                case "==":
                    return x == y
                case "!=":
                    return x != y
                case "<":
                    return x < y
                case ">":
                    return x > y
                case "<=":
                    return x <= y
                case ">=":
                    return x >= y
    raise TypeError(e)
