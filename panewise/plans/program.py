"""Programs as data, and a builder."""

from __future__ import annotations

import dataclasses

from ..functions.patterns import Wild
from . import windows
from .expr import Bin, Cond, Expr, Num, Un, Var

APIS = ("add", "query", "add_query")
CLASSES = {"ExistSet": "Exist", "CountSet": "Count", "FoldSet": "Fold"}


class ProgramError(ValueError):
    """A program that breaks a rule of the language."""


@dataclasses.dataclass(frozen=True)
class Fold:
    """Ordered fold: the first add sets ``init``, later ones ``update`` (over ``s.<field>`` of the old state); ``index`` is the result."""

    fields: tuple[str, ...]
    init: tuple[Expr, ...]
    update: tuple[Expr, ...]
    index: int = 0


@dataclasses.dataclass(frozen=True)
class SetDecl:
    name: str
    kind: str
    keys: tuple[tuple[str, int], ...]
    err: str
    window: windows.Window
    fold: Fold | None = None


@dataclasses.dataclass(frozen=True)
class Local:
    name: str
    width: int
    value: Expr


@dataclasses.dataclass(frozen=True)
class Assign:
    target: str
    value: Expr


@dataclasses.dataclass(frozen=True)
class Match:
    on: tuple[Expr, ...]
    branches: tuple[tuple[tuple, tuple[Assign, ...]], ...]


@dataclasses.dataclass(frozen=True)
class Call:
    api: str
    keys: tuple[tuple[str, Expr], ...]


@dataclasses.dataclass(frozen=True)
class Route:
    """A match whose branches add to or query one set; None: nothing happens."""

    set: str
    into: str | None
    on: tuple[Expr, ...]
    branches: tuple[tuple[tuple, Call | None], ...]


Statement = Local | Assign | Match | Route


@dataclasses.dataclass
class Program:
    sets: dict[str, SetDecl] = dataclasses.field(default_factory=dict)
    body: list[Statement] = dataclasses.field(default_factory=list)
    widths: dict[str, int] = dataclasses.field(default_factory=dict)  # of packet fields; 32 where none is given

    # builder

    def _expr(self, e) -> Expr:
        from .parse import parse_expr

        return e if isinstance(e, Expr) else Num(e) if isinstance(e, int) else parse_expr(e)

    def local(self, name: str, value=0, width: int = 32) -> Program:
        self.body.append(Local(name, width, self._expr(value)))
        return self

    def assign(self, target: str, value) -> Program:
        self.body.append(Assign(target, self._expr(value)))
        return self

    def _declare(self, name: str, kind: str, keys, err: str, window, fold: Fold | None = None) -> str:
        if name in self.sets:
            raise ProgramError(f"set {name} is declared twice")
        self.sets[name] = SetDecl(name, kind, tuple((k, 32) if isinstance(k, str) else k for k in keys), err, window, fold)
        return name

    def exist(self, name: str, keys, window, err: str = "super") -> str:
        return self._declare(name, "ExistSet", keys, err, window)

    def count(self, name: str, keys, window, err: str = "super") -> str:
        return self._declare(name, "CountSet", keys, err, window)

    def fold(self, name: str, keys, window, init: dict, update: dict, index: int = 0, err: str = "sub") -> str:
        fields = tuple(init)
        if set(fields) != set(update):
            raise ProgramError("init and update differ in fields")
        made = Fold(fields, tuple(self._expr(init[f]) for f in fields), tuple(self._expr(update[f]) for f in fields), index)
        return self._declare(name, "FoldSet", keys, err, window, made)

    def match(self, on, *branches) -> Program:
        """branches: (patterns, {target: value})"""
        made = tuple((tuple(p), tuple(Assign(t, self._expr(v)) for t, v in a.items())) for p, a in branches)
        self.body.append(Match(tuple(self._expr(e) for e in on), made))
        return self

    def route(self, name: str, on, *branches, into: str | None = None) -> Program:
        """branches: (patterns, api, {key: value}) or (patterns, None)"""
        made = tuple((tuple(b[0]), None if b[1] is None else Call(b[1], tuple((k, self._expr(v)) for k, v in b[2].items()))) for b in branches)
        self.body.append(Route(name, into, tuple(self._expr(e) for e in on), made))
        return self


def comparisons(e: Expr) -> list[Bin]:
    """The comparisons of a predicate."""
    match e:
        case Bin("&&" | "||", a, b):
            return comparisons(a) + comparisons(b)
        case Un("!", a):
            return comparisons(a)
        case Bin("==" | "!=" | "<" | ">" | "<=" | ">=", _, _):
            return [e]
    raise ProgramError(f"{e} is no predicate")


def linear(e: Expr) -> bool:
    """A sum or difference of variables and literals."""
    match e:
        case Num() | Var():
            return True
        case Bin("+" | "-", a, b):
            return linear(a) and linear(b)
    return False


def strict_fold(d: SetDecl) -> None:
    """What one stateful unit of the hardware can do: two state fields, two inputs, two linear comparisons, and conditionals only around whole expressions with one state field and one input each."""
    if len(d.fold.fields) > 2:
        raise ProgramError(f"{d.name}: at most two state fields")
    inputs, tests = set(), set()
    for e in (*d.fold.init, *d.fold.update):
        leaves = [e]
        if isinstance(e, Cond):
            leaves = [e.a, e.b]
            for c in comparisons(e.test):
                tests.add(c)
                if not (linear(c.a) and linear(c.b)):
                    raise ProgramError(f"{d.name}: {c} is not linear")
        inputs |= {n for n in e.names() if not n.startswith("s.")}
        for leaf in leaves:
            if holds_condition(leaf):
                raise ProgramError(f"{d.name}: a conditional inside an expression")
            names = set(leaf.names())
            if sum(n.startswith("s.") for n in names) > 1 or sum(not n.startswith("s.") for n in names) > 1:
                raise ProgramError(f"{d.name}: {leaf} has more than one state field or input")
    if len(tests) > 2 or len(inputs) > 2:
        raise ProgramError(f"{d.name}: at most two comparisons and two inputs")


def holds_condition(e: Expr) -> bool:
    return isinstance(e, Cond) or any(holds_condition(x) for x in vars(e).values() if isinstance(x, Expr))


def analyze(program: Program, strict: bool = False) -> Program:
    """Check the rules; with ``strict`` also those that only hardware needs."""
    locals_, used = set(), set()
    for d in program.sets.values():
        windows.check(d.window)
        if d.kind not in CLASSES or (d.kind == "FoldSet") != (d.fold is not None):
            raise ProgramError(f"{d.name}: bad class {d.kind}")
        if d.err not in ("super", "sub", "approx", "exact"):
            raise ProgramError(f"{d.name}: bad error direction {d.err}")
        if strict and ((d.kind != "FoldSet" and d.err in ("sub", "exact")) or (d.kind == "FoldSet" and d.err == "super")):
            raise ProgramError(f"{d.name}: {d.err} is not implemented for {d.kind}")
        if d.fold:
            if len(d.fold.init) != len(d.fold.update) or not 0 <= d.fold.index < len(d.fold.fields):
                raise ProgramError(f"{d.name}: bad fold")
            if strict:
                strict_fold(d)
            if any(n.startswith("s.") for e in d.fold.init for n in e.names()):
                raise ProgramError(f"{d.name}: init has no state")
            for e in d.fold.update:
                for n in e.names():
                    if n.startswith("s.") and n[2:] not in d.fold.fields:
                        raise ProgramError(f"{d.name}: no state field {n}")
    for s in program.body:
        match s:
            case Local():
                if s.name in locals_ or s.name in program.sets:
                    raise ProgramError(f"{s.name} is declared twice")
                locals_.add(s.name)
            case Match():
                for patterns, _ in s.branches:
                    if len(patterns) != len(s.on):
                        raise ProgramError("a branch needs a pattern for each value")
                if strict and any(not isinstance(e, Var) for e in s.on):
                    raise ProgramError("only variables can be matched")
            case Route():
                if s.set not in program.sets:
                    raise ProgramError(f"no set {s.set}")
                if s.set in used:
                    raise ProgramError(f"set {s.set} is used in two matches")
                used.add(s.set)
                keys = {k for k, _ in program.sets[s.set].keys}
                for patterns, call in s.branches:
                    if len(patterns) != len(s.on):
                        raise ProgramError("a branch needs a pattern for each value")
                    if call is None:
                        continue
                    if call.api not in APIS:
                        raise ProgramError(f"no call {call.api}")
                    if {k for k, _ in call.keys} != keys:
                        raise ProgramError(f"{s.set}: keys are {sorted(keys)}")
                    if call.api != "add" and s.into is None:
                        raise ProgramError(f"{s.set}: a query needs a result variable")
                    if strict and any(not isinstance(e, (Var, Num)) for _, e in call.keys):
                        raise ProgramError("keys are variables or literals")
    return program


def describe(program: Program) -> str:
    """The program as text."""
    lines = []
    for d in program.sets.values():
        fields = " ".join(f"int<{w}> {k};" for k, w in d.keys)
        agg = f"{CLASSES[d.kind]}()"
        lines.append(f"type {d.name}_key = {{ {fields} }}")
        if d.fold:
            own = " ".join(f"int<32> {f};" for f in d.fold.fields)
            lines.append(f"type {d.name}_state = {{ {own} }}")
            for what, arg, es in (("init", "", d.fold.init), ("upd", f", {d.name}_state s", d.fold.update)):
                ret = "; ".join(f"{f} = {e}" for f, e in zip(d.fold.fields, es, strict=True))
                lines.append(f"fun {d.name}_state {d.name}_{what}(pkt_type p{arg}) {{ return {{{ret}}}; }}")
            agg = f"Fold({d.name}_init, {d.name}_upd, {d.fold.index})"
        lines.append(f"global {d.kind}.t<{d.name}_key> {d.name} = {d.kind}.create({d.err}, {d.window}, {agg});")
    lines.append("handle pkt_in(pkt_type p) {")
    for s in program.body:
        match s:
            case Local():
                lines.append(f"  int<{s.width}> {s.name} = {s.value};")
            case Assign():
                lines.append(f"  {s.target} = {s.value};")
            case Match() | Route():
                lines.append(f"  match {', '.join(map(str, s.on))} with")
                for patterns, action in s.branches:
                    if isinstance(s, Match):
                        text = " ".join(f"{a.target} = {a.value};" for a in action)
                    elif action is None:
                        text = ""
                    else:
                        kind = program.sets[s.set].kind
                        keys = "; ".join(f"{k} = {v}" for k, v in action.keys)
                        text = ("" if action.api == "add" else f"{s.into} = ") + f"{kind}.{action.api}({s.set}, {{{keys}}});"
                    lines.append(f"  | {', '.join(map(str, patterns))} -> {{ {text} }}")
    return "\n".join([*lines, "}"])


def wild(n: int) -> tuple:
    return (Wild(),) * n
