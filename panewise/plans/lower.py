"""Lowering: a program and a DataFrame of events to one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import all_hold, first_match
from ..functions.uint import full, long, mask
from ..operators import folds, sets, sketch
from .expr import Expr, to_column, width_of
from .program import Assign, Local, Match, Program, ProgramError, Route, analyze
from .windows import Panes

#: Widths of packet fields that are not 32 bits (fixed values of the headers).
PACKET_WIDTHS = {
    "hdr.ethernet.dst_addr": 48, "hdr.ethernet.src_addr": 48, "hdr.ethernet.ether_type": 16,
    "hdr.ipv4.version": 4, "hdr.ipv4.ihl": 4, "hdr.ipv4.diffserv": 8, "hdr.ipv4.total_len": 16, "hdr.ipv4.identification": 16,
    "hdr.ipv4.flags": 3, "hdr.ipv4.frag_offset": 13, "hdr.ipv4.ttl": 8, "hdr.ipv4.protocol": 8, "hdr.ipv4.hdr_checksum": 16,
    "hdr.tcp.src_port": 16, "hdr.tcp.dst_port": 16, "hdr.tcp.data_offset": 4, "hdr.tcp.res": 4, "hdr.tcp.flags": 8,
    "hdr.tcp.window": 16, "hdr.tcp.checksum": 16, "hdr.tcp.urgent_ptr": 16,
    "hdr.udp.src_port": 16, "hdr.udp.dst_port": 16, "hdr.udp.hdr_length": 16, "hdr.udp.checksum": 16,
    "ig_intr_md.ingress_port": 9, "ig_intr_md.ingress_mac_tstamp": 48, "ig_intr_dprsr_md.drop_ctl": 3, "ig_intr_tm_md.ucast_egress_port": 9,
}


class Scope:
    """Names to columns; a dotted packet field is the flat column of that name, or the nested one."""

    def __init__(self, program: Program, df: DataFrame, sketches: dict[str, tuple[Panes, int, int]]):
        self.program, self.df, self.sketches = program, df, sketches
        self.locals = {s.name: s.width for s in program.body if isinstance(s, Local)}

    def width(self, name: str) -> int:
        return self.locals.get(name) or self.program.widths.get(name) or PACKET_WIDTHS.get(name, 32)

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.df.columns else F.col(".".join(f"`{p}`" for p in name.split(".")))

    def value(self, e: Expr) -> Column:
        return to_column(e, self.column, self.width)

    def key(self, e: Expr) -> Column:
        return self.value(e)

    def fitted(self, target: str, e: Expr) -> Column:
        """A value cut to the target's width."""
        bits = min(63, self.width(target))
        wide = width_of(e, self.width)
        return self.value(e) if wide is not None and wide <= bits else mask(self.value(e).cast("long"), bits)

    def assign(self, values: dict[str, Column]) -> None:
        self.df = self.df.withColumns(values)

    def old(self, name: str) -> Column:
        """The present value of an assigned name; fields that are new begin at 0."""
        known = name in self.df.columns
        if not known and "." in name:
            try:
                self.df.select(self.column(name)).schema  # noqa: B018
                known = True
            except Exception:  # noqa: BLE001 - no such nested field
                known = False
        return self.column(name) if known else long(0)


def run(program: Program, df: DataFrame, ts: str = "ts_ns", seq: str = "seq", tick: int = 1, strict: bool = False, sketches: dict[str, tuple[Panes, int, int]] | None = None) -> DataFrame:
    """Apply a program to events, exactly but for the sets that ``sketches`` names.

    ``ts``: integer time column in units of ``tick`` ns; ``seq``: a unique
    tie-break. Adds the program's locals and assigned fields as columns (dotted
    names are flat columns); rows and other columns stay. ``sketches``: panes,
    rows and log2 of slots (as ``sketch.choose`` gives them) of the sets to be
    answered approximately; their ``err`` must allow more than the truth.
    """
    analyze(program, strict)
    for name in sketches or {}:
        if name not in program.sets or program.sets[name].err not in ("super", "approx"):
            raise ProgramError(f"{name} is no set that may hold more than was added")
    scope = Scope(program, df, sketches or {})
    for s in program.body:
        match s:
            case Local():
                scope.assign({s.name: mask(scope.value(s.value).cast("long"), min(63, s.width))})
            case Assign():
                scope.assign({s.target: scope.fitted(s.target, s.value)})
            case Match():
                on = [scope.value(e) for e in s.on]
                targets = dict.fromkeys(a.target for _, actions in s.branches for a in actions)
                made = {}
                for t in targets:
                    old = scope.old(t)
                    branches = [(p, next((scope.fitted(t, a.value) for a in reversed(actions) if a.target == t), old)) for p, actions in s.branches]
                    made[t] = first_match(on, branches, old)
                if made:
                    scope.assign(made)
            case Route():
                scope.df = route(scope, s, ts, seq, tick)
    return scope.df


def route(scope: Scope, s: Route, ts: str, seq: str, tick: int) -> DataFrame:
    decl = scope.program.sets[s.set]
    on = [scope.value(e) for e in s.on]
    ops = {"add": sets.INSERT, "query": sets.QUERY, "add_query": sets.INSQUERY}
    nothing = F.lit(None).cast("string")
    op = first_match(on, [(p, F.lit(ops[c.api]) if c else nothing) for p, c in s.branches], nothing)
    columns = {sets.OP: op}
    names = []
    for k, _ in decl.keys:
        chain = first_match(on, [(p, scope.key(dict(c.keys)[k]) if c else F.lit(None)) for p, c in s.branches], F.lit(None))
        names.append(f"__key_{k}")
        columns[names[-1]] = chain
    result = s.into or "__none"
    before = scope.df.columns
    old = scope.old(result) if s.into else long(0)
    df = scope.df.withColumns(columns)
    args = (decl.window, ts, seq, result, old, tick)
    if s.set in scope.sketches:
        out = sketch.approximate(df, names, decl.kind, decl.window, scope.sketches[s.set], *args[1:])
    elif decl.kind == "ExistSet":
        out = sets.exist(df, names, *args)
    elif decl.kind == "CountSet":
        out = sets.count(df, names, *args)
    else:
        out = folds.fold(df, names, decl.fold, *args, scope.column, scope.width)
    keep = [*(c for c in before if c != result), *([result] if s.into else [])]
    return out.select(*(F.col(f"`{c}`") for c in keep))


__all__ = ["PACKET_WIDTHS", "Scope", "all_hold", "full", "run"]
