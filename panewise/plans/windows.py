"""Time constructs and the geometry of panes."""

from __future__ import annotations

import dataclasses

NS = {"nanosec": 1, "microsec": 1_000, "millisec": 1_000_000, "sec": 1_000_000_000, "min": 60_000_000_000, "hour": 3_600_000_000_000}
MAX_LOG2 = 48
#: Most units in all panes of a set together.
MAX_UNITS = 1 << 16
#: Most panes of a set.
MAX_PANES = 16


@dataclasses.dataclass(frozen=True)
class Within:
    """Anything added at most ``lo`` ns ago counts, nothing older than ``hi`` may."""

    lo: int
    hi: int

    def __str__(self) -> str:
        return f"within(nanosec({self.lo}), nanosec({self.hi}))"


@dataclasses.dataclass(frozen=True)
class Since:
    t: int

    def __str__(self) -> str:
        return f"since(nanosec({self.t}))"


@dataclasses.dataclass(frozen=True)
class Last:
    t: int

    def __str__(self) -> str:
        return f"last(nanosec({self.t}))"


Window = Within | Since | Last


def check(w: Window) -> Window:
    values = (w.lo, w.hi) if isinstance(w, Within) else (w.t,)
    if any(not isinstance(v, int) or isinstance(v, bool) for v in values):
        raise ValueError("window lengths are whole numbers of nanoseconds")
    if values[0] < 0 or values[-1] <= 0 or (isinstance(w, Within) and w.lo > w.hi):
        raise ValueError(f"bad window {w}")
    if any(v >= 1 << MAX_LOG2 for v in values):
        raise ValueError(f"window lengths are under 2^{MAX_LOG2} ns")
    return w


def normal(w: Window) -> Window:
    """within(0, hi) is since(hi)."""
    return Since(w.hi) if isinstance(check(w), Within) and w.lo == 0 else w


@dataclasses.dataclass(frozen=True)
class Panes:
    """``count`` panes of ``units`` units of 2^log2 ns."""

    count: int
    units: int
    log2: int

    @property
    def length(self) -> int:
        return self.units << self.log2


def panes(w: Window, count: int, fold: bool = False) -> Panes | None:
    """The unit that fits a window best with so many panes, the larger unit of equals; None if none fits."""
    w = normal(w)
    best: tuple[int, int, Panes] | None = None
    for log2 in range(1, MAX_LOG2):
        unit = 1 << log2
        if isinstance(w, Within):
            spans = count - 2
            if spans < 1:
                return None
            tries = [-(-w.lo // (unit * spans))]
            goal, most = w.lo, w.hi
            cover = count if fold else count - 1
        else:
            spans, goal, most, cover = 1, w.t, None, 1
            tries = [w.t // unit, -(-w.t // unit)]
        for units in tries:
            if not units or units * count > MAX_UNITS or (most is not None and unit * units * cover > most):
                continue
            off = abs(unit * units * spans - goal)
            if best is None or off < best[0] or (off == best[0] and log2 > best[1]):
                best = off, log2, Panes(count, units, log2)
    return best[2] if best else None


def pane_counts(w: Window, fold: bool = False) -> list[int]:
    """Numbers of panes that a window may have."""
    w = normal(w)
    if isinstance(w, Within):
        slack = (w.hi - w.lo) // 2 if fold else w.hi - w.lo
        return [] if slack <= 0 else list(range(-(-w.lo // slack) + 2, MAX_PANES + 1))
    return [{Since: (2, 1), Last: (3, 2)}[type(w)][fold]]


def pane_number(ts: int, first: int, p: Panes) -> int:
    """Pane of a time on a clock that starts with the first event."""
    return ((ts >> p.log2) - (first >> p.log2)) // p.units
