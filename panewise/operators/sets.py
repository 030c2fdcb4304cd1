"""Keyed windowed sets on DataFrames.

Input rows carry an operation (INSERT, QUERY, INSQUERY or null), key columns,
an integer time and a tie-break; the order is (time, tie-break). A query sees
what came strictly before it, an INSQUERY also itself.

Every operator deals rows by key *and* by a pane of time, so a hot key is
split over time; rows that the next pane must also see are sent there as
ghosts (once). Rows without an operation are spread by their tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uint import full, long
from ..plans import windows as w

INSERT, QUERY, INSQUERY = "INSERT", "QUERY", "INSQUERY"
OP, PANE, GHOST, SPREAD = "__op", "__pane", "__ghost", "__spread"
COUNT_TOP = full(32)


def adds() -> Column:
    return F.coalesce(F.col(OP).isin(INSERT, INSQUERY), F.lit(False))


def ticks(ns: int, tick: int) -> int:
    """A length in units of the time column."""
    return max(1, ns // tick) if ns else 0


def paned(df: DataFrame, ts: str, seq: str, pane: Column, ghosts: bool) -> DataFrame:
    """Add pane, ghost and spread columns; with ``ghosts`` each add also goes to the next pane."""
    out = df.withColumn(SPREAD, F.when(F.col(OP).isNull(), F.xxhash64(seq)))
    if not ghosts:
        return out.withColumn(PANE, pane).withColumn(GHOST, F.lit(False))
    both = F.when(adds(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return out.withColumn(GHOST, F.explode(both)).withColumn(PANE, pane + F.col(GHOST).cast("long"))


def parts(keys: list[str]) -> list[str]:
    return [*keys, PANE, SPREAD]


def finish(df: DataFrame, result: str, value: Column, old: Column, columns: list[str]) -> DataFrame:
    """Rows that asked get the value, the others keep the old result; ghosts go."""
    asked = F.col(OP).isin(QUERY, INSQUERY)
    made = df.withColumn("__value", F.when(asked, value).otherwise(old)).where(~F.col(GHOST))
    return made.select(*(F.col(f"`{c}`") for c in columns if c != result), F.col("__value").alias(result))


def frame(keys: list[str], ts: str, seq: str):
    """Rows of a part before the current one."""
    return Window.partitionBy(*parts(keys)).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, -1)


def exist(df: DataFrame, keys: list[str], window: w.Window, ts: str, seq: str, result: str, old: Column, tick: int = 1) -> DataFrame:
    """1 if an equal key was added in the window, else 0."""
    window, columns = w.normal(window), df.columns
    inserted = F.max(adds().cast("long"))
    match window:
        case w.Within():
            lo = ticks(window.lo, tick)
            rows = paned(df, ts, seq, F.floor(F.col(ts) / lo), ghosts=True)
            seen = F.last(F.when(adds(), F.col(ts)), ignorenulls=True).over(frame(keys, ts, seq)) >= F.col(ts) - lo
        case w.Since():
            rows = paned(df, ts, seq, F.floor(F.col(ts) / ticks(window.t, tick)), ghosts=False)
            seen = inserted.over(frame(keys, ts, seq)) == 1
        case w.Last():
            return last_pane(df, keys, window, ts, seq, result, old, tick, lambda n: (n > 0).cast("long"))
    value = F.when(F.col(OP) == INSQUERY, 1).otherwise(F.coalesce(seen, F.lit(False)).cast("long"))
    return finish(rows, result, value, old, columns)


def count(df: DataFrame, keys: list[str], window: w.Window, ts: str, seq: str, result: str, old: Column, tick: int = 1) -> DataFrame:
    """Adds of an equal key in the window, at most 2^32 - 1."""
    window, columns = w.normal(window), df.columns
    one = adds().cast("long")
    self_ = F.when(F.col(OP) == INSQUERY, 1).otherwise(0)
    match window:
        case w.Within():
            lo = ticks(window.lo, tick)
            rows = paned(df, ts, seq, F.floor(F.col(ts) / lo), ghosts=True)
            old_rows = Window.partitionBy(*parts(keys)).orderBy(ts).rangeBetween(Window.unboundedPreceding, -(lo + 1))
            number = F.coalesce(F.sum(one).over(frame(keys, ts, seq)), long(0)) - F.coalesce(F.sum(one).over(old_rows), long(0))
        case w.Since():
            rows = paned(df, ts, seq, F.floor(F.col(ts) / ticks(window.t, tick)), ghosts=False)
            number = F.coalesce(F.sum(one).over(frame(keys, ts, seq)), long(0))
        case w.Last():
            return last_pane(df, keys, window, ts, seq, result, old, tick, lambda n: F.least(n, long(COUNT_TOP)))
    return finish(rows, result, F.least(number + self_, long(COUNT_TOP)), old, columns)


def last_pane(df: DataFrame, keys: list[str], window: w.Last, ts: str, seq: str, result: str, old: Column, tick: int, value) -> DataFrame:
    """Over the previous whole pane only: adds are summed by (key, pane), then looked up."""
    columns = df.columns
    pane = F.floor(F.col(ts) / ticks(window.t, tick))
    rows = paned(df, ts, seq, pane, ghosts=False)
    names = [f"__k{i}" for i in range(len(keys))]
    before = df.where(adds()).groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), (pane + 1).alias("__p")).agg(F.count("*").alias("__n"))
    test = F.col(PANE) == F.col("__p")
    for k, n in zip(keys, names, strict=True):
        test = test & F.col(k).eqNullSafe(F.col(n))
    joined = rows.join(before, test & F.col(OP).isNotNull(), "left")
    return finish(joined, result, value(F.coalesce("__n", long(0))), old, columns)
