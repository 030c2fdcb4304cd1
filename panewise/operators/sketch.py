"""Sketches: error models, choice of sizes, and (pane, row, slot) forms on DataFrames.

A sketch holds one fixed-size table for each pane and row, so its state does
not grow with the keys. Contracts: Bloom answers are a superset of the truth,
count-min answers an upper bound, the fold table (one owner for each slot)
a subset.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uint import hash32, long, mask, slot
from ..plans import windows as w
from ..plans.expr import to_column
from ..plans.program import Fold
from . import folds, sets
from .sets import INSQUERY, OP

#: Distinct keys in a minute where no statistics are given.
DEFAULT_KEYS = (60_000_000_000, 57060.0)


def keys_in(span: int, statistics: tuple[int, float] = DEFAULT_KEYS) -> float:
    return statistics[1] / statistics[0] * span


def bloom_fpr(slots: float, keys: float, rows: int, panes: int) -> float:
    """Chance that a key that was never added is found in one of the panes."""
    filled = 1 - (1 - 1 / slots) ** (keys / panes)
    return 1 - (1 - filled**rows) ** panes


def cms_error(slots: float, rows: int) -> float:
    delta, epsilon = math.exp(-rows), math.e / slots
    return delta + (1 - delta) * epsilon


def fold_table_error(slots: float, keys: float, rows: int, fingerprints: int, key_bits: int) -> float:
    """Share of keys that a table with one owner a slot gets wrong; no fingerprint: the key is the place."""
    if fingerprints == 0:
        return 0.0
    total = 1 << 16
    wrong = 0.0
    for r in range(rows):
        here = keys * (total * (r + 1) // rows - total * r // rows) / total
        filled = slots * (1 - (1 - 1 / slots) ** here)
        each = here / filled if filled else 1.0
        clear = 1.0 if fingerprints == -(-key_bits // 32) else (1 - 2.0 ** (-32 * fingerprints)) ** (each - 1)
        wrong += filled * (clear * (each - 1) + (1 - clear) * each)
    return wrong / keys


def choose(window: w.Window, kind: str, cells: int, statistics: tuple[int, float] = DEFAULT_KEYS, most_rows: int = 8) -> tuple[float, w.Panes, int, int]:
    """The least predicted error within ``cells`` cells: error, panes, rows, log2 of slots."""
    span = w.normal(window)
    length = span.hi if isinstance(span, w.Within) else span.t
    best = None
    for count in w.pane_counts(window):
        panes = w.panes(window, count)
        if panes is None:
            continue
        for rows in range(1, most_rows + 1):
            bits = (cells // (count * rows)).bit_length() - 1
            if bits < 1 or (kind == "CountSet" and count * rows > 16):
                continue
            slots = float(1 << bits)
            error = bloom_fpr(slots, keys_in(length, statistics), rows, max(1, count - 1)) if kind == "ExistSet" else cms_error(slots, rows)
            found = (error, count, rows, panes, bits)
            if best is None or found[:3] < best[:3]:
                best = found
    if best is None:
        raise ValueError(f"no panes fit {window}")
    return best[0], best[3], best[2], best[4]


def pane_column(ts: str, pane_ticks: int) -> Column:
    return F.floor(F.col(ts) / pane_ticks)


def cells(adds: DataFrame, keys: list[str], ts: str, pane_ticks: int, rows: int, bits: int) -> DataFrame:
    """pane, row, slot, n: the sketch of the adds. Summed before it is shuffled."""
    places = F.array(*(F.struct(F.lit(r).alias("row"), slot(r + 1, bits, *map(F.col, keys)).alias("slot")) for r in range(rows)))
    return adds.select(pane_column(ts, pane_ticks).alias("pane"), F.explode(places).alias("at")).groupBy("pane", "at.row", "at.slot").agg(F.count("*").alias("n"))


def look_up(queries: DataFrame, sketch: DataFrame, keys: list[str], ts: str, pane_ticks: int, panes: int, rows: int, bits: int, seq: str, result: str, counts: bool) -> DataFrame:
    """Read whole panes p - panes + 1 .. p: membership is any pane with all rows, a count the sum of row minima."""
    places = F.array(*(F.struct(F.lit(r).alias("row"), slot(r + 1, bits, *map(F.col, keys)).alias("slot")) for r in range(rows)))
    asked = queries.select(seq, pane_column(ts, pane_ticks).alias("p"), F.explode(places).alias("at")).select(seq, "at.row", "at.slot", F.explode(F.sequence(F.col("p") - panes + 1, F.col("p"))).alias("pane"))
    found = asked.join(sketch, ["pane", "row", "slot"]).groupBy(seq, "pane").agg(F.count("*").alias("hit"), F.min("n").alias("n"))
    whole = found.where(F.col("hit") == rows).groupBy(seq).agg(F.sum("n").alias("n"))
    value = F.coalesce("n", long(0))
    return queries.join(whole, seq, "left").withColumn(result, F.least(value, long((1 << 32) - 1)) if counts else (value > 0).cast("long")).drop("n")


def approximate(df: DataFrame, keys: list[str], kind: str, window: w.Window, size: tuple[w.Panes, int, int], ts: str, seq: str, result: str, old: Column, tick: int) -> DataFrame:
    """A routed Exist or Count set answered from a Bloom filter or count-min sketch of ``size`` (panes, rows, log2 of slots).

    A query reads all panes but the one being cleared: whole earlier panes,
    and of its own what came before it. ``since`` reads its own pane, ``last``
    the one before. A null key counts as 0 in the hashes, which keeps the
    contract (a superset of the members, an upper bound of the counts).
    """
    if kind not in ("ExistSet", "CountSet"):
        raise ValueError("Exist and Count sets have sketches; for folds see fold_table")
    panes, rows, bits = size
    length = -(-panes.length // tick)
    last = isinstance(w.normal(window), w.Last)
    offsets = {w.Since: [0], w.Last: [1]}.get(type(w.normal(window)), list(range(panes.count - 1)))
    places = F.array(*(F.struct(F.lit(r).alias("row"), slot(r + 1, bits, *map(F.col, keys)).alias("slot")) for r in range(rows)))
    routed = df.where(F.col(OP).isNotNull()).select(OP, F.col(ts).alias("__t"), F.col(seq).alias("__q"), pane_column(ts, length).alias("__pane"), F.explode(places).alias("__at"))
    at = routed.select(OP, "__t", "__q", "__pane", F.col("__at.row").alias("__row"), F.col("__at.slot").alias("__slot"))
    cell, asked = ["__pane", "__row", "__slot"], F.col(OP) != sets.INSERT
    read = []
    if 0 in offsets:
        before = Window.partitionBy(*cell).orderBy("__t", "__q").rowsBetween(Window.unboundedPreceding, -1)
        read.append(at.withColumn("__n", F.sum(sets.adds().cast("long")).over(before)).where(asked))
    if any(offsets):
        whole = at.where(sets.adds()).groupBy(*cell).agg(F.count("*").alias("__n"))
        earlier = F.explode(F.array(*(F.col("__pane") - o for o in offsets if o)))
        read.append(at.where(asked).withColumn("__pane", earlier).join(whole, cell))
    found = read[0].select("__q", *cell, "__n")
    for more in read[1:]:
        found = found.union(more.select(found.columns))
    hits = found.where("__n > 0").groupBy("__q", "__pane").agg(F.count("*").alias("__hit"), F.min("__n").alias("__n"))
    total = hits.where(F.col("__hit") == rows).groupBy("__q").agg(F.sum("__n").alias("__n"))
    n = F.coalesce("__n", long(0)) + F.when((F.col(OP) == INSQUERY) & F.lit(not last), 1).otherwise(0)
    value = F.least(n, long(sets.COUNT_TOP)) if kind == "CountSet" else (n > 0).cast("long")
    made = df.join(total, F.col(f"`{seq}`") == F.col("__q"), "left").withColumn("__value", F.when(F.col(OP).isin(sets.QUERY, INSQUERY), value).otherwise(old))
    return made.select(*(F.col(f"`{c}`") for c in df.columns if c != result), F.col("__value").alias(result))


def owners(adds: DataFrame, keys: list[str], ts: str, seq: str, pane_ticks: int, rows: int, bits: int) -> DataFrame:
    """Fold table: the first key of each (pane, row, slot) owns it; a key's row comes from its hash."""
    row = F.pmod(hash32(0, *map(F.col, keys)), long(rows))
    placed = adds.select(pane_column(ts, pane_ticks).alias("pane"), row.alias("row"), slot(1, bits, *map(F.col, keys)).alias("slot"), F.struct(F.col(ts).alias("t"), F.col(seq).alias("q"), *(F.col(k).alias(k) for k in keys)).alias("k"))
    return placed.groupBy("pane", "row", "slot").agg(F.min("k").alias("owner")).select("pane", "row", "slot", *(F.col(f"owner.{k}").alias(k) for k in keys))


def fold_table(adds: DataFrame, keys: list[str], spec: Fold, ts: str, seq: str, pane_ticks: int, rows: int, bits: int, result: str) -> DataFrame:
    """pane, keys, state of the fold: a table of cells, each with one owner a pane.

    A pane finds all cells expired. The first add of an expired cell sets its
    key and ``init``; adds of that key are ``update``; adds of other keys are
    ignored while the cell lives. Counters, first and last values are summed up
    before the shuffle; other shapes need an order of all adds and are refused.
    """
    found = folds.shape(spec)
    if found is None or found[0] == "falls":
        raise ValueError("a fold table takes counters, first and last values")
    cut = lambda name: mask(F.col(f"`{name}`").cast("long"), 32)
    value = lambda e: mask(to_column(e, cut, lambda n: 32).cast("long"), 32)
    when = F.struct(F.col(ts).alias("t"), F.col(seq).alias("q"))
    n = F.count("*")
    match found:
        case ("counter", init, step):
            state = mask(long(init) + (n - 1) * step, 32)
        case ("first", init):
            state = F.min_by(value(init), when)
        case ("last", init, update):
            state = F.when(n == 1, F.min_by(value(init), when)).otherwise(F.max_by(value(update), when))
    own = owners(adds, keys, ts, seq, pane_ticks, rows, bits)
    return adds.withColumn("pane", pane_column(ts, pane_ticks)).groupBy("pane", *keys).agg(state.alias(result)).join(own.select("pane", *keys), ["pane", *keys], "left_semi")


def statistics(adds: DataFrame, keys: list[str], ts: str, pane_ticks: int) -> DataFrame:
    """pane, distinct_keys: the workload that sizes are chosen for."""
    return adds.groupBy(pane_column(ts, pane_ticks).alias("pane")).agg(F.count_distinct(*map(F.col, keys)).alias("distinct_keys"))


def measured(adds: DataFrame, keys: list[str], ts: str, pane_ticks: int, tick: int) -> tuple[int, float]:
    """Statistics as ``choose`` takes them: the length of a pane in ns, and the mean of distinct keys in it."""
    mean = statistics(adds, keys, ts, pane_ticks).agg(F.avg("distinct_keys")).first()[0]  # one number
    return pane_ticks * tick, float(mean or 0)


__all__ = ["Window", "approximate", "bloom_fpr", "cells", "choose", "cms_error", "fold_table", "fold_table_error", "look_up", "measured", "owners", "statistics"]
