"""Ordered folds by key.

Common shapes become window functions: a counter, the first value, the last
value, and a count of falls against the value before. Other folds scan each
part once in order, row by row, in Arrow batches. A part is a key and a pane
of time.

A ``since`` state begins at an add that finds none alive (its anchor) and
lives for the window's length. Anchors follow from each other, so they are
found in one ordered pass over each key's add times alone; rows then learn
their anchor, which is in their own pane or the one before, and the fold of
each anchor is made as any other.

A query of a key without a live state gives 0.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.uint import long, mask
from ..plans import windows as w
from ..plans.expr import Bin, Cond, Expr, Num, Var, evaluate, to_column, width_of
from ..plans.program import Fold
from . import sets
from .sets import GHOST, INSQUERY, OP, PANE, adds, finish, frame, paned, parts, ticks

TOP = (1 << 32) - 1
ANCHOR, MARK = "__anchor", "__mark"
#: Times handled at once; this many windows of the longest length stay within 64 bits.
TIMES = 1 << 13


def shape(fold: Fold) -> tuple | None:
    """Name and arguments of the native form of a fold, if it has one."""
    init, upd = fold.init[fold.index], fold.update[fold.index]
    own = Var(f"s.{fold.fields[fold.index]}")
    state = lambda e: any(n.startswith("s.") for n in e.names())
    if upd == own:
        return ("first", init)
    if not state(upd):
        return ("last", init, upd)
    match upd:
        case Bin("+", a, Num(step)) if a == own and isinstance(init, Num):
            return ("counter", init.value, step)
        case Bin("+", Num(step), a) if a == own and isinstance(init, Num):
            return ("counter", init.value, step)
        case Cond(Bin(">", Var(other), now), Bin("+", a, Num(step)), b) if a == own and b == own and isinstance(init, Num) and other.startswith("s.") and other != own.name and not state(now):
            k = fold.fields.index(other[2:])
            if fold.update[k] == now and fold.init[k] == now:
                return ("falls", init.value, step, now)
    return None


def native(df: DataFrame, keys: list[str], fold: Fold, window: w.Window, ts: str, seq: str, result: str, old: Column, tick: int, column, widths) -> DataFrame | None:
    """The fold as window functions, if its shape and window allow."""
    window, found = w.normal(window), shape(fold)
    if found is None:
        return None
    if found[0] == "falls" and not isinstance(found[3], Var) and (width_of(found[3], widths) or 32) > 32:
        return None  # a state holds 32 bits of it, the comparison all
    cut = lambda name: mask(column(name).cast("long"), 32)  # noqa: E731  inputs and states have 32 bits
    value_of = lambda e: mask(to_column(e, cut, widths).cast("long"), 32)
    columns, lo = df.columns, ticks(window.lo if isinstance(window, w.Within) else window.t, tick)
    rows = df.withColumn("__in", value_of(found[-1]) if found[0] != "counter" else long(0))
    if found[0] == "last":
        rows = rows.withColumn("__first", value_of(found[1]))
    rows = anchored(rows, keys, ts, seq, lo) if isinstance(window, w.Since) else paned(rows, ts, seq, F.floor(F.col(ts) / lo), ghosts=True)
    part = parts(keys)
    if not isinstance(window, w.Within):
        own = [*part, ANCHOR] if isinstance(window, w.Since) else part
        if found[0] == "falls":
            before = Window.partitionBy(*own).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, -1)
            above = F.last(F.when(adds(), F.col("__in")), ignorenulls=True).over(before)
            rows = rows.withColumn("__fall", F.when(adds() & (above > F.col("__in")), 1).otherwise(0))
        live, value = so_far(found, own, ts, seq)
        if isinstance(window, w.Since):
            live = live & F.col(ANCHOR).isNotNull()
        else:  # the pane before, whose adds came as ghosts, must have one
            upto = Window.partitionBy(*part).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
            live = live & (F.max(F.col(GHOST).cast("int")).over(upto) == 1)
        return finish(rows, result, F.when(live, value).otherwise(0), old, columns)
    added, mine = adds().cast("long"), F.col(OP) == INSQUERY
    upto = Window.partitionBy(*part).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    old_rows = Window.partitionBy(*part).orderBy(ts).rangeBetween(Window.unboundedPreceding, -(lo + 1))
    expired = F.coalesce(F.sum(added).over(old_rows), long(0))
    # adds are numbered within the part; those up to ``expired`` have left the window
    rows = rows.withColumn("__n", F.coalesce(F.sum(added).over(upto), long(0)) - F.when(adds() & ~mine, 1).otherwise(0)).withColumn("__old", expired)
    size = F.col("__n") - F.col("__old")
    if found[0] == "counter":
        value = mask(long(found[1]) + (size - 1) * found[2], 32)
    elif found[0] == "falls":
        before = F.last(F.when(adds(), F.col("__in")), ignorenulls=True).over(frame(keys, ts, seq))
        rows = rows.withColumn("__fall", F.when(adds() & (before > F.col("__in")), 1).otherwise(0))
        rows = rows.withColumn("__all", F.sum("__fall").over(upto) - F.when(adds() & ~mine, F.col("__fall")).otherwise(0))
        # falls before the window and at its first add do not count
        rows = rows.withColumn("__lost", F.coalesce(F.sum("__fall").over(old_rows), long(0)))
        in_window = Window.partitionBy(*part).orderBy(ts).rangeBetween(-lo, 0)
        head = F.first(F.when(adds(), F.struct(F.col(seq).alias("q"), F.col("__fall").alias("f"))), ignorenulls=True).over(in_window)
        value = long(found[1]) + (F.col("__all") - F.col("__lost") - F.coalesce(head["f"], long(0))) * found[2]
        value = mask(value, 32)
    elif found[0] == "first":
        in_window = Window.partitionBy(*part).orderBy(ts).rangeBetween(-lo, 0)
        value = F.first(F.when(adds(), F.col("__in")), ignorenulls=True).over(in_window)
    else:
        # the last add, by the update but for the first of the window
        latest = F.last(F.when(adds(), F.struct(F.col("__in").alias("u"), F.col("__first").alias("i"))), ignorenulls=True)
        kept = F.when(mine, F.struct(F.col("__in").alias("u"), F.col("__first").alias("i"))).otherwise(latest.over(frame(keys, ts, seq)))
        value = F.when(size == 1, kept["i"]).otherwise(kept["u"])
    return finish(rows, result, F.when(size > 0, value).otherwise(0), old, columns)


def so_far(found: tuple, part: list[str], ts: str, seq: str) -> tuple[Column, Column]:
    """If a part has an add up to the row, and the fold of its adds up to there."""
    order = Window.partitionBy(*part).orderBy(ts, seq)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    mine, added = F.col(OP) == INSQUERY, adds().cast("long")
    size = F.coalesce(F.sum(added).over(before), long(0)) + F.when(mine, 1).otherwise(0)
    of = lambda c: F.when(adds(), c)
    if found[0] == "counter":
        value = mask(long(found[1]) + (size - 1) * found[2], 32)
    elif found[0] == "first":
        value = F.first(of(F.col("__in")), ignorenulls=True).over(upto)
    elif found[0] == "last":
        both = F.struct(F.col("__in").alias("u"), F.col("__first").alias("i"))
        kept = F.when(mine, both).otherwise(F.last(of(both), ignorenulls=True).over(before))
        value = F.when(size == 1, kept["i"]).otherwise(kept["u"])
    else:
        fallen = F.coalesce(F.sum("__fall").over(before), long(0)) + F.when(mine, F.col("__fall")).otherwise(0)
        value = mask(long(found[1]) + fallen * found[2], 32)
    return size > 0, value


def anchors(added: DataFrame, keys: list[str], ts: str, length: int) -> DataFrame:
    """keys and time of the adds that begin a state: a key's first, and always the next one ``length`` or more later.

    Only keys and times are dealt, by key, and pass in order in constant
    memory. Gaps of ``length`` or more count as ``length``: the add after one
    begins a state, as the first of a key does, so a batch of many keys is one
    sequence in which each add's successor is found at once.
    """
    n_keys, n = len(keys), int(added.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, time, past = None, 0, 0  # of the last add; past: how long after its anchor it came
        for batch in batches:
            for i in range(0, batch.num_rows, TIMES):
                b = batch.slice(i, TIMES)
                t = b.column(n_keys).to_numpy(zero_copy_only=False)
                same = np.ones(len(t) - 1, bool)
                for c in b.columns[:n_keys]:
                    code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    same &= code[1:] == code[:-1]
                head = tuple(c[0].as_py() for c in b.columns[:n_keys])
                begin = past + min(int(t[0]) - time, length) if head == key else length
                at = begin + np.concatenate([[0], np.cumsum(np.where(same, np.minimum(np.diff(t), length), length))])
                after = np.searchsorted(at, at + length).tolist()
                here, found = int(np.searchsorted(at, length)), []
                while here < len(t):
                    found.append(here)
                    here = after[here]
                key, time, past = tuple(c[-1].as_py() for c in b.columns[:n_keys]), int(t[-1]), int(at[-1] - (at[found[-1]] if found else 0))
                if found:
                    yield b.take(pa.array(found))

    names = [*keys, ts]
    safe = added.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)))
    dealt = safe.repartition(n, F.hash(F.lit(0), *safe.columns[:n_keys])).sortWithinPartitions(*safe.columns)
    return dealt.mapInArrow(run, safe.schema).toDF(*names)


def anchored(df: DataFrame, keys: list[str], ts: str, seq: str, length: int) -> DataFrame:
    """Rows in parts of key and pane, adds also in the next one, with the anchor of the state alive at their time (null: none)."""
    begun = anchors(df.where(adds() & F.col(ts).isNotNull()).select(*(F.col(f"`{c}`") for c in (*keys, ts))), keys, ts, length)
    both = df.withColumn(MARK, F.lit(False)).unionByName(begun.withColumns({OP: F.lit(sets.INSERT), MARK: F.lit(True)}), allowMissingColumns=True)
    rows = paned(both, ts, seq, F.floor(F.col(ts) / length), ghosts=True)
    upto = Window.partitionBy(*parts(keys)).orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max(F.when(F.col(MARK), F.col(ts))).over(upto)
    return rows.withColumn(ANCHOR, latest).withColumn(ANCHOR, F.when(F.col(ts) - F.col(ANCHOR) < length, F.col(ANCHOR))).where(~F.col(MARK)).drop(MARK)


def scan(df: DataFrame, keys: list[str], fold: Fold, window: w.Window, ts: str, seq: str, result: str, old: Column, tick: int, column, widths) -> DataFrame:
    """Any fold, by one ordered pass over each part."""
    window, columns = w.normal(window), df.columns
    inputs = sorted({n for e in (*fold.init, *fold.update) for n in e.names() if not n.startswith("s.")})
    rows = df
    for i, n in enumerate(inputs):
        rows = rows.withColumn(f"__in{i}", mask(column(n).cast("long"), 32))
    length = ticks(window.lo if isinstance(window, w.Within) else window.t, tick)
    since = isinstance(window, w.Since)
    rows = anchored(rows, keys, ts, seq, length) if since else paned(rows, ts, seq, F.floor(F.col(ts) / length), ghosts=True)
    part_cols = [*parts(keys), ANCHOR] if since else parts(keys)
    rows = rows.withColumn("__part", F.xxhash64(*part_cols))
    kept = [c for c in rows.columns if c not in ("__part",)]
    bits = {i: widths(i) for i in inputs}
    own = lambda name: bits.get(name, 32)  # noqa: E731  (a plain table: this goes to the workers)
    n_inputs, where_ = len(inputs), {n: i for i, n in enumerate(inputs)}
    in_names = [f"__in{i}" for i in range(n_inputs)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def begin(x: tuple) -> tuple:
        get = lambda name: x[where_[name]]
        return tuple(evaluate(e, get, own) & TOP for e in fold.init)

    def step(x: tuple, state: tuple) -> tuple:
        def get(name: str) -> int:
            return state[fold.fields.index(name[2:])] if name.startswith("s.") else x[where_[name]]

        return tuple(evaluate(e, get, own) & TOP for e in fold.update)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: tuple | None = None
        state: tuple | None = None
        held: deque = deque()  # adds in the window, for a window that slides
        for batch in batches:
            b = batch.rename_columns(kept)
            names = zip(*(b.column(c).to_pylist() for c in part_cols), strict=True)
            xs = list(zip(*(b.column(c).to_pylist() for c in in_names), strict=True)) if n_inputs else [()] * b.num_rows
            out = []
            for here, op, t, x, p in zip(names, b.column(OP).to_pylist(), b.column(ts).to_pylist(), xs, b.column(PANE).to_pylist(), strict=True):
                if here != part:
                    part, state = here, None
                    held.clear()
                if op is None:
                    out.append(0)
                    continue
                add = op in (sets.INSERT, INSQUERY)
                if since:
                    if add and here[-1] is not None:
                        state = begin(x) if state is None else step(x, state)
                    out.append(state[fold.index] if state is not None else 0)
                elif isinstance(window, w.Last):
                    # a state begins in the pane before (whose adds came as ghosts) and goes on through this one
                    if add and (state is not None or t < p * length):
                        state = begin(x) if state is None else step(x, state)
                    out.append(state[fold.index] if state is not None else 0)
                else:
                    if add:
                        held.append((t, x))
                    while held and held[0][0] < t - length:
                        held.popleft()
                    if op == sets.INSERT:
                        out.append(0)
                        continue
                    live = None
                    for _, y in held:
                        live = begin(y) if live is None else step(y, live)
                    out.append(live[fold.index] if live is not None else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "__fold"])

    ordered = rows.repartition(n, "__part").sortWithinPartitions("__part", *part_cols, ts, seq).select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)))
    safe = {c: f"__c{i}" for i, c in enumerate(kept)}  # names without dots on the way through Arrow
    schema = StructType([*ordered.schema.fields, StructField("__fold", LongType())])
    folded = ordered.mapInArrow(run, schema)
    named = folded.select(*(F.col(v).alias(c) for c, v in safe.items()), "__fold")
    return finish(named, result, F.col("__fold"), old, columns)


def fold(df: DataFrame, keys: list[str], spec: Fold, window: w.Window, ts: str, seq: str, result: str, old: Column, tick: int, column, widths) -> DataFrame:
    made = native(df, keys, spec, window, ts, seq, result, old, tick, column, widths)
    return scan(df, keys, spec, window, ts, seq, result, old, tick, column, widths) if made is None else made


__all__ = ["GHOST", "Expr", "fold", "native", "scan", "shape"]
