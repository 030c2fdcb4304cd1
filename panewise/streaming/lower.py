"""Keyed windowed sets on Structured Streaming.

Events go through the watermark; late ones are dropped. State is kept by key
in the state store. Within a micro-batch a key's events are handled in
(time, tie-break) order, so feed batches in time order (as a log does) for the
results of the batch engine. A key's state ends when the watermark passes its
last use by the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import windows as w
from ..plans.expr import evaluate
from ..plans.program import SetDecl

TOP = (1 << 32) - 1


def stateful_set(events: DataFrame, decl: SetDecl, result: str, ts: str = "ts", seq: str = "seq", delay: str = "1 minute") -> DataFrame:
    """Run one set over a stream.

    events: ``op`` (INSERT, QUERY, INSQUERY), the key columns, the timestamp
    ``ts``, the tie-break ``seq`` and the BIGINT inputs of a fold. Returns
    keys, seq, ts and the result of each event that asked.

    State of a key: the latest add for Exist within a time; counts by pane for
    ``since`` and ``last``, by time for Count within a time; the fold of a
    ``since`` state; the adds in the window for other folds.
    """
    keys = [k for k, _ in decl.keys]
    window = w.normal(decl.window)
    length = (window.lo if isinstance(window, w.Within) else window.t) // 1000  # microseconds
    kind, fold = decl.kind, decl.fold
    inputs = sorted({n for e in ((*fold.init, *fold.update) if fold else ()) for n in e.names() if not n.startswith("s.")})
    anchored = kind == "FoldSet" and isinstance(window, w.Since)
    back = 2 * length if isinstance(window, w.Last) else length

    def begin(x: dict) -> list[int]:
        return [evaluate(e, x.__getitem__, lambda n: 32) & TOP for e in fold.init]

    def step(x: dict, state: list[int]) -> list[int]:
        get = lambda n: state[fold.fields.index(n[2:])] if n.startswith("s.") else x[n]
        return [evaluate(e, get, lambda n: 32) & TOP for e in fold.update]

    def live(held: list, t: int) -> list:
        if isinstance(window, w.Within):
            return [h for h in held if h[0] >= t - length]
        if isinstance(window, w.Since):
            return [h for h in held if h[0] // length == t // length]
        if kind == "FoldSet":
            own = [h for h in held if h[0] // length >= t // length - 1]
            return own if own and own[0][0] // length == t // length - 1 else []
        return [h for h in held if h[0] // length == t // length - 1]

    def fold_in(held: list, t: int) -> list:
        """Adds of Exist and Count sets as (time, [count])."""
        within = isinstance(window, w.Within)
        if within and kind == "ExistSet":
            return [(max([t, *(h[0] for h in held)]), [1])]
        at = t if within else t // length * length
        if held and held[-1][0] == at:
            return [*held[:-1], (at, [int(held[-1][1][0]) + 1])]
        return [*held, (at, [1])]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, values, anchor = (list(map(list, s)) if i == 1 else s for i, s in enumerate(state.get)) if state.exists else ([], [], [])
        held, anchor = list(zip(list(times), values, strict=True)), list(anchor)
        rows = pd.concat(list(batches)).assign(__t=lambda d: d["__us"]).sort_values(["__t", seq], kind="stable")
        out = []
        for r in rows.to_dict("records"):
            t, op = r["__t"], r["op"]
            x = [int(r[n]) & TOP for n in inputs]
            named = dict(zip(inputs, x, strict=True))
            if anchored:
                if anchor and t - anchor[0] >= length:
                    anchor = []
                if op != "QUERY":
                    anchor = [t, *begin(named)] if not anchor else [anchor[0], *step(named, anchor[1:])]
                value = anchor[1 + fold.index] if anchor else 0
            else:
                if op != "QUERY":
                    held = fold_in(held, t) if fold is None else [*held, (t, x)]
                held = [h for h in held if h[0] >= t - back]
                own = live(held, t)
                if kind == "ExistSet":
                    value = int(bool(own))
                elif kind == "CountSet":
                    value = min(sum(n for _, (n,) in own), TOP)
                else:
                    cur = None
                    for _, y in own:
                        y_ = dict(zip(inputs, y, strict=True))
                        cur = begin(y_) if cur is None else step(y_, cur)
                    value = cur[fold.index] if cur else 0
            if op != "INSERT":
                out.append((*key, r[seq], r[ts], value))
        state.update(([h[0] for h in held], [h[1] for h in held], anchor))
        last = max([h[0] for h in held] + anchor[:1] + [int(rows["__t"].max())])
        until = (last + back) // 1000 + 1
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, seq, ts, result])

    fields = dict(events.dtypes)
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), f"`{seq}` {fields[seq]}", f"`{ts}` timestamp", f"`{result}` long"])
    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).withColumn("__us", F.unix_micros(ts))
    grouped = marked.groupBy(*keys)
    return grouped.applyInPandasWithState(update, schema, "times array<long>, inputs array<array<long>>, anchor array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def pane_counts(events: DataFrame, keys: list[str], length: str, ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Adds by key and tumbling pane, with native state and watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"))
