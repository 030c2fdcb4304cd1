"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens. In every round a source's deficit grows by
its share of one window, and it sends whole grains of ``grain`` tokens while
its deficit lasts; what is left is carried into the next round. The sent
tokens, in order, are cut into windows of ``window`` tokens, so every window
but the last is full and holds each source's share up to a few grains.

How far a queue has come after k rounds is floor(k * share / grain) * grain,
so a document finds its windows from its place in its queue alone: partitions
carry deficits across without waiting for each other. When a queue ends, its
rest is sent and the shares of the others grow (at most one such phase for
each source). Beyond ``MAX_QUEUES`` sources the same schedule is followed by a
running sum over all pieces in sending order instead of a sum over all queues
for each piece; the ids are shuffled then.

Cases: null text is an empty text (only the end id); null and empty sources
share a queue; repeated ids and rows are packed as they come; a very long text
is encoded whole (some 60 bytes of memory for each byte) and cut into pieces;
an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, wordbpe

#: Most queues whose places are summed up for each piece; beyond that pieces are sorted in sending order.
MAX_QUEUES = 1024
#: Most rows of the (partition, queue) offsets that are broadcast; beyond that they are joined.
BROADCAST_ROWS = 200_000
SCALE = 1 << 20


@dataclasses.dataclass
class Phase:
    """Rounds in which the same queues are active. at: queue positions at its start; rests: (queue, tokens) sent after its rounds."""

    active: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    begin: int
    rounds: int
    rests: list[tuple[int, int, int]]


def plan(totals: list[int], shares: list[float], window: int, grain: int) -> list[Phase]:
    """The phases of a schedule for queues of the given lengths."""
    if window % grain:
        raise ValueError("grain must divide window")
    per = window // grain
    left = np.array(totals, np.int64)
    at = np.zeros(len(totals), np.int64)
    begin, phases = 0, []
    while left.any():
        active = np.flatnonzero(left)
        share = np.array([max(shares[i], 0.0) for i in active])
        share = share / share.sum() if share.sum() > 0 else np.full(len(active), 1 / len(active))
        weight = np.maximum(1, np.round(share * SCALE)).astype(np.int64)
        total = int(weight.sum())
        # rounds until a queue cannot send what it is due: the first k with sent(k) > left
        ends = [(-(-((int(left[i]) // grain + 1) * total) // (per * int(w)))) - 1 for i, w in zip(active, weight, strict=True)]
        rounds = min(ends)
        sent = grain * ((rounds * per * weight) // total)
        size = int(sent.sum())
        rests = []
        pos = begin + size
        start = at.copy()
        at[active] += sent
        left[active] -= sent
        for i, e in zip(active.tolist(), ends, strict=True):
            if e == rounds:
                rests.append((i, pos, int(at[i])))
                pos += int(left[i])
                at[i] += left[i]
                left[i] = 0
        phases.append(Phase(active, weight, start, begin, rounds, rests))
        begin = pos
    return phases


def rounds_of(own: np.ndarray, first: np.ndarray, n: np.ndarray, total: int, per: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and round of each piece: documents ``own`` have ``n`` grains from ``first`` on."""
    block = wordbpe.gather(np.arange(int((first + n).max()) - int(first.min())), first - first.min(), n) + first.min()
    doc = np.repeat(own, n)
    rnd = -(-((block + 1) * total) // (per * w)) - 1
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rnd[1:] != rnd[:-1])
    return doc[new], rnd[new]


def weights(share: np.ndarray | float, total: np.ndarray | float, active: np.ndarray | int) -> np.ndarray:
    """Integer weights of shares that sum up to ``total`` over so many active queues."""
    part = np.where(np.asarray(total) > 0, share / np.where(np.asarray(total) > 0, total, 1.0), 1 / np.asarray(active))
    return np.maximum(1, np.round(part * SCALE)).astype(np.int64)


def course(totals: list[int], shares: list[float], window: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The schedule of ``plan`` for many queues: sum of shares (a row for each phase); active queues, weight and rounds; last phase of each queue."""
    if window % grain:
        raise ValueError("grain must divide window")
    per = window // grain
    left, want = np.array(totals, np.int64), np.maximum(np.array(shares, float), 0.0)
    last = np.zeros(len(left), np.int64)
    active = np.flatnonzero(left)
    sums, steps = [], []
    while len(active):
        share = want[active]
        weight = weights(share, share.sum(), len(active))
        total = int(weight.sum())
        ends = -(-((left[active] // grain + 1) * total) // (per * weight)) - 1
        rounds = int(ends.min())
        left[active] -= grain * ((rounds * per * weight) // total)
        over = (ends == rounds) | (left[active] == 0)
        last[active[over]] = len(steps)
        sums.append(float(share.sum()))
        steps.append((len(active), total, rounds))
        active = active[~over]
    return np.array(sums), np.array(steps, np.int64).reshape(-1, 3), last


def walk(sums: np.ndarray, steps: np.ndarray, last: int, share: float, starts: np.ndarray, lengths: np.ndarray, window: int, grain: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents of one queue: document index, queue position, length, phase, round (the rest of a queue: after its rounds)."""
    per = window // grain
    active, total, rounds = steps[: last + 1].T
    weight = weights(max(share, 0.0), sums[: last + 1], active)
    stop = np.cumsum(grain * ((rounds * per * weight) // total))
    base = np.append(0, stop[:-1])
    ends = starts + lengths
    out: list[tuple[np.ndarray, ...]] = []
    for p in range(int(np.searchsorted(stop, starts.min(), "right")), int(np.searchsorted(base, ends.max(), "left"))):
        lo, hi = np.maximum(starts - base[p], 0), np.minimum(ends, stop[p]) - base[p]
        own = np.flatnonzero(hi > lo)
        if len(own):
            first = lo[own] // grain
            doc, rnd = rounds_of(own, first, (hi[own] - 1) // grain - first + 1, int(total[p]), per, int(weight[p]))
            a = np.maximum(lo[doc], grain * ((rnd * per * weight[p]) // total[p]))
            b = np.minimum(hi[doc], grain * (((rnd + 1) * per * weight[p]) // total[p]))
            out.append((doc, a + base[p], b - a, np.full(len(doc), p), rnd))
    a = np.maximum(starts, stop[-1])
    own = np.flatnonzero(ends > a)
    out.append((own, a[own], (ends - a)[own], np.full(len(own), last), np.full(len(own), rounds[-1])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def place(phases: list[Phase], totals: list[int], queue: int, starts: np.ndarray, lengths: np.ndarray, window: int, grain: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents of one queue: document index, queue position, length, place in the sent order."""
    per = window // grain
    out: list[tuple[np.ndarray, ...]] = []
    ends = starts + lengths
    for ph in phases:
        k = int(np.searchsorted(ph.active, queue))
        if k == len(ph.active) or ph.active[k] != queue:
            continue
        total, w, base = int(ph.weight.sum()), int(ph.weight[k]), int(ph.at[queue])
        sent = grain * ((ph.rounds * per * w) // total)
        lo, hi = np.maximum(starts - base, 0), np.minimum(ends - base, sent)
        own = np.flatnonzero(hi > lo)
        if len(own):
            first, last = lo[own] // grain, (hi[own] - 1) // grain
            n = last - first + 1
            doc, rnd = rounds_of(own, first, n, total, per, w)
            at_round = lambda r, x: grain * ((r * per * x) // total)
            mine, after = at_round(rnd, w), at_round(rnd + 1, w)
            a, b = np.maximum(lo[doc], mine), np.minimum(hi[doc], after)
            pos = np.full(len(rnd), ph.begin, np.int64)
            for j, x in enumerate(ph.weight.tolist()):
                pos += at_round(rnd, x) if j >= k else at_round(rnd + 1, x)
            out.append((doc, a + base, b - a, pos + a - mine))
        for i, pos0, at in ph.rests:
            if i == queue:
                a, b = np.maximum(starts, at), np.minimum(ends, totals[queue])
                own = np.flatnonzero(b > a)
                out.append((own, a[own], (b - a)[own], pos0 + a[own] - at))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    doc, at, length, pos = (np.concatenate(x) for x in zip(*out, strict=True))
    # cut at the windows' ends
    n = (pos + length - 1) // window - pos // window + 1
    which = np.repeat(np.arange(len(doc)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    lo = np.maximum(pos[which], (pos[which] // window + nth) * window)
    hi = np.minimum(pos[which] + length[which], (pos[which] // window + nth + 1) * window)
    return doc[which], at[which] + lo - pos[which], hi - lo, lo


def pack(docs: DataFrame, shares: dict[str, float] | None = None, window: int = 4096, grain: int = 64, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row for each piece.

    shares: target share of tokens for each source (absent: 0, sent when the
    others have ended); None: each source's share of all tokens. Returns
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source
    (and ids). Each source has a queue of its own, at any count; the driver
    plans with one row for each. The text is read once and never shuffled (the
    ids are, beyond ``MAX_QUEUES`` sources).
    """
    spark = docs.sparkSession
    path = path or wordbpe.default_path()
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(""))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, came = wordbpe.encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for b in common.slices(batch, limit=4 << 20):
                flat, off = wordbpe.append_end(*enc.encode(common.texts(b)), end_id)
                size = np.diff(off)
                before = np.empty(b.num_rows, np.int64)
                coded = b.column("queue").dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    own = np.flatnonzero(codes == k)
                    s = np.cumsum(size[own])
                    before[own] = came.get(name, 0) + s - size[own]
                    came[name] = came.get(name, 0) + int(s[-1])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, pid, np.int32)), b.column("queue"), b.column("source"), pa.array(before), b.column("doc_id"), pa.array(size), data.cast(pa.binary())], ["pid", "queue", "source", "before", "doc_id", "n", "ids"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("queue"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    table = common.Scratch(spark, "packing").save(columns.mapInArrow(common.tidy(encode), "pid int, queue string, source string, before long, doc_id long, n long, ids binary"))
    by_part = table.groupBy("pid", "queue").agg(F.sum("n").alias("part_n"))
    totals = {r["queue"]: r["n"] for r in by_part.groupBy("queue").agg(F.sum("part_n").alias("n")).collect()}  # one row for each source
    names = sorted(totals)
    lengths = [totals[x] for x in names]
    target = [float(x) for x in lengths] if shares is None else [float(shares.get(x, 0.0)) for x in names]
    ahead = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = common.Scratch(spark, "packing-offsets").save(by_part.select("pid", "queue", F.coalesce(F.sum("part_n").over(ahead), F.lit(0)).alias("ahead")))
    if len(names) > MAX_QUEUES:
        return pack_many(table, offsets, names, lengths, target, window, grain, with_ids)
    phases = plan(lengths, target, window, grain)
    number = {x: i for i, x in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, "ids"):
                raw, off = common.byte_view(b.column("ids"))
                at = b.column("at").to_numpy()
                size = b.column("n").to_numpy()
                coded = b.column("queue").dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                cols: list[tuple[np.ndarray, ...]] = []
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    own = np.flatnonzero(codes == k)
                    doc, start, length, pos = place(phases, lengths, number[name], at[own], size[own], window, grain)
                    cols.append((own[doc], start - at[own][doc], length, pos))
                doc, start, length, pos = (np.concatenate(x) for x in zip(*cols, strict=True))
                data = memoryview(raw)
                lo = off[doc] + 4 * start
                crc = [zlib.crc32(data[i:j]) for i, j in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
                rows = pa.array(doc)
                arrays = [b.column("doc_id").take(rows), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(pos // window), pa.array(pos % window), b.column("source").take(rows)]
                fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
                if with_ids:
                    ids = raw.view("<u4")
                    arrays.append(pa.array([ids[i // 4 : i // 4 + n] for i, n in zip(lo.tolist(), length.tolist(), strict=True)], pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, fields)

    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    placed = table.join(offsets, ["pid", "queue"]).select("queue", "source", "doc_id", "n", "ids", (F.col("before") + F.col("ahead")).alias("at"))
    return placed.mapInArrow(common.tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<long>" * with_ids)


def pack_many(table: DataFrame, offsets: DataFrame, names: list[str], lengths: list[int], target: list[float], window: int, grain: int, with_ids: bool) -> DataFrame:
    """The same pieces for any number of queues: pieces in sending order, placed by a running sum of their lengths."""
    spark = table.sparkSession
    scratch = common.Scratch(spark, "packing-many")
    sums, steps, last = course(lengths, target, window, grain)
    courses = scratch.save(spark.createDataFrame(list(zip(names, range(len(names)), target, last.tolist(), strict=True)), "queue string, number long, share double, last long"))
    offsets = scratch.save(offsets.join(courses, "queue"))
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    fields = ["doc_id", "start", "length", "doc_tokens", "source", "phase", "round", "number", "at", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, "ids"):
                raw, off = common.byte_view(b.column("ids"))
                at, size, number, share, end = (b.column(c).to_numpy() for c in ("at", "n", "number", "share", "last"))
                order = np.argsort(number, kind="stable")
                cols: list[tuple[np.ndarray, ...]] = []
                for own in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                    doc, *rest = walk(sums, steps, int(end[own[0]]), float(share[own[0]]), at[own], size[own], window, grain)
                    cols.append((own[doc], *rest))
                doc, where, length, phase, rnd = (np.concatenate(x) for x in zip(*cols, strict=True))
                rows, start, data = pa.array(doc), where - at[doc], memoryview(raw)
                lo = off[doc] + 4 * start
                ids = pa.array([bytes(data[i:j]) for i, j in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)], pa.binary())
                arrays = [b.column("doc_id").take(rows), pa.array(start), pa.array(length), pa.array(size[doc]), b.column("source").take(rows), pa.array(phase), pa.array(rnd), pa.array(number[doc]), pa.array(where), ids]
                yield pa.RecordBatch.from_arrays(arrays, fields)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, came = TaskContext.get().partitionId(), 0
        for b in batches:
            size = b.column("length").to_numpy()
            pos = came + np.cumsum(size) - size
            came += int(size.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(pos), *(b.column(c) for c in ("doc_id", "start", "length", "doc_tokens", "source", "ids"))], ["pid", "pos", "doc_id", "start", "length", "doc_tokens", "source", "ids"])

    rows = table.join(offsets, ["pid", "queue"]).select("source", "doc_id", "n", "ids", "number", "share", "last", (F.col("before") + F.col("ahead")).alias("at"))
    sent = rows.mapInArrow(common.tidy(pieces), "doc_id long, start long, length long, doc_tokens long, source string, phase long, round long, number long, at long, ids binary")
    key = ["phase", "round", "number", "at"]
    ordered = scratch.save(sent).repartitionByRange(common.partitions(spark), *key).sortWithinPartitions(*key)
    ordered = scratch.save(ordered.mapInArrow(common.tidy(running), "pid int, pos long, doc_id long, start long, length long, doc_tokens long, source string, ids binary"))
    totals = sorted((r["pid"], r["n"]) for r in ordered.groupBy("pid").agg(F.sum("length").alias("n")).collect())  # one row for each partition
    ahead = dict(zip([p for p, _ in totals], np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, "ids"):
                raw, off = common.byte_view(b.column("ids"))
                pid, pos, start, length = (b.column(c).to_numpy() for c in ("pid", "pos", "start", "length"))
                pos = pos + np.array([ahead[p] for p in pid.tolist()], np.int64)
                n = (pos + length - 1) // window - pos // window + 1
                which = np.repeat(np.arange(len(pos)), n)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                lo = np.maximum(pos[which], (pos[which] // window + nth) * window)
                size = np.minimum(pos[which] + length[which], (pos[which] // window + nth + 1) * window) - lo
                byte, data, at = off[which] + 4 * (lo - pos[which]), memoryview(raw), pa.array(which)
                parts = [data[i:j] for i, j in zip(byte.tolist(), (byte + 4 * size).tolist(), strict=True)]
                arrays = [b.column("doc_id").take(at), pa.array(start[which] + lo - pos[which]), pa.array(size), pa.array([zlib.crc32(x) for x in parts], pa.int64()), b.column("doc_tokens").take(at), pa.array(lo // window), pa.array(lo % window), b.column("source").take(at)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4") for x in parts], pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return ordered.mapInArrow(common.tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<long>" * with_ids)
