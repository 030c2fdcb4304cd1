"""Suffix-array dedup: remove every byte of a 100-byte string that also starts earlier.

1. Anchors. Each window of ``LENGTH`` bytes has an anchor: its leftmost least
   hashed ``GRAM``-byte string. Equal windows have equal anchors at equal
   places, so only windows under equal anchors can be equal. Windows that
   follow each other under one anchor form a context (their bytes, at most
   2 LENGTH - GRAM). A task sends a context once for each of its chunks.
2. By anchor. A context equal to an earlier one is a repeat in all its
   windows. Contexts that are the only ones of their anchor are done too. What
   is left, different contexts under one anchor, needs their bytes.
3. Run-length index. The bytes of those contexts, anchor by anchor, are
   indexed by a run-compressed Burrows-Wheeler transform with sampled run
   ends. The contexts are streamed through it: matching statistics, compared
   byte by byte at the samples and carried on between them, give each window
   its longest match and the place of it. Windows linked by matches of LENGTH
   bytes are equal, and all but the first of them are repeats.
   Anchors with very many contexts are dealt over several indexes; the windows
   that are first in theirs then meet by window hash.
4. The repeats of each document come together at its text and are cut out.

Equal contexts are found by a 64-bit hash of their bytes beside that of their
anchor, windows of different indexes by two 64-bit hashes; inside an index
bytes are compared. Order is (doc_id, row of the input,
start); a null doc_id comes first.

Cases: null text is an empty text; repeated rows and ids are judged in the
order of the input; very long texts are handled in pieces; an empty table
gives no rows; further columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BYTE_VALUES, RollingHash

LENGTH = 100
GRAM = 32
BASE2 = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of a text handled at once; longer texts come in pieces that overlap by LENGTH - 1.
PIECE = 1 << 19
#: Bytes of text of which a task sends equal contexts once.
CHUNK = 16 << 20
#: Bytes of contexts in one index.
BATCH = 1 << 19
#: Contexts of one anchor beyond which they are dealt over several indexes.
HOT = 4096
#: Most anchors with more contexts than that which are broadcast; beyond that they are joined.
BROADCAST_ROWS = 100_000


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts of the texts: anchor hash, context hash, first and last window start."""
    n = len(raw)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if n < length:
        return none
    valid = np.zeros(n + 1, np.int8)
    long = np.diff(off) >= length
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[1:][long] - length + 1, -1)
    own = np.flatnonzero(np.cumsum(valid[: n - length + 1]))
    if not len(own):
        return none
    values = BYTE_VALUES[raw]
    first = RollingHash(values)
    grams = np.arange(n - gram + 1)
    code = common.fmix(first.of(grams, grams + gram))
    bits = int(n).bit_length()
    low = np.uint64((1 << bits) - 1)
    least = (code & ~low) | grams.astype(np.uint64)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = n - length + 1
    least = np.minimum(least[:count], least[width - span : width - span + count])
    at = (least[own] & low).astype(np.int64)
    new = np.ones(len(own), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)
    start = own[new]
    stop = own[np.append(np.flatnonzero(new)[1:], len(own)) - 1]
    at = at[new]
    size = (stop + length - start).astype(np.uint64)
    context = common.fmix(RollingHash(values, BASE2).of(start, stop + length) + size) ^ common.fmix((at - start).astype(np.uint64) + np.uint64(7))
    return code[at].view(np.int64), context.view(np.int64), start, stop


def ranges(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join ranges of window starts that follow each other in a text."""
    order = np.lexsort((lo, uid))
    uid, lo, hi = uid[order], lo[order], hi[order]
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (lo[1:] != hi[:-1] + 1)
    first = np.flatnonzero(new)
    return uid[first], lo[first], hi[np.append(first[1:], len(uid)) - 1] if len(uid) else hi


NAMES = ["kind", "h", "c", "dk", "uid", "lo", "hi"]
MARKS = "kind int, h long, c long, dk long, uid long, lo long, hi long"
REPEAT, CONTEXT, OPEN, WINDOW = 0, 1, 2, 3


def rows(kind: int, **cols: np.ndarray) -> pa.RecordBatch:
    n = len(cols["uid"])
    zero = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(cols.get(k, zero), np.int64)) for k in NAMES[1:])], NAMES)


def repeats(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    uid, lo, hi = ranges(uid, lo, hi)
    return rows(REPEAT, h=uid, uid=uid, lo=lo, hi=hi)


def find_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, c, dk, uid, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((lo, uid, dk, c, h))
        h, c, dk, uid, lo, hi = (x[order] for x in (h, c, dk, uid, lo, hi))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        yield rows(CONTEXT, h=h[~again], c=c[~again], dk=dk[~again], uid=uid[~again], lo=lo[~again], hi=hi[~again])
        yield repeats(uid[again], lo[again], hi[again])

    for batch in batches:
        for b in common.slices(batch, limit=PIECE):
            raw, off = common.byte_view(common.texts(b))
            dk, uid = b.column("dk").to_numpy(), b.column("uid").to_numpy()
            if b.num_rows == 1 and len(raw) > PIECE:
                for t in range(0, len(raw) - LENGTH + 1, PIECE):
                    part = raw[t : t + PIECE + LENGTH - 1]
                    h, c, lo, hi = anchors(part, np.array([0, len(part)]))
                    held.append((h, c, np.repeat(dk, len(h)), np.repeat(uid, len(h)), lo + t, hi + t))
            else:
                h, c, lo, hi = anchors(raw, off)
                doc = np.searchsorted(off, lo, side="right") - 1
                held.append((h, c, dk[doc], uid[doc], lo - off[doc], hi - off[doc]))
            size += len(raw)
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def compare_contexts(batches: Iterator[pa.RecordBatch], single: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h, c, dk, uid, lo). All but the first of equal (h, c) are repeats.

    First ones whose h has another c stay open (not with ``single``).
    """
    last_h = last_c = None
    waiting = None  # the first row of last_h while it has one c only
    for b in batches:
        kind, h, c, dk, uid, lo, hi = (b.column(k).to_numpy() for k in NAMES)
        passed = kind == REPEAT
        if passed.any():
            yield repeats(uid[passed], lo[passed], hi[passed])
            h, c, dk, uid, lo, hi = (x[~passed] for x in (h, c, dk, uid, lo, hi))
        if not len(h):
            continue
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first[0] = not (h[0] == last_h and c[0] == last_c)
        yield repeats(uid[~first], lo[~first], hi[~first])
        if not single:
            fh, fc, fdk, fuid, flo, fhi = (x[first] for x in (h, c, dk, uid, lo, hi))
            if waiting is not None:
                fh, fc, fdk, fuid, flo, fhi = (np.concatenate([[w], x]) for w, x in zip(waiting, (fh, fc, fdk, fuid, flo, fhi), strict=True))
                known = False
            else:
                known = True  # last_h is known to have several
            same = np.zeros(len(fh), bool)
            same[1:] = fh[1:] == fh[:-1]
            more = same.copy()
            more[:-1] |= same[1:]
            if known and last_h is not None:
                more |= fh == last_h
            hold = len(fh) > 0 and not more[-1]
            waiting = tuple(x[-1] for x in (fh, fc, fdk, fuid, flo, fhi)) if hold else (waiting if not len(fh) else None)
            yield rows(OPEN, h=fh[more], dk=fdk[more], uid=fuid[more], lo=flo[more], hi=fhi[more])
        last_h, last_c = h[-1], c[-1]


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with sampled run ends.

    Each text is followed by an end mark of its own. ``starts`` are the texts'
    places in the joined sequence. Only the runs, the places of their ends and
    the texts are kept, not the suffix array. Within a run, the neighbour above
    and the match with it move along as one goes to the left in a text, so both
    follow for every place from the next sample to its right.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        self.n = int(sizes.sum()) + len(texts)
        data = np.zeros(self.n, np.uint8)
        inside = np.ones(self.n, bool)
        inside[self.ends] = False
        data[inside] = np.frombuffer(b"".join(texts), np.uint8)
        self.data = data
        symbol = data.astype(np.int64) + len(texts)
        symbol[self.ends] = np.arange(len(texts))  # end marks differ, in order
        order = self._suffixes(symbol, int(sizes.max(initial=0)) + 1)
        before = symbol[order - 1] if self.n else symbol
        before[before < len(texts)] = -1  # a text begins here
        head = np.ones(self.n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        first = np.flatnonzero(head)
        self.run_symbol = before[first]
        self.run_size = np.diff(np.append(first, self.n))
        self.sample_first, self.sample_last = order[first], order[first + self.run_size - 1]

    @staticmethod
    def _suffixes(symbol: np.ndarray, longest: int) -> np.ndarray:
        """Suffix order by prefix doubling; end marks are unique, so ``longest`` symbols decide."""
        n = len(symbol)
        rank = symbol
        step = 1
        if n:
            # four symbols at once to begin with
            wide = int(symbol.max()) + 2
            if wide < 1 << 15:
                key = np.zeros(n, np.int64)
                for i in range(4):
                    key = key * wide
                    key[: max(0, n - i)] += symbol[i:] + 1
                rank, step = key, 4
        while True:
            order = np.argsort(rank, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = rank[order[1:]] != rank[order[:-1]]
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(new) - 1
            if step >= longest or (n and dense.max() == n - 1):
                return order
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - step)] = dense[step:] + 1
            rank = dense * (n + 1) + nxt
            step *= 2

    def common_size(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many bytes the texts share from places ``one`` and ``two`` on, by comparing them, eight at a time."""
        pad = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(pad, 8)[: self.n + 1]
        most = np.minimum(self.left(one), self.left(two))
        size = np.zeros(len(one), np.int64)
        todo = np.flatnonzero(most > 0)
        while len(todo):
            at = size[todo]
            differ = eight[one[todo] + at] != eight[two[todo] + at]
            some = differ.any(1)
            size[todo] = np.minimum(at + np.where(some, differ.argmax(1), 8), most[todo])
            todo = todo[~some & (size[todo] < most[todo])]
        return size

    def left(self, place: np.ndarray) -> np.ndarray:
        """Bytes of a place's text from there on."""
        return self.ends[np.searchsorted(self.ends, place)] - place

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text streamed through the index of all: for every place the neighbour above in suffix order, and the size of the match with it.

        The longest match of a place with any other is the one with a neighbour.
        A place one to the left of a run's first place has the sampled end of the
        run that comes before in the order of symbols as its neighbour's right one;
        all other places take over from the place to their right.
        """
        by = np.argsort(self.run_symbol, kind="stable")
        real = np.flatnonzero(self.run_symbol[by] >= 0)  # the runs of text beginnings come before
        inner = self.run_symbol[by[real - 1]] >= 0
        place = np.concatenate([self.sample_first[by[real]] - 1, self.ends])
        above = np.concatenate([np.where(inner, self.sample_last[by[real - 1]] - 1, self.ends[-1:]), np.append(-1, self.ends)[:-1]])
        order = np.argsort(place, kind="stable")
        place, above = place[order], above[order]
        size = np.zeros(len(place), np.int64)
        known = above >= 0
        size[known] = self.common_size(place[known], above[known])
        at = np.arange(self.n)
        sample = np.searchsorted(place, at)
        ahead = place[sample] - at
        return above[sample] - ahead, size[sample] + ahead

    def first_places(self, length: int) -> np.ndarray:
        """For each place the least place that shares ``length`` bytes with it (itself, if no other does)."""
        up, size = self.matching_statistics()
        at = np.arange(self.n)
        top = np.where(size >= length, up, at)
        while True:  # to the top of the rows that share so many bytes
            higher = top[top]
            if (higher == top).all():
                break
            top = higher
        least = at.copy()
        np.minimum.at(least, top, at)
        return least[top]


def index_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, part, parts, dk, uid, lo, hi, data) come sorted by (h, part, dk, uid, lo); whole groups share an index."""

    def judge(group: list[tuple[np.ndarray, ...]], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts, uid, dk, lo, hi = (np.concatenate(x) for x in zip(*group, strict=True))
        index = RunLengthIndex(data)
        least = index.first_places(LENGTH)
        windows = hi - lo + 1
        text = np.repeat(np.arange(len(data)), windows)
        place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = index.starts[text] + place
        again = least[at] < at
        start = lo[text] + place
        yield repeats(uid[text[again]], start[again], start[again])
        split = ~again & (parts[text] > 1)
        if split.any():
            text, place = text[split], place[split]
            sums, other = RollingHash(BYTE_VALUES[index.data]), RollingHash(BYTE_VALUES[index.data], BASE2)
            a = index.starts[text] + place
            one, two = common.fmix(sums.of(a, a + LENGTH)), common.fmix(other.of(a, a + LENGTH))
            yield rows(WINDOW, h=one.view(np.int64), c=two.view(np.int64), dk=dk[text], uid=uid[text], lo=lo[text] + place, hi=lo[text] + place)

    group: list[tuple[np.ndarray, ...]] = []
    data: list[bytes] = []
    size, last = 0, None
    for b in batches:
        h, part, parts, dk, uid, lo, hi = (b.column(k).to_numpy() for k in ("h", "part", "parts", "dk", "uid", "lo", "hi"))
        raw = b.column("data").to_pylist()
        edge = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(h)], strict=True):
            if i == j:
                continue
            if size >= BATCH and (h[i], part[i]) != last:
                yield from judge(group, data)
                group, data, size = [], [], 0
            group.append((parts[i:j], uid[i:j], dk[i:j], lo[i:j], hi[i:j]))
            data += raw[i:j]
            size += sum(map(len, raw[i:j]))
            last = (h[i], part[i])
    if data:
        yield from judge(group, data)


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the open contexts of each text."""
    for batch in batches:
        for b in common.slices(batch, limit=8 << 20):
            raw, off = common.byte_view(common.texts(b))
            text = raw.tobytes()
            lists = b.column("open")
            inner = lists.flatten()
            n = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(b.num_rows), n)
            lo, hi, h = (inner.field(k).to_numpy() for k in ("lo", "hi", "h"))
            a = off[doc] + lo
            data = [text[i:j] for i, j in zip(a.tolist(), (off[doc] + hi + LENGTH).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column("dk").take(pa.array(doc)), b.column("uid").take(pa.array(doc)), pa.array(lo), pa.array(hi), pa.array(data, pa.binary())], ["h", "dk", "uid", "lo", "hi", "data"])


def find_repeats(base: DataFrame, scratch: common.Scratch) -> DataFrame:
    """uid, lo, hi: ranges of starts of repeated windows. base: uid, dk, text."""
    spark = base.sparkSession
    n = common.partitions(spark)
    sorted_by = ["h", "c", "dk", "uid", "lo"]
    marks = scratch.save(base.mapInArrow(common.tidy(find_contexts), MARKS).repartition(n, "h").sortWithinPartitions(*sorted_by).mapInArrow(common.tidy(compare_contexts), MARKS))
    common.release_shuffles(spark)
    opened = marks.where(F.col("kind") == OPEN)
    hot = scratch.save(opened.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    by_doc = opened.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "h")).alias("open"))
    contexts = base.join(by_doc, "uid").mapInArrow(common.tidy(cut_contexts), "h long, dk long, uid long, lo long, hi long, data binary")
    parts = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    dealt = contexts.join(parts, "h", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / HOT), F.lit(1)).cast("long")).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts"))).select("h", "part", "parts", "dk", "uid", "lo", "hi", "data")
    judged = scratch.save(dealt.repartition(n, "h", "part").sortWithinPartitions("h", "part", "dk", "uid", "lo").mapInArrow(common.tidy(index_contexts), MARKS))
    common.release_shuffles(spark)
    met = judged.where(F.col("kind") == WINDOW).repartition(n, "h").sortWithinPartitions(*sorted_by).mapInArrow(common.tidy(lambda it: compare_contexts(it, single=True)), MARKS)
    found = marks.where(F.col("kind") == REPEAT).union(judged.where(F.col("kind") == REPEAT)).union(met)
    return found.select("uid", "lo", "hi")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Cut the repeated bytes out of every text.

    Returns the carried columns (default: the id as ``doc_id``), then n_bytes,
    n_removed, n_spans, kept_sha256 and, with ``with_text``, spans (begin and
    end of each removed run, in bytes) and kept_text (what is left, without the
    bytes of characters that were cut apart).
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "suffix")
    least = F.lit(-(1 << 63)).cast("long")
    mine = common.fresh(docs, "__uid")
    numbered = common.numbered(docs, mine, scratch)
    text = F.col(f"`{text_col}`")
    base = numbered.select(F.col(mine).alias("uid"), F.coalesce(F.col(f"`{id_col}`").cast("long"), least).alias("dk"), text.alias("text"))
    with common.small_batches(spark):
        found = find_repeats(base, scratch)
    by_doc = found.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    kept = [F.col(f"`{id_col}`").cast("long").alias("doc_id")] if carry is None else [F.col(f"`{c}`") for c in carry]
    data = numbered.select(F.col(mine).alias("uid"), F.struct(*kept).alias("carried"), text.alias("text")).join(by_doc, "uid", "left").select("carried", "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch):
                raw, off = common.byte_view(common.texts(b))
                content = raw.tobytes()
                lists = b.column("found")
                inner, bounds = lists.values, lists.offsets.to_numpy()
                lo, hi = inner.field("lo").to_numpy(), inner.field("hi").to_numpy()
                out: list[list] = [[] for _ in range(6)]
                for i in range(b.num_rows):
                    body = content[off[i] : off[i + 1]]
                    a, z = bounds[i], bounds[i + 1]
                    spans: list[tuple[int, int]] = []
                    if z > a:
                        order = np.argsort(lo[a:z], kind="stable")
                        s, e = lo[a:z][order], hi[a:z][order] + LENGTH
                        e = np.maximum.accumulate(e)
                        new = np.ones(len(s), bool)
                        new[1:] = s[1:] > e[:-1]
                        first = np.flatnonzero(new)
                        spans = list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist(), strict=True))
                    at, left = 0, []
                    for x, y in spans:
                        left.append(body[at:x])
                        at = y
                    rest = b"".join([*left, body[at:]])
                    row = (len(body), sum(y - x for x, y in spans), len(spans), hashlib.sha256(rest).hexdigest(), spans, rest.decode(errors="ignore") if with_text else "")
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                carried = b.column("carried")
                arrays = [carried.field(k) for k in range(carried.type.num_fields)] + [pa.array(c, k) for c, k in zip(out[:4], (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                if with_text:
                    pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
                    arrays += [pa.array([[{"begin": x, "end": y} for x, y in s] for s in out[4]], pa.list_(pair)), pa.array(out[5], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = docs.select(*kept).schema
    for k, t in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(k, t)
    text_schema = "spans array<struct<begin: long, end: long>>, kept_text string"
    if with_text:
        for f in spark.createDataFrame([], text_schema).schema.fields:
            schema = schema.add(f)
    names = schema.names
    return data.mapInArrow(common.tidy(cut), schema)
