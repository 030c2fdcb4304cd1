"""Token-ID output: one wavelet matrix per shard.

A shard file holds the ids of a run of documents as succinct bit planes
(a wavelet matrix) in one zstd frame. Rank and select over the planes give
token access, counting and occurrence lookup without decoding the rest.

Cases: null text is an empty text (its document holds only the end id); a
null doc_id sorts first; equal doc_ids sort by their ids; a very long text is
encoded whole (some 60 bytes of memory for each byte) and gets a shard of its
own; an empty table gives no shards; further columns are ignored whatever
their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordbpe

MAGIC = b"PWWM0001"
#: Tokens after which a shard is closed; a longer document gets a shard of its own.
SHARD_TOKENS = 1 << 20
SUPER = 512  # bits for each entry of the rank directory


class WaveletMatrix:
    """Bit planes of a sequence, highest bit first; each plane orders the one below it stably by bit."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.levels = planes, zeros, n, len(planes)
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, seq: np.ndarray) -> WaveletMatrix:
        n = len(seq)
        levels = max(1, int(seq.max()).bit_length() if n else 1)
        cur = seq.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(levels - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << b)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low = cur[~bit]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[bit]])
        return cls(planes, zeros, n)

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            z = self.zeros[level]
            out[~bit] = cur[:z]
            out[bit] = cur[z:] | kind(1 << (self.levels - 1 - level))
            cur = out
        return cur.astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if self._ranks is None:
            self._ranks = []
            for plane in self.planes:
                padded = np.zeros(-(-len(plane) * 8 // SUPER) * SUPER // 8 + SUPER // 8, np.uint8)
                padded[: len(plane)] = plane
                ones = np.bitwise_count(padded).reshape(-1, SUPER // 8).sum(1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        block = i // SUPER
        part = np.unpackbits(self.planes[level][block * SUPER // 8 : (i + 7) // 8], bitorder="little")
        return int(self._ranks[level][block]) + int(part[: i - block * SUPER].sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences before i lie below the last plane."""
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        if token < 0 or token >> self.levels:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def dump_shard(doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one shard file."""
    wm = WaveletMatrix.build(ids)
    body = [struct.pack("<QQI", len(lengths), wm.n, wm.levels), np.asarray(wm.zeros, "<u8").tobytes(), doc_ids.astype("<i8").tobytes(), has_id.astype(np.uint8).tobytes(), lengths.astype("<u8").tobytes()]
    body += [p.tobytes() for p in wm.planes]
    return MAGIC + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def load_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, which of them are not null, lengths, and the wavelet matrix of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard file")
    body = zstandard.ZstdDecompressor().decompress(data[8:])
    docs, n, levels = struct.unpack_from("<QQI", body)
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    zeros = take("<u8", levels).astype(np.int64).tolist()
    doc_ids, has_id, lengths = take("<i8", docs), take("u1", docs).astype(bool), take("<u8", docs).astype(np.int64)
    planes = [take("u1", -(-n // 8)) for _ in range(levels)]
    return doc_ids, has_id, lengths, WaveletMatrix(planes, zeros, n)


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, bounds: list[int]) -> DataFrame:
    """part, doc_id, ids (little-endian uint32) of each document; part is its place among ``bounds``."""
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = wordbpe.encoder(path)
        for batch in batches:
            for b in common.slices(batch, limit=4 << 20):
                flat, off = wordbpe.append_end(*enc.encode(common.texts(b)), end_id)
                ids = b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)  # nulls come first
                part = np.searchsorted(cuts, ids, side="right").astype(np.int32)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(part), b.column("doc_id"), data.cast(pa.binary())], ["part", "doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.tidy(run), "part int, doc_id long, ids binary")


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents and write shard files in ascending id order.

    Returns the written table: part, shard, before (tokens of the part before
    the shard), n_docs, n_tokens, payload (the file's bytes). Only ids move in
    the one shuffle, and each task holds one shard at a time.
    """
    spark = docs.sparkSession
    path = path or wordbpe.default_path()
    n = common.partitions(spark)
    cuts = docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(x) for x in cuts})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = before = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, before, number
            ids = np.concatenate([h[3] for h in held])
            lengths = np.concatenate([h[4] for h in held])
            payload = dump_shard(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), lengths, ids)
            out = pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(lengths)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "shard", "before", "n_docs", "n_tokens", "payload"])
            before, number, held, size = before + len(ids), number + 1, [], 0
            return out

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            raw, off = common.byte_view(b.column("ids"))
            ids, off = raw.view("<u4"), off // 4
            keys = b.column("doc_id")
            has = keys.is_valid().to_numpy(zero_copy_only=False)
            keys = keys.fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(off, off[at] + shard_tokens - size, side="right")) - 1)
                held.append((part, keys[at:stop].copy(), has[at:stop].copy(), ids[off[at] : off[stop]].copy(), np.diff(off[at : stop + 1])))
                size += int(off[stop] - off[at])
                at = stop
                if size >= shard_tokens or at < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    ordered = encoded(docs, path, end_id, id_col, text_col, bounds).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    table = ordered.mapInArrow(common.tidy(shards), "part int, shard int, before long, n_docs long, n_tokens long, payload binary")
    return common.Scratch(spark, "tokens").save(table)


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, read from shard files."""
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a number for each part
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                keys, has, lengths, wm = load_shard(b.column("payload")[row].as_buffer().to_pybytes())
                ids = wm.decode()
                ends = np.cumsum(lengths)
                start = base[b.column("part")[row].as_py()] + b.column("before")[row].as_py() + ends - lengths
                data = memoryview(ids.astype("<u4").tobytes())
                cuts = list(zip(((ends - lengths) * 4).tolist(), (ends * 4).tolist(), strict=True))
                crc = [common.zlib.crc32(data[i:j]) for i, j in cuts]
                cols = [pa.array(keys, pa.int64(), mask=~has), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[i // 4 : j // 4] for i, j in cuts], pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return shards.select("part", "before", "payload").mapInArrow(common.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def export_files(shards: DataFrame, folder: str) -> list[str]:
    """Write each shard as a file of its own, one at a time (for a folder this process can write to)."""
    out = []
    for row in shards.orderBy("part", "shard").toLocalIterator():
        out.append(f"{folder}/part-{row['part']:06d}-{row['shard']:06d}.wm")
        with open(out[-1], "wb") as f:
            f.write(row["payload"])
    return out
