"""Exact top-k inner products with KD-trees.

Each shard of vectors gets a KD-tree (median splits on the widest dimension,
tight bounding boxes). The bound of a query and a box is the largest inner
product that a point of the box could have; a query visits leaves from the
largest bound down and stops where the bound falls under its k-th best score,
which it carries from leaf to leaf and from shard to shard. All queries of a
block move at once. Queries come in blocks; a task holds one group of blocks
and streams its share of the shards, so nothing unbounded is broadcast.

Components become floor(scale * x) of the component as a double, held within
+-2^62; scores are exact integers whatever their size, and those beyond the
64-bit range are held at its ends (where they tie).

Cases: vectors that are null or hold a null or non-finite component take no
part; shorter vectors count as padded with zeros; equal scores rank by the
smaller id (nulls last); a repeated id is another row; fewer than k candidates
give fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD = 8192
LEAF = 128
QUERY_BLOCK = 512
#: Query blocks that a task holds at most.
GROUP = 64
#: Shards that a task streams, about.
STREAM = 8
NO_ID = np.iinfo(np.int64).max
NO_SCORE = np.iinfo(np.int64).min


def tree(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Leaves (row numbers) of a KD-tree: median splits on the dimension whose box side is longest."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        side = points[own].max(0) - points[own].min(0) if len(own) else np.zeros(1)
        if len(own) <= leaf or not side.max(initial=0) > 0:
            out += [own[i : i + leaf] for i in range(0, len(own), leaf)]
            continue
        half = len(own) // 2
        order = np.argpartition(points[own, int(side.argmax())], half)
        todo += [own[order[:half]], own[order[half:]]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b."""
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if big < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if big < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, NO_SCORE + 1, NO_ID).astype(np.int64)


class Best:
    """The k best rows of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.uid = np.full((n, k), NO_SCORE), np.full((n, k), NO_ID), np.full((n, k), -1)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        u = np.concatenate([self.uid[rows], np.broadcast_to(uids, score.shape)], axis=1)
        order = np.lexsort((u, i, ~s), axis=1)[:, :k]  # ~s falls as s rises, without overflow
        self.score[rows], self.id[rows], self.uid[rows] = (np.take_along_axis(x, order, 1) for x in (s, i, u))


def search(queries: np.ndarray, query_uids: np.ndarray, best: Best, points: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> int:
    """Update ``best`` with a shard; returns the number of (query, leaf) visits."""
    width = max(queries.shape[1], points.shape[1])
    queries, points = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, points))
    leaves = tree(points)
    low, high = np.array([points[x].min(0) for x in leaves]), np.array([points[x].max(0) for x in leaves])
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = up.astype(float) @ high.T.astype(float) + down.astype(float) @ low.T.astype(float)
    bound = np.maximum(bound + np.abs(bound) * 1e-12 + 1, float(NO_SCORE))
    order = np.argsort(-bound, axis=1, kind="stable")
    visits = 0
    active = np.arange(len(queries))
    for turn in range(len(leaves)):
        at = order[active, turn]
        near = bound[active, at] >= best.score[active, -1]
        active, at = active[near], at[near]
        if not len(active):
            break
        visits += len(active)
        for leaf in np.unique(at):
            rows, own = active[at == leaf], leaves[leaf]
            score = products(queries[rows], points[own])
            score[query_uids[rows][:, None] == uids[own][None, :]] = NO_SCORE
            hit = score.max(1) >= best.score[rows, -1]
            if hit.any():
                best.add(rows[hit], score[hit], ids[own], uids[own])
    return visits


def quantised(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uids, ids and integer vectors of the rows that take part."""
    lists = batch.column("vector")
    flat = lists.flatten()
    length = np.diff(lists.offsets.to_numpy())
    value = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(length)), length)
    ok = lists.is_valid().to_numpy(zero_copy_only=False)
    ok &= np.bincount(row[~np.isfinite(value)], minlength=len(length)) == 0
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = np.clip(np.floor(scale * np.where(np.isfinite(value), value, 0)), -(2.0**62), 2.0**62).astype(np.int64)
    ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return batch.column("uid").to_numpy()[ok], ids[ok], out[ok]


BLOCK = "role int, number long, dim int, uids binary, ids binary, data binary"


def blocks(vectors: DataFrame, size: int, role: int, scale: int) -> DataFrame:
    """Vectors in blocks of up to ``size``, numbered within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        number = 0

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            width = max(x[2].shape[1] for x in held)
            uid, ids = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            data = np.concatenate([np.pad(x[2], ((0, 0), (0, width - x[2].shape[1]))) for x in held])
            held = []
            for i in range(0, len(uid), size):
                part = slice(i, i + size)
                yield pa.RecordBatch.from_arrays([pa.array([role], pa.int32()), pa.array([number], pa.int64()), pa.array([width], pa.int32()), *(pa.array([x[part].astype("<i8").tobytes()], pa.binary()) for x in (uid, ids, data))], ["role", "number", "dim", "uids", "ids", "data"])
                number += 1

        for b in batches:
            if b.num_rows:
                held.append(quantised(b, scale))
                if sum(len(x[0]) for x in held) >= size:
                    yield from made()
        if held:
            yield from made()

    return vectors.mapInArrow(common.tidy(run), BLOCK)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "topk")
    data = common.numbered(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")), "uid", scratch).select("uid", "id", "vector")
    asked = blocks(data.where(F.col("id") % every == 0), QUERY_BLOCK, 0, scale)
    table = scratch.save(asked.union(blocks(data, SHARD, 1, scale)).withColumn("place", F.monotonically_increasing_id()))
    n = {r["role"]: r["n"] for r in table.groupBy("role").agg(F.count("*").alias("n")).collect()}
    groups = max(1, -(-n.get(0, 0) // GROUP))
    streams = max(1, -(-n.get(1, 0) // STREAM))
    # a cell is a group of query blocks and a share of the shards; both sides go to all cells that need them
    deal = lambda m: F.pmod(F.xxhash64("place"), F.lit(m)).cast("long")
    span = lambda m: F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))
    query_side = table.where("role = 0").select("*", deal(groups).alias("g"), F.explode(span(streams)).alias("s"))
    point_side = table.where("role = 1").select("*", F.explode(span(groups)).alias("g"), deal(streams).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for _, uid, ids, best in held:
                row, col = np.nonzero(best.score > NO_SCORE)
                found = best.id[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(ids[row]), pa.array(found, mask=found == NO_ID), pa.array(best.score[row, col]), pa.array(best.uid[row, col])], ["uid", "query_id", "vec_id", "score", "found_uid"])

        for b in batches:
            for i in range(b.num_rows):
                here = (b.column("g")[i].as_py(), b.column("s")[i].as_py())
                if here != cell:
                    yield from done()
                    cell, held = here, []
                uid, ids, flat = (np.frombuffer(b.column(c)[i].as_buffer(), "<i8") for c in ("uids", "ids", "data"))
                points = flat.reshape(len(uid), b.column("dim")[i].as_py())
                if b.column("role")[i].as_py() == 0:
                    held.append((points.copy(), uid.copy(), ids.copy(), Best(len(uid), k)))
                elif len(uid):
                    for queries, own, _, best in held:
                        search(queries, own, best, points, ids, uid)
        yield from done()

    cells = query_side.unionByName(point_side).repartition(min(max(common.partitions(spark), 1), groups * streams), "g", "s").sortWithinPartitions("g", "s", "role", "place")
    found = cells.mapInArrow(common.tidy(run), "uid long, query_id long, vec_id long, score long, found_uid long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "found_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
