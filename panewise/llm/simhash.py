"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints are dealt to tables by the bits of ``blocks - radius``
blocks of the 64 (two fingerprints that differ in at most ``radius`` bits
agree in so many blocks). Rows of a table with equal bits form a bucket. A
task lays out many buckets vertically, as 64 bit planes, and compares every
row with the row L places on, for L = 1, 2, ...: planes are XORed with their
own shift, and carry-save counters add up all distances at once; words of 64
pairs whose counters have all passed the radius are abandoned. Only a spanning
forest of the links leaves a task. Buckets beyond ``HOT`` rows are cut into
chunks and every pair of chunks is compared in a task of its own. Components
come from alternating large-star and small-star steps.

Cases: null and empty texts have fingerprint zero and link like others; null
ids stay null and count as larger than any in a component; repeated rows and
ids get one row each; a very long text is hashed whole (some 30 bytes of memory
for each byte); an empty table gives no rows; further columns are ignored or
carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a bucket beyond which it is cut into chunks of about that size.
HOT = 4096
#: Rows that a task compares at once (more only to complete a bucket).
BATCH = 1 << 17
#: Most hot buckets that are broadcast; beyond that they are joined.
BROADCAST_ROWS = 100_000
SIMILARITY = 0.8
#: Radius within which near_dedup compares a text with the least of its bucket first. It decides no link: all pairs left are compared after that.
WIDE = 26
#: Bytes of text whose shingle sets are made at once.
SET_BYTES = 2 << 20
#: Words of 64 bits in the parity sketch of a shingle set.
SKETCH = 8
#: Rounds in which only as many pairs are compared as would connect all that may be similar; one round of all pairs left follows.
ROUNDS = 2
#: Most rows of one or two numbers (of texts that are read or dropped) that are broadcast, so that texts need no shuffle.
UID_ROWS = 1 << 21
#: Rows of shingles from which on buckets are handled in parts, one after the other, and the most parts.
PART_ROWS = 1 << 24
PARTS = 8
#: Share of the elements of all sets that is sent at once to compare pairs.
SENT = 0.25
#: Slots of the table that orders shingles by how common they are.
SLOTS = 1 << 18


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``size`` words of a text; fewer words: of all of them; none: nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    k = min(size, len(words))
    of = xxhash.xxh64_intdigest
    return np.array([of(line[i:j], 42) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(data: DataFrame, size: int) -> DataFrame:
    """All columns but ``text``, and fp (as a signed 64-bit integer)."""
    carry = [c for c in data.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch):
                raw, off = common.byte_view(common.texts(b))
                content = raw.tobytes()
                hashes = (shingle_hashes(content[i:j], size) for i, j in itertools.pairwise(off.tolist()))
                fp = [fingerprint(x) for x in hashes]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(np.array(fp, np.uint64).view(np.int64))], [*carry, "fp"])

    return data.mapInArrow(common.tidy(run), data.drop("text").schema.add("fp", "long"))


def planes_of(fp: np.ndarray) -> np.ndarray:
    """64 bit planes over rows, as words of 64 rows (with one empty word at the end)."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(fp) % 64 + 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, pad), (0, 0))), axis=0, bitorder="little").T).view("<u8")


def shifted(planes: np.ndarray, rows: int, words: np.ndarray) -> np.ndarray:
    """The given words of all planes, moved ``rows`` places down."""
    step, bit = divmod(rows, 64)
    top = planes.shape[1] - 1
    low = planes[:, np.minimum(words + step, top)]
    if bit == 0:
        return low
    return (low >> np.uint64(bit)) | (planes[:, np.minimum(words + step + 1, top)] << np.uint64(64 - bit))


def within(planes: np.ndarray, rows: int, mask: np.ndarray, radius: int) -> np.ndarray:
    """Of the pairs (i, i + rows) that ``mask`` marks, those at distance ``radius`` or less, as a bit mask over i."""
    words = np.flatnonzero(mask)
    alive = mask[words]
    width = radius.bit_length()
    counters = [np.zeros(len(words), np.uint64) for _ in range(width)]
    over = np.zeros(len(words), np.uint64)
    for first in range(0, 64, 8):
        part = planes[first : first + 8]
        diff = part[:, words] ^ shifted(part, rows, words)
        for plane in diff:
            carry = plane
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        # counters > radius, from the highest bit down
        more, equal = np.zeros(len(words), np.uint64), ~np.zeros(len(words), np.uint64)
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                more |= equal & counters[k]
                equal &= ~counters[k]
        left = alive & ~(over | more)
        live = left != 0
        if not live.all():  # abandon words without a pair in reach
            words, alive, over = words[live], left[live], over[live]
            counters = [c[live] for c in counters]
        else:
            alive = left
        if not len(words):
            break
    out = np.zeros(len(mask), np.uint64)
    out[words] = alive
    return out


def forest(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of one group, as pairs of linked rows; groups are runs."""
    label = np.arange(len(fp))
    tree = [np.zeros((0, 2), np.int64)]
    index = np.arange(len(fp))
    lag = 1
    while True:
        size = np.bincount(np.cumsum(np.append(0, group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
        keep = np.repeat(size > lag, size)
        fp, group, index, size = fp[keep], group[keep], index[keep], size[size > lag]
        if not len(fp):
            break
        planes = planes_of(fp)
        while 2 * (left := int(size[size > lag].sum())) > len(fp):  # lay out anew when half of the rows are done
            same = np.zeros(planes.shape[1] * 64, np.uint8)
            same[: len(group) - lag] = group[lag:] == group[:-lag]
            hit = within(planes, lag, np.packbits(same, bitorder="little").view("<u8"), radius)
            rows = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            a, b = label[index[rows]], label[index[rows + lag]]
            new = a != b
            if new.any():
                rows = rows[new][join_labels(label, a[new], b[new])]
                tree.append(np.stack([index[rows], index[rows + lag]], axis=1))
            lag += 1
        if not left:
            break
    pairs = np.concatenate(tree)
    return pairs[:, 0], pairs[:, 1]


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, fp) come sorted; links within equal (key, cell)."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def judge(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, cell, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        group = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        several = np.bincount(group)[group] > 1
        fp, group = fp[several], group[several]
        one, two = forest(fp.view(np.uint64), group, radius)
        pairs = np.stack([fp[one], fp[two]], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(b.column(k).to_numpy() for k in ("key", "cell", "fp"))
        held.append(cols)
        count += b.num_rows
        if count >= BATCH:
            key, cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            cut = int(edge[-1]) + 1 if len(edge) else 0  # the last bucket may go on
            if cut:
                yield judge([(key[:cut], cell[:cut], fp[:cut])])
            held, count = [(key[cut:], cell[cut:], fp[cut:])], len(key) - cut
    if count:
        yield judge(held)


def links(distinct: DataFrame, radius: int, blocks: int, scratch: common.Scratch) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp), enough to connect what is connected."""
    spark = distinct.sparkSession
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]

    def bits(i: int):
        width = bounds[i + 1] - bounds[i]
        return F.shiftrightunsigned("fp", bounds[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long")), width

    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            value, width = bits(i)
            key = F.shiftleft(key, width).bitwiseOR(value)
        keys.append(key)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    hot = scratch.save(counted.where(F.col("n") > HOT))
    many = hot.count()
    if many:
        parts = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
        rows = rows.join(parts, "key", "left")
        chunks = F.coalesce(F.ceil(F.col("n") / HOT), F.lit(1)).cast("long")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        pair = lambda other: F.least(own, other) * F.col("chunks") + F.greatest(own, other)
        rows = rows.withColumn("chunks", chunks).select("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), pair)).alias("cell"), "fp")
    else:
        rows = rows.select("key", F.lit(0).cast("long").alias("cell"), "fp")
    n = common.partitions(spark)
    found = rows.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", "fp").mapInArrow(common.tidy(lambda it: compare(it, radius)), "u long, v long")
    out = scratch.save(found.distinct())
    scratch.drop(hot)
    return out


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """node, root: the least node of each component, for all nodes but the roots. A scratch table."""
    star = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())

    def is_star() -> bool:
        """Each u has one v, and no v is a u."""
        ends = star.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(star.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 OR low > 0 AND high > 0").limit(1).count() == 0

    while not is_star():
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, star = star, scratch.save(small)
        scratch.drop(before)
    named = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    named._scratch_path = star._scratch_path
    return named


def near_components(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (the least doc_id that links reach) of each document."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "simhash")
    data = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    table = scratch.save(fingerprints(data, shingle))
    least = scratch.save(table.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(least.select("fp"), radius, blocks, scratch)
    roots = components(found, scratch)
    scratch.drop(found)
    rooted = scratch.save(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    scratch.drop(least, roots)
    common.release_shuffles(spark)
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(by_root, "root").select("fp", "component_id")
    return table.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def word_sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``size`` words (fewer words: of all of them; none: nothing)."""
    raw, off = common.byte_view(common.texts(batch))
    starts, ends, first = common.word_bounds(raw, off)
    word = common.range_hashes(raw, starts, ends, common.CASELESS_VALUES)
    grams = word[: max(0, len(word) - size + 1)].copy()
    for j in range(1, size):
        grams = grams * common.BASE + word[j : j + len(grams)]
    grams = common.fmix(grams + np.uint64(size))
    out = []
    for i, j in itertools.pairwise(first.tolist()):
        if j - i >= size:
            out.append(np.unique(grams[i : j - size + 1]))
            continue
        total = 0
        for w in word[i:j].tolist():
            total = (total * int(common.BASE) + w) & ((1 << 64) - 1)
        out.append(common.fmix(np.array([total + j - i] if j > i else [], np.uint64)))
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """A sketch of a set: bit i is the parity of the hashes that fall on i. Two sketches differ in no more bits than the sets in elements."""
    bits = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def wide_parity(hashes: np.ndarray) -> bytes:
    """A parity sketch of at least one bit for each element; its number of bits is a power of two, so that two sketches of different sizes can be compared."""
    width = max(64 * SKETCH, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64 * SKETCH
    bits = np.bincount(((hashes >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def sketches_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches (as words of 64 bits) differ, the longer one folded to the length of the other: at most the elements not shared."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum(dtype=np.int64))


def described(data: DataFrame, size: int) -> DataFrame:
    """uid, dk and, of each text's shingle set: fp (SimHash), n (elements), key (a hash of the whole set, 0 for the empty one), sketch and a wide sketch."""
    names = ["uid", "dk", "fp", "n", "key", "sketch", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, limit=SET_BYTES):
                sets = word_sets(b, size)
                fp = np.array([fingerprint(x) for x in sets], np.uint64).view(np.int64)
                key = np.array([xxhash.xxh64_intdigest(x.tobytes()) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("dk"), pa.array(fp), pa.array([len(x) for x in sets], pa.int32()), pa.array(key), pa.array([parity(x).tobytes() for x in sets], pa.binary()), pa.array([wide_parity(x) for x in sets], pa.binary())], names)

    return data.mapInArrow(common.tidy(run), "uid long, dk long, fp long, n int, key long, sketch binary, wide binary")


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i], one by one; which of these joined two classes. ``label`` points to smaller members and is changed."""
    new = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while label[x] != x:
            x = label[x]
        while label[y] != y:
            y = label[y]
        if x != y:
            label[max(x, y)] = min(x, y)
            new[i] = True
    while (label[label] != label).any():
        label[:] = label[label]
    return new


def pair_blocks(root: np.ndarray, n: np.ndarray, at: np.ndarray, sketch: np.ndarray, group: np.ndarray, similarity: float, forest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (groups are runs), of different root, that may be similar, in blocks of bounded size: no similar pair is lost.

    Sets of similarity t share at least t / (1 + t) of their summed sizes. At the
    first shared shingle, only it and what follows it can be shared; and the
    sketches tell apart at most the elements that are not shared. With
    ``forest`` only pairs that connect roots which the pairs before did not.
    """
    root = np.unique(root, return_inverse=True)[1]
    label = np.arange(root.max(initial=-1) + 1)
    index, lag = np.arange(len(n)), 1
    while True:
        size = np.bincount(np.cumsum(np.append(0, group[index[1:]] != group[index[:-1]]))) if len(index) else np.zeros(0, np.int64)
        index = index[np.repeat(size > lag, size)]
        if not len(index):
            return
        sizes = size[size > lag]
        g, m, rest = (x[index] for x in (group, n, n - at))
        r = label[root[index]]
        while 2 * int(sizes[sizes > lag].sum()) > len(index):  # lay out anew when half of the rows are done
            total = m[:-lag] + m[lag:]
            need = similarity / (1 + similarity) * total - 1e-6
            fit = (g[:-lag] == g[lag:]) & (r[:-lag] != r[lag:]) & (np.minimum(m[:-lag], m[lag:]) >= similarity * np.maximum(m[:-lag], m[lag:]) - 1e-9)
            fit = np.flatnonzero(fit & (np.minimum(rest[:-lag], rest[lag:]) >= need))
            for first in range(0, len(fit), BATCH):
                rows = fit[first : first + BATCH]
                one, two = index[rows], index[rows + lag]
                apart = np.bitwise_count(sketch[one] ^ sketch[two]).sum(1, dtype=np.int64)
                close = apart <= total[rows] - 2 * need[rows]
                one, two = one[close], two[close]
                if forest and len(one):
                    new = join_labels(label, label[root[one]], label[root[two]])
                    one, two = one[new], two[new]
                    r = label[root[index]]
                if len(one):
                    yield one, two
            lag += 1


def possible_pairs(root: np.ndarray, n: np.ndarray, at: np.ndarray, sketch: np.ndarray, group: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of ``pair_blocks`` together."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *pair_blocks(root, n, at, sketch, group, similarity)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shingle_weights(data: DataFrame, size: int) -> np.ndarray:
    """How common shingles are: the binary logarithm of the count in each of ``SLOTS`` hashed slots.

    It only orders shingles, so that buckets of common ones are rare; every
    order is right. Its size does not depend on the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for b in common.slices(batch, limit=SET_BYTES):
                for hashes in word_sets(b, size):
                    np.add.at(total, (hashes % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["slot", "n"])

    rows = data.select("text").mapInArrow(common.tidy(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.uint8)
    out[rows["slot"].to_numpy()] = np.log2(rows["n"].to_numpy().astype(float)).astype(np.uint8)
    return out


def prefix_rows(data: DataFrame, weights: np.ndarray, size: int, similarity: float) -> DataFrame:
    """h, key, n, at: the prefix of each set, the rarest shingles first, and the place ``at`` of each.

    Two sets of similarity t share an element of their first n - ceil(t n) + 1
    under any common order, so no similar pair lacks a common h. A task sends
    equal sets once.
    """
    held = data.sparkSession.sparkContext.broadcast(weights)
    names = ["h", "key", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        sent: set[int] = set()
        for batch in batches:
            for b in common.slices(batch, limit=SET_BYTES):
                heads, keys, counts = [np.zeros(0, np.uint64)], [], []
                for hashes in word_sets(b, size):
                    n = len(hashes)
                    key = xxhash.xxh64_intdigest(hashes.tobytes())
                    if not n or key in sent:
                        continue
                    sent.add(key)
                    first = n - int(np.ceil(similarity * n - 1e-9)) + 1
                    heads.append(hashes[np.argsort(order[(hashes % np.uint64(SLOTS)).astype(np.int64)], kind="stable")[:first]])
                    keys.append(key)
                    counts.append((first, n))
                first, n = np.array(counts, np.int64).reshape(-1, 2).T
                key = np.repeat(np.array(keys, np.uint64).view(np.int64), first)
                at = np.arange(first.sum()) - np.repeat(np.cumsum(first) - first, first)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(key), pa.array(np.repeat(n, first).astype(np.int32)), pa.array(at.astype(np.int32))], names)

    return data.select("text").mapInArrow(common.tidy(run), "h long, key long, n int, at int")


def candidates(batches: Iterator[pa.RecordBatch], similarity: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (h, cell, key, root, n, at, sketch) come sorted; pairs of equal (h, cell) and different root that may be similar (``forest``: as many as connect them)."""
    names = ("h", "cell", "key", "root", "n", "at")
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def judge(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        h, cell, key, root, n, at, sketch = rows
        group = np.cumsum(np.append(0, (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])))
        some, size = [], 0
        for one, two in pair_blocks(root, n.astype(np.int64), at.astype(np.int64), sketch, group, similarity, forest):
            some.append(np.stack([np.maximum(key[one], key[two]), np.minimum(key[one], key[two])], axis=1))
            size += len(one)
            if size >= BATCH:
                some, size = [np.unique(np.concatenate(some), axis=0)], 0
                yield pa.RecordBatch.from_arrays([pa.array(some[0][:, 0]), pa.array(some[0][:, 1])], ["u", "v"])
                some = []
        if some:
            pairs = np.unique(np.concatenate(some), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        sketch = common.byte_view(b.column("sketch"))[0].reshape(b.num_rows, 8 * SKETCH).view("<u8")
        held.append((*(b.column(k).to_numpy() for k in names), sketch))
        count += b.num_rows
        if count >= BATCH:
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(edge[-1]) + 1 if len(edge) else 0  # the last bucket may go on
            if cut:
                yield from judge(tuple(x[:cut] for x in rows))
            held, count = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
    if count:
        yield from judge(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def bucket_parts(rows: DataFrame, weight: int = 1) -> list[DataFrame]:
    """The rows by whole buckets: one part, or some of about ``PART_ROWS / weight`` rows, at most ``PARTS``."""
    n = min(PARTS, 1 + weight * rows.count() // PART_ROWS)
    return [rows.where(F.pmod(F.xxhash64("h"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def mixed_buckets(rows: DataFrame, by: str, scratch: common.Scratch) -> DataFrame:
    """The rows of buckets in which ``by`` differs. A scratch table."""

    def parts() -> Iterator[DataFrame]:
        for part in bucket_parts(rows):
            seen = part.groupBy("h").agg(F.min(by).alias("a"), F.max(by).alias("b"))
            keep = scratch.save(seen.where("a != b").select("h"))
            del seen
            common.release_shuffles(scratch.spark)
            yield part.join(F.broadcast(keep) if keep.count() <= BROADCAST_ROWS else keep, "h").distinct()
            scratch.drop(keep)

    return scratch.save_parts(parts())


def bucket_cells(rows: DataFrame) -> DataFrame:
    """Rows with a cell: rows of one bucket that may be similar, and differ in root, meet in one cell at least.

    A bucket of up to ``HOT`` rows is one cell. In a larger one, the rows of its
    most frequent root need not meet each other: each goes to one chunk of its
    own, times the chunks of the others, which are dealt to all pairs of chunks.
    """
    by_root = rows.groupBy("h", "root").agg(F.count("*").alias("c"))
    bucket = by_root.groupBy("h").agg(F.sum("c").alias("total"), F.max(F.struct("c", F.col("root").alias("r"))).alias("m")).where(F.col("total") > HOT)
    sized = rows.join(bucket.select("h", "total", F.col("m.c").alias("most"), F.col("m.r").alias("main")), "h", "left")
    chunks = lambda n: F.ceil(n / HOT).cast("long")
    own = lambda n: F.pmod(F.xxhash64("key"), n)
    a, b = chunks(F.col("most")), chunks(F.greatest(F.col("total") - F.col("most"), F.lit(1)))
    steps = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_main = lambda i, j: i * b + j  # noqa: E731  chunk i of the main root, chunk j of the others
    among = lambda i, j: a * b + F.least(i, j) * b + F.greatest(i, j)
    main = F.transform(steps(b), lambda j: with_main(own(a), j))
    others = F.concat(F.transform(steps(a), lambda i: with_main(i, own(b))), F.transform(steps(b), lambda j: among(own(b), j)))
    cells = F.when(F.col("total").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("root") == F.col("main"), main).otherwise(others)
    return sized.withColumn("cell", F.explode(cells)).drop("total", "most", "main")


def similar_pairs(pairs: DataFrame, data: DataFrame, nodes: DataFrame, size: int, similarity: float, elements: int, scratch: common.Scratch) -> DataFrame:
    """Of pairs (u, v) of set keys, those whose sets are similar. A scratch table.

    Wide sketches first prove most pairs not similar. Sets are made of what is
    left, and sent to pairs in turns of about ``SENT`` of ``elements`` (those of
    all sets).
    """
    spark = scratch.spark

    def ends_of(some: DataFrame) -> DataFrame:
        return some.select(F.col("u").alias("key")).union(some.select(F.col("v").alias("key"))).distinct()

    def both(some: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        for end in ("u", "v"):
            some = some.join(of.select(F.col("key").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return some

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy().astype(np.int64) for k in ("n_u", "n_v"))
            most = (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6
            apart = [sketches_apart(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(b.column("wide_u"), b.column("wide_v"), strict=True)]
            keep = pa.array((np.array(apart, np.int64) <= most) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep), pa.array(n + m).filter(keep)], ["u", "v", "size"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, limit=SET_BYTES):
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([x.astype("<u8").tobytes() for x in word_sets(b, size)], pa.binary())], ["key", "set"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("set_u"), b.column("set_v"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                near.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])

    ends = scratch.save(nodes.select("key", "uid", "n", "wide").join(ends_of(pairs), "key"))
    left = scratch.save(both(pairs, ends, "n", "wide").select("u", "v", "n_u", "n_v", "wide_u", "wide_v").mapInArrow(common.tidy(possible), "u long, v long, size long"))
    common.release_shuffles(spark)
    members = scratch.save(ends.select("key", "uid").join(ends_of(left), "key"))
    scratch.drop(ends)
    chosen = data.select("uid", "text").join(F.broadcast(members) if members.count() <= UID_ROWS else members, "uid")
    sets = scratch.save(chosen.select("key", "text").mapInArrow(common.tidy(hashes), "key long, set binary"))
    del chosen
    common.release_shuffles(spark)
    turns = max(1, int(np.ceil((left.agg(F.sum("size")).first()[0] or 0) / max(1, SENT * elements))))

    def compared(some: DataFrame) -> DataFrame:
        return both(some.select("u", "v"), sets, "set").select("u", "v", "set_u", "set_v").mapInArrow(common.tidy(similar), "u long, v long")

    out = scratch.save_parts(compared(left.where(F.pmod(F.xxhash64("u", "v"), F.lit(turns)) == i) if turns > 1 else left) for i in range(turns))
    scratch.drop(left, members, sets)
    return out


def simhash_pairs(nodes: DataFrame, radius: int, blocks: int, scratch: common.Scratch) -> DataFrame:
    """u, v: set keys whose fingerprints are within ``radius`` bits: of each fingerprint all with the first, and the first with that of the nearest smaller one."""
    lead = scratch.save(nodes.groupBy("fp").agg(F.min("key").alias("lead")))
    edges = links(lead.select("fp"), radius, blocks, scratch)
    between = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).alias("d"))
    nearest = between.groupBy("u").agg(F.min(F.struct("d", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    one, two = lead.select(F.col("fp").alias("u"), F.col("lead").alias("a")), lead.select(F.col("fp").alias("v"), F.col("lead").alias("b"))
    nearest = nearest.join(one, "u").join(two, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same_fp = nodes.select("fp", "key").join(lead, "fp").where("key != lead").select(F.col("key").alias("u"), F.col("lead").alias("v"))
    out = scratch.save(nearest.union(same_fp))
    scratch.drop(lead, edges)
    return out


def head_pairs(mixed: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """u, v: each set of a bucket with the bucket's smallest one, where size, fingerprint and sketch leave it likely that they are similar."""
    head = mixed.groupBy("h").agg(F.min(F.struct("n", "key")).alias("f"))
    pairs = mixed.join(head, "h").where((F.col("key") != F.col("f.key")) & (F.col("f.n") >= similarity * F.col("n") - 1e-9)).select(F.col("key").alias("u"), F.col("f.key").alias("v")).distinct()
    own = lambda k, *of: nodes.select(F.col("key").alias(k), F.struct(*of).alias(f"of_{k}"))
    near = F.bit_count(F.col("of_u.fp").bitwiseXOR(F.col("of_v.fp"))) <= WIDE
    close = pairs.join(own("u", "fp"), "u").join(own("v", "fp"), "v").where(near).select("u", "v")
    both = close.join(own("u", "n", "sketch"), "u").join(own("v", "n", "sketch"), "v")
    word = lambda k, i: F.conv(F.hex(F.substring(F.col(f"of_{k}.sketch"), 8 * i + 1, 8)), 16, -10).cast("long")
    apart = sum(F.bit_count(word("u", i).bitwiseXOR(word("v", i))) for i in range(SKETCH))
    most = (F.col("of_u.n") + F.col("of_v.n")) * ((1 - similarity) / (1 + similarity))
    return both.where(apart <= most + 1e-6).select("u", "v")


def drop_near_copies(docs: DataFrame, shingle: int = 5, radius: int = 4, blocks: int = 6, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies; one document of each group stays, all columns as they came.

    Two texts are linked if the Jaccard similarity of their shingle sets is at
    least ``similarity``. Groups are the components of links, and their least
    document (by id, then row) stays. Equal sets are one node. First nodes with
    fingerprints (of their distinct shingles) within ``radius`` bits, and nodes
    with the smallest node of a bucket of a rare shingle, are compared as sets;
    this joins nearly all copies. Then nodes of different groups that share one
    of their rarest shingles (as all linked ones do) are compared, but those
    whose sizes, places or parity sketches prove that they are not similar:
    ``ROUNDS`` times a spanning forest of such pairs, so that a large group is
    joined without all of its pairs, and at last all that are left.
    Neither ``radius`` nor ``WIDE`` decides a link: what they pass over is
    compared after that.

    Null and empty texts, and others without words, are one group; a null id
    comes first; repeated rows are copies; very long texts are read whole (about
    30 bytes of memory for each byte); an empty table gives no rows; further
    columns are carried, whatever their names. Sets are compared by 64-bit
    hashes of their shingles, and equal sets are found by a 64-bit hash.
    """
    with common.small_batches(docs.sparkSession):
        return without_near_copies(docs, shingle, radius, blocks, similarity, id_col, text_col)


def without_near_copies(docs: DataFrame, shingle: int, radius: int, blocks: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The steps of ``drop_near_copies``."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "near")
    mine = common.fresh(docs, "__uid")
    numbered = common.numbered(docs, mine, scratch)
    least = F.lit(-(1 << 63)).cast("long")
    data = numbered.select(F.col(mine).alias("uid"), F.coalesce(F.col(f"`{id_col}`").cast("long"), least).alias("dk"), F.col(f"`{text_col}`").alias("text"))
    table = scratch.save(described(data, shingle))
    nodes = scratch.save(table.groupBy("key").agg(F.min(F.struct("dk", "uid")).alias("f"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("wide").alias("wide")).select("key", "f.dk", "f.uid", "fp", "n", "sketch", "wide"))
    scratch.drop(table)
    common.release_shuffles(spark)
    elements = nodes.agg(F.sum("n")).first()[0] or 0
    by_print = simhash_pairs(nodes, radius, blocks, scratch)
    rows = scratch.save(prefix_rows(data, shingle_weights(data, shingle), shingle, similarity))
    mixed = mixed_buckets(rows, "key", scratch)
    scratch.drop(rows)
    common.release_shuffles(spark)
    tried = by_print.union(head_pairs(mixed, nodes, similarity))
    tried = scratch.save(tried.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    scratch.drop(by_print)
    common.release_shuffles(spark)
    edges = similar_pairs(tried, data, nodes, shingle, similarity, elements, scratch)
    turn = 0
    while turn <= ROUNDS:
        tree = components(edges, scratch)
        rooted = mixed.select("h", "key", "n", "at").join(tree, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
        rooted = scratch.save(rooted)
        scratch.drop(mixed)
        common.release_shuffles(spark)
        mixed = mixed_buckets(rooted, "root", scratch)
        scratch.drop(rooted)

        def made(part: DataFrame, turn: int = turn) -> DataFrame:
            cells = bucket_cells(part).join(nodes.select("key", "sketch"), "key").withColumn("place", F.xxhash64("key", "h", F.lit(turn)))  # other pairs first in each bucket and round
            cells = cells.repartition(common.partitions(spark), "h", "cell").sortWithinPartitions("h", "cell", "place", "key")
            return cells.mapInArrow(common.tidy(lambda it: candidates(it, similarity, turn < ROUNDS)), "u long, v long").distinct()

        found = scratch.save_parts(made(part) for part in bucket_parts(mixed, 4))
        asked = scratch.save(found.distinct().join(tried, ["u", "v"], "left_anti"))
        scratch.drop(found)
        common.release_shuffles(spark)
        new = similar_pairs(asked, data, nodes, shingle, similarity, elements, scratch)
        turn = turn + 1 if turn == ROUNDS or not new.isEmpty() else ROUNDS
        old, edges = edges, scratch.save(tree.select(F.col("node").alias("u"), F.col("root").alias("v")).union(new))
        before, tried = tried, scratch.save(tried.union(asked))
        scratch.drop(old, tree, new, before, asked)
    final = components(edges, scratch)
    grouped = nodes.select("key", "dk", "uid").join(final, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    grouped = scratch.save(grouped.select("key", "dk", "uid", "root"))
    scratch.drop(mixed, tried, edges, final, nodes)
    stays = grouped.groupBy("root").agg(F.min(F.struct("dk", "uid")).alias("f")).select(F.col("f.uid").alias("uid"))
    stays = scratch.save(stays)
    gone = scratch.save(data.select("uid").join(stays, "uid", "left_anti").select(F.col("uid").alias(mine)))
    scratch.drop(grouped, stays)
    common.release_shuffles(spark)
    return numbered.join(F.broadcast(gone) if gone.count() <= UID_ROWS else gone, mine, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
