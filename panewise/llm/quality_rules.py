"""Quality rules on repetition coverage.

Rolling hashes of several n-gram lengths (prefix sums of word hashes times
powers of an odd base, modulo 2^64) find the n-grams and lines of a text that
came before in it; the characters inside them, over all characters in words,
are the coverage. All texts of a slice are handled at once in numpy.

Equal hashes of 64 bits count as equal n-grams and lines.

Cases: null and empty texts have no words and fail; every row is judged as it
comes, copies alike; a very long text is measured whole, in about 20 bytes of
memory for each byte; an empty table gives no rows; further columns are
ignored or carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Largest share of characters inside duplicated n-grams, by n: twice the published limits of large web
#: corpora, as one repeated sentence in a short text of 60 words already reaches those.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.50  # duplicated lines among lines
LINE_CHARS_LIMIT = 0.30  # characters in duplicated lines among characters in words
SYMBOLS = b"#*$%&|<>"


def seen_before(keys: np.ndarray) -> np.ndarray:
    """For each key whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the windows of ``length`` words."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the texts with the given bytes and offsets."""
    docs = len(off) - 1
    starts, ends, first = common.word_bounds(raw, off)
    n_words = np.diff(first)
    inner = np.flatnonzero(raw & 0xC0 == 0x80)  # bytes that begin no character
    word_len = (ends - starts) - (np.searchsorted(inner, ends) - np.searchsorted(inner, starts))
    doc_of = np.repeat(np.arange(docs), n_words)
    salt = common.fmix(doc_of.astype(np.uint64) + np.uint64(1))

    def total(x: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(x)])
        return s[first[1:]] - s[first[:-1]]

    out = {"n_words": n_words, "word_chars": total(word_len)}
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    signs = np.searchsorted(np.flatnonzero(table[raw]), off)
    out["n_symbols"] = np.diff(signs)

    grams = common.RollingHash(common.range_hashes(raw, starts, ends))
    n = len(starts)
    last = first[1:][doc_of] if n else np.zeros(0, np.int64)
    at = np.arange(n)

    windows = at[at + 3 <= last]
    keys = common.fmix(grams.of(windows, windows + 3)) ^ salt[windows]
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    repeated = np.zeros(len(keys), bool)
    repeated[order[1:]] |= equal
    repeated[order[:-1]] |= equal
    out["n_repeat_words"] = total(covered(windows[repeated], 3, n))

    again = windows[repeated]  # only there can a longer n-gram come twice
    for size in NGRAM_LIMITS:
        again = again[again + size <= last[again]]
        dup = again[seen_before(common.fmix(grams.of(again, again + size)) ^ salt[again])]
        out[f"dup{size}_chars"] = total(np.where(covered(dup, size, n), word_len, 0))

    breaks = np.flatnonzero(raw == 0x0A)
    lo = np.sort(np.concatenate([off[:-1], breaks + 1]))
    hi = np.sort(np.concatenate([breaks, off[1:]]))
    words_in = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)
    real = words_in > 0
    lo, hi = lo[real], hi[real]
    owner = np.searchsorted(off, lo, side="right") - 1
    dup = seen_before(common.range_hashes(raw, lo, hi) ^ common.fmix(owner.astype(np.uint64) + np.uint64(1)))
    out["n_lines"] = np.bincount(owner, minlength=docs)
    out["n_dup_lines"] = np.bincount(owner[dup], minlength=docs)
    ahead = np.concatenate([[0], np.cumsum(word_len)])
    inside = ahead[np.searchsorted(starts, hi)] - ahead[np.searchsorted(starts, lo)]
    out["dup_line_chars"] = np.bincount(owner[dup], weights=inside[dup], minlength=docs).astype(np.int64)
    return out


def judge(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = np.zeros(len(base_failed), bool)
    for size, limit in NGRAM_LIMITS.items():
        bad |= m[f"dup{size}_chars"] > limit * m["word_chars"]
    bad |= m["n_dup_lines"] > LINE_LIMIT * m["n_lines"]
    bad |= m["dup_line_chars"] > LINE_CHARS_LIMIT * m["word_chars"]
    return base_failed, ~(base_failed | bad)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup{n}_chars" for n in NGRAM_LIMITS), "n_lines", "dup_line_chars"]


def quality_rules(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of each row (None: all), its measures, base_failed and kept; one pass, no shuffle.

    Measure columns replace carried columns of the same name.
    """
    made = [*MEASURES, "base_failed", "kept"]
    carried = [c for c in (carry if carry is not None else docs.columns) if c not in made]
    kept_columns = [F.col(f"`{c}`") for c in carried]
    data = docs.select(F.struct(*kept_columns).alias("carried"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, limit=2 << 20):
                raw, off = common.byte_view(common.texts(b))
                m = measure(raw, off)
                failed, kept = judge(m)
                yield pa.RecordBatch.from_arrays([*(b.column("carried").field(k) for k in range(len(carried))), *(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(failed), pa.array(kept)], [*carried, *made])

    schema = docs.select(*kept_columns).schema
    for k in MEASURES:
        schema = schema.add(k, "long")
    return data.mapInArrow(common.tidy(run), schema.add("base_failed", "boolean").add("kept", "boolean"))
