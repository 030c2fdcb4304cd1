"""Token counts under a unigram model, by dynamic programming shared over a trie.

Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+`` with the space mark before
them. The distinct pre-tokens of a slice are walked as a trie (in sorted
order, each from where it leaves the one before it); the forward score of a
prefix is computed once for all words under it, and a word's terminal keeps
the number of tokens of its best segmentation. A document's count is the sum
over its words.

The vocabulary file gives pieces in order of rank but no probabilities; a
piece of rank r gets the Zipf probability 1 / ((r + 1) H). A character that no
piece covers costs one byte piece for each of its bytes. Of equal scores the
segmentation with fewer tokens wins.

Cases: null and empty texts hold no tokens; every row is counted as it comes;
a very long text is counted whole (some 20 bytes of memory for each byte); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spm_spans

MARK = "▁"
MICRO = 1_000_000


class Unigram:
    """Integer costs (micro-nats) of pieces; ``costs`` also holds every proper suffix of a piece, with None."""

    def __init__(self, pieces: list[str], byte_cost: int | None = None):
        harmonic = sum(1 / (r + 1) for r in range(len(pieces)))
        own = {p: round(MICRO * (math.log(r + 1) + math.log(harmonic))) for r, p in enumerate(pieces) if p}
        self.byte_cost = byte_cost if byte_cost is not None else round(MICRO * (math.log(len(pieces) + 1) + math.log(harmonic)))
        self.costs: dict[str, int | None] = {p[i:]: None for p in own for i in range(1, len(p))}
        self.costs |= own

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of the best segmentation of each of the sorted, distinct words."""
        get, byte_cost = self.costs.get, self.byte_cost
        cost, used = [0], [0]  # forward scores of the current path
        out, before = [], ""
        miss: dict[str, int] = {}
        for word in words:
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del cost[n + 1 :], used[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                char = word[end - 1]
                width = miss.get(char) or miss.setdefault(char, len(char.encode()))
                best, tokens = cost[end - 1] + width * byte_cost, used[end - 1] + width
                for start in range(end - 1, -1, -1):
                    piece = get(word[start:end], -1)
                    if piece is None:
                        continue
                    if piece < 0:
                        break
                    total = cost[start] + piece
                    if total < best or (total == best and used[start] + 1 < tokens):
                        best, tokens = total, used[start] + 1
                cost.append(best)
                used.append(tokens)
            out.append(used[len(word)])
            before = word
        return out


@functools.lru_cache(maxsize=2)
def model(path: str) -> Unigram:
    lib = spm_spans.encoder(path).lib
    return Unigram([lib.id_to_piece(i) for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))])


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each document, in one pass without a shuffle."""
    path = path or spm_spans.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = model(path)
        for batch in batches:
            for b in common.slices(batch):
                raw, off = common.byte_view(common.texts(b))
                starts, ends, first = common.word_bounds(raw, off)
                bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
                keep = ~common.is_space(raw)
                words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw[keep]))
                coded = words.dictionary_encode()
                order = pc.array_sort_indices(coded.dictionary).to_numpy()
                terminal = np.empty(len(order), np.int64)
                terminal[order] = lm.counts([MARK + w for w in coded.dictionary.take(pa.array(order)).to_pylist()])
                total = np.concatenate([[0], np.cumsum(terminal[coded.indices.to_numpy(zero_copy_only=False)])])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]])], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.tidy(run), "doc_id long, n_words long, n_tokens long")
