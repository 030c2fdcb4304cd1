"""Batch encoder for a word-level byte-pair tokenizer file.

The tokenizer drops white space and never merges across it, so a text's ids
are the ids of its words in order. Each batch is split and dictionary-encoded
in Arrow and only distinct words that the worker has not seen reach the
tokenizers library. Only words that case cannot change are looked up in lower
case: special tokens are matched before normalisation, and letters may compose
with marks before they are lower-cased. Ids are exactly those of
``Tokenizer.encode`` on the whole text.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words kept between batches; the cache starts anew beyond that (memory bound, never a limit on the input).
CACHE_WORDS = 500_000
#: Letters that are one pre-token in a row, stay what they are under NFC, and take no mark when lower-cased.
_LETTERS = "a-zA-Zà-öø-ÿßÀ-ÖØ-Þ"
_TAIL = f"([{_LETTERS}])([.,!?;:#$%&*|)]+)( |$)"  # such a run of signs before a space is one pre-token anyhow
_PLAIN = "^[a-zà-öø-ÿß]+$"
#: Words that hold a mark, a letter beyond Latin-1, or what may begin a special token keep their case.
_CASED = r"<\||[^\x00-\x{ff}]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.closes = np.array([bool(t) and t.endswith("</w>") for t in tokens])
        self.reset()

    def reset(self) -> None:
        self.words = pa.array([], pa.string())
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and the count for each."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(words), np.int64)
        flat: list[np.ndarray] = []
        order: list[np.ndarray] = []
        at = np.flatnonzero(plain)
        simple = words.take(pa.array(at)).to_pylist()
        for i in range(0, len(simple), 4096):  # one pre-token each: the id that closes a word ends it
            part = simple[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                counts[at[i : i + 4096]] = np.diff(ends, prepend=0)
                flat.append(ids)
                continue
            for k, e in zip(at[i : i + 4096].tolist(), self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                counts[k] = len(e.ids)
                flat.append(np.array(e.ids, np.uint32))
        order.append(at)
        rest = np.flatnonzero(~plain)
        for k, e in zip(rest.tolist(), self.tokenizer.encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            counts[k] = len(ids)
            flat.append(ids)
        order.append(rest)
        order_ = np.concatenate(order)
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        starts = np.empty(len(words), np.int64)
        starts[order_] = np.cumsum(counts[order_]) - counts[order_]
        return gather(ids, starts, counts), counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (nulls: empty), flat, and n + 1 offsets."""
        column = pc.fill_null(column, "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        text = column
        for space in ("\n", "\t", "\r"):
            text = pc.replace_substring(text, space, " ")
        text = pc.replace_substring_regex(text, _TAIL, r"\1 \2\3")
        parts = pc.split_pattern(text, " ")
        coded = parts.flatten().dictionary_encode()
        raw = coded.dictionary
        coded_words = pc.if_else(pc.match_substring_regex(raw, _CASED), raw, pc.ascii_lower(raw)).dictionary_encode()
        words, codes = coded_words.dictionary, coded_words.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        if len(self.words) > CACHE_WORDS:
            self.reset()
        known = pc.index_in(words, value_set=self.words)
        missing = words.filter(pc.is_null(known))
        slot = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            slot[slot < 0] = len(self.words) + np.arange(len(missing))
            ids, counts = self._new(missing)
            self.words = pa.concat_arrays([self.words, missing])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
        at = slot[codes]
        counts = (self.offsets[1:] - self.offsets[:-1])[at]
        flat = gather(self.ids, self.offsets[at], counts)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return flat, bounds[parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)]


def gather(source: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """source[starts[i] : starts[i] + counts[i]] of all i, concatenated."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return source[np.repeat(starts - first, counts) + np.arange(total)]


def append_end(flat: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` after each document's ids."""
    n = len(off) - 1
    new = off + np.arange(n + 1)
    out = np.empty(new[-1], np.uint32)
    mask = np.ones(len(out), bool)
    mask[new[1:] - 1] = False
    out[mask] = flat[off[0] : off[-1]]
    out[new[1:] - 1] = end_id
    return out, new


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)
