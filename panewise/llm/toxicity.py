"""Toxicity by a weighted lexicon.

Texts are folded (lower case, accents and homoglyphs to their Latin letters,
digit and sign substitutions next to letters), an Aho-Corasick automaton finds
the lexicon's words at word bounds, hits inside an exception phrase do not
count, and the weighted hits, also normalised by length, give a logistic
score.

The lexicon, the exceptions and the logistic are learned from at most
``MAX_SAMPLE`` labelled rows outside the held-out fold, the first by a hash of
their id; of documents with one id one text is read. The best ``max_entries``
entries and as many exceptions make the lexicon (a parameter of ``learn``, so
that the model has a bounded size). Of texts of one label whose shingle sets
are similar, found by an equal signature and then compared, the first counts.

Cases: null and empty texts have no hits and get the score of such texts; null
labels are not learned from; repeated labels of a document count as toxic if
any is; every document row is scored as it comes; without labelled rows of
both kinds every score is the share of toxic labels (0 without labels); a very long
text is folded and searched whole (some 15 bytes of memory for each byte).
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_SAMPLE = 10_000
MAX_LEXICON = 500
SIMILARITY = 0.8  # of texts that count once
MIN_SHARE = 0.02  # of the toxic texts that a lexicon entry must be in
MIN_TEXTS = 5.0  # and at least so many
MIN_PRECISION = 0.8  # from which on an entry is strong
MIN_WEIGHT = 2.0  # log of how much oftener toxic texts have it
#: Cyrillic and Greek letters that look like Latin ones (fixed values).
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s", "!": "i"}


def _folds() -> dict[int, str]:
    """Each letter that decomposes to a Latin one, and the homoglyphs, to lower-case Latin letters."""
    out = {}
    for code in [*range(0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530), *range(0xFF21, 0xFF5B)]:
        low = chr(code).lower()
        base = unicodedata.normalize("NFKD", low)[:1]
        base = HOMOGLYPHS.get(base, HOMOGLYPHS.get(low, base))
        if base.isalpha() and base != chr(code):
            out[code] = base
    out |= {c: "" for c in range(0x300, 0x370)}
    return out | {c: "" for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}


FOLDS = _folds()
_SUBSTITUTED = re.compile(r"[013457](?=[a-z])|(?<=[a-z])[013457]|[@$](?=[a-z])|(?<=[a-z])!(?=[a-z])")
_WORD = re.compile(r"[^\W_]+")
_LEFT = re.compile(r"[^\W_]+ $")
_RIGHT = re.compile(r" [^\W_]+")


def fold(text: str) -> str:
    text = text.translate(FOLDS)
    return _SUBSTITUTED.sub(lambda m: DIGITS.get(m[0]) or SIGNS[m[0]], text)


@dataclasses.dataclass
class Entry:
    """A whole word, or a stem (all words that begin with it); strong if few texts that hold it are clean."""

    weight: float
    stem: bool = False
    strong: bool = True


@dataclasses.dataclass
class Lexicon:
    """Weighted entries (stems end in ``*``), phrases within which they do not count, and the logistic over ``features``."""

    entries: dict[str, Entry]
    exceptions: list[str] = dataclasses.field(default_factory=list)
    coef: tuple[float, ...] = (-3.0, 1.0, 1.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        by_key: dict[str, list[Entry | None]] = {}
        for name, e in self.entries.items():
            by_key.setdefault(name.rstrip("*"), []).append(e)
        for p in self.exceptions:
            by_key.setdefault(p, []).append(None)
        made = ahocorasick.Automaton()
        for key, own in by_key.items():
            made.add_word(key, (len(key), own))
        if len(made):
            made.make_automaton()
        return made

    def score(self, strong: np.ndarray, weak: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = features(strong, weak, words) @ np.array(self.coef)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def matches(machine, text: str) -> list[tuple[int, int, Entry]]:
    """Spans of lexicon entries at word bounds in a folded text, without those in exception phrases."""
    if not len(machine):
        return []
    hits, free = [], []
    for end, (size, own) in machine.iter(text):
        start = end + 1 - size
        if start and text[start - 1].isalnum():
            continue
        whole = end + 1 == len(text) or not text[end + 1].isalnum()
        for e in own:
            if e is None:
                if whole:
                    free.append((start, end + 1))
            elif whole or e.stem:
                hits.append((start, end + 1, e))
    return [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in free)] if free else hits


def features(strong: np.ndarray, weak: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Weighted hits, plain and for each hundred words, of strong and weak entries."""
    n = np.maximum(words, 1) / 100
    return np.stack([np.ones(len(words)), np.log1p(strong), np.log1p(strong / n), np.log1p(weak), np.log1p(weak / n)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    pull[0, 0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def shingles(words: list[str]) -> set[int]:
    """Hashes of a text's five-word shingles (or of all its words)."""
    import xxhash

    return {xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))}


def signature(words: list[str]) -> int:
    """The least hash of a text's shingles: equal for most near copies."""
    return min(shingles(words))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label and text of at most ``limit`` labelled documents outside the held-out fold, one row for each id."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("__id").isNotNull() & (common.crc_fold(F.col("__id")) != 0))
    bounded = known.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(bounded), "__id").groupBy("__id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    return found.select("label", "t.text")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_SAMPLE, exceptions: list[str] | None = None, max_entries: int = MAX_LEXICON) -> Lexicon:
    """Learn lexicon, exceptions and logistic from at most ``limit`` labelled documents: at most ``max_entries`` entries, the best, and learned exceptions."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "toxicity")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch):
                folded = [fold(t) for t in common.texts(b).to_pylist()]
                words = [_WORD.findall(t) for t in folded]
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([signature(w) for w in words], pa.int64()), pa.array(folded, pa.string())], ["label", "sign", "text"])

    tasks = max(32, common.partitions(spark))
    sample = scratch.save(labelled(docs, labels, "toxic", limit, id_col, text_col).mapInArrow(common.tidy(prepare), "label int, sign long, text string").repartition(tasks, "sign"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts and occurrences by entry and label; of similar texts with one label only the first counts."""
        seen: dict[tuple[int, int], list[set[int]]] = {}
        texts: Counter = Counter()
        times: Counter = Counter()
        for b in batches:
            for label, sign, text in zip(b.column("label").to_pylist(), b.column("sign").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = _WORD.findall(text)
                parts, known = shingles(words), seen.setdefault((label, sign), [])
                if any(len(parts & x) >= SIMILARITY * len(parts | x) for x in known):
                    continue
                known.append(parts)
                own = Counter(words)
                for w, n in list(own.items()):
                    for k in range(4, min(8, len(w))):
                        own[w[:k] + "*"] += n
                own[""] = sum(n for w, n in own.items() if not w.endswith("*"))
                texts.update((label, w) for w in own)
                times.update({(label, w): n for w, n in own.items()})
        keys = list(texts)
        yield pa.RecordBatch.from_arrays([pa.array([k[1] for k in keys], pa.string()), pa.array([k[0] for k in keys], pa.int32()), pa.array([texts[k] for k in keys], pa.int64()), pa.array([times[k] for k in keys], pa.int64())], ["entry", "label", "texts", "times"])

    one = lambda c, label: F.sum(F.when(F.col("label") == label, F.col(c)).otherwise(0)).alias(f"{c}{label}")
    sums = sample.repartition(tasks, "sign").mapInArrow(common.tidy(count), "entry string, label int, texts long, times long").groupBy("entry").agg(one("texts", 1), one("texts", 0), one("times", 1), one("times", 0))
    sums = scratch.save(sums.where("texts1 >= 5 or entry = ''"))
    all_ = sums.where("entry = ''").collect()
    bad, good = (all_[0]["texts1"], all_[0]["texts0"]) if all_ else (0, 0)
    if not bad or not good:
        n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Lexicon({}, [], (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0, 0.0, 0.0, 0.0))
    rate1, rate0 = all_[0]["times1"], all_[0]["times0"]
    weight = F.log(((F.col("times1") + 0.5) / rate1) / ((F.col("times0") + 0.5) / rate0))
    strong = F.col("texts1") >= MIN_PRECISION * (F.col("texts1") + F.col("texts0"))
    found = sums.where((F.col("entry") != "") & (F.col("texts1") >= max(MIN_TEXTS, MIN_SHARE * bad))).select("entry", weight.alias("weight"), strong.alias("strong"), "texts1").where(weight >= MIN_WEIGHT)
    best = found.orderBy(F.desc("strong"), F.desc(F.col("weight") * F.col("texts1")), F.length("entry"), "entry").limit(max_entries).collect()
    entries: dict[str, Entry] = {}
    for r in sorted(best, key=lambda r: (len(r["entry"].rstrip("*")), r["entry"])):  # short stems first; what they cover about as well is left out
        key = r["entry"].rstrip("*")
        inside = [entries[key[:k] + "*"] for k in range(4, len(key) + 1) if key[:k] + "*" in entries]
        if not any(e.weight >= r["weight"] - 0.7 and e.strong >= r["strong"] for e in inside):
            entries[r["entry"]] = Entry(float(r["weight"]), r["entry"].endswith("*"), bool(r["strong"]))
    lexicon = Lexicon(entries, [])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for b in batches:
            rows: list[tuple] = []
            for label, sign, text in zip(b.column("label").to_pylist(), b.column("sign").to_pylist(), b.column("text").to_pylist(), strict=True):
                near = set()
                for start, end, e in matches(machine, text):
                    if e.strong:
                        left, right = _LEFT.search(text[max(0, start - 40) : start]), _RIGHT.match(text[end : end + 40])
                        near |= {text[start - len(m[0]) : end] for m in [left] if m} | {text[start : end + len(m[0])] for m in [right] if m}
                rows += [(p, label, sign) for p in near]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["entry", "label", "sign"])

    clean = F.count_distinct(F.when(F.col("label") == 0, F.col("sign")))
    usual = sample.mapInArrow(common.tidy(phrases), "entry string, label int, sign long").groupBy("entry").agg(clean.alias("c0"), F.max("label").alias("worst"))
    lexicon.exceptions = [r["entry"] for r in usual.where("c0 >= 3 and worst = 0").orderBy(F.desc("c0"), "entry").limit(max_entries).collect()] + [fold(p) for p in exceptions or []]
    rows = apply_lexicon(sample, lexicon, ["label"], folded=True).select("label", "strong_hits", "weak_hits", "n_words").toPandas()  # four numbers for each sampled row
    x = features(*(rows[c].to_numpy(float) for c in ("strong_hits", "weak_hits", "n_words")))
    lexicon.coef = tuple(fit_logistic(x, rows["label"].to_numpy(float)).tolist())
    scratch.drop(sample)
    scratch.drop(sums)
    return lexicon


def apply_lexicon(docs: DataFrame, lexicon: Lexicon, carry: list[str], text_col: str = "text", folded: bool = False) -> DataFrame:
    """The carried columns, with strong_hits and weak_hits (weighted), n_words and score, in one pass."""
    made = ["strong_hits", "weak_hits", "n_words", "score"]
    carry = [c for c in carry if c not in made]
    kept = [F.col(f"`{c}`") for c in carry]
    data = docs.select(F.struct(*kept).alias("carried"), F.col(f"`{text_col}`").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(lexicon)  # of a bounded number of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value.automaton()
        for batch in batches:
            for b in common.slices(batch):
                hits, words = np.zeros((2, b.num_rows)), np.zeros(b.num_rows, np.int64)
                for i, text in enumerate(common.texts(b).to_pylist()):
                    for _, _, e in matches(machine, text if folded else fold(text)):
                        hits[int(not e.strong), i] += e.weight
                    words[i] = len(text.split())
                yield pa.RecordBatch.from_arrays([*(b.column("carried").field(k) for k in range(len(carry))), pa.array(hits[0]), pa.array(hits[1]), pa.array(words), pa.array(model.value.score(hits[0], hits[1], words))], [*carry, *made])

    schema = docs.select(*kept).schema
    return data.mapInArrow(common.tidy(run), schema.add("strong_hits", "double").add("weak_hits", "double").add("n_words", "long").add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, strong_hits, weak_hits, n_words of each document; learns from ``labels.toxic`` outside the held-out fold."""
    lexicon = learn(docs, labels, id_col, text_col)
    scored = apply_lexicon(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), lexicon, ["doc_id"])
    return scored.select("doc_id", (common.crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "strong_hits", "weak_hits", "n_words")
