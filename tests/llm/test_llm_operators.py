"""Each operator against a brute-force version, over rows with every odd case."""

import hashlib
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panewise.llm import common, packing, quality_model, quality_rules, queries, simhash, spm_spans, suffix_dedup, token_counts, tokenstore, topk, toxicity, wordbpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "kept long, doc_id long, text string, lang string, source string, n_chars long, score string, uid string, __text string, h long"


def corpus() -> list[tuple]:
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, base = text(40), text(120)
    texts = [None, "", " \n\t ", "one", "Two words", base, base, base + " tail", base.replace(base.split()[60], "changed", 1), shared, text(30) + "\n" + shared + "\n" + text(30), text(20) + " " + shared]
    texts += ["naïve, café! 🙂 x.\n" * 12, "a" * 450, "word " * 300, "İstanbul, ﬀ Ǆ é \u0000 \x1c <|endoftext|> ▁x  y", "ab\n" * 90, text(15000), shared + shared]
    texts += [text(r.randint(1, 200)) for _ in range(25)]
    rows = [(1, i, t, "en", ["s0", "s1", None, ""][i % 4] if i % 3 else "s0", 0, "x", "y", "z", 5) for i, t in enumerate(texts)]
    null = (1, None, base, None, "s1", None, None, None, None, None)
    return [*rows, rows[5], rows[10], null, null, (1, 3, "another text with an id that is taken", "en", "s2", 0, "x", "y", "z", 5)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars").coalesce(1)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordbpe.default_path())


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def in_order(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


EMPTY = {
    "op1": lambda d, s: simhash.near_components(d),
    "near": lambda d, s: simhash.drop_near_copies(d),
    "op2": lambda d, s: tokenstore.read_documents(tokenstore.write_shards(d)),
    "op3": lambda d, s: suffix_dedup.remove_repeats(d, with_text=True),
    "op4": lambda d, s: spm_spans.encode_decode(d),
    "op5": lambda d, s: token_counts.count_tokens(d),
    "op6": lambda d, s: packing.pack(d),
    "op7": lambda d, s: quality_model.classify(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    "op8": lambda d, s: quality_rules.quality_rules(d),
    "op9": lambda d, s: topk.top_k(s.createDataFrame([], "vec_id long, embedding array<float>")),
    "op10": lambda d, s: toxicity.classify(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(name, spark):
    assert EMPTY[name](spark.createDataFrame([], SCHEMA), spark).count() == 0


def test_simhash(docs, monkeypatch):
    data = in_order(docs)
    fps = []
    for _, t in data:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((data[i][0] for i in range(len(data)) if group[i] == g and data[i][0] is not None), default=None) for g in set(group)}
    want = sorted(((data[i][0], f"{fps[i]:016x}", least[group[i]]) for i in range(len(data))), key=repr)
    assert plain(simhash.near_components(docs)) == want
    monkeypatch.setattr(simhash, "HOT", 2)
    assert plain(simhash.near_components(docs)) == want


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_forest_connects_what_links_connect(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    fp[40:120] = fp[40] ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64))
    group = np.sort(rng.integers(0, 6, 300))
    order = rng.permutation(300)
    fp = fp[order]

    def classes(pairs):
        label = list(range(300))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    brute = [(i, j) for i in range(300) for j in range(i) if group[i] == group[j] and bin(int(fp[i] ^ fp[j])).count("1") <= radius]
    one, two = simhash.forest(fp, group, radius)
    assert {(max(a, b), min(a, b)) for a, b in zip(one.tolist(), two.tolist(), strict=True)} <= set(brute)
    assert classes(zip(one.tolist(), two.tolist(), strict=True)) == classes(brute)


def test_near_copies_go(docs):
    kept = [r for r in simhash.drop_near_copies(docs).collect()]
    assert simhash.drop_near_copies(docs).columns == docs.columns
    texts = [r["text"] for r in kept]
    base = corpus()[5][2]
    assert sum((t or "") in (base, base + " tail") for t in texts) == 1
    assert sum(not (t or "").strip() for t in texts) == 1
    assert len({t for t in texts}) == len(texts)
    assert sum(len(t or "") > 20000 for t in texts) == 1


def similar_groups(texts: list[str]) -> set[int]:
    """Rows that stay: the first of each component of pairs of similarity 0.8 or more, by all pairs."""
    sets = []
    for t in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        k = min(5, len(words))
        sets.append(frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset())
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if top(i) == i}


@pytest.mark.parametrize("hot", [4096, 3])
def test_near_copies_of_any_similarity_go(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(500)]
    draw = lambda n: [r.choice(vocab) for _ in range(n)]
    common_part, texts = draw(40), []
    for _ in range(40):
        base = draw(r.randint(8, 300))
        texts.append(base)
        for share in (0.01, 0.03, 0.04, 0.05):
            copy = list(base)
            for at in r.sample(range(len(copy)), int(share * len(copy))):
                copy[at] = r.choice(vocab)
            texts.append(copy)
    texts += [common_part + draw(r.randint(0, 20)) for _ in range(40)]
    texts += [draw(r.randint(1, 7)) for _ in range(20)] + [[], []]
    texts = [" ".join(t) for t in texts]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {x["doc_id"] for x in simhash.drop_near_copies(docs).collect()}
    assert kept == similar_groups(texts)


@pytest.mark.parametrize("wide", [26, 0])
def test_near_copies_with_repeated_runs_go(spark, wide, monkeypatch):
    """Links are between sets: neither how often a shingle repeats nor the fingerprints' distance may lose one."""
    monkeypatch.setattr(simhash, "WIDE", wide)
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(500)]
    draw = lambda n: [r.choice(vocab) for _ in range(n)]
    texts = []
    for n in (30, 300, 300, 900):
        base = draw(n)
        texts += [base + ["."] * 104, base + ["."] * 5, base + ["-"] * 7, ["ab", "cd"] * 200 + base, ["ab", "cd"] * 4 + base]
        for share in (0.02, 0.03, 0.04):
            copy = list(base)
            for at in r.sample(range(n), int(share * n)):
                copy[at] = r.choice(vocab)
            texts += [copy, copy + ["."] * 300]
    texts = [" ".join(t) for t in texts + [draw(r.randint(5, 400)) for _ in range(30)]]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x["doc_id"] for x in simhash.drop_near_copies(docs).collect()} == similar_groups(texts)


def test_near_copies_in_parts_and_turns(spark, monkeypatch):
    """Buckets and pairs handled one part after the other lose no link."""
    monkeypatch.setattr(simhash, "PART_ROWS", 1)
    monkeypatch.setattr(simhash, "PARTS", 2)
    monkeypatch.setattr(simhash, "SENT", 0.4)
    monkeypatch.setattr(simhash, "UID_ROWS", 0)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(simhash, "WIDE", 0)
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(500)]
    texts = []
    for n in (30, 300, 900):
        base = [r.choice(vocab) for _ in range(n)]
        texts += [" ".join(r.choice(vocab) if r.random() < share else w for w in base) for share in (0, 0.01, 0.02, 0.03, 0.04, 0.05)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.drop_near_copies(docs).collect()} == similar_groups(texts)


def test_sets_of_long_texts_are_not_sent_for_one_shared_shingle(spark, monkeypatch):
    """Their pairs grow with the square of the input; wide sketches must tell them apart."""
    monkeypatch.setattr(simhash, "SLOTS", 1)
    made, save = [0], common.Scratch.save

    def spy(self, df):
        out = save(self, df)
        made[0] += out.count() if "set" in df.columns else 0
        return out

    monkeypatch.setattr(common.Scratch, "save", spy)
    r = random.Random(9)
    draw = lambda n: [f"{r.getrandbits(40):x}" for _ in range(n)]
    texts = []
    for _ in range(20):
        run = draw(40)
        texts += [" ".join(draw(1500) + run + draw(1500)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.drop_near_copies(docs).count() == 40
    assert made[0] == 0


def test_wide_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 511, 512, 513, 1500, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for part in (1.0, 0.95, 0.8, 0.5, 0.0):
            other = np.unique(np.concatenate([base[: int(n * part)], rng.integers(0, 1 << 63, int(n * (1 - part) / 3), dtype=np.uint64)]))
            x, y = (np.frombuffer(simhash.wide_parity(s), "<u8") for s in (base, other))
            apart = simhash.sketches_apart(x, y)
            assert apart == simhash.sketches_apart(y, x) <= len(np.setxor1d(base, other))
            assert part or n < 500 or apart > (len(base) + len(other)) / 9  # unrelated sets are told apart


def test_possible_pairs_lose_no_similar_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 1 << 63, rng.integers(1, 1200), dtype=np.uint64)
        for part in (1.0, 0.95, 0.9, 0.8, 0.5):
            sets.append(np.unique(np.concatenate([base[: int(len(base) * part) + 1], base[:3]])))
    n, sketch = np.array([len(x) for x in sets]), np.stack([simhash.parity(x).view("<u8") for x in sets])
    row = np.arange(len(sets))
    one, two = simhash.possible_pairs(row, n, np.zeros(len(n), np.int64), sketch, np.zeros(len(n), np.int64), 0.8)
    similar = {(i, j) for j in row for i in range(j) if (both := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (n[i] + n[j] - both)}
    found = set(zip(one.tolist(), two.tolist(), strict=True))
    assert similar <= found and len(found) < 3 * len(similar)


def test_token_store(docs, rows, tokenizer, tmp_path):
    table = tokenstore.write_shards(docs, shard_tokens=500)
    got = [tuple(r) for r in tokenstore.read_documents(table, with_ids=True).orderBy("start").collect()]
    ids = [(r[1], [*tokenizer.encode(r[2] or "", add_special_tokens=False).ids, 2]) for r in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u4").tobytes()))
    at = 0
    for (doc, start, n, crc, own), (want, full) in zip(got, ids, strict=True):
        assert (doc, start, n, crc, own) == (want, at, len(full), zlib.crc32(np.array(full, "<u4").tobytes()), full)
        at += n
    files = tokenstore.export_files(table, str(tmp_path))
    assert len(files) > 3 and tokenstore.load_shard(open(files[0], "rb").read())[3].n > 0


@pytest.mark.parametrize("text", ["<|EndOfText|> x", "a <|endoftext|>B <|StartOfText|>", "T\u0308 J\u030c H\u0331 Y\u030a", "t\u0308 T\u0308s, É É E\u0301. Ǆ İ K", "The the THE The's CAN'T CAN\u2019T Über ÜBER", "", "A\u00a0B A\u0308B\nÀ\u0301 X=\u0338 Q. \u0308"])
def test_ids_are_those_of_the_library(text, tokenizer):
    import pyarrow as pa

    enc = wordbpe.WordEncoder(wordbpe.default_path())
    texts = [text, text.lower(), text.upper(), text]
    flat, off = enc.encode(pa.array(texts))
    for t, i, j in zip(texts, off[:-1], off[1:], strict=True):
        assert flat[i:j].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (1500, 49408), (700, 3)):
        seq = rng.integers(0, top, n).astype(np.uint32)
        wm = tokenstore.WaveletMatrix.build(seq)
        assert (wm.decode() == seq).all()
        for t in {*seq[:5].tolist(), 1, 70000}:
            where = np.flatnonzero(seq == t).tolist()
            assert wm.count(t) == len(where) and wm.occurrences(t)[:40] == where[:40]
            assert wm.rank(t, n // 2) == sum(i < n // 2 for i in where)
        assert all(wm.access(i) == seq[i] for i in range(0, n, 97))


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000 if hot == 2 else 1 << 20)
    data = in_order(docs)
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is not None, data[i][0] or 0, i))
    seen, want = set(), {}
    for i in order:
        b = data[i][1].encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        want[i] = (data[i][0], len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.remove_repeats(docs, with_text=True)
    assert plain(got.drop("spans", "kept_text")) == sorted(want.values(), key=repr)
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in got.collect())


@pytest.mark.parametrize("letters", ["ab", "a", "ab\0c", "abcdefghijklmnop"])
def test_run_length_index(letters):
    r = random.Random(1)
    texts = [bytes(r.choice(letters.encode()) for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts += [texts[3], texts[5] + texts[6], b"", texts[7][3:]]
    index = suffix_dedup.RunLengthIndex(texts)
    places = [(i, k) for i, t in enumerate(texts) for k in range(len(t))]
    rest = {(i, k): texts[i][k:] for i, k in places}
    share = lambda x, y: next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    ordered = sorted(places, key=lambda p: (*((c + 1) * 100 for c in rest[p]), p[0]))  # end marks come before letters, in the order of texts
    up, size = index.matching_statistics()
    where = {p: int(index.starts[p[0]]) + p[1] for p in places}
    back = {v: k for k, v in where.items()}
    for above, p in zip(ordered, ordered[1:], strict=False):
        assert size[where[p]] == share(rest[above], rest[p])
        if size[where[p]]:
            assert back[int(up[where[p]])] == above
    for length in (1, 5, 20):
        least = index.first_places(length)
        for p in places:
            equal = [where[q] for q in places if len(rest[p]) >= length and rest[q][:length] == rest[p][:length]]
            assert least[where[p]] == min(equal, default=where[p])


def test_spans(docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=spm_spans.default_path())
    want = []
    for r in rows:
        ids = [1, *lib.encode(r[2] or ""), 2]
        want.append((r[1], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    got = spm_spans.encode_decode(docs, with_spans=True)
    assert plain(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(want, key=repr)
    assert all(r["spans_tile"] for r in got.collect())


def test_normalisation_by_a_compiled_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(open(spm_spans.default_path(), "rb").read())
    rules = {"ﬀ": "ff", "a": "b", "ab": "X", "abc": "é", "　": " ", "é": "e", "①": "(1)", "\t": " ", "zz": ""}
    for collapse in (False, True):
        spec.normalizer_spec.precompiled_charsmap = spm_spans.compile_map(rules)
        spec.normalizer_spec.remove_extra_whitespaces = collapse
        enc = spm_spans.SpanEncoder(proto=spec.SerializeToString())
        lib = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        for text in ["", " ", "abcab a ﬀ", "x　　 é① ", "  abca  zz \tb", "zz"]:
            proto = lib.encode(text, return_type="proto")
            ids = np.array([p.id for p in proto.pieces], np.int64)
            normal, _ = enc.normalize(text.encode())
            assert normal.decode().replace("▁", " ") == lib.normalize(text).replace("▁", " "), text
            lo, hi = enc.spans(text.encode(), ids)
            assert [(p.begin, p.end) for p in proto.pieces] == list(zip(lo.tolist(), hi.tolist(), strict=True)), text


def test_token_counts(docs, rows):
    lm = token_counts.model(spm_spans.default_path())

    def best(word):
        cost = [(0, 0)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            width = len(word[e - 1].encode())
            options = [(cost[e - 1][0] + width * lm.byte_cost, cost[e - 1][1] + width)]
            options += [(cost[s][0] + p, cost[s][1] + 1) for s in range(e) if (p := lm.costs.get(word[s:e])) is not None]
            cost[e] = min(options)
        return cost[-1][1]

    memo = {}
    want = []
    for r in rows:
        words = WORD.findall(r[2] or "")
        want.append((r[1], len(words), sum(memo.setdefault(x, None) or memo.__setitem__(x, best("▁" + x)) or memo[x] for x in words)))
    assert plain(token_counts.count_tokens(docs)) == sorted(want, key=repr)


@pytest.mark.parametrize("shares", [None, {"s0": 0.7, "s1": 0.2, "s2": 0.1}])
def test_packing(docs, rows, tokenizer, shares):
    got = packing.pack(docs, shares, window=256, grain=8, with_ids=True).collect()
    order = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in order:  # every window is full and without gaps, but the last
        assert r["sequence_id"] * 256 + r["offset"] == at and len(r["ids"]) == r["length"] > 0
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        at += r["length"]
    full = [[*tokenizer.encode(r[2] or "", add_special_tokens=False).ids, 2] for r in rows]
    assert at == sum(map(len, full))
    tokens = lambda xs: sorted(t for x in xs for t in x)
    assert tokens(r["ids"] for r in got) == tokens(full)
    single = {r[1]: f for r, f in zip(rows, full, strict=True) if sum(x[1] == r[1] for x in rows) == 1}
    for doc, ids in single.items():
        own = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["start"])
        assert sum((list(r["ids"]) for r in own), []) == ids and all(r["doc_tokens"] == len(ids) for r in own)
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()


def test_packing_follows_deficit_round_robin():
    totals, shares, window, grain = [5000, 1200, 90, 7], [5.0, 3.0, 1.0, 1.0], 256, 16
    phases = packing.plan(totals, shares, window, grain)
    first = phases[0]
    total, queue, deficit, at, pos = int(first.weight.sum()), [0] * 4, [0] * 4, [], 0
    for _ in range(first.rounds):  # the loop that the closed form stands for
        for i, wgt in enumerate(first.weight.tolist()):
            deficit[i] += window * wgt
            send = deficit[i] // (total * grain) * grain
            deficit[i] -= send * total
            at += [(i, queue[i] + k, pos + k) for k in range(send)]
            queue[i] += send
            pos += send
    where = {(i, q): p for i, q, p in at}
    every = set()
    for i in range(4):
        doc, start, length, place = packing.place(phases, totals, i, np.array([0]), np.array([totals[i]]), window, grain)
        for s, n, p in zip(start.tolist(), length.tolist(), place.tolist(), strict=True):
            for k in range(n):
                every.add(p + k)
                assert where.get((i, s + k), p + k) == p + k
    assert every == set(range(sum(totals)))


@pytest.mark.parametrize("shares", [None, {"s0": 0.7, "s1": 0.2}])
def test_packing_beyond_the_queue_limit_keeps_the_schedule(docs, shares, monkeypatch):
    want = plain(packing.pack(docs, shares, window=256, grain=8))
    monkeypatch.setattr(packing, "MAX_QUEUES", 1)
    assert plain(packing.pack(docs, shares, window=256, grain=8)) == want


def test_packing_of_many_sources_keeps_shares(spark):
    rows = [(i, "one two three four five " * (i % 3 + 1), f"d{i}") for i in range(1200)]
    rows += [(2000 + i, "six seven eight nine ten " * 60, f"big{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, {"big0": 0.75, "big1": 0.25}, window=512, grain=8).collect()
    first = [r for r in got if r["sequence_id"] < 10]
    part = lambda s: sum(r["length"] for r in first if r["source"] == s) / (10 * 512)
    assert abs(part("big0") - 0.75) < 0.02 and abs(part("big1") - 0.25) < 0.02
    at = 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 512 + r["offset"] == at
        at += r["length"]
    assert len({r["doc_id"] for r in got}) == len(rows)


def test_quality_rules(docs, rows):
    from collections import Counter

    def brute(t):
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        out = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)]
        for n in quality_rules.NGRAM_LIMITS:
            seen, inside = set(), set()
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in seen:
                    inside |= set(range(i, i + n))
                seen.add(g)
            out.append(sum(len(w[i]) for i in inside))
        return tuple(out)

    got = quality_rules.quality_rules(docs, carry=["doc_id"])
    want = sorted(((r[1], *brute(r[2] or "")) for r in rows), key=repr)
    assert plain(got.select("doc_id", *quality_rules.MEASURES[:-2])) == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_top_k(spark):
    rng = np.random.default_rng(2)
    data = np.round(rng.normal(size=(900, 9)), 1).astype(np.float32)
    data[100:160] = data[0]
    rows = [(i, data[i].tolist(), 1) for i in range(900)] + [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1002, [float("nan")] * 9, 1), (100, data[3].tolist(), 2), (None, data[4].tolist(), 2), (1100, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(ok):
        if q is not None and q % 100 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, x, strict=False)), i is None, i or 0, i) for m, (i, x) in enumerate(ok) if m != n))[:10]
            want += [(q, k + 1, s[3], -s[0]) for k, s in enumerate(scored)]
    assert plain(topk.top_k(df)) == sorted(want, key=repr)
    few = df.where("vec_id IN (100, 200, 300)")
    assert topk.top_k(few).where("query_id = 300").count() == 3


def test_top_k_of_large_components(spark):
    rows = [(0, [2.0**30, 2.0**30]), (1, [2.0**30, 1.0]), (2, [-(2.0**30), -(2.0**30)]), (3, [1.0, 0.5]), (4, [2.0**18, -3.0]), (100, [1e300, 0.0]), (200, [2.0**18, 7.0])]
    held = {i: [max(-(2**62), min(2**62, int(np.floor(1024 * x)))) for x in v] for i, v in rows}
    want = []
    for q in (0, 100, 200):
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(held[q], v, strict=True)))), i) for i, v in held.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted(want)


def labelled_corpus(spark, sf_dir):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def held_out(scored, labels, column):
    pairs = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(column).alias("y")).toPandas()
    rank = pairs["score"].rank().to_numpy()
    y = pairs["y"].to_numpy()
    pos, neg = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg), pairs


def test_quality_model_held_out(spark, sf_dir):
    docs, labels = labelled_corpus(spark, sf_dir)
    auc, pairs = held_out(quality_model.classify(docs, labels), labels, "quality")
    assert auc > 0.95 and ((pairs.score >= 0.3) == (pairs.predicted == 1)).all()


def test_pooling_costs_little_beside_finding_words():
    rng = np.random.default_rng(2)
    vectors = quality_model.word_vectors(rng.integers(-9, 10, (quality_model.BUCKETS, quality_model.DIM)))
    texts = [b" ".join(b"w%d" % w for w in rng.zipf(1.3, size) % 5000) for size in [0, 1, 2, 150_000, *rng.integers(1, 1000, 400)]]

    def view(some):
        return np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])

    def cost(run):
        began = time.process_time()
        run(*view(texts))
        return time.process_time() - began

    whole = quality_model.pool(*view(texts), vectors)
    for i in (0, 1, 2, 3, 50):  # the texts beside it change nothing, and the numbers are those of the words one by one
        assert (quality_model.pool(*view(texts[i : i + 1]), vectors) == whole[i]).all()
        x = vectors[quality_model.word_slots(*view(texts[i : i + 1]))[0]].astype(float)
        want = np.concatenate([x.mean(0), x.std(0), [np.log1p(len(x))]]) if len(x) else np.zeros(4 * quality_model.DIM + 1)
        assert np.allclose(whole[i], want, atol=1e-6)
    assert min(cost(lambda r, o: quality_model.pool(r, o, vectors)) for _ in range(3)) < 4 * min(cost(quality_model.word_slots) for _ in range(3))


def test_toxicity_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    auc, pairs = held_out(toxicity.classify(docs, labels), labels, "toxic")
    assert auc > 0.9 and (pairs.predicted[pairs.y == 0] == 0).mean() > 0.99 and pairs.predicted[pairs.y == 1].mean() > 0.8


def test_scores_on_odd_rows(docs, spark, rows):
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(30)] + [(1, None, None), (1, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for scored in (quality_model.classify(docs, labels), toxicity.classify(docs, labels)):
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_folding_and_lexicon():
    assert toxicity.fold("М0rоn 1d10t cl@ss ＭＯＲＯＮ móron 2.0 a$$$") == "moron idiot class moron moron 2.0 a$$$"
    lex = toxicity.Lexicon({"idiot": toxicity.Entry(3.0), "mor*": toxicity.Entry(2.0, stem=True, strong=False)}, ["no idiot here"])
    machine = lex.automaton()
    spans = lambda t: [(a, b) for a, b, _ in toxicity.matches(machine, toxicity.fold(t))]
    assert spans("an 1DIOT, m0rons amor") == [(3, 8), (10, 13)]
    assert spans("no idiot here") == [] and spans("idiotic") == []
    assert unicodedata.normalize("NFC", "x") == "x"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        assert 0 < docs.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.ORACLE_SQL is None and {*queries.QUERIES} == {f.__name__ for f in queries.OPERATORS}
    assert common.partitions(spark) == 4


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() > 0
        stage(spark, docs.limit(0), str(tmp_path)).count()
