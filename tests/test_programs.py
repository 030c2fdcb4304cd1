import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panewise.functions import uint
from panewise.functions.patterns import Bits, Eq, Range, Wild
from panewise.operators import folds
from panewise.plans import loop, lower, parse
from panewise.plans import program as pr
from panewise.plans import windows as w
from panewise.plans.expr import evaluate

FOLDS = {
    "counter": ({"c": 0}, {"c": "s.c + 1"}, 0),
    "first": ({"c": "x"}, {"c": "s.c"}, 0),
    "last": ({"c": "x + 1"}, {"c": "x"}, 0),
    "falls": ({"a": "x", "b": 0}, {"a": "x", "b": "s.b + 1 if s.a > x else s.b"}, 1),
    "any": ({"c": 1}, {"c": "(s.c << 1) ^ x"}, 0),
}


def events(n=300, seed=5):
    r = random.Random(seed)
    rows = [dict(ts=r.randint(0, 300), seq=i, k=r.randint(0, 2), a=r.randint(0, 3), x=r.randint(0, 9)) for i in range(n)]
    # edges: exactly lo old, one older, equal times, a pane's first tick, a key never added
    rows += [dict(ts=t, seq=n + i, k=7, a=a, x=1) for i, (t, a) in enumerate([(10, 0), (50, 1), (51, 1), (10, 1), (50, 0), (50, 1), (100, 2), (150, 2), (151, 1)])]
    return [*rows, dict(ts=1, seq=10**6, k=9, a=1, x=0)]


def one(kind, window, fold=None):
    p = pr.Program().local("r", 7)
    if kind == "fold":
        p.fold("z", ["k"], window, *FOLDS[fold])
    else:
        getattr(p, kind)("z", ["k"], window)
    return p.route("z", ["a"], ([Eq(0)], "add", {"k": "k"}), ([Eq(1)], "query", {"k": "k"}), ([Eq(2)], "add_query", {"k": "k"}), ([Wild()], None), into="r")


@pytest.mark.parametrize("window", [w.Within(40, 80), w.Since(50), w.Last(30), w.Within(0, 60)], ids=str)
@pytest.mark.parametrize("kind,fold", [("exist", None), ("count", None), *(("fold", f) for f in FOLDS)])
def test_sets_equal_the_event_loop(spark, window, kind, fold):
    p, rows = one(kind, window, fold), events()
    got = {r["seq"]: r["r"] for r in lower.run(p, spark.createDataFrame(rows), "ts", "seq").collect()}
    assert got == {r["seq"]: r["r"] for r in loop.run_rows(p, rows, "ts", "seq")}


@pytest.mark.parametrize("bits", [1, 12])
@pytest.mark.parametrize("window,panes", [(w.Within(40, 80), w.Panes(4, 5, 2)), (w.Since(50), w.Panes(2, 25, 1)), (w.Last(30), w.Panes(3, 15, 1))], ids=str)
@pytest.mark.parametrize("kind", ["exist", "count"])
def test_programs_on_sketches(spark, kind, window, panes, bits):
    def place(row, k):
        h = ((row + 1) * uint.HASH_SEED + 1) % 2**32
        for part in (k % 2**32, k >> 32):
            h = (h ^ part) * uint.HASH_FACTOR % 2**32
            h ^= h >> 15
        return h >> 32 - bits

    p, rows = one(kind, window), events()
    got = {r["seq"]: r["r"] for r in lower.run(p, spark.createDataFrame(rows), "ts", "seq", sketches={"z": (panes, 2, bits)}).collect()}
    offsets = {w.Since: [0], w.Last: [1]}.get(type(window), [0, 1, 2])
    cells, want = {}, {}
    for e in sorted(rows, key=lambda e: (e["ts"], e["seq"])):  # cell by cell, one event at a time
        pane, at = e["ts"] // panes.length, [(r, place(r, e["k"])) for r in range(2)]
        if e["a"] in (0, 2):
            for c in at:
                cells[pane, c] = cells.get((pane, c), 0) + 1
        n = sum(min(cells.get((pane - o, c), 0) for c in at) for o in offsets)
        want[e["seq"]] = (n if kind == "count" else int(n > 0)) if e["a"] in (1, 2) else 7
    assert got == want
    exact = {r["seq"]: r["r"] for r in loop.run_rows(p, rows, "ts", "seq")}
    assert all(got[q] >= exact[q] for q in exact) and (bits == 1 or isinstance(window, w.Within) or got == exact)


def test_sketches_need_their_contract(spark):
    df = spark.createDataFrame(events(), "ts long, seq long, k long, a long, x long")
    size = (w.Panes(2, 25, 1), 2, 4)
    p = pr.Program().local("r", 7)
    p.exist("z", ["k"], w.Since(50), err="exact")
    for bad in ({"z": size}, {"none": size}):
        with pytest.raises(pr.ProgramError):
            lower.run(p, df, "ts", "seq", sketches=bad)
    with pytest.raises(ValueError):
        p = one("fold", w.Since(50), "counter")
        lower.run(p, df, "ts", "seq", sketches={"z": size})


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10000])
def test_anchors_carry_over_batches(spark, rows_a_batch):
    r = random.Random(rows_a_batch)
    rows = [(r.choice([None, 1, 2, 3]), r.choice(["", "a", None]), r.choice([r.randint(0, 60), r.randint(0, 400) * 10])) for _ in range(600)]
    rows += [(9, "far", t) for t in (-(2**62), -1, 0, 24, 25, 2**62)]
    want = set()
    for key in {x[:2] for x in rows}:
        end = None
        for t in sorted(x[2] for x in rows if x[:2] == key):
            if end is None or t >= end:
                want.add((*key, t))
                end = t + 25
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = [tuple(x) for x in folds.anchors(spark.createDataFrame(rows, "`k.a` long, s string, ts long"), ["k.a", "s"], "ts", 25).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("fold", FOLDS)
@pytest.mark.parametrize("window", [w.Within(40, 80), w.Since(50), w.Last(30)], ids=str)
def test_wide_inputs_are_cut(spark, window, fold):
    r = random.Random(3)
    rows = [e | {"x": r.choice([0, 5, 2**32 - 1]) + r.choice([0, 2**32, 2**40, 2**47])} for e in events()]
    p = one("fold", window, fold)
    p.widths["x"] = 48
    got = {e["seq"]: e["r"] for e in lower.run(p, spark.createDataFrame(rows), "ts", "seq").collect()}
    assert got == {e["seq"]: e["r"] for e in loop.run_rows(p, rows, "ts", "seq")}


@pytest.mark.parametrize(
    "init,update,good",
    [
        ({"a": 0}, {"a": "s.a + 1"}, True),
        ({"a": "x", "n": 0}, {"a": "x", "n": "s.n + 1 if s.a > x else s.n"}, True),
        ({"a": 0, "b": 0}, {"a": "s.a + s.b", "b": "s.b"}, False),
        ({"a": 0}, {"a": "x + y"}, False),
        ({"a": 0}, {"a": "s.a + 1 if (s.a & x) > 3 else s.a"}, False),
        ({"a": 0}, {"a": "s.a + 1 if s.a > x && x > 3 && s.a < 9 else s.a"}, False),
        ({"a": 0}, {"a": "s.a + (1 if s.a > x else 0)"}, False),
        ({"a": "x", "b": "y"}, {"a": "z", "b": "s.b"}, False),
        ({"a": 0, "b": 0, "c": 0}, {"a": "s.a", "b": "s.b", "c": "s.c"}, False),
    ],
)
def test_strict_folds(init, update, good):
    p = pr.Program()
    p.fold("z", ["k"], w.Since(5), init, update)
    pr.analyze(p)
    if good:
        pr.analyze(p, strict=True)
    else:
        with pytest.raises(pr.ProgramError):
            pr.analyze(p, strict=True)


def test_empty_stream(spark):
    df = spark.createDataFrame([], "ts long, seq long, k long, a long, x long")
    for kind, fold in (("exist", None), ("count", None), ("fold", "counter"), ("fold", "any")):
        assert lower.run(one(kind, w.Within(40, 80), fold), df, "ts", "seq").count() == 0


TEXT = """
type pair = { int<32> a; int<32> b; }
type st = { int<32> v; }
fun st begin(pkt_type q) { return { v = q.hdr.tcp.seq_no }; }
fun st next(pkt_type q, st s) { return { v = s.v |+| 1 if s.v >= q.hdr.tcp.seq_no else s.v }; }
global FoldSet.t<pair> f = FoldSet.create(sub, since(min(2)), Fold(begin, next, 0));
global ExistSet.t<pair> g = ExistSet.create(super, within(sec(60), sec(121)), Exist());
// routes, then acts
handle one(pkt_type p) {
    int<8> seen = 1;
    int<32> v = 0;
    match p.hdr.ipv4.protocol, p.hdr.tcp.flags with
    | 6, 0b*1****** -> { ExistSet.add(g, { b = p.hdr.ipv4.dst_addr; a = p.hdr.ipv4.src_addr }); }
    | 7 .. 20, _ -> { seen = ExistSet.query(g, { a = p.hdr.ipv4.dst_addr; b = p.hdr.ipv4.src_addr }); }
    match seen with
    | 1 -> { v = FoldSet.add_query(f, { a = 5w32; b = p.hdr.ipv4.src_addr }); }
    match seen with
    | 0 -> { p.ig_intr_dprsr_md.drop_ctl = 0x1; p.hdr.ethernet.src_addr = p.hdr.ipv4.src_addr[0:7] ++ 3w8; }
    | _ -> { p.ig_intr_dprsr_md.drop_ctl = 0; }
}
"""


def test_text_form_round_trip_and_run(spark, tmp_path):
    p = parse.parse(TEXT)
    assert pr.describe(parse.parse(pr.describe(p))) == pr.describe(p)
    (tmp_path / "part.ca").write_text("\n".join(TEXT.splitlines()[:3]))
    (tmp_path / "main.ca").write_text('include "part.ca"\ninclude "part.ca"\n' + "\n".join(TEXT.splitlines()[3:]))
    assert pr.describe(parse.parse_file(str(tmp_path / "main.ca"))) == pr.describe(p)
    r = random.Random(2)
    names = ["hdr.ipv4.protocol", "hdr.tcp.flags", "hdr.ipv4.src_addr", "hdr.ipv4.dst_addr", "hdr.tcp.seq_no"]
    rows = [dict(zip(names, (r.choice([6, 9]), r.randint(0, 255), r.randint(0, 2), r.randint(0, 2), r.randint(0, 2**32 - 1)), strict=True)) | {"ts_ns": r.randint(0, 200) * 10**9, "seq": i} for i in range(120)]
    got = {x["seq"]: x.asDict() for x in lower.run(p, spark.createDataFrame(rows)).collect()}
    for want in loop.run_rows(p, rows):
        assert {k: got[want["seq"]][k] for k in want} == want


@pytest.mark.parametrize(
    "bad",
    ["if", "generate", "x = ExistSet.query(nope, {a = 1}", "y = 1"],
)
def test_rejected(bad):
    text = TEXT.replace("// routes, then acts", "").replace("int<8> seen = 1;", f"int<8> seen = 1; {bad}") if bad != "y = 1" else TEXT.replace("within(sec(60)", "within(sec(p)")
    with pytest.raises((pr.ProgramError, KeyError)):
        parse.parse(text)


def test_rules():
    for bad in (w.Within(-1, 5), w.Within(5, 0), w.Since(0), w.Last(1 << 48), w.Since(1.5)):
        with pytest.raises(ValueError):
            w.check(bad)
    p = pr.Program()
    p.exist("s", ["k"], w.Since(5), err="exact")
    pr.analyze(p)
    with pytest.raises(pr.ProgramError):
        pr.analyze(p, strict=True)
    p.route("s", ["a"], ([Wild()], "add", {"other": "k"}))
    with pytest.raises(pr.ProgramError):
        pr.analyze(p)


def test_pane_geometry():
    sec = w.NS["sec"]
    assert w.panes(w.Within(60 * sec, 121 * sec), 4) == w.Panes(4, 7153, 22)
    assert w.panes(w.Within(60 * sec, 120 * sec), 3) is None
    assert w.normal(w.Within(0, 9)) == w.Since(9)
    p = w.Panes(4, 3, 4)
    assert [w.pane_number(t, 5, p) for t in (5, 47, 48, 96, 300)] == [0, 0, 1, 2, 6]


@given(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=50, deadline=None)
def test_unsigned_values(a, b):
    env = {"a": a, "b": b}.__getitem__
    value = lambda t: evaluate(parse.parse_expr(t), env, lambda n: 32)
    top = 2**32 - 1
    assert value("a + b") == (a + b) % 2**32 and value("a - b") == (a - b) % 2**32
    assert value("a |+| b") == min(a + b, top) and value("a |-| b") == max(a - b, 0)
    assert value("~a") == top - a and value("-a") == -a % 2**32
    assert value("a[8:15]") == a >> 8 & 255 and value("a ++ b") == a << 32 | b
    assert value("a if a > b && !(a == 0) else b") == max(a, b)


def test_unsigned_columns_equal_values(spark):
    r = random.Random(4)
    rows = [{"ts_ns": 0, "seq": i, "a": r.choice([0, 1, 2**31, 2**32 - 1, r.randint(0, 2**32 - 1)]), "b": r.choice([0, 2**32 - 1, r.randint(0, 40)])} for i in range(60)]
    p = pr.Program()
    for i, e in enumerate(["a + b", "a - b", "a |+| b", "a |-| b", "-a", "~a", "a & b", "a | b", "a ^ b", "a << 3", "a >> 3", "a << b", "a >> b", "a[3:9]", "(int<8>) a", "a if a <= b || a != b else 5"]):
        p.local(f"v{i}", e)
    got = {x["seq"]: x.asDict() for x in lower.run(p, spark.createDataFrame(rows)).collect()}
    for want in loop.run_rows(p, rows):
        assert got[want["seq"]] == want


def test_patterns():
    assert Bits("1*0").holds(4) and Bits("1*0").holds(6) and not Bits("1*0").holds(5)
    assert Range(2, 4).holds(4) and not Range(2, 4).holds(5) and Eq(3).holds(3)
    with pytest.raises(ValueError):
        Bits("12")
