"""Queries over the shared tables, each with equivalent SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import uint
from .functions.patterns import Bits, Eq, Range, Wild
from .operators import evalkit, sketch
from .plans import lower, parse
from .plans import windows as w
from .plans.program import Program
from .sources import packets
from .streaming import lower as streaming

HOUR = w.NS["hour"]
TICK = 1000  # event times are in microseconds
_ = Wild()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream: ts in microseconds (free of any session time zone), a type code, a payload, two small keys."""
    clock = "unix_date(CAST(ts AS DATE)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)"
    kinds = "CASE event_type WHEN 'signup' THEN 0L WHEN 'purchase' THEN 1L WHEN 'view' THEN 2L WHEN 'click' THEN 3L ELSE 4L END"
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{clock} AS ts", "user_id", f"{kinds} AS kind", "event_id * 7919 % 1000 AS x", "user_id % 16 AS src", "event_id * 31 % 16 AS dst")


E = """e AS (
  SELECT event_id, epoch_us(ts) AS ts, user_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS kind,
         event_id * 7919 % 1000 AS x, user_id % 16 AS src, event_id * 31 % 16 AS dst
  FROM events)"""


def us(ns: int) -> int:
    return ns // TICK


def live(window: w.Window, fold: bool = False) -> str:
    """SQL: add i is in the window of q."""
    match window:
        case w.Within():
            return f"i.ts >= q.ts - {us(window.lo)}"
        case w.Since():
            return f"i.ts // {us(window.t)} = q.ts // {us(window.t)}"
    return f"i.ts // {us(window.t)} {'>=' if fold else '='} q.ts // {us(window.t)} - 1"


def joined(window: w.Window, adds: str, asks: str, key: str = "i.user_id = q.user_id", fold: bool = False) -> str:
    """SQL: each event q with the adds i that it sees."""
    before = "(i.ts < q.ts OR (i.ts = q.ts AND (i.event_id < q.event_id OR (i.event_id = q.event_id AND q.kind IN " + adds + "))))"
    return f"e q LEFT JOIN e i ON q.kind IN {asks} AND i.kind IN {adds} AND {key} AND {live(window, fold)} AND {before}"


def run(program: Program, df: DataFrame, *columns: str) -> DataFrame:
    return lower.run(program, df, "ts", "event_id", TICK).select("event_id", *columns)


def one_set(kind: str, window: w.Window, branches: list[tuple], fold: dict | None = None) -> Program:
    """A program with one set by user, routed by event type."""
    p = Program().local("r", 0)
    if kind == "fold":
        p.fold("s", ["user"], window, **fold)
    else:
        getattr(p, kind)("s", ["user"], window)
    return p.route("s", ["kind"], *((pat, api, {"user": "user_id"}) for pat, api in branches), into="r")


ADD_ASK = [([Eq(0)], "add"), ([Eq(1)], "query")]
BOTH = [([Range(0, 1)], "add_query")]
DAY2 = w.Within(24 * HOUR, 48 * HOUR)


def exist_sql(window, adds="(0)", asks="(1)", key="i.user_id = q.user_id") -> str:
    return f"WITH {E} SELECT q.event_id, CAST(count(i.event_id) > 0 AS BIGINT) AS r FROM {joined(window, adds, asks, key)} GROUP BY q.event_id"


def count_sql(window, adds="(0)", asks="(1)") -> str:
    return f"WITH {E} SELECT q.event_id, count(i.event_id) AS r FROM {joined(window, adds, asks)} GROUP BY q.event_id"


def fold_sql(value: str, window, adds="(0)", asks="(1)", extra: str = "TRUE") -> str:
    """``value`` over l, the ordered payloads of the adds."""
    return f"""WITH {E}, g AS (SELECT q.event_id, q.ts, list(i.x ORDER BY i.ts, i.event_id) FILTER (i.event_id IS NOT NULL) AS l, min(i.ts) AS t0 FROM {joined(window, adds, asks, fold=True)} GROUP BY q.event_id, q.ts)
SELECT event_id, CAST(CASE WHEN l IS NULL OR NOT ({extra}) THEN 0 ELSE {value} END AS BIGINT) AS r FROM g"""


def simple(name: str, kind: str, window, branches, sql: str | None, fold: dict | None = None) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(one_set(kind, window, branches, fold), events(spark, sf_dir), "r")

    f.__name__ = name
    query(sql)(f)


simple("exist_within_query", "exist", DAY2, ADD_ASK, exist_sql(DAY2))
simple("exist_add_query", "exist", DAY2, BOTH, exist_sql(DAY2, "(0, 1)", "(0, 1)"))
simple("exist_since_pane", "exist", w.Since(12 * HOUR), ADD_ASK, exist_sql(w.Since(12 * HOUR)))
simple("exist_last_pane", "exist", w.Last(24 * HOUR), ADD_ASK, exist_sql(w.Last(24 * HOUR)))
simple("exist_within_zero", "exist", w.Within(0, 12 * HOUR), ADD_ASK, exist_sql(w.Since(12 * HOUR)))
simple("count_within_add_query", "count", DAY2, BOTH, count_sql(DAY2, "(0, 1)", "(0, 1)"))
simple("count_since", "count", w.Since(48 * HOUR), BOTH, count_sql(w.Since(48 * HOUR), "(0, 1)", "(0, 1)"))
simple("count_last", "count", w.Last(24 * HOUR), ADD_ASK, count_sql(w.Last(24 * HOUR)))
simple("count_add_then_query", "count", DAY2, ADD_ASK, count_sql(DAY2))

COUNTER = {"init": {"n": 0}, "update": {"n": "s.n + 1"}}
FIRST = {"init": {"v": "x"}, "update": {"v": "s.v"}}
LATEST = {"init": {"v": "x"}, "update": {"v": "x"}}
FALLS = {"init": {"last": "x", "n": 0}, "update": {"last": "x", "n": "s.n + 1 if s.last > x else s.n"}, "index": 1}
HASHED = {"init": {"h": "x"}, "update": {"h": "(s.h << 1) ^ x"}}
FALLS_SQL = "coalesce(list_sum([CAST(l[j] > l[j + 1] AS BIGINT) FOR j IN range(1, len(l))]), 0)"
HASH_SQL = "list_reduce(l, lambda a, b: xor((a & 2147483647) * 2, b))"
simple("fold_counter", "fold", DAY2, BOTH, fold_sql("len(l) - 1", DAY2, "(0, 1)", "(0, 1)"), COUNTER)
simple("fold_first", "fold", DAY2, ADD_ASK, fold_sql("l[1]", DAY2), FIRST)
simple("fold_last", "fold", DAY2, ADD_ASK, fold_sql("l[len(l)]", DAY2), LATEST)
simple("fold_prev_compare", "fold", DAY2, BOTH, fold_sql(FALLS_SQL, DAY2, "(0, 1)", "(0, 1)"), FALLS)
simple("fold_within_staggered", "fold", DAY2, BOTH, fold_sql(HASH_SQL, DAY2, "(0, 1)", "(0, 1)"), HASHED)
simple("fold_last_pane", "fold", w.Last(24 * HOUR), BOTH, fold_sql("len(l) - 1", w.Last(24 * HOUR), "(0, 1)", "(0, 1)", f"t0 // {us(24 * HOUR)} = ts // {us(24 * HOUR)} - 1"), COUNTER)


def anchored(begin: str, step: str, length: int, adds: str = "kind IN (0, 1)", names: str = "e", extra: str = "") -> str:
    """SQL: per-key states that each begin at an add and live for ``length``; s is the state after the add, t0 its begin."""
    return f"""a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {names} WHERE {adds}),
st AS (
  SELECT user_id, rn, event_id, ts, ts AS t0, CAST({begin.replace("@", "a.")} AS BIGINT) AS s{extra} FROM a WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.rn, a.event_id, a.ts, CASE WHEN a.ts - st.t0 >= {length} THEN a.ts ELSE st.t0 END,
         CAST(CASE WHEN a.ts - st.t0 >= {length} THEN {begin.replace("@", "a.")} ELSE {step.replace("@", "a.")} END AS BIGINT){extra}
  FROM st JOIN a ON a.user_id = st.user_id AND a.rn = st.rn + 1)"""


T60 = us(60 * HOUR)
simple("fold_since_anchored", "fold", w.Since(60 * HOUR), BOTH, f"WITH RECURSIVE {E}, {anchored('0', 'st.s + 1', T60)} SELECT e.event_id, coalesce(st.s, 0) AS r FROM e LEFT JOIN st USING (event_id)", COUNTER)
simple("fold_generic_two_field", "fold", w.Since(60 * HOUR), BOTH, f"WITH RECURSIVE {E}, {anchored('@x', 'xor((st.s & 2147483647) * 2, @x)', T60)} SELECT e.event_id, coalesce(st.s, 0) AS r FROM e LEFT JOIN st USING (event_id)", {"init": {"h": "x", "n": 1}, "update": {"h": "(s.h << 1) ^ x", "n": "s.n |+| 1"}})

# compositions


def swapped(adds, asks, window=DAY2) -> Program:
    p = Program().local("found", 1, 8)
    p.exist("seen", ["inner", "outer"], window)
    p.route("seen", ["kind"], *((a, "add", {"inner": "src", "outer": "dst"}) for a in adds), *((q, "query", {"inner": "dst", "outer": "src"}) for q in asks), into="found")
    return p


SWAP = "i.src = q.dst AND i.dst = q.src"


def swapped_sql(select: str, adds: str, asks: str) -> str:
    return f"WITH {E}, g AS (SELECT q.event_id, any_value(q.kind) AS kind, any_value(q.x) AS x, CASE WHEN any_value(q.kind) IN {asks} THEN CAST(count(i.event_id) > 0 AS BIGINT) ELSE 1 END AS found FROM {joined(DAY2, adds, asks, SWAP)} GROUP BY q.event_id) SELECT event_id, {select} FROM g"


@query(swapped_sql("found", "(0, 2)", "(1, 3, 4)"))
def exist_swapped_keys(spark, sf_dir):
    return run(swapped([[Eq(0)], [Eq(2)]], [[_]]), events(spark, sf_dir), "found")


@query(swapped_sql("found, CAST(found = 0 AS BIGINT) AS drop_ctl", "(0)", "(1, 2, 3, 4)"))
def firewall_drop(spark, sf_dir):
    p = swapped([[Eq(0)]], [[_]]).match(["found"], ([Eq(0)], {"drop_ctl": 1}), ([_], {"drop_ctl": 0}))
    return run(p, events(spark, sf_dir), "found", "drop_ctl")


@query(
    f"""WITH {E.replace("event_id * 7919 % 1000 AS x", "event_id * 7919 % 5 AS x")}, g AS (
SELECT q.event_id, any_value(q.kind) AS kind, any_value(q.x) AS x, count(i.event_id) AS n FROM e q LEFT JOIN e i
ON q.kind <> 1 AND q.x = 3 AND i.kind = 1 AND {SWAP} AND {live(DAY2)} AND (i.ts < q.ts OR (i.ts = q.ts AND i.event_id < q.event_id)) GROUP BY q.event_id)
SELECT event_id, CAST(CASE WHEN kind <> 1 AND x = 3 AND n = 0 THEN 0 ELSE 1 END AS BIGINT) AS found, CAST(CASE WHEN kind <> 1 AND x = 3 AND n = 0 THEN 1 ELSE 0 END AS BIGINT) AS drop_ctl FROM g"""
)
def dns_amplification(spark, sf_dir):
    p = Program().local("found", 1, 8)
    p.exist("seen", ["inner", "outer"], DAY2)
    p.route("seen", ["kind", "x5"], ([Eq(1), _], "add", {"inner": "src", "outer": "dst"}), ([_, Eq(3)], "query", {"inner": "dst", "outer": "src"}), into="found")
    p.match(["found"], ([Eq(0)], {"drop_ctl": 1}), ([_], {"drop_ctl": 0}))
    return run(p, events(spark, sf_dir).withColumn("x5", F.col("event_id") * 7919 % 5), "found", "drop_ctl")


@query(f"SELECT event_id, r AS n, CAST(r BETWEEN 4 AND 4294967295 AS BIGINT) AS port FROM ({count_sql(DAY2, '(0, 1)', '(0, 1)')})")
def heavy_hitters(spark, sf_dir):
    p = Program().local("n", 0)
    p.count("c", ["user"], DAY2)
    p.route("c", ["kind"], ([Range(0, 1)], "add_query", {"user": "user_id"}), into="n").match(["n"], ([Range(4, 2**32 - 1)], {"port": 1}))
    return run(p, events(spark, sf_dir), "n", "port")


@query(
    f"""WITH RECURSIVE {E}, c AS (SELECT q.event_id, any_value(q.ts) AS ts, any_value(q.user_id) AS user_id, any_value(q.kind) AS kind, any_value(q.x) AS x, count(i.event_id) AS n FROM {joined(DAY2, "(0)", "(1)")} GROUP BY q.event_id),
{anchored("@x", "@x", T60, "kind = 1 AND n >= 1", "c")},
l AS (SELECT c.event_id, max(st.rn) AS rn FROM c JOIN st ON c.user_id = st.user_id AND c.kind = 0 AND (st.ts < c.ts OR (st.ts = c.ts AND st.event_id < c.event_id)) GROUP BY c.event_id)
SELECT c.event_id, c.n, CAST(CASE WHEN st.s IS NOT NULL AND c.ts - st.t0 < {T60} THEN st.s ELSE 0 END AS BIGINT) AS v FROM c LEFT JOIN l USING (event_id) LEFT JOIN st ON st.user_id = c.user_id AND st.rn = l.rn"""
)
def netcache_lookup(spark, sf_dir):
    p = Program().local("n", 0).local("v", 0)
    p.count("asked", ["user"], DAY2)
    p.fold("value", ["user"], w.Since(60 * HOUR), **LATEST)
    p.route("asked", ["kind"], ([Eq(0)], "add", {"user": "user_id"}), ([Eq(1)], "query", {"user": "user_id"}), into="n")
    p.route("value", ["n", "kind"], ([Range(1, 2**32 - 1), Eq(1)], "add", {"user": "user_id"}), ([_, Eq(0)], "query", {"user": "user_id"}), into="v")
    return run(p, events(spark, sf_dir), "n", "v")


@query(
    f"""WITH RECURSIVE {E}, {anchored("0", "CASE WHEN lag_x > @x THEN st.s + 1 ELSE st.s END", T60, "kind IN (0, 1)", "(SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag_x FROM e WHERE kind IN (0, 1))")}
SELECT e.event_id, coalesce(st.s, 0) AS n, CAST(coalesce(st.s, 0) >= 3 AS BIGINT) AS port FROM e LEFT JOIN st USING (event_id)"""
)
def ooo_tcp(spark, sf_dir):
    p = Program().local("n", 0)
    p.fold("o", ["user"], w.Since(60 * HOUR), **FALLS)
    p.route("o", ["kind"], ([Range(0, 1)], "add_query", {"user": "user_id"}), into="n").match(["n"], ([Range(3, 2**32 - 1)], {"port": 1}))
    return run(p, events(spark, sf_dir), "n", "port")


@query(f"WITH {E}, g AS (SELECT q.event_id, any_value(q.user_id) & 7 AS prefix, count(*) - 1 AS n FROM e q JOIN e i ON (i.user_id & 7) = (q.user_id & 7) AND {live(w.Within(6 * HOUR, 12 * HOUR))} AND (i.ts < q.ts OR (i.ts = q.ts AND i.event_id <= q.event_id)) GROUP BY q.event_id) SELECT * FROM g")
def rate_prefix(spark, sf_dir):
    p = Program().local("n", 0).local("prefix", 0, 8)
    p.fold("c", [("p", 8)], w.Within(6 * HOUR, 12 * HOUR), **COUNTER, err="exact")
    p.assign("prefix", "user_id[0:2]").route("c", ["kind"], ([_], "add_query", {"p": "prefix"}), into="n")
    return run(p, events(spark, sf_dir), "prefix", "n")


def difference(spark, sf_dir, plus: list, minus: list) -> DataFrame:
    p = Program().local("a", 0).local("b", 0).local("left", 0)
    p.count("more", ["user"], w.Since(60 * HOUR))
    p.fold("less", ["user"], w.Since(60 * HOUR), **COUNTER)
    p.route("more", ["kind"], (plus, "add_query", {"user": "user_id"}), into="a").route("less", ["kind"], (minus, "add_query", {"user": "user_id"}), into="b")
    p.assign("left", "a - b").match(["left"], ([Range(2, 2**32 - 1)], {"port": 1}))
    return run(p, events(spark, sf_dir), "a", "b", "left", "port")


def difference_sql(plus: str, minus: str) -> str:
    return f"""WITH RECURSIVE {E}, {anchored("0", "st.s + 1", T60, f"kind IN {minus}")},
c AS (SELECT q.event_id, count(i.event_id) AS a FROM {joined(w.Since(60 * HOUR), plus, plus)} GROUP BY q.event_id)
SELECT event_id, a, coalesce(s, 0) AS b, (a - coalesce(s, 0)) & 4294967295 AS "left", CAST(((a - coalesce(s, 0)) & 4294967295) >= 2 AS BIGINT) AS port FROM c LEFT JOIN st USING (event_id)"""


@query(difference_sql("(0, 1)", "(2)"))
def superspreader(spark, sf_dir):
    return difference(spark, sf_dir, [Bits("00*")], [Bits("010")])


@query(difference_sql("(1, 3)", "(2, 3)"))
def synflood(spark, sf_dir):
    return difference(spark, sf_dir, [Bits("0*1")], [Bits("01*")])


@query(
    f"""WITH {E}, g AS (SELECT q.event_id, any_value(q.kind) AS kind, count(i.event_id) AS n FROM {joined(DAY2, "(0)", "(1)", "i.src = q.dst AND i.dst = q.src AND i.x % 2 = q.x % 2")} GROUP BY q.event_id)
SELECT event_id, CAST(CASE WHEN kind = 1 AND n = 0 THEN 0 ELSE 1 END AS BIGINT) AS found, CAST(kind = 1 AND n = 0 AS BIGINT) AS drop_ctl FROM g"""
)
def ftp_pinhole(spark, sf_dir):
    p = Program().local("found", 1, 8)
    p.fold("open", ["inner", "outer", ("port", 16)], DAY2, init={"one": 1}, update={"one": "s.one"})
    p.route("open", ["kind"], ([Eq(0)], "add", {"inner": "src", "outer": "dst", "port": "port2"}), ([Eq(1)], "query", {"inner": "dst", "outer": "src", "port": "port2"}), into="found")
    p.match(["found"], ([Eq(0)], {"drop_ctl": 1}), ([_], {"drop_ctl": 0}))
    return run(p, events(spark, sf_dir).withColumn("port2", F.col("x") % 2), "found", "drop_ctl")


CAMPUS = w.Within(30 * HOUR, 61 * HOUR)


@query(
    f"""WITH {E}, h AS (SELECT *, (src IN (2, 3) OR src >= 12) AS inner_side FROM e),
g AS (SELECT q.event_id, any_value(q.ts) AS ts, any_value(q.inner_side) AS inner_side, count(i.event_id) AS n FROM h q LEFT JOIN h i ON NOT q.inner_side AND i.inner_side AND i.src = q.dst AND i.dst = q.src AND {live(CAMPUS)} AND (i.ts < q.ts OR (i.ts = q.ts AND i.event_id < q.event_id)) GROUP BY q.event_id)
SELECT event_id, CAST(NOT inner_side AND n = 0 AS BIGINT) AS report, 129 AS port, ts & 281474976710655 AS stamp FROM g"""
)
def campus_prefix_firewall(spark, sf_dir):
    p = Program(widths={"stamp": 48, "ts": 63}).local("found", 1, 8)
    p.exist("seen", ["inner", "outer"], CAMPUS)
    p.route("seen", ["src"], *(([Bits(b)], "add", {"inner": "src", "outer": "dst"}) for b in ("001*", "11**")), ([_], "query", {"inner": "dst", "outer": "src"}), into="found")
    p.match(["found"], ([Eq(0)], {"report": 1, "port": 0x81, "stamp": "ts"}), ([_], {"report": 0, "port": 0x81, "stamp": "ts"}))
    made = run(p, events(spark, sf_dir), "report", "port", "stamp")
    return made.withColumn("port", F.col("port").cast("int"))


# patterns


def matched(spark, sf_dir, on, *branches) -> DataFrame:
    return run(Program(widths={"ts": 63}).local("m", 7).match(on, *((p, {"m": v}) for p, v in branches)), events(spark, sf_dir), "m")


@query(f"WITH {E} SELECT event_id, CAST(CASE WHEN x BETWEEN 0 AND 499 THEN 1 WHEN x BETWEEN 400 AND 799 THEN 2 ELSE 3 END AS BIGINT) AS m FROM e")
def match_first_wins(spark, sf_dir):
    return matched(spark, sf_dir, ["x"], ([Range(0, 499)], 1), ([Range(400, 799)], 2), ([_], 3))


@query(f"WITH {E} SELECT event_id, CAST(CASE WHEN kind = 1 AND x BETWEEN 100 AND 300 THEN x WHEN kind BETWEEN 2 AND 3 THEN 5 ELSE 7 END AS BIGINT) AS m FROM e")
def match_range(spark, sf_dir):
    return matched(spark, sf_dir, ["kind", "x"], ([Eq(1), Range(100, 300)], "x"), ([Range(2, 3), _], 5))


@query(f"WITH {E} SELECT event_id, CAST(CASE WHEN (x & 771) = 257 THEN 1 WHEN (x & 4) = 4 THEN 2 ELSE 0 END AS BIGINT) AS m FROM e")
def match_bitpattern(spark, sf_dir):
    return matched(spark, sf_dir, ["x"], ([Bits("01******01")], 1), ([Bits("*******1**")], 2), ([_], 0))


@query(f"WITH {E} SELECT event_id, CAST(CASE WHEN kind = 4 THEN 1 ELSE 7 END AS BIGINT) AS m FROM e")
def match_default_noop(spark, sf_dir):
    return matched(spark, sf_dir, ["kind"], ([Eq(4)], 1))


# unsigned integers

N = "n AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 2654435761 + l_linenumber) & 4294967295 AS a, (l_partkey * 40503 * 65537) & 4294967295 AS b FROM lineitem)"


def numbers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "(l_orderkey * 2654435761L + l_linenumber) & 4294967295L AS a", "(l_partkey * 40503L * 65537L) & 4294967295L AS b")


def arithmetic(name: str, exprs: dict[str, str], sql: dict[str, str]) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = Program()
        for k, e in exprs.items():
            p.local(k, e, 48 if k == "cat" else 32)
        return lower.run(p, numbers(spark, sf_dir)).select("l_orderkey", "l_linenumber", *exprs)

    f.__name__ = name
    query(f"WITH {N} SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({e} AS BIGINT) AS {k}' for k, e in sql.items())} FROM n")(f)


TOP = 4294967295
arithmetic("uint_wrap_arith", {"s": "a + b", "d": "a - b", "n": "-a"}, {"s": f"(a + b) & {TOP}", "d": f"(a - b) & {TOP}", "n": f"(-a) & {TOP}"})
arithmetic("uint_sat_arith", {"s": "a |+| b", "d": "a |-| b"}, {"s": f"least(a + b, {TOP})", "d": "greatest(a - b, 0)"})
arithmetic("uint_bitwise", {"x": "a & b", "y": "a | b", "z": "a ^ b", "n": "~a"}, {"x": "a & b", "y": "a | b", "z": "xor(a, b)", "n": f"(~a) & {TOP}"})
arithmetic("uint_shift", {"u": "a << 5", "v": "a >> 7"}, {"u": f"(a * 32) & {TOP}", "v": "a >> 7"})
arithmetic("uint_slice", {"low": "a[0:7]", "mid": "a[8:19]", "high": "a[24:31]"}, {"low": "a & 255", "mid": "(a >> 8) & 4095", "high": "a >> 24"})
arithmetic("uint_concat", {"cat": "a ++ b[0:15]"}, {"cat": "a * 65536 + (b & 65535)"})
arithmetic("uint_cast", {"c": "(int<8>) a", "d": "(int<16>) (a + b)"}, {"c": "a & 255", "d": "(a + b) & 65535"})
arithmetic("uint_compare", {"c": "a if a > b else b", "d": "1 if a >= 2147483648 && !(b < a) || a == b else 0"}, {"c": "greatest(a, b)", "d": "CASE WHEN (a >= 2147483648 AND NOT (b < a)) OR a = b THEN 1 ELSE 0 END"})


@query(f"WITH {N} SELECT l_orderkey, l_linenumber, a AS mac FROM n")
def mac_to_int(spark, sf_dir):
    digits = F.lpad(F.lower(F.hex("a")), 12, "0")
    text = F.concat_ws(":", *(F.substring(digits, i, 2) for i in range(1, 12, 2)))
    return numbers(spark, sf_dir).select("l_orderkey", "l_linenumber", uint.mac_to_int(text).alias("mac"))


@query(f"WITH {N} SELECT l_orderkey, l_linenumber, concat_ws('.', a >> 24, (a >> 16) & 255, (a >> 8) & 255, a & 255) AS ip, a AS number FROM n")
def ipv4_to_int(spark, sf_dir):
    text = uint.int_to_ipv4(F.col("a"))
    return numbers(spark, sf_dir).select("l_orderkey", "l_linenumber", text.alias("ip"), uint.ipv4_to_int(text).alias("number"))


PREFIXES = ["128.0.0.0/4", "17.32.0.0/11", "66.180.176.0/20"]


@query(f"WITH {N} SELECT l_orderkey, l_linenumber, ((a >> 28) = 8 OR (a >> 21) = 137 OR (a >> 12) = {(66 << 24 | 180 << 16 | 176 << 8) >> 12}) AS inside FROM n")
def prefix_classify(spark, sf_dir):
    return numbers(spark, sf_dir).select("l_orderkey", "l_linenumber", uint.in_prefixes(F.col("a"), PREFIXES).alias("inside"))


# evaluation kit

SPAN = us(36 * HOUR)
BIN = us(HOUR)
TRUTH = f"""{E}, lab AS (SELECT q.event_id, any_value(q.ts) AS ts, any_value(q.user_id) AS user_id, any_value(q.kind) AS kind, any_value(q.ts) // {BIN} AS "window", any_value(q.event_id) % 3 % 2 AS report,
CASE WHEN any_value(q.kind) IN (0, 3) THEN 0 WHEN count(i.event_id) > 0 THEN 0 ELSE 1 END AS ground_truth
FROM e q LEFT JOIN e i ON q.kind NOT IN (0, 3) AND i.kind IN (0, 3) AND i.user_id = q.user_id AND i.ts >= q.ts - {SPAN} AND i.ts < q.ts GROUP BY q.event_id)"""
STATS = f"""{TRUTH}, stats AS (SELECT "window", count(*) FILTER (report = 0 AND ground_truth = 1) AS num_falsepos, count(*) FILTER (report = 1 AND ground_truth = 0) AS num_falseneg,
count(*) FILTER (report = 0 AND ground_truth = 0) AS num_truepos, count(*) FILTER (report = 1 AND ground_truth = 1) AS num_trueneg, count(*) FILTER (ground_truth = 1) AS num_negatives, count(*) AS num_packets,
count(*) FILTER (report = 0 AND ground_truth = 1) / nullif(CAST(count(*) FILTER (ground_truth = 1) AS DOUBLE), 0) AS FPR FROM lab GROUP BY "window")"""


def labelled(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"window": F.floor(F.col("ts") / BIN), "report": F.col("event_id") % 3 % 2})
    return evalkit.ground_truth(rows, F.col("kind").isin(0, 3), ["user_id"], "ts", "event_id", SPAN)


@query(f"WITH {TRUTH} SELECT event_id, CAST(ground_truth AS BIGINT) AS ground_truth FROM lab")
def groundtruth_60s(spark, sf_dir):
    return labelled(spark, sf_dir).select("event_id", F.col("ground_truth").cast("long").alias("ground_truth"))


@query(f"WITH {STATS} SELECT * FROM stats")
def confusion_by_window(spark, sf_dir):
    return evalkit.confusion(labelled(spark, sf_dir))


@query(f"WITH {STATS} SELECT round(sum(num_falsepos) / CAST(sum(num_negatives) AS DOUBLE), 10) AS FPR FROM stats")
def fpr_global(spark, sf_dir):
    return evalkit.global_rate(evalkit.confusion(labelled(spark, sf_dir)))


@query(f'WITH {STATS} SELECT "window" // 24 * 24 AS "window", round(avg(FPR), 9) AS FPR, CAST(sum(num_packets) AS BIGINT) AS num_packets FROM stats GROUP BY 1')
def fpr_smoothed(spark, sf_dir):
    return evalkit.smoothed(evalkit.confusion(labelled(spark, sf_dir)), 24).withColumn("FPR", F.round("FPR", 9))


@query(f'WITH {E} SELECT ts // {BIN} AS "window", count(DISTINCT (src, dst)) AS num_insertions FROM e WHERE kind IN (0, 3) GROUP BY 1')
def distinct_pairs_per_window(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("kind").isin(0, 3)).withColumn("window", F.floor(F.col("ts") / BIN))
    return evalkit.distinct_pairs(rows, "src", "dst")


@query(f"WITH {TRUTH} SELECT CAST(report AS BIGINT) AS report, CAST(ground_truth AS BIGINT) AS ground_truth, count(*) AS n FROM lab GROUP BY ALL")
def report_counts(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy(F.col("report").cast("long").alias("report"), F.col("ground_truth").cast("long").alias("ground_truth")).agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT q.event_id FROM e q WHERE q.kind = 1 AND NOT EXISTS (SELECT 1 FROM e i WHERE i.kind = 0 AND i.user_id = q.user_id AND q.ts // {BIN} - i.ts // {BIN} BETWEEN 1 AND 59)")
def anti_join_shifted(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("bin", F.floor(F.col("ts") / BIN))
    return evalkit.anti_join_shifted(rows.where("kind = 1"), rows.where("kind = 0"), ["user_id"], "bin", 1, 59).select("event_id")


@query(f'WITH {E}, g AS (SELECT ts // {BIN} AS "window", user_id, min(ts) AS lo, max(ts) AS hi FROM e WHERE kind = 0 GROUP BY ALL) SELECT e.event_id, coalesce(g.lo, 0) AS min_insert_ts, coalesce(g.hi, -1) AS max_insert_ts FROM e LEFT JOIN g ON e.ts // {BIN} = g."window" AND e.user_id = g.user_id WHERE kind = 1')
def left_join_fill(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("window", F.floor(F.col("ts") / BIN))
    groups = evalkit.insert_groups(rows.where("kind = 0"), ["user_id"], "ts")
    return evalkit.left_join_fill(rows.where("kind = 1"), groups, ["window", "user_id"], {"min_insert_ts": 0, "max_insert_ts": -1}).select("event_id", "min_insert_ts", "max_insert_ts")


@query(f"WITH {E}, c AS (SELECT user_id, count(*) AS n FROM e WHERE kind = 0 GROUP BY 1) SELECT * FROM c ORDER BY n DESC, user_id LIMIT 20")
def top_inserters(spark, sf_dir):
    return events(spark, sf_dir).where("kind = 0").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


# panes and sketches

CLOCK = w.Panes(4, 7153, 22)


@query(f"WITH {E}, f AS (SELECT min(ts) AS t0 FROM e) SELECT event_id, ((ts >> {CLOCK.log2}) - (t0 >> {CLOCK.log2})) // {CLOCK.units} AS pane, ((ts >> {CLOCK.log2}) - (t0 >> {CLOCK.log2})) // {CLOCK.units} % {CLOCK.count} AS role FROM e, f")
def pane_clock(spark, sf_dir):
    rows = events(spark, sf_dir)
    first = F.broadcast(rows.agg(F.min("ts").alias("t0")))  # one row
    pane = F.floor((F.shiftright("ts", CLOCK.log2) - F.shiftright("t0", CLOCK.log2)) / CLOCK.units)
    return rows.crossJoin(first).select("event_id", pane.alias("pane"), (pane % CLOCK.count).alias("role"))


PANE = us(12 * HOUR)


def sketch_parts(spark, sf_dir):
    rows = events(spark, sf_dir)
    adds, asks = rows.where("kind = 0"), rows.where("kind = 1").select("event_id", "user_id", "ts")
    exact = asks.withColumn("p", F.floor(F.col("ts") / PANE)).select("event_id", "user_id", F.explode(F.sequence(F.col("p") - 2, F.col("p"))).alias("p")).join(adds.groupBy("user_id", F.floor(F.col("ts") / PANE).alias("p")).agg(F.count("*").alias("n")), ["user_id", "p"]).groupBy("event_id").agg(F.sum("n").alias("truth"))
    return adds, asks, asks.join(exact, "event_id", "left").withColumn("truth", F.coalesce("truth", F.lit(0)))


def hash_sql(key: str, seed: int) -> str:
    """SQL of uint.hash32."""
    h = str((seed * uint.HASH_SEED + 1) & TOP)
    for part in (f"({key} & {TOP})", f"({key} >> 32)"):
        h = f"((xor({h}, {part}) * {uint.HASH_FACTOR}) & {TOP})"
        h = f"xor({h}, ({h} >> 15))"
    return h


def slot_sql(key: str, seed: int, bits: int) -> str:
    return f"(({hash_sql(key, seed)}) >> {32 - bits})"


def sketch_sql(rows: int, bits: int, select: str) -> str:
    """Places, cells and whole panes in SQL, beside the truth."""
    placed = " UNION ALL ".join(f"SELECT event_id, kind, ts // {PANE} AS p, {r} AS r, {slot_sql('user_id', r + 1, bits)} AS slot FROM e" for r in range(rows))
    return f"""WITH {E}, placed AS ({placed}),
cells AS (SELECT p, r, slot, count(*) AS n FROM placed WHERE kind = 0 GROUP BY ALL),
hit AS (SELECT a.event_id, c.p, min(c.n) AS n FROM placed a JOIN cells c ON a.kind = 1 AND c.r = a.r AND c.slot = a.slot AND c.p BETWEEN a.p - 2 AND a.p GROUP BY ALL HAVING count(*) = {rows}),
ans AS (SELECT event_id, sum(n) AS n FROM hit GROUP BY 1),
truth AS (SELECT q.event_id, count(i.event_id) AS truth FROM e q LEFT JOIN e i ON i.kind = 0 AND i.user_id = q.user_id AND i.ts // {PANE} BETWEEN q.ts // {PANE} - 2 AND q.ts // {PANE} WHERE q.kind = 1 GROUP BY 1)
SELECT event_id, {select} FROM truth LEFT JOIN ans USING (event_id)"""


@query(sketch_sql(3, 5, "CAST(truth > 0 AS BIGINT) AS truth, CAST(n IS NOT NULL AS BIGINT) AS r"))
def bloom_exist_superset(spark, sf_dir):
    adds, _asks, exact = sketch_parts(spark, sf_dir)
    cells = sketch.cells(adds, ["user_id"], "ts", PANE, 3, 5)
    found = sketch.look_up(exact, cells, ["user_id"], "ts", PANE, 3, 3, 5, "event_id", "r", counts=False)
    return found.select("event_id", (F.col("truth") > 0).cast("long").alias("truth"), "r")


@query(sketch_sql(2, 5, "truth, CAST(coalesce(n, 0) AS BIGINT) AS r"))
def cms_count_upper(spark, sf_dir):
    adds, _asks, exact = sketch_parts(spark, sf_dir)
    cells = sketch.cells(adds, ["user_id"], "ts", PANE, 2, 5)
    found = sketch.look_up(exact, cells, ["user_id"], "ts", PANE, 3, 2, 5, "event_id", "r", counts=True)
    return found.select("event_id", F.col("truth").cast("long").alias("truth"), "r")


#: Four panes for DAY2; a query reads its own and the two before.
FOUR = w.panes(DAY2, 4)
FOUR_US = -(-FOUR.length // TICK)


def program_sketch_sql(rows: int, bits: int, value: str) -> str:
    """Whole earlier panes, and of a query's own pane what came before it."""
    placed = " UNION ALL ".join(f"SELECT event_id, ts, kind, ts // {FOUR_US} AS p, {r} AS r, {slot_sql('user_id', r + 1, bits)} AS slot FROM e WHERE kind IN (0, 1)" for r in range(rows))
    return f"""WITH {E}, placed AS ({placed}),
cells AS (SELECT p, r, slot, count(*) AS n FROM placed WHERE kind = 0 GROUP BY ALL),
running AS (SELECT *, count(*) FILTER (kind = 0) OVER (PARTITION BY p, r, slot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM placed),
seen AS (SELECT event_id, p, n FROM running WHERE kind = 1 AND n > 0 UNION ALL
  SELECT a.event_id, c.p, c.n FROM placed a JOIN cells c ON a.kind = 1 AND c.r = a.r AND c.slot = a.slot AND c.p BETWEEN a.p - 2 AND a.p - 1),
hit AS (SELECT event_id, p, min(n) AS n FROM seen GROUP BY ALL HAVING count(*) = {rows}),
ans AS (SELECT event_id, sum(n) AS n FROM hit GROUP BY 1)
SELECT e.event_id, {value} AS r FROM e LEFT JOIN ans USING (event_id)"""


def program_sketch(spark, sf_dir, kind: str, rows: int, bits: int) -> DataFrame:
    made = lower.run(one_set(kind, DAY2, ADD_ASK), events(spark, sf_dir), "ts", "event_id", TICK, sketches={"s": (FOUR, rows, bits)})
    return made.select("event_id", "r")


@query(program_sketch_sql(3, 5, "CAST(n IS NOT NULL AS BIGINT)"))
def program_on_bloom(spark, sf_dir):
    return program_sketch(spark, sf_dir, "exist", 3, 5)


@query(program_sketch_sql(2, 5, "CAST(coalesce(n, 0) AS BIGINT)"))
def program_on_count_min(spark, sf_dir):
    return program_sketch(spark, sf_dir, "count", 2, 5)


@query(
    f"""WITH {E}, placed AS (SELECT *, ts // {PANE} AS pane, ({hash_sql('user_id', 0)}) % 2 AS row_, {slot_sql('user_id', 1, 3)} AS slot FROM e WHERE kind = 0),
own AS (SELECT pane, row_, slot, user_id FROM placed QUALIFY row_number() OVER (PARTITION BY pane, row_, slot ORDER BY ts, event_id) = 1)
SELECT pane, user_id, CAST(count(*) - 1 AS BIGINT) AS n, arg_min(x, (ts, event_id)) AS first_x, arg_max(x, (ts, event_id)) AS last_x FROM placed JOIN own USING (pane, row_, slot, user_id) GROUP BY pane, user_id"""
)
def fold_table_subset(spark, sf_dir):
    adds = events(spark, sf_dir).where("kind = 0")
    made = None
    for name, fold in (("n", COUNTER), ("first_x", FIRST), ("last_x", LATEST)):
        program = Program()
        program.fold("f", ["user_id"], w.Since(12 * HOUR), **fold)
        spec = program.sets["f"].fold
        own = sketch.fold_table(adds, ["user_id"], spec, "ts", "event_id", PANE, 2, 3, name)
        made = own if made is None else made.join(own, ["pane", "user_id"])
    return made


@query(f"WITH {E} SELECT ts // {PANE} AS pane, count(DISTINCT user_id) AS distinct_keys FROM e WHERE kind = 0 GROUP BY 1")
def workload_statistics(spark, sf_dir):
    return sketch.statistics(events(spark, sf_dir).where("kind = 0"), ["user_id"], "ts", PANE)


GRID = [(b, r, p) for b in (10, 14, 18) for r in (1, 2, 3) for p in (2, 3, 4)]
VALUES = ", ".join(f"({b}, {r}, {p})" for b, r, p in GRID)


@query(f"SELECT bits, r, p, round(1 - power(1 - power(1 - power(1 - 1.0 / CAST(1 << bits AS DOUBLE), 57060.0 / p), r), p), 9) AS fpr FROM (VALUES {VALUES}) AS g(bits, r, p)")
def bloom_fpr_model(spark, sf_dir):
    rows = [(b, r, p, round(sketch.bloom_fpr(1 << b, 57060.0, r, p), 9)) for b, r, p in GRID]
    return spark.createDataFrame(rows, "bits int, r int, p int, fpr double")


@query(f"SELECT bits, r, round(exp(-r) + (1 - exp(-r)) * exp(1) / CAST(1 << bits AS DOUBLE), 12) AS error FROM (SELECT DISTINCT bits, r FROM (VALUES {VALUES}) AS g(bits, r, p))")
def cms_error_model(spark, sf_dir):
    rows = [(b, r, round(sketch.cms_error(1 << b, r), 12)) for b, r in sorted({(b, r) for b, r, _p in GRID})]
    return spark.createDataFrame(rows, "bits int, r int, error double")


# wide inputs, several filters, text form

WIDE = 281474976710655
WIDE_E = E.replace("event_id * 7919 % 1000 AS x", f"epoch_us(ts) & {WIDE} AS x")


def wide_fold(spark, sf_dir, fold: dict) -> DataFrame:
    p = one_set("fold", DAY2, ADD_ASK, fold)
    p.widths["x"] = 48
    return run(p, events(spark, sf_dir).withColumn("x", F.col("ts").bitwiseAND(F.lit(WIDE))), "r")


@query(fold_sql(f"l[1] & {TOP}", DAY2).replace(E, WIDE_E))
def fold_first_wide_input(spark, sf_dir):
    return wide_fold(spark, sf_dir, FIRST)


@query(fold_sql(f"l[len(l)] & {TOP}", DAY2).replace(E, WIDE_E))
def fold_last_wide_input(spark, sf_dir):
    return wide_fold(spark, sf_dir, LATEST)


def filters(n: int) -> Program:
    """n independent filters, each opened by another kind of event; an event passes if all let it."""
    p = Program()
    for i in range(n):
        p.local(f"found{i}", 1, 8)
        p.exist(f"open{i}", ["inner", "outer"], DAY2)
        p.route(f"open{i}", ["kind"], ([Eq(i)], "add", {"inner": "src", "outer": "dst"}), ([_], "query", {"inner": "dst", "outer": "src"}), into=f"found{i}")
    shut = [([Eq(0) if j == i else _ for j in range(n)], {"drop_ctl": 1}) for i in range(n)]
    return p.match([f"found{i}" for i in range(n)], *shut, ([_] * n, {"drop_ctl": 0}))


def filters_sql(n: int) -> str:
    parts = [E]
    for i in range(n):
        asks = f"({', '.join(str(k) for k in range(5) if k != i)})"
        parts.append(f"f{i} AS (SELECT q.event_id, CASE WHEN any_value(q.kind) = {i} THEN 1 ELSE CAST(count(i.event_id) > 0 AS BIGINT) END AS found{i} FROM {joined(DAY2, f'({i})', asks, SWAP)} GROUP BY q.event_id)")
    found = ", ".join(f"CAST(found{i} AS BIGINT) AS found{i}" for i in range(n))
    least = f"least({', '.join(f'found{i}' for i in range(n))})" if n > 1 else "found0"
    tables = "f0" + "".join(f" JOIN f{i} USING (event_id)" for i in range(1, n))
    return f"WITH {', '.join(parts)} SELECT event_id, {found}, CAST({least} = 0 AS BIGINT) AS drop_ctl FROM {tables}"


def several_filters(n: int) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(filters(n), events(spark, sf_dir), *(f"found{i}" for i in range(n)), "drop_ctl")

    f.__name__ = f"filters_{n}"
    query(filters_sql(n))(f)


for _n in (1, 2, 3, 4):
    several_filters(_n)

FIREWALL_TEXT = """
type pair = { int<32> inner; int<32> outer; }
global ExistSet.t<pair> seen = ExistSet.create(super, within(hour(24), hour(48)), Exist());
handle packet(pkt_type p) {
  int<8> found = 1;
  match p.kind with
  | 0 -> { ExistSet.add(seen, { inner = p.src; outer = p.dst }); }
  | _ -> { found = ExistSet.query(seen, { inner = p.dst; outer = p.src }); }
  match found with
  | 0 -> { p.drop_ctl = 1; }
  | _ -> { p.drop_ctl = 0; }
}
"""


@query(ORACLES["firewall_drop"])
def firewall_from_text(spark, sf_dir):
    return run(parse.parse(FIREWALL_TEXT), events(spark, sf_dir), "found", "drop_ctl")


# packets, captures, streams

HEADERS = {
    "hdr.ethernet.ether_type": "CASE WHEN event_id % 5 = 0 THEN 2054 ELSE 2048 END",
    "hdr.ipv4.protocol": "CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END",
    "hdr.ipv4.ttl": "event_id % 256",
    "hdr.ipv4.src_addr": "src",
    "hdr.ipv4.dst_addr": "dst",
    "hdr.tcp.src_port": "x",
    "hdr.udp.src_port": "x + 1",
}


@query(
    f"""WITH {E}, k AS (SELECT event_id, event_id % 3 AS m, event_id % 256 AS ttl, src, x FROM e WHERE event_id % 5 <> 0)
SELECT event_id AS seq, ttl - CAST(ttl > 0 AS BIGINT) AS ttl, CASE WHEN m = 0 THEN x ELSE 0 END AS tcp_port, CASE WHEN m = 1 THEN x + 1 ELSE 0 END AS udp_port, src * 256 + (CASE WHEN m = 0 THEN 6 WHEN m = 1 THEN 17 ELSE 1 END) AS tag FROM k WHERE ttl >= 8"""
)
def packet_rewrite(spark, sf_dir):
    """Nested packets: headers parsed, one rewritten, short-lived packets dropped, the others emitted."""
    flat = events(spark, sf_dir).selectExpr("event_id AS seq", "ts * 1000 AS ts_ns", *(f"CAST({e} AS BIGINT) AS `{c}`" for c, e in HEADERS.items()))
    rows = packets.parse_headers(packets.flatten(packets.nest(flat)))
    p = Program().local("tag", "hdr.ipv4.src_addr ++ hdr.ipv4.protocol", 40)
    p.match(["hdr.ipv4.ttl"], ([Range(0, 7)], {"ig_intr_dprsr_md.drop_ctl": 1}), ([_], {"ig_intr_dprsr_md.drop_ctl": 0}))
    p.assign("hdr.ipv4.ttl", "hdr.ipv4.ttl |-| 1")
    made = packets.flatten(packets.nest(packets.emit(lower.run(p, rows, tick=1))))
    return made.select("seq", F.col("`hdr.ipv4.ttl`").alias("ttl"), F.col("`hdr.tcp.src_port`").alias("tcp_port"), F.col("`hdr.udp.src_port`").alias("udp_port"), "tag")


@query(f"WITH {E}, k AS (SELECT event_id, ts * 1000 AS t FROM e WHERE event_id % 3 < 2) SELECT event_id, (t - (SELECT min(t) FROM k)) // 1000 AS offset_us FROM k")
def relative_time(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"ts_ns": F.col("ts") * 1000, "protocol": F.expr(HEADERS["hdr.ipv4.protocol"])})
    return packets.relative_time(rows).select("event_id", "offset_us")


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only where all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panewise-")
    return f"{root}/capture-{uuid.uuid4().hex}"


MONTH = 1704067200000000  # 2024-01-01 in microseconds
REACH = 6_000_000_000
STAMP = f"(ts - {MONTH}) // 20"


@query(
    f"""WITH {E}, c AS (SELECT event_id, {STAMP} AS m, src >= 8 AS inner_side, CASE WHEN src >= 8 THEN src ELSE dst END AS i, CASE WHEN src >= 8 THEN dst ELSE src END AS o, event_id % 3 % 2 AS report FROM e),
lab AS (SELECT q.event_id, any_value(q.m) AS m, any_value(q.report) AS report, CASE WHEN any_value(q.inner_side) THEN 0 WHEN count(a.event_id) > 0 THEN 0 ELSE 1 END AS truth
  FROM c q LEFT JOIN c a ON NOT q.inner_side AND a.inner_side AND a.i = q.i AND a.o = q.o AND a.m >= q.m - {REACH} AND a.m < q.m GROUP BY q.event_id)
SELECT CAST((m - (SELECT min(m) FROM c)) // 1000000000 AS INTEGER) AS "window", count(*) FILTER (report = 0 AND truth = 1) AS num_falsepos, count(*) FILTER (report = 1 AND truth = 0) AS num_falseneg,
count(*) FILTER (report = 0 AND truth = 0) AS num_truepos, count(*) FILTER (report = 1 AND truth = 1) AS num_trueneg, count(*) FILTER (truth = 1) AS num_negatives, count(*) AS num_packets,
round(count(*) FILTER (report = 0 AND truth = 1) / nullif(CAST(count(*) FILTER (truth = 1) AS DOUBLE), 0), 9) AS FPR FROM lab GROUP BY 1"""
)
def capture_evaluation(spark, sf_dir):
    """The whole evaluation job: a capture file in, reports and times out of its MAC addresses, ground truth, counts by second, a CSV report."""
    mac = lambda c: F.concat_ws(":", *(F.substring(F.lpad(F.lower(F.hex(c)), 12, "0"), i, 2) for i in range(1, 12, 2)))
    rows = events(spark, sf_dir)
    ip = lambda c: F.concat(F.lit("10.0.0."), F.col(c).cast("string"))
    stamp = F.floor((F.col("ts") - MONTH) / 20)
    capture = rows.select(ip("src").alias("src_ip"), ip("dst").alias("dst_ip"), F.lit(6).alias("protocol"), F.col("event_id").cast("string").alias("ip_id"), mac(F.col("event_id") % 3 % 2).alias("src_mac"), mac(stamp).alias("dst_mac"))
    folder = work_folder(spark)
    packets.write_capture(capture, f"{folder}/capture")
    read = packets.report_columns(packets.read_capture(spark, f"{folder}/capture"))
    known = evalkit.classify(read, ["10.0.0.8/29"])
    truth = evalkit.ground_truth(known, F.col("from_internal"), ["internal_ip", "external_ip"], "mac_ts", "ip_id", REACH)
    stats = evalkit.confusion(truth).withColumn("FPR", F.round("FPR", 9))
    packets.write_table(stats, f"{folder}/stats", single=True)  # a row for each second
    return packets.read_table(spark, f"{folder}/stats", stats.schema)


@query(f"WITH {E} SELECT ts // {us(HOUR)} AS hour, user_id, count(*) AS n FROM e WHERE kind = 0 GROUP BY ALL")
def stream_pane_counts(spark, sf_dir):
    """Adds by key and hour from a stream of files, with watermark and native state, read to its present end."""
    folder, name = work_folder(spark), f"panes_{uuid.uuid4().hex}"
    rows = events(spark, sf_dir).where("kind = 0").select(F.timestamp_micros("ts").alias("ts"), "user_id")
    rows.write.parquet(f"{folder}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    counts = streaming.pane_counts(live, ["user_id"], "1 hour")
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.floor(F.unix_micros("window.start") / us(HOUR)).alias("hour"), "user_id", "n")
