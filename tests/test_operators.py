import math

import pytest
from pyspark.sql import functions as F

from panewise import queries
from panewise.functions import uint
from panewise.operators import sketch
from panewise.plans import windows as w
from panewise.plans.program import SetDecl
from panewise.sources import packets
from panewise.streaming import lower as streaming


def test_packets_round_trip(spark):
    flat = spark.range(4).select(F.col("id").alias("seq"), *(F.lit(0).cast("long").alias(f"hdr.{h}.{f}") for h, fs in packets._FIELDS.items() for f in fs if (h, f) not in (("ethernet", "ether_type"), ("ipv4", "protocol"))), F.when(F.col("id") == 0, 1).otherwise(packets.IPV4).alias("hdr.ethernet.ether_type"), F.lit(6).alias("hdr.ipv4.protocol"))
    nested = packets.nest(flat)
    assert set(packets.flatten(nested).columns) == set(flat.columns)
    assert packets.parse_headers(packets.flatten(nested)).count() == 3


def test_capture_files(spark, tmp_path):
    row = ["0"] * 51
    row[packets.CAPTURE_COLUMNS.index("src_mac")], row[packets.CAPTURE_COLUMNS.index("dst_mac")] = "00:00:00:00:00:01", "00:00:3b:9a:ca:00"
    (tmp_path / "a.tsv").write_text("\t".join(row) + "\n" + "\t".join([*row[:-1], "00:00:b2:d0:5e:00"]) + "\n")
    got = packets.report_columns(packets.read_capture(spark, str(tmp_path / "a.tsv"))).select("report", "mac_ts", "window").orderBy("mac_ts").collect()
    assert [tuple(r) for r in got] == [(1, 10**9, 0), (1, 3 * 10**9, 2)]
    packets.write_table(spark.range(3), str(tmp_path / "out"), single=True)
    assert packets.read_table(spark, str(tmp_path / "out")).count() == 3
    times = spark.createDataFrame([(5000, 6), (9000, 17), (7000, 1)], "ts_ns long, protocol int")
    assert sorted(r["offset_us"] for r in packets.relative_time(times).collect()) == [0, 4]


def test_addresses(spark):
    df = spark.createDataFrame([("10.1.2.3", "AA-bb.cc:dd ee 0f"), ("x", "0"), ("999.1.1.1", "0")], "ip string, mac string")
    got = df.select(uint.ipv4_to_int(F.col("ip")).alias("i"), uint.mac_to_int(F.col("mac")).alias("m"), uint.in_prefixes(uint.ipv4_to_int(F.col("ip")), ["10.0.0.0/8"]).alias("p")).collect()
    assert (got[0]["i"], got[0]["m"], got[0]["p"]) == (10 << 24 | 1 << 16 | 2 << 8 | 3, 0xAABBCCDDEE0F, True) and got[1]["i"] is None and got[2]["i"] is None


def test_error_models():
    assert sketch.bloom_fpr(1 << 18, 57060.0 * 1.5, 3, 3) == pytest.approx(1 - (1 - (1 - (1 - 2.0**-18) ** (57060.0 / 2)) ** 3) ** 3)
    assert sketch.cms_error(1 << 10, 2) == pytest.approx(math.exp(-2) + (1 - math.exp(-2)) * math.e / 1024)
    assert sketch.fold_table_error(1 << 10, 100.0, 1, 0, 32) == 0
    small, large = (sketch.fold_table_error(1 << b, 1000.0, 2, 1, 32) for b in (12, 8))
    assert 0 <= small < large
    window = w.Within(60 * w.NS["sec"], 121 * w.NS["sec"])
    few, many = sketch.choose(window, "ExistSet", 1 << 16), sketch.choose(window, "ExistSet", 1 << 22)
    assert many[0] < few[0] and many[1].count in w.pane_counts(window)


def test_hash_and_fold_table(spark):
    rows = [(i, i % 7, i % 3, i * 11 % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "ts long, k long, j long, x long")

    def plain(seed, *keys):
        h = (seed * uint.HASH_SEED + 1) % 2**32
        for k in keys:
            for part in (k % 2**32, k >> 32):
                h = (h ^ part) * uint.HASH_FACTOR % 2**32
                h ^= h >> 15
        return h

    got = df.select("k", "j", uint.hash32(3, F.col("k"), F.col("j") + F.lit(2**40)).alias("h"), uint.slot(1, 4, F.col("k")).alias("s")).distinct().collect()
    assert all(r["h"] == plain(3, r["k"], r["j"] + 2**40) and r["s"] == plain(1, r["k"]) >> 28 for r in got)
    from panewise.plans.program import Program

    for fold in (queries.COUNTER, queries.FIRST, {"init": {"v": "x + 1"}, "update": {"v": "x"}}):
        program = Program()
        program.fold("f", ["k"], w.Since(5), **fold)
        table = {(r["pane"], r["k"]): r["v"] for r in sketch.fold_table(df, ["k"], program.sets["f"].fold, "ts", "ts", 20, 2, 1, "v").collect()}
        cells, want = {}, {}
        for ts, k, _, x in rows:  # a cell is set by its first key; other keys are ignored
            at = (ts // 20, plain(0, k) % 2, plain(1, k) >> 31)
            if cells.setdefault(at, k) == k:
                old = want.get((ts // 20, k))
                want[ts // 20, k] = ((0, x, x + 1) if old is None else (old + 1, old, x))[(queries.COUNTER, queries.FIRST).index(fold) if fold in (queries.COUNTER, queries.FIRST) else 2]
        assert table == want
    assert sketch.measured(df, ["k"], "ts", 20, 1000) == (20_000, 7.0)


def test_plans(spark, sf_dir):
    """No Python on the native shapes, narrow scans, one exchange for a set."""
    for name in ("exist_within_query", "count_within_add_query", "fold_counter", "fold_prev_compare", "fold_last_pane", "firewall_drop"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "value" not in plan.split("ReadSchema")[1][:200], name
        assert plan.count("Exchange hashpartitioning") == 1, name
    for name in ("fold_since_anchored", "ooo_tcp"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        # Python sees keys and times of adds only, and rows are dealt by key and pane
        assert plan.count("MapInArrow ") == 1 and "MapInArrow run(__c0" in plan and ", __c2" not in plan, name
        assert plan.count("Exchange hashpartitioning") == 2, name


@pytest.mark.parametrize("kind,window,fold", [("ExistSet", w.Within(24 * queries.HOUR, 48 * queries.HOUR), None), ("CountSet", w.Last(24 * queries.HOUR), None), ("CountSet", w.Within(24 * queries.HOUR, 48 * queries.HOUR), None), ("ExistSet", w.Since(24 * queries.HOUR), None), ("FoldSet", w.Since(60 * queries.HOUR), queries.COUNTER)])
def test_streaming_equals_batch(spark, sf_dir, tmp_path, kind, window, fold):
    from panewise.plans.program import Program

    program = Program()
    if fold:
        program.fold("s", ["user_id"], window, **fold)
    else:
        {"ExistSet": program.exist, "CountSet": program.count}[kind]("s", ["user_id"], window)
    decl: SetDecl = program.sets["s"]
    rows = queries.events(spark, sf_dir)
    op = F.when(F.col("kind") == 0, "INSERT").when(F.col("kind") == 1, "QUERY").when(F.col("kind") == 2, "INSQUERY")
    stream = rows.withColumn("op", op).where("op IS NOT NULL").withColumn("ts", F.timestamp_micros("ts"))
    part = stream.orderBy("ts", "event_id").collect()
    third = len(part) // 3 + 1
    for k in range(3):  # three micro-batches in time order
        spark.createDataFrame(part[k * third : (k + 1) * third], stream.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out_{kind}_{type(window).__name__}"
    q = streaming.stateful_set(source, decl, "r", seq="event_id").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["event_id"]: r["r"] for r in spark.table(name).collect()}
    from panewise.functions.patterns import Eq
    from panewise.plans import lower

    program.local("r", 0).route("s", ["kind"], ([Eq(0)], "add", {"user_id": "user_id"}), ([Eq(1)], "query", {"user_id": "user_id"}), ([Eq(2)], "add_query", {"user_id": "user_id"}), into="r")
    want = {r["event_id"]: r["r"] for r in lower.run(program, rows, "ts", "event_id", queries.TICK).where("kind IN (1, 2)").collect()}
    assert got == want
