"""Ground truth of a filter, and how far its reports agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uint import in_prefixes, ipv4_to_int
from ..plans.windows import Within
from . import sets


def classify(packets: DataFrame, prefixes: list[str], src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """from_internal, internal_ip and external_ip by the prefixes of the inner side."""
    inner = in_prefixes(ipv4_to_int(F.col(src)), prefixes)
    return packets.withColumns({
        "from_internal": inner,
        "internal_ip": F.when(inner, F.col(src)).otherwise(F.col(dst)),
        "external_ip": F.when(inner, F.col(dst)).otherwise(F.col(src)),
    })


def ground_truth(events: DataFrame, insert: Column, keys: list[str], ts: str, seq: str, span: int, out: str = "ground_truth") -> DataFrame:
    """1 for a query without an insert of an equal key in [ts - span, ts), 0 for one with; inserts get 0.

    Equal times do not count, whatever their tie-break. One window over the
    whole history of a key's pane and the one before it takes the place of a
    join for each second.
    """
    from pyspark.sql import Window

    rows = events.withColumn(sets.OP, F.when(insert, sets.INSERT).otherwise(sets.QUERY))
    rows = sets.paned(rows, ts, seq, F.floor(F.col(ts) / span), ghosts=True)
    frame = Window.partitionBy(*sets.parts(keys)).orderBy(ts).rangeBetween(-span, -1)
    hit = F.coalesce(F.max(sets.adds().cast("int")).over(frame), F.lit(0))
    made = rows.withColumn("__truth", F.when(F.col(sets.OP) == sets.QUERY, 1 - hit).otherwise(0)).where(~F.col(sets.GHOST))
    return made.select(*(F.col(f"`{c}`") for c in events.columns), F.col("__truth").alias(out))


def anti_join_shifted(queries: DataFrame, inserts: DataFrame, keys: list[str], bin_col: str, first: int, last: int) -> DataFrame:
    """Queries without an insert of an equal key ``first`` .. ``last`` bins before, by one window over both.

    Rows meet by keys and a pane of ``last`` bins; each distinct insert also goes to the next pane. A null key equals none.
    """
    from pyspark.sql import Window

    pane = F.floor(F.col(bin_col) / last)
    added = inserts.select(*keys, bin_col).distinct().withColumn("__pane", F.explode(F.array(pane, pane + 1))).withColumn("__add", F.lit(1))
    asked = queries.withColumns({"__pane": pane, "__add": F.lit(0)})
    frame = Window.partitionBy(*keys, "__pane").orderBy(bin_col).rangeBetween(-last, -first)
    both = asked.unionByName(added, allowMissingColumns=True).withColumn("__hit", F.coalesce(F.max("__add").over(frame), F.lit(0)))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return both.where((F.col("__add") == 0) & ((F.col("__hit") == 0) | ~whole)).select(*queries.columns)


def left_join_fill(left: DataFrame, right: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    return left.join(right, on, "left").fillna(fill)


def insert_groups(inserts: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """First and last insert of each key and window."""
    return inserts.groupBy("window", *keys).agg(F.min(ts).alias("min_insert_ts"), F.max(ts).alias("max_insert_ts"))


def confusion(labelled: DataFrame, by: str = "window", report: str = "report", truth: str = "ground_truth") -> DataFrame:
    """Counts by window; an allowed packet (report 0) is a positive, a packet with truth 1 a negative."""
    r, t = F.col(report), F.col(truth)
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return labelled.groupBy(by).agg(
        n((r == 0) & (t == 1)).alias("num_falsepos"),
        n((r == 1) & (t == 0)).alias("num_falseneg"),
        n((r == 0) & (t == 0)).alias("num_truepos"),
        n((r == 1) & (t == 1)).alias("num_trueneg"),
        n(t == 1).alias("num_negatives"),
        F.count("*").alias("num_packets"),
    ).withColumn("FPR", F.try_divide("num_falsepos", "num_negatives"))


def global_rate(stats: DataFrame, digits: int = 10) -> DataFrame:
    """False positives over negatives in all windows together."""
    return stats.agg(F.round(F.try_divide(F.sum("num_falsepos"), F.sum("num_negatives")), digits).alias("FPR"))


def smoothed(stats: DataFrame, width: int, by: str = "window") -> DataFrame:
    """Means over coarser windows."""
    return stats.groupBy((F.floor(F.col(by) / width) * width).alias(by)).agg(F.avg("FPR").alias("FPR"), F.sum("num_packets").alias("num_packets"))


def distinct_pairs(inserts: DataFrame, a: str, b: str, by: str = "window") -> DataFrame:
    return inserts.groupBy(by).agg(F.count_distinct(a, b).alias("num_insertions"))
