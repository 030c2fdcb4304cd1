"""Packets as rows: nested headers, flat dotted columns, capture files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.uint import mac_to_int
from ..plans.lower import PACKET_WIDTHS

IPV4 = 0x0800
_FIELDS = {
    "ethernet": ("dst_addr", "src_addr", "ether_type"),
    "ipv4": ("version", "ihl", "diffserv", "total_len", "identification", "flags", "frag_offset", "ttl", "protocol", "hdr_checksum", "src_addr", "dst_addr"),
    "tcp": ("src_port", "dst_port", "seq_no", "ack_no", "data_offset", "res", "flags", "window", "checksum", "urgent_ptr"),
    "udp": ("src_port", "dst_port", "hdr_length", "checksum"),
}
#: Columns of a tab-separated capture, in order (a fixed format).
CAPTURE_COLUMNS = (
    "version", "ip_hdr_len", "ip_dsfield", "tos_precedence", "tos_delay", "tos_throughput", "tos_reliability",
    "tos_cost", "ip_dsfield_dscp", "ip_dsfield_ecn", "ip_len", "ip_id", "flags_rb", "flags_sf", "flags_df", "flags_mf",
    "frag_offset", "ip_fragment", "fragment_count", "ttl", "protocol", "src_ip", "dst_ip", "ip_src_rt", "ip_opt_flag",
    "ip_opt_type", "ip_opt_type_number", "ip_opt_type_class", "src_port", "dst_port", "tcp_seq", "tcp_ack",
    "tcp_flags_res", "tcp_flags_ns", "tcp_flags_cwr", "tcp_flags_ecn", "tcp_flags_urg", "tcp_flags_ack", "tcp_hdr_len",
    "tcp_flags_push", "tcp_flags_reset", "tcp_flags_syn", "tcp_flags_fin", "tcp_window_size", "tcp_urgent_pointer",
    "tcp_option_len", "length", "tcp_len", "time_stamp", "src_mac", "dst_mac",
)
_INTEGERS = {"src_port", "dst_port", "protocol"}


def _field(path: str) -> StructField:
    return StructField(path.rsplit(".", 1)[-1], IntegerType() if PACKET_WIDTHS.get(path, 32) < 32 else LongType())


PACKET_SCHEMA = StructType([
    StructField("seq", LongType()),
    StructField("ts_ns", LongType()),
    StructField("ig_intr_md", StructType([StructField("ingress_port", IntegerType())])),
    StructField("hdr", StructType([StructField(h, StructType([_field(f"hdr.{h}.{f}") for f in fs])) for h, fs in _FIELDS.items()])),
])


def flatten(packets: DataFrame) -> DataFrame:
    """Nested packets as flat dotted columns (``hdr.ipv4.src_addr``); the time stamp also as ingress metadata."""

    def leaves(prefix: str, kind: StructType):
        for f in kind.fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, StructType):
                yield from leaves(path + ".", f.dataType)
            else:
                column = F.col(".".join(f"`{p}`" for p in path.split(".")))
                yield (column.cast("long") if isinstance(f.dataType, (IntegerType, LongType)) else column).alias(path)

    out = packets.select(*leaves("", packets.schema))
    if "ts_ns" in out.columns and "ig_intr_md.ingress_mac_tstamp" not in out.columns:
        out = out.withColumn("ig_intr_md.ingress_mac_tstamp", F.col("ts_ns"))
    return out


def nest(flat: DataFrame) -> DataFrame:
    """Flat dotted columns back to nested structs."""

    def group(names: list[tuple[list[str], str]]) -> list[Column]:
        out, done = [], set()
        for path, full in names:
            head = path[0]
            if head in done:
                continue
            done.add(head)
            same = [(p[1:], f) for p, f in names if p[0] == head]
            out.append(F.col(f"`{full}`").alias(head) if len(path) == 1 else F.struct(*group(same)).alias(head))
        return out

    return flat.select(*group([(c.split("."), c) for c in flat.columns]))


def parse_headers(packets: DataFrame) -> DataFrame:
    """Keep IPv4 packets; headers of other protocols than their own become zero."""
    kept = packets.where(F.col("`hdr.ethernet.ether_type`") == IPV4)
    for header, protocol in (("tcp", 6), ("udp", 17)):
        own = F.col("`hdr.ipv4.protocol`") == protocol
        kept = kept.withColumns({c: F.when(own, F.col(f"`{c}`")).otherwise(0) for c in kept.columns if c.startswith(f"hdr.{header}.")})
    return kept


def emit(packets: DataFrame) -> DataFrame:
    """Packets that are not dropped."""
    return packets.where(F.col("`ig_intr_dprsr_md.drop_ctl`") == 0)


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated capture without header, with a fixed schema (no pass to infer one)."""
    schema = StructType([StructField(c, IntegerType() if c in _INTEGERS else StringType()) for c in CAPTURE_COLUMNS])
    return spark.read.csv(path, schema=schema, sep="\t")


def write_capture(df: DataFrame, path: str) -> None:
    """A tab-separated capture without header; columns that the table lacks are empty."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in CAPTURE_COLUMNS)).write.mode("overwrite").csv(path, sep="\t")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Comma-separated values with a header line."""
    return spark.read.csv(path, header=True, sep=",", schema=schema)


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """Comma-separated values with a header line; ``single`` is for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def relative_time(packets: DataFrame, ts: str = "ts_ns", protocol: str = "protocol", out: str = "offset_us") -> DataFrame:
    """TCP and UDP packets with their time since the first one, in microseconds; negative offsets go."""
    kept = packets.where(F.col(protocol).isin(6, 17))
    first = kept.agg(F.min(ts).alias("__first"))
    return kept.crossJoin(F.broadcast(first)).withColumn(out, F.floor((F.col(ts) - F.col("__first")) / 1000)).where(F.col(out) >= 0).drop("__first")  # one row


def report_columns(capture: DataFrame) -> DataFrame:
    """``report`` and ``mac_ts`` from the MAC addresses, and seconds since the first as ``window``."""
    decoded = capture.withColumns({"report": mac_to_int(F.col("src_mac")), "mac_ts": mac_to_int(F.col("dst_mac"))}).drop("src_mac", "dst_mac")
    first = decoded.agg(F.min("mac_ts").alias("__first"))
    return decoded.crossJoin(F.broadcast(first)).withColumn("window", F.floor((F.col("mac_ts") - F.col("__first")) / 1_000_000_000).cast("int")).drop("__first")
