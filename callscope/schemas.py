"""Schemas of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

PACKETS = T.StructType([
    T.StructField("capture_file", T.StringType()),
    T.StructField("frame_no", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("cap_len", T.IntegerType()),
    T.StructField("orig_len", T.IntegerType()),
    T.StructField("link_type", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])

MIRROR = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("span_id", T.IntegerType()),
    T.StructField("vlan", T.IntegerType()),
    T.StructField("direction", T.IntegerType()),
    T.StructField("ts32", T.LongType()),
])

# The fields of the delivered stream record.
STREAM_STATISTICS = T.ArrayType(T.StructType([
    T.StructField("ssrc", T.StringType()),
    T.StructField("src_endpoint", T.StringType()),
    T.StructField("dst_endpoint", T.StringType()),
    T.StructField("packet_count", T.LongType()),
    T.StructField("expected_packets", T.LongType()),
    T.StructField("lost_packets", T.LongType()),
    T.StructField("out_of_order_count", T.LongType()),
    T.StructField("duplicate_count", T.LongType()),
    T.StructField("max_delta_ms", T.DoubleType()),
    T.StructField("min_delta_ms", T.DoubleType()),
    T.StructField("avg_delta_ms", T.DoubleType()),
    T.StructField("ptime_ms", T.IntegerType()),
]))

# The columns of the delivered calls table; ``call_seq`` is our own.
SIP_CALLS = T.StructType([
    T.StructField("call_id", T.StringType(), False),
    T.StructField("instance_id", T.StringType(), False),
    T.StructField("call_seq", T.LongType(), False),
    T.StructField("start_timestamp", T.TimestampType(), False),
    T.StructField("end_timestamp", T.TimestampType()),
    T.StructField("pcap_filename", T.StringType()),
    T.StructField("sip_from", T.StringType()),
    T.StructField("sip_to", T.StringType()),
    T.StructField("s3_location", T.StringType()),
    T.StructField("state", T.StringType(), False),
    T.StructField("rtp_statistics", STREAM_STATISTICS),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

# A change of the calls table: values, what it does, its place among the changes of its call, and which retractions take it back.
CALL_CHANGES = T.StructType(
    [T.StructField(f.name, f.dataType) for f in SIP_CALLS.fields]
    + [T.StructField("kind", T.StringType()), T.StructField("change_no", T.LongType()), T.StructField("revision", T.LongType())]
)

# Column order of the delivered CSV tables.
DETECTED_CALLS_COLUMNS = ["call_id", "start_timestamp", "output_pcap_filename", "sip_from", "sip_to", "s3_location"]
CALL_STATISTICS_COLUMNS = [
    "call_id", "start_timestamp", "output_pcap_filename", "sip_from", "sip_to", "ssrc_hex", "src_rtp_endpoint",
    "dst_rtp_endpoint", "rtp_packet_count", "expected_rtp_packets", "lost_packets", "out_of_order_count",
    "duplicate_count", "max_delta_ms", "min_delta_ms", "avg_delta_ms", "ptime_ms", "s3_location",
]
