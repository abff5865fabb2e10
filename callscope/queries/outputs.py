"""Queries over what an analysis delivers: CSV tables, packets per call, statistics in the calls table, counters, and captures as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.privacy import PrivacyRules
from callscope.functions.values import micros
from callscope.operators.nest import unnest
from callscope.operators.packets import decode_ip
from callscope.operators.fragments import reassemble
from callscope.options import Options
from callscope.plans.calls import CallAnalysis, analyse_calls, call_packets, decode_datagrams
from callscope.queries import frames as f
from callscope.queries.events import DAY_US
from callscope.queries.tables import call_frames, document_fragments
from callscope.schemas import CALL_STATISTICS_COLUMNS, DETECTED_CALLS_COLUMNS
from callscope.sinks.pcap import write_capture_files
from callscope.sinks.tables import CallsTable, write_call_packets, write_outputs
from callscope.sources.pcap import load_packets
from callscope.sources.storage import scratch_table


def _options(**more) -> Options:
    return Options("5060-5060", call_timeout_us=DAY_US, close_at_end=False, **more)


def _analysis(spark: SparkSession, sf: str, **more) -> CallAnalysis:
    return analyse_calls(call_frames(spark, sf).drop("user_id", "event_id"), _options(**more))


def _csv_tables(spark: SparkSession, sf: str) -> str:
    """The CSV tables of an analysis, written in two steps: what is there stays, and each file has its header."""
    found, folder = _analysis(spark, sf), scratch_table(spark, "outputs")
    even = F.crc32("call_id") % 2 == 0
    for part in (even, ~even):
        write_outputs(found.calls.filter(part), found.streams.filter(part), folder, sink="csv")
    return folder


def call_index(spark: SparkSession, sf: str) -> DataFrame:
    """The CSV index of detected calls, read back."""
    rows = spark.read.option("header", True).csv(f"{_csv_tables(spark, sf)}/detected_calls")
    return rows.select(*DETECTED_CALLS_COLUMNS).fillna("")


def call_statistics_table(spark: SparkSession, sf: str) -> DataFrame:
    """The 18 columns of the CSV statistics, read back as text."""
    rows = spark.read.option("header", True).csv(f"{_csv_tables(spark, sf)}/call_statistics")
    return rows.select(*CALL_STATISTICS_COLUMNS).fillna("")


def call_packet_table(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of all calls as Parquet, without media of calls that the privacy rules name."""
    options = _options(privacy=PrivacyRules(for_call_id="[05]$"))
    found = analyse_calls(call_frames(spark, sf).drop("user_id", "event_id"), options)
    folder = scratch_table(spark, "call-packets")
    write_call_packets(call_packets(found, options), folder)
    rows = spark.read.parquet(folder)
    # The names of a call used again go on with its number, which is left out here.
    by_file = rows.groupBy("call_file").agg(
        F.count(F.lit(1)).alias("packets"), F.count(F.col("method")).alias("messages"), F.min(micros("ts")).alias("first_us"), F.max(micros("ts")).alias("last_us"),
    )
    return by_file.withColumn("call_file", F.regexp_extract("call_file", "^[0-9a-f]+", 0))


def table_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics as the calls table holds them, one row for each stream of a call."""
    found, folder = _analysis(spark, sf), scratch_table(spark, "outputs")
    write_outputs(found.calls, found.streams, folder, sink="table")
    rows = unnest(CallsTable(spark, f"{folder}/sip_calls").read(), "rtp_statistics")
    return rows.select(
        "call_id", micros("start_timestamp").alias("start_us"), "state", "ssrc", "packet_count", "expected_packets", "lost_packets", "out_of_order_count", "duplicate_count", F.col("ptime_ms").alias("ptime")
    )


def filtered_source(spark: SparkSession, sf: str) -> DataFrame:
    """Datagrams that a source filter lets through."""
    options = _options(source_filter="proto = 'udp' AND dst_port = 4000 AND cap_len < 60")
    rows = decode_datagrams(call_frames(spark, sf).drop("user_id", "event_id"), options)
    return rows.groupBy(F.col("ssrc").alias("user_id")).agg(F.count(F.lit(1)).alias("packets"), F.min("seq").alias("least_seq"), F.max("seq").alias("largest_seq"))


def arriving_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Capture files of a folder as a stream, some files at a time: frames per file."""
    rows = call_frames(spark, sf).withColumn("call_file", F.concat(F.lit("group-"), (F.col("user_id") % 8).cast("string"), F.lit(".pcap")))
    folder, out = scratch_table(spark, "arriving"), scratch_table(spark, "arrived")
    write_capture_files(spark, rows, folder)
    frames = load_packets(spark, stream=folder, files_per_batch=3, instance_id="stream")
    frames = frames.select("instance_id", "capture_file", "frame_no", "ts", "cap_len")
    frames.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    group = F.regexp_extract("capture_file", r"group-([0-9]+)[.]", 1).cast("bigint")
    return spark.read.parquet(out).groupBy("instance_id", group.alias("group")).agg(
        F.count(F.lit(1)).alias("frames"), F.count_distinct("frame_no").alias("numbers"), F.min(micros("ts")).alias("first_us"), F.sum("cap_len").alias("bytes")
    )


def fragment_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of ``document_fragments`` as frames, the first 8 bytes of a text standing in for a UDP header; of documents that an IP packet can hold."""
    rows = document_fragments(spark, sf).filter(F.col("size") <= 65000)
    flags = F.when(F.col("more_fragments"), 0x2000).otherwise(0) + F.floor(F.col("fragment_offset") / 8)
    packet = f.ipv4(F.lit(0x0A000001) + F.floor(F.col("doc_id") / 65536), F.lit(0x0A000002), 17, F.col("ip_payload"), F.col("doc_id") % 65536, flags)
    rows = rows.withColumn("data", f.ethernet(packet))
    return rows.select(
        F.lit("documents").alias("instance_id"), F.lit("documents").alias("capture_file"), "frame_no", "ts", F.octet_length("data").alias("cap_len"),
        F.octet_length("data").alias("orig_len"), F.lit(1).alias("link_type"), "data",
    )


def rebuilt_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Whole packets in place of fragments: their frames, with the length set and the fragment flags cleared, decoded again."""
    rows = reassemble(decode_ip(fragment_frames(spark, sf)), scope=["instance_id"])
    again = decode_ip(rows.select("instance_id", "capture_file", "frame_no", "ts", "cap_len", "orig_len", "link_type", "data"))
    return again.filter(~F.col("more_fragments") & (F.col("fragment_offset") == 0)).select(
        F.col("ip_id").cast("bigint").alias("ip_id"), "src_ip", F.col("cap_len").cast("bigint").alias("cap_len"), F.md5("ip_payload").alias("digest"),
        F.conv(F.hex(F.substring("data", 17, 2)), 16, 10).cast("bigint").alias("total_length"),
    )


def analysis_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Capture and fragment counters out of an analysis, and the labelled row of the latter in the CSV outputs."""
    found = analyse_calls(fragment_frames(spark, sf), _options(reassemble=True), capture_end_us=F.lit(1_700_000_000_000_000 + 10**15))
    folder = scratch_table(spark, "outputs")
    write_outputs(found.calls, found.streams, folder, fragments=found.fragments)
    summary = spark.read.option("header", True).schema("total bigint, reassembled bigint, timeout bigint, active bigint, dropped bigint").csv(f"{folder}/fragment_counters")
    counts = found.counters.select("received", "truncated").unpivot([], ["received", "truncated"], "counter", "value")
    return counts.unionByName(summary.unpivot([], summary.columns, "counter", "value"))


def mirrored_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Mirror sessions of calls, media included: frames inside mirror packets whose span and VLAN hang on the user."""
    user = F.col("user_id")
    rows = call_frames(spark, sf)
    span, vlan = user % 8, user % 64
    head = f.join(f.octets("100088BE"), f.be(F.col("event_id"), 4), f.be(F.lit(0x1000) + vlan, 2), f.be(span, 2), f.octets("00000001"))
    data = f.ethernet(f.ipv4(F.lit(0x09000001), F.lit(0x09000002), 47, f.join(head, F.col("data"))))
    rows = rows.withColumn("data", data).withColumns({"cap_len": F.octet_length("data"), "orig_len": F.octet_length("data")}).drop("user_id", "event_id", "instance_id")
    found = analyse_calls(rows, _options(mirror_enabled=True, mirror_media=True, instance_id="mirror-1", mirror_span_ids="1,2,0x3"))
    return found.mirror_sessions.select("instance_id", "call_id", "span_id", "vlan", "version", micros("first_seen").alias("first_us"), "packet_count")
