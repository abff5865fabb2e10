"""Queries over events: sessions, streams, attachment."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.values import endpoint_text, fixed2, hex8, micros, rfc3339
from callscope.operators.attach import attach_asof, attach_media, endpoint_intervals, first_per_owner
from callscope.operators.nest import json_int, nest
from callscope.operators.packets import capture_counters, mirror_sessions
from callscope.operators.sequence import delta_statistics, expected_packets, stream_statistics, unwrap_sequence
from callscope.operators.sessions import sessionize, state_counts
from callscope.operators.slots import HOUR_US
from callscope.plans.reports import calls_by_state, worst_loss_first
from callscope.sinks.tables import CallsTable
from callscope.sources.storage import scratch_table
from callscope.streaming.calls import stream_sessions, use_rocksdb, write_calls

DAY_US = 24 * HOUR_US
ORDER = ["ts", "frame_no"]


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    # Times of the tables have no zone; reading them as UTC keeps them as they are.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{table}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").withColumn("frame_no", F.col("event_id"))


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a 16-bit number that has gaps, copies, reordering and a wrap."""
    n = F.floor(F.col("event_id") / F.lit(100)) + F.col("event_id") % F.lit(3)
    return events(spark, sf).withColumn("seq", ((F.lit(65500) + n) % F.lit(65536)).cast("int"))


def k() -> Column:
    return json_int("props", "k")


def signs_up() -> Column:
    return F.col("event_type") == "signup"


def fails() -> Column:
    return F.col("event_type") == "error"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessionize(events(spark, sf), ["user_id"], ORDER, signs_up(), fails(), DAY_US, slot_us=HOUR_US)


def sessionize_events(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).select(
        "user_id", "call_seq", micros("start_ts").alias("start_us"), micros("last_ts").alias("last_us"),
        micros("end_ts").alias("end_us"), "n_rows", "state",
    )


def closed_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions when the end of the input ends what is still open."""
    rows = sessionize(events(spark, sf), ["user_id"], ORDER, signs_up(), fails(), DAY_US, close_at_end=True, slot_us=HOUR_US)
    return rows.select("user_id", "call_seq", micros("end_ts").alias("end_us"), "state")


def null_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Inter-arrival over streams one of which has no name."""
    rows = events(spark, sf).withColumn("user_id", F.nullif(F.col("user_id") % F.lit(7), F.lit(0)))
    return delta_statistics(rows, ["user_id"], ORDER, slot_us=HOUR_US)


def state_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return state_counts(sessions(spark, sf))


def active_calls(spark: SparkSession, sf: str) -> DataFrame:
    return calls_by_state(sessions(spark, sf), "active", "start_ts").select("user_id", micros("start_ts").alias("start_us"), "n_rows")


def inter_arrival_query(spark: SparkSession, sf: str) -> DataFrame:
    return delta_statistics(events(spark, sf), ["user_id"], ORDER, slot_us=HOUR_US)


def sequence_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = stream_statistics(numbered(spark, sf), ["user_id"], ORDER, slot_us=HOUR_US)
    return rows.drop("first_ts")


def unwrapped(spark: SparkSession, sf: str) -> DataFrame:
    return unwrap_sequence(numbered(spark, sf), ["user_id"], ORDER, slot_us=HOUR_US).select("event_id", "ext_seq", "delta_us", "late")


def worst_loss(spark: SparkSession, sf: str) -> DataFrame:
    streams = stream_statistics(numbered(spark, sf), ["user_id"], ORDER, slot_us=HOUR_US)
    calls = nest(streams, ["user_id"], F.struct("user_id", "lost_packets", "packet_count"))
    calls = calls.select("items")
    return worst_loss_first(calls, 45, "items").select("user_id", "lost_packets", "packet_count")


def expected_packets_query(spark: SparkSession, sf: str) -> DataFrame:
    calls = sessions(spark, sf).withColumn("ptime_ms", (F.col("user_id") % F.lit(4)) * F.lit(10))
    n = expected_packets(F.col("start_ts"), F.col("last_ts"), F.col("ptime_ms"))
    return calls.select("user_id", "call_seq", "ptime_ms", n.alias("expected_packets"))


def stream_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumns({
        "src": endpoint_text(F.concat(F.lit("10.0.0."), k().cast("string")), F.lit(5000) + F.col("event_id") % F.lit(100)),
        "dst": endpoint_text(F.concat(F.lit("10.1.0."), (F.col("user_id") % F.lit(250)).cast("string")), F.lit(6000)),
    })
    at = F.struct(*ORDER)
    return rows.groupBy("user_id").agg(F.min_by("src", at).alias("src_endpoint"), F.min_by("dst", at).alias("dst_endpoint"))


def asof_attach(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("endpoint", F.col("user_id") % F.lit(16))
    probes = rows.filter(F.col("event_type").isin("click", "view")).select("endpoint", *ORDER, "event_id")
    registrations = rows.filter(signs_up()).withColumn("owner", F.col("user_id"))
    found = attach_asof(probes, registrations, ["endpoint"], ORDER, ["owner"], slot_us=HOUR_US)
    return found.filter(F.col("owner").isNotNull()).select("event_id", "endpoint", "owner")


def attach_both_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Destination before source, and owners that lose their endpoints at their next ``error`` event."""
    rows = events(spark, sf)
    endpoint = F.concat(F.lit("10.0.0."), (F.col("user_id") % F.lit(64)).cast("string"))
    owners = rows.filter(signs_up() | fails()).withColumn("owner", F.col("user_id"))
    ends = owners.filter(fails()).select("owner", *ORDER, F.struct(F.col("ts").alias("o0"), F.col("frame_no").alias("o1")).alias("ended"))
    # The end of a registration is the next failure of its owner, found by looking back along reversed time.
    def back(df: DataFrame) -> DataFrame:
        return df.withColumns({"ts": F.timestamp_micros(F.lit(4_000_000_000_000_000) - micros("ts")), "frame_no": -F.col("frame_no")})

    registrations = attach_asof(
        back(owners.filter(signs_up()).withColumns({"at_ts": F.col("ts"), "at_no": F.col("frame_no"), "ip": endpoint, "port": F.lit(9)})),
        back(ends), ["owner"], ORDER, ["ended"], slot_us=HOUR_US,
    ).select("owner", "ip", "port", "ended", F.col("at_ts").alias("ts"), F.col("at_no").alias("frame_no"))
    probes = rows.filter(F.col("event_type").isin("click", "view")).select(
        *ORDER, "event_id",
        F.concat(F.lit("10.0.0."), (F.col("event_id") % F.lit(80)).cast("string")).alias("dst_ip"), F.lit(9).alias("dst_port"),
        endpoint.alias("src_ip"), F.lit(9).alias("src_port"),
    )
    found = attach_media(probes, registrations, ORDER, ["owner"], until="ended", slot_us=HOUR_US)
    return found.select("event_id", "owner", "matched_by")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).filter(signs_up()).withColumn("endpoint", F.col("user_id") % F.lit(16))
    found = endpoint_intervals(rows, ["endpoint"], ORDER, slot_us=HOUR_US)
    return found.select("event_id", "endpoint", "user_id", micros("valid_from").alias("from_us"), micros("valid_to").alias("to_us"))


def endpoint_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("endpoint", k() % F.lit(20))
    found = first_per_owner(rows, ["user_id"], ["endpoint"], ORDER)
    return found.select("user_id", "endpoint", micros("first_ts").alias("first_us"), F.col("first_frame_no").alias("first_event"))


def media_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoints of each user in the order first seen: at most 20 of them."""
    found = endpoint_first_seen(spark, sf)
    lists = nest(found, ["user_id"], F.struct("first_event", "endpoint"))
    return lists.select("user_id", F.array_join(F.transform("items", lambda i: i["endpoint"].cast("string")), ",").alias("endpoints"))


def mirror_sessions_query(spark: SparkSession, sf: str) -> DataFrame:
    mirror = F.struct(
        F.lit(1).alias("version"), (F.col("event_id") % F.lit(3)).cast("int").alias("span_id"), k().cast("int").alias("vlan")
    )
    rows = events(spark, sf).withColumn("mirror", F.when(F.col("event_id") % F.lit(4) != 0, mirror))
    found = mirror_sessions(rows, ["user_id"], ORDER)
    return found.select("user_id", "span_id", "vlan", "version", micros("first_seen").alias("first_us"), "packet_count")


def capture_counters_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumns({"cap_len": F.least(k(), F.lit(60)), "orig_len": k()})
    found = capture_counters(rows)
    return found.select("received", "truncated", (micros("last_ts") - micros("first_ts")).alias("duration_us"))


def csv_format(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "event_id",
        rfc3339("ts").alias("start_timestamp"),
        F.concat(F.lit("0x"), hex8(F.col("event_id") * F.lit(65537))).alias("ssrc_hex"),
        fixed2("value").alias("value_text"),
    )


@contextmanager
def small_streams(spark: SparkSession) -> Iterator[None]:
    """A partition of state for each core, as each starts a Python worker in each micro-batch; the session's settings come back afterwards."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    use_rocksdb(spark)
    spark.conf.set(name, min(int(before), max(4, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def files_of_piece(n_rows: int, pieces: int, rows_of_file: int) -> int:
    """Files of one micro-batch, when each micro-batch takes one of so many pieces: as many tasks write and read it."""
    return max(1, -(-n_rows // (pieces * rows_of_file)))


def in_pieces(spark: SparkSession, sf: str, pieces: int = 4, rows_of_file: int = 250_000) -> tuple[str, int]:
    """The events as files of which each holds rows of all times, so that a stream that takes some after the others meets most rows late; and how many are a piece."""
    folder, rows = scratch_table(spark, "event-pieces"), load(spark, sf, "events")
    files = files_of_piece(rows.count(), pieces, rows_of_file)
    rows.repartition(pieces * files, F.pmod(F.xxhash64("event_id"), F.lit(64 * files))).write.parquet(folder)
    return folder, files


def stream_sessionize(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions of ``sessionize_events`` by Structured Streaming, from files in no order of time, a quarter of them per micro-batch: stateful sessions into the log of a calls table."""
    schema = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
    ])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder, files = in_pieces(spark, sf)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    messages = rows.select(
        F.lit("events").alias("instance_id"), F.col("user_id").cast("string").alias("call_id"), F.col("event_id").alias("frame_no"),
        "ts", "event_type", F.lit(None).cast("string").alias("sip_from"), F.lit(None).cast("string").alias("sip_to"),
    )
    changes = stream_sessions(messages, signs_up(), fails(), DAY_US, lateness="0 seconds")
    folder = scratch_table(spark, "stream-sessionize")
    table = CallsTable(spark, f"{folder}/sip_calls")
    with small_streams(spark):
        write_calls(changes, table, f"{folder}/progress", availableNow=True).awaitTermination()
    return table.read().select(
        F.col("call_id").cast("bigint").alias("user_id"), micros("start_timestamp").alias("start_us"),
        micros("end_timestamp").alias("end_us"), "state",
    )
