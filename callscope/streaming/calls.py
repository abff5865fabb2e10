"""Calls from a stream of messages: stateful sessions per call in any order of arrival, written to the calls table batch by batch."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from callscope.functions.values import micros
from callscope.functions.naming import output_filename
from callscope.operators.sequence import with_endpoints
from callscope.operators.sessions import ACTIVE
from callscope.schemas import SIP_CALLS
from callscope.sinks.tables import CallsTable, change_number
from callscope.sources.storage import kept_name
from callscope.streaming.shares import Dealt, ShareProcessor, deal, in_shares, names
from callscope.streaming.timeline import Timeline

#: The changes of one call, and those of all.
CHANGED = (
    "call_seq long, kind string, start_us long, last_us long, at_us long, state string, "
    "sip_from string, sip_to string, n_rows long, revision long, rtp_statistics string, nth long"
)
CHANGES = f"instance_id string, call_id string, {CHANGED}"
#: Rows that came too late for what the state still holds: their values, as they arrived.
LATE = "late"
CALL = ["instance_id", "call_id"]

_INPUT = ("us", "frame_no", "opens", "closes", "sip_from", "sip_to", "ptime", "registered_us", "registered_no", "seq", "ssrc", "src_endpoint", "dst_endpoint")


class CallSessions(ShareProcessor):
    """Keeps the timelines of calls and hands on what a micro-batch, or a timer, changes in the calls of each."""

    columns, found = _INPUT, names(CHANGED)

    def __init__(self, timeout_us: int, keep_us: int | None, always: bool):
        self.timeout_us, self.keep_us, self.always = timeout_us, keep_us, always

    def take(self, key: str, held: bytes | None, rows: list[tuple], watermark_ms: int) -> tuple[bytes | None, int | None, list[tuple]]:
        timeline, out = Timeline.of(held), []
        if timeline.aside and (self.keep_us is not None or any(row[0] <= timeline.floor[0] or (row[7] is not None and row[7] <= timeline.floor[0]) for row in rows)):
            timeline.recall()
        oldest = watermark_ms * 1000 - self.keep_us if self.keep_us is not None and watermark_ms > 0 else None
        packets = []
        for us, frame_no, opening, closing, sip_from, sip_to, ptime, *of_packet in rows:
            if oldest is not None and us < oldest:
                kind = "close" if closing else "open" if opening else None
                out.append((frame_no, LATE, us, us, us, kind, sip_from, sip_to, 1, timeline.revision, None, 0))
            elif of_packet[0] is not None:
                packets.append((us, frame_no, *of_packet))
            else:
                timeline.add_message(us, frame_no, bool(opening), bool(closing), sip_from, sip_to, ptime)
        for us, frame_no, by_us, by_no, seq, ssrc, source, destination in sorted(packets, key=lambda p: p[:2]):
            timeline.add_media(us, frame_no, (by_us, by_no), self.timeout_us)
            if seq is not None:
                timeline.add_packet(ssrc, seq, us, frame_no, (by_us, by_no), source, destination, self.timeout_us)
        # Derive the calls, forget what is over.
        now = watermark_ms * 1000 if watermark_ms > 0 else None
        out += timeline.advance(self.timeout_us, now, self.always)
        if now is not None and self.keep_us is not None:
            timeline.forget(now - self.keep_us - max(self.timeout_us, 0))
        elif now is not None:
            # Media packets up to the watermark have come.
            timeline.put_aside(now)
        due = timeline.due(self.timeout_us, self.keep_us)
        # Silence must be longer than the timeout, and timers count whole milliseconds.
        return None if timeline.empty else timeline.text(), None if due is None else due // 1000 + 1, out


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB from now on: stateful processors with timers need it, and it spills to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_sessions(
    messages: DataFrame, opens: Column, closes: Column, timeout_us: int, lateness: str = "10 seconds", ts: str = "ts",
    media: DataFrame | None = None, keep_us: int | None = None, always: bool = False,
) -> DataFrame:
    """Changes of calls (``CHANGES``) from a stream with instance_id, call_id, frame_no, sip_from and sip_to.

    Rows may arrive in any order: a late one changes the timeline of its call, and calls that are others now are retracted and handed on anew.
    ``lateness`` only says how far behind the newest row silence is judged. ``media`` are packets attached to calls (``PACKETS`` of ``stream_media``),
    which keep a call alive; of them the state holds stretches and one summary for each SSRC, and a call that ends, or with ``always`` each call in each micro-batch, carries the statistics of its streams. What ended longer than ``keep_us`` ago (default: never) is left out of the
    state, and rows older than that are handed on as LATE. A call's number ``call_seq`` is its start, so that no call changes the name of another.

    Needs the RocksDB state store. A silence ends a call once the watermark has passed it.
    """
    return sessions_of([deal_messages(messages, opens, closes, lateness, ts), *([deal_media(media)] if media is not None else [])], timeout_us, keep_us, always)


def deal_messages(messages: DataFrame, opens: Column, closes: Column, lateness: str, ts: str = "ts") -> Dealt:
    """Messages by their calls, with all that is asked of them."""
    rows = messages.withColumn("event_ts", F.col(ts).cast("timestamp")).withWatermark("event_ts", lateness).select(
        "instance_id", "call_id", micros("event_ts").alias("us"), F.col("frame_no").cast("bigint").alias("frame_no"),
        F.coalesce(opens, F.lit(False)).alias("opens"), F.coalesce(closes, F.lit(False)).alias("closes"), "sip_from", "sip_to",
        (F.col("ptime") if "ptime" in messages.columns else F.lit(None)).cast("int").alias("ptime"),
        *([F.to_json(F.transform("endpoints", lambda e: F.array(e["ip"], e["port"].cast("string")))).alias("endpoints")] if "endpoints" in messages.columns else []),
    )
    # The event time itself stays behind here: Spark would drop rows older than the watermark.
    return deal(rows, CALL, rows.columns[2:])


def deal_media(media: DataFrame) -> Dealt:
    """Packets by the calls that they are attached to."""
    return deal(with_endpoints(media), CALL, ["us", "frame_no", "registered_us", "registered_no", "seq", "ssrc", "src_endpoint", "dst_endpoint"])


def sessions_of(dealt: list[Dealt], timeout_us: int, keep_us: int | None, always: bool) -> DataFrame:
    return in_shares(dealt, CallSessions(timeout_us, keep_us, always), CHANGED)


def table_changes(changes: DataFrame) -> DataFrame:
    """Session changes as changes of the calls table."""
    at, kind = F.timestamp_micros("at_us"), SIP_CALLS["rtp_statistics"].dataType
    statistics = F.from_json("rtp_statistics", kind) if "rtp_statistics" in changes.columns else F.lit(None).cast(kind)
    return changes.select(
        "call_id",
        "instance_id",
        "call_seq",
        F.timestamp_micros("start_us").alias("start_timestamp"),
        F.when(F.col("state") != ACTIVE, at).alias("end_timestamp"),
        output_filename(F.col("call_id")).alias("pcap_filename"),
        "sip_from",
        "sip_to",
        F.lit("").alias("s3_location"),
        "state",
        statistics.alias("rtp_statistics"),
        F.timestamp_micros("start_us").alias("created_at"),
        at.alias("updated_at"),
        "kind",
        change_number(F.col("at_us"), F.col("kind"), F.col("state"), F.col("nth") if "nth" in changes.columns else F.lit(0)).alias("change_no"),
        F.col("revision") if "revision" in changes.columns else F.lit(0).cast("bigint").alias("revision"),
    )


def write_calls(changes: DataFrame, table: CallsTable, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Append each micro-batch to the log of the calls table.

    The stream's name as a writer lies beside its checkpoint: a repeated micro-batch replaces its own folder, and streams with other checkpoints never touch it.
    Rows that came too late lie beside the table, below ``late``.
    """
    writer = kept_name(table.spark, f"{checkpoint.rstrip('/')}-writer")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        table.append(table_changes(batch.filter(F.col("kind") != LATE)), number, writer)
        late = batch.filter(F.col("kind") == LATE)
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{table.path}/late/writer={writer}/batch={number:012d}")
        batch.unpersist()

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


class CounterListener(StreamingQueryListener):
    """Hands the counters of each micro-batch to a function: ``report(name, {"received": ..., "truncated": ...})``."""

    def __init__(self, report):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.report(name, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
