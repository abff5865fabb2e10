"""Delivered tables: call index, stream statistics, packets per call, and the calls table with its change log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from callscope.functions.values import fixed2, hex8, micros, rfc3339
from callscope.operators.nest import nest, stream_item
from callscope.operators.sessions import ACTIVE
from callscope.operators.slots import HOUR_US, MINUTE_US
from callscope.operators.upsert import INSERT, RETRACT, UPDATE, check_states, fold_changes, needed_changes, without_retracted
from callscope.schemas import CALL_CHANGES, CALL_STATISTICS_COLUMNS, DETECTED_CALLS_COLUMNS, SIP_CALLS
from callscope.sources.storage import finished, subfolders

#: Places for changes within a microsecond, and for those of one rank.
CHANGES_PER_US = 2048
SAME_MOMENT = 512
#: A Call-ID used again is a new ``call_seq``.
CALLS_KEY = ["call_id", "instance_id", "call_seq"]


def detected_calls(calls: DataFrame) -> DataFrame:
    """The call index; From and To are those of the message that opened the call."""
    return calls.select(
        "call_id",
        rfc3339("start_ts").alias("start_timestamp"),
        F.col("output_filename").alias("output_pcap_filename"),
        F.col("first_from").alias("sip_from"),
        F.col("first_to").alias("sip_to"),
        "s3_location",
    ).select(*DETECTED_CALLS_COLUMNS)


def call_statistics(streams: DataFrame) -> DataFrame:
    """The 18 text and number columns of the statistics table."""
    return streams.select(
        "call_id",
        rfc3339("start_ts").alias("start_timestamp"),
        F.col("output_filename").alias("output_pcap_filename"),
        "sip_from",
        "sip_to",
        F.concat(F.lit("0x"), hex8("ssrc")).alias("ssrc_hex"),
        F.col("src_endpoint").alias("src_rtp_endpoint"),
        F.col("dst_endpoint").alias("dst_rtp_endpoint"),
        F.col("packet_count").alias("rtp_packet_count"),
        F.col("expected_packets").alias("expected_rtp_packets"),
        "lost_packets",
        "out_of_order_count",
        "duplicate_count",
        *[fixed2(c).alias(c) for c in ("max_delta_ms", "min_delta_ms", "avg_delta_ms")],
        "ptime_ms",
        "s3_location",
    ).select(*CALL_STATISTICS_COLUMNS)


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a CSV table; every part file carries the header."""
    df.write.mode("append").option("header", True).csv(path)


def write_outputs(calls: DataFrame, streams: DataFrame, path: str, sink: str = "csv", fragments: DataFrame | None = None) -> None:
    """Calls and statistics as CSV, or as changes of the calls table only. Fragment counters always go to CSV."""
    if sink == "csv":
        append_csv(detected_calls(calls), f"{path}/detected_calls")
        append_csv(call_statistics(streams), f"{path}/call_statistics")
    elif sink == "table":
        CallsTable(calls.sparkSession, f"{path}/sip_calls").append(call_changes(calls, streams))
    else:
        raise ValueError("sink is 'csv' or 'table'")
    if fragments is not None:
        append_csv(fragments, f"{path}/fragment_counters")


def write_call_packets(packets: DataFrame, path: str, tasks_per_folder: int = 8, slot_us: int = HOUR_US) -> None:
    """Packets of all calls as Parquet, below 256 folders by the start of the file name.

    A folder per call would leave millions of tiny files. Rows are dealt by folder and by a hash of call and time slot, so a large call is spread over several tasks and files and
    nothing has to be sampled first; the sort lets a reader of one call skip the row groups of all others. ``path`` may be an object store.
    """
    rows = packets.withColumn("call_prefix", F.substring("call_file", 1, 2))
    share = F.pmod(F.xxhash64("call_file", F.floor(micros("ts") / slot_us)), F.lit(tasks_per_folder))
    rows = rows.repartition("call_prefix", share).sortWithinPartitions("call_prefix", "call_file", "ts", "frame_no")
    rows.write.mode("append").partitionBy("call_prefix").parquet(path)


def nested_statistics(streams: DataFrame, keys: list[str]) -> DataFrame:
    """``rtp_statistics``, one row per call."""
    return nest(streams, keys, stream_item()).withColumnRenamed("items", "rtp_statistics")


def call_changes(calls: DataFrame, streams: DataFrame) -> DataFrame:
    """Each call as an insert at its start and an update at its newest state, in event-time order."""
    keys = ["instance_id", "call_id", "call_seq"]
    rows = calls.join(nested_statistics(streams, keys), keys, "left")
    statistics = SIP_CALLS["rtp_statistics"].dataType
    start, end = F.unix_micros("start_ts"), F.unix_micros(F.coalesce("end_ts", "last_ts"))
    shared = [
        *CALLS_KEY,
        F.col("start_ts").alias("start_timestamp"),
        F.col("output_filename").alias("pcap_filename"),
        "s3_location",
        F.col("start_ts").alias("created_at"),
    ]
    inserts = rows.select(
        *shared,
        F.col("first_from").alias("sip_from"),
        F.col("first_to").alias("sip_to"),
        F.lit(ACTIVE).alias("state"),
        F.lit(None).cast("timestamp").alias("end_timestamp"),
        F.lit(None).cast(statistics).alias("rtp_statistics"),
        F.col("start_ts").alias("updated_at"),
        F.lit(INSERT).alias("kind"),
        change_number(start, F.lit(INSERT), F.lit(ACTIVE)).alias("change_no"),
    )
    updates = rows.select(
        *shared,
        "sip_from",
        "sip_to",
        "state",
        F.col("end_ts").alias("end_timestamp"),
        F.col("rtp_statistics").cast(statistics).alias("rtp_statistics"),
        F.coalesce("end_ts", "last_ts").alias("updated_at"),
        F.lit(UPDATE).alias("kind"),
        change_number(end, F.lit(UPDATE), F.col("state")).alias("change_no"),
    )
    return inserts.unionByName(updates)


def change_number(at_us: Column, kind: Column, state: Column, nth: Column | None = None) -> Column:
    """Order of a change; at one moment an insert goes first and the end of a call last, and of several updates the ``nth`` of their writer."""
    rank = F.when(kind == INSERT, 0).when(state == ACTIVE, 1).otherwise(2)
    return at_us * F.lit(CHANGES_PER_US) + rank * F.lit(SAME_MOMENT) + F.least(F.lit(0) if nth is None else nth, F.lit(SAME_MOMENT - 1))


class CallsTable:
    """The calls table as a base and a log of change batches, merged when read.

    A batch is a folder named by who wrote it and its number with that writer, so writers never meet, and a batch written again replaces itself.
    ``compact`` folds the log into a new base, which lists the batches it holds: what a reader still has to merge is every finished batch that isn't
    listed, whenever it arrives. A base holds the rows, and beside them the changes they came from (``needed_changes``): a call that the log names is
    folded anew from all its changes in their order, so neither the order of batches nor the moments of compaction alter an answer, and an update
    may come long before the insert it waits for. All other calls pass through.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, changes: DataFrame, batch: int = 0, writer: str | None = None) -> None:
        """Add a batch. A writer that may have to repeat its batches names itself; without a name, each call is a writer of its own."""
        folder = f"{self.path}/changes/writer={writer or uuid.uuid4().hex}/batch={batch:012d}"
        if "revision" not in changes.columns:
            changes = changes.withColumn("revision", F.lit(0).cast("bigint"))
        checked = check_states(changes).select(*[F.col(f.name).cast(f.dataType) for f in CALL_CHANGES.fields])
        checked.write.mode("overwrite").parquet(folder)

    def read(self) -> DataFrame:
        base = self._base()
        waiting, rows = self._waiting(base), self._stored(base, "rows", _nullable(SIP_CALLS))
        if not waiting:
            return rows
        keys, _, touched, retracted = self._touched(base, waiting)
        return self._others(rows, keys).unionByName(self._rows(touched, retracted))

    def compact(self) -> None:
        """Write a new base from the base and the batches that wait.

        Changes of calls that the batches name, and all others, lie apart: the first are worked out once, and folded as they were written.
        """
        base = self._base()
        waiting = self._waiting(base)
        if not waiting:
            return
        version = int(base.split("=")[1].split("-")[0]) + 1 if base else 0
        folder = f"{self.path}/base/version={version:012d}-{uuid.uuid4().hex}"
        keys, kept, touched, retracted = self._touched(base, waiting)
        for part, history in ((0, kept), (1, touched)):
            history.repartitionByRange(*CALLS_KEY).sortWithinPartitions(*CALLS_KEY, "change_no").write.parquet(f"{folder}/history/part={part}")
        written = self.spark.read.schema(CALL_CHANGES).parquet(f"{folder}/history/part=1")
        rows = self._others(self._stored(base, "rows", _nullable(SIP_CALLS)), keys).unionByName(self._rows(written, retracted))
        # A fold keeps one row per key; files sorted by start and state let readers of a time span or state skip most of them.
        rows = rows.withColumn("start_date", F.to_date("start_timestamp"))
        rows = rows.repartitionByRange("start_date", "start_timestamp").sortWithinPartitions("start_date", "state", "instance_id")
        rows.write.partitionBy("start_date").parquet(f"{folder}/rows")
        # Written last: a base counts once its list is there. Runs of a writer's numbers make it as short as there are writers.
        held = self.spark.createDataFrame(_runs({*self._folded(base), *waiting}), HELD)
        held.coalesce(1).write.parquet(f"{folder}/holds")

    def publish(self, name: str) -> None:
        """Let the catalog show the table under a name, as of now. Readers find the former state until the new one is there."""
        self.compact()
        base = self._base()
        own = f"{name}__{uuid.uuid4().hex}"
        create_calls_table(self.spark, own, f"{self.path}/base/{base}/rows" if base else None)
        if base:
            self.spark.sql(f"MSCK REPAIR TABLE {own}")
        self.spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {own}")

    def _base(self) -> str | None:
        """Folder name of the newest whole base."""
        whole = [n for n in subfolders(self.spark, f"{self.path}/base") if finished(self.spark, f"{self.path}/base/{n}/holds")]
        return max(whole, default=None)

    def _folded(self, base: str | None) -> set[str]:
        if not base:
            return set()
        runs = self.spark.read.schema(HELD).parquet(f"{self.path}/base/{base}/holds").collect()
        return {f"{r['writer']}/batch={n:012d}" for r in runs for n in range(r["first"], r["last"] + 1)}

    def _waiting(self, base: str | None) -> list[str]:
        """Finished batches that the base doesn't hold."""
        folded, found = self._folded(base), []
        for writer in subfolders(self.spark, f"{self.path}/changes"):
            for batch in subfolders(self.spark, f"{self.path}/changes/{writer}"):
                name = f"{writer}/{batch}"
                if name not in folded and finished(self.spark, f"{self.path}/changes/{name}"):
                    found.append(name)
        return found

    def _stored(self, base: str | None, part: str, schema: StructType) -> DataFrame:
        """Rows or history of a base; without one, or where it has none, an empty table."""
        if not base:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/base/{base}/{part}").select(*schema.fieldNames())

    def _touched(self, base: str | None, waiting: list[str]) -> tuple[DataFrame | None, DataFrame, DataFrame, bool]:
        """The keys that batches name (none: all there are), the base's changes of other calls, the changes that the named calls hang on, and whether some are retracted."""
        history = self._stored(base, "history", CALL_CHANGES)
        changes = self.spark.read.schema(CALL_CHANGES).parquet(*[f"{self.path}/changes/{name}" for name in waiting])
        keys, kept, touched = None, history, changes
        if base:
            keys = changes.select(*CALLS_KEY).distinct()
            kept, touched = self._others(history, keys), history.join(keys, CALLS_KEY, "left_semi").unionByName(changes)
        # Looks at files only: most often nothing is retracted, or has no statistics, and then all changes are needed as they are.
        both = (history, changes) if base else (changes,)
        retracted = any(not x.filter(F.col("kind") == RETRACT).isEmpty() for x in both)
        heavy = [c for c in ["rtp_statistics"] if any(not x.filter(F.col(c).isNotNull()).isEmpty() for x in both)]
        if retracted or heavy:
            touched = needed_changes(touched, CALLS_KEY, "change_no", heavy=heavy)
        return keys, kept, touched, retracted

    @staticmethod
    def _others(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
        return rows.join(keys, CALLS_KEY, "left_anti") if keys is not None else rows

    def _rows(self, changes: DataFrame, retracted: bool) -> DataFrame:
        """The calls that changes make."""
        folded = fold_changes(
            self.spark.createDataFrame([], SIP_CALLS), without_retracted(changes, CALLS_KEY) if retracted else changes, CALLS_KEY, "change_no",
            longest=["sip_from", "sip_to"],
            non_empty=["s3_location"],
            newest=["end_timestamp", "rtp_statistics", "updated_at"],
            fixed=["start_timestamp", "pcap_filename", "created_at"],
            slot_width=CHANGES_PER_US * MINUTE_US,
        )
        return folded.select(*SIP_CALLS.fieldNames())


HELD = "writer string, first bigint, last bigint"


def _nullable(schema: StructType) -> StructType:
    """What a file gives back: a column that must not be null is checked when it is written."""
    return StructType([StructField(f.name, f.dataType) for f in schema.fields])


def _runs(names: set[str]) -> list[tuple[str, int, int]]:
    """Batches ``writer=.../batch=...`` as runs of numbers (writer, first, last)."""
    runs: list[tuple[str, int, int]] = []
    for writer, n in sorted((w, int(b.split("=")[1])) for w, b in (name.split("/") for name in names)):
        if runs and runs[-1][0] == writer and runs[-1][2] == n - 1:
            runs[-1] = (writer, runs[-1][1], n)
        else:
            runs.append((writer, n, n))
    return runs


def create_calls_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Declare the calls table in the catalog, in the layout of a compacted base: partitioned by start date."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SIP_CALLS.fields)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, start_date DATE) USING parquet PARTITIONED BY (start_date){place}")
