"""Packets back into capture files, one per call, or several for a very long one."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from callscope.functions.values import micros
from callscope.operators.slots import HOT_ROWS, HOUR_US, hot_keys, join_groups
from callscope.sources.pcap import MICRO_MAGIC
from callscope.sources.storage import file_system, qualified

SNAP_LENGTH = 65536


class CaptureFiles(DataSource):
    """Sink ``capture_files``: rows (file_name, us, orig_len, link_type, data), sorted by file within a partition."""

    @classmethod
    def name(cls) -> str:
        return "capture_files"

    def schema(self) -> str:
        return "file_name string, us long, orig_len int, link_type int, data binary"

    def writer(self, schema, overwrite: bool) -> "CaptureFilesWriter":
        return CaptureFilesWriter(self.options["path"])


class CaptureFilesWriter(DataSourceArrowWriter):
    """A task writes each file under a temporary name and renames it when it is whole.

    The rows of a file and their order do not depend on the attempt, so a repeated task replaces a file by the same file.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        name, out = None, None

        def finish() -> None:
            if out is not None:
                out.close()
                system.move(f"{folder}/_{attempt}-{name}", f"{folder}/{name}")

        for batch in iterator:
            names = batch.column("file_name").to_pylist()
            starts = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(names)]):
                if names[start] != name:
                    finish()
                    name = names[start]
                    out = system.open_output_stream(f"{folder}/_{attempt}-{name}")
                    out.write(struct.pack("<IHHiIII", MICRO_MAGIC, 2, 4, 0, 0, SNAP_LENGTH, batch.column("link_type")[start].as_py()))
                out.write(_records(batch.slice(start, end - start)))
        finish()
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


def _records(rows: pa.RecordBatch) -> bytes:
    """Records of some rows: their heads are packed together, then laid between the frames."""
    us, orig = rows.column("us").to_numpy(), rows.column("orig_len").to_numpy()
    frames = rows.column("data").to_pylist()
    heads = np.empty((len(frames), 4), "<u4")
    heads[:, 0], heads[:, 1], heads[:, 2], heads[:, 3] = us // 1_000_000, us % 1_000_000, [len(f) for f in frames], orig
    packed = heads.tobytes()
    return b"".join(part for i, frame in enumerate(frames) for part in (packed[16 * i : 16 * i + 16], frame))


def write_capture_files(spark: SparkSession, packets: DataFrame, path: str, file: str = "call_file", hot_rows: int | None = None, slot_us: int = HOUR_US) -> None:
    """
    One capture file per call, under the call's own name: a capture has one order, so one task writes it, and streams its sorted packets.

    A call of more than ``hot_rows`` packets is written by many tasks, as one capture for each ``slot_us`` of time: ``name~0000.pcap`` and so on, in the order of the
    numbers, each a whole capture file. Which calls these are is counted first, on the names alone.
    """
    spark.dataSource.register(CaptureFiles)
    rows = packets.withColumn("us", micros("ts")).withColumnRenamed(file, "file_name")
    hot = hot_keys(rows, ["file_name"], HOT_ROWS if hot_rows is None else hot_rows)
    if not hot.isEmpty():
        begins = rows.groupBy("file_name").agg(F.min("us").alias("__first")).join(hot.select("file_name"), "file_name", "left_semi")
        rows = join_groups(rows, begins, ["file_name"], ["__first"])
        part = F.format_string("~%04d.pcap", F.floor((F.col("us") - F.col("__first")) / slot_us))
        rows = rows.withColumn("file_name", F.when(F.col("__first").isNull(), F.col("file_name")).otherwise(F.concat(F.regexp_replace("file_name", "[.]pcap$", ""), part)))
    rows = rows.repartition("file_name").sortWithinPartitions("file_name", "us", "frame_no")
    rows.select("file_name", "us", "orig_len", "link_type", "data").write.format("capture_files").mode("append").save(qualified(spark, path))
