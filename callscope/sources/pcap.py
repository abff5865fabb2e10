"""Capture files as a packets table, in batch and as a stream of arriving files.

Files are listed by Spark and cut at plain byte offsets. A task finds the first record of its piece by a chain of plausible record headers, and hops
over the headers of its piece; where each piece begins must be where the one before it ended, and the numbers of records give each
its first frame number. Then the pieces are decoded. So one big file is read by many tasks from the start, and no file is ever held whole. A file whose
pieces don't fit together is cut by hopping over all its headers in one task, and so are files of a stream.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.schemas import PACKETS
from callscope.sources.storage import file_system

# Magic numbers of the classic capture format, and its header sizes.
MICRO_MAGIC, NANO_MAGIC = 0xA1B2C3D4, 0xA1B23C4D
FILE_HEADER, RECORD_HEADER = 24, 16

SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: A record header found from an arbitrary byte counts if so many follow each other, none of a longer record or of a time further from the first record's.
CHAIN = 16
LONGEST_RECORD = 1 << 18
FURTHEST_SECONDS = 366 * 86400

PIECES = "capture_file string, size long, at long, until long, start long, stop long, n long"
RANGES = "capture_file string, start long, stop long, first_frame long, little boolean, nano boolean, link_type int"
REST = "capture_file string, at long, bytes long"
LISTING = "path string, modificationTime timestamp, length long, content binary"


def read_pcap(
    spark: SparkSession, path: str | list[str], instance_id: str = "default", split_bytes: int = SPLIT_BYTES, tasks: int | None = None
) -> DataFrame:
    """Frames of all capture files under a path or glob."""
    return _decode(spark, spark.read.format("binaryFile").load(path), instance_id, split_bytes, tasks)


def stream_pcap(
    spark: SparkSession,
    path: str,
    instance_id: str = "default",
    split_bytes: int = SPLIT_BYTES,
    tasks: int | None = None,
    files_per_batch: int = 100,
) -> DataFrame:
    """Frames of the capture files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(LISTING).option("maxFilesPerTrigger", files_per_batch).load(path)
    return _decode(spark, files, instance_id, split_bytes, tasks)


def load_packets(spark: SparkSession, path: str | None = None, stream: str | None = None, **options: Any) -> DataFrame:
    """Frames of exactly one source: a path of finished files or a folder of arriving ones."""
    if (path is None) == (stream is None):
        raise ValueError("give exactly one of path and stream")
    return read_pcap(spark, path, **options) if path is not None else stream_pcap(spark, stream, **options)


def unread_bytes(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES, tasks: int | None = None) -> DataFrame:
    """(capture_file, at, bytes) of what follows the last whole record: frames stop there, as in a file cut off while it was written."""
    return _ranges(spark, spark.read.format("binaryFile").load(path), split_bytes, tasks).mapInArrow(range_reader(rest_only=True), REST)


def _ranges(spark: SparkSession, files: DataFrame, split_bytes: int, tasks: int | None) -> DataFrame:
    # A plain number keeps adaptive execution from merging the few bytes that describe the ranges into one task.
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    listed = files.select("path", "length")
    if not files.isStreaming:
        at = F.sequence(F.lit(FILE_HEADER).cast("long"), F.greatest(F.col("length") - 1, F.lit(FILE_HEADER)), F.lit(split_bytes).cast("long"))
        pieces = listed.select(F.col("path").alias("capture_file"), F.col("length").alias("size"), F.explode(at).alias("at"))
        pieces = pieces.withColumn("until", F.least(F.col("at") + split_bytes, F.greatest("size", "at")))
        found = pieces.repartition(tasks, "capture_file", "at").mapInArrow(_find_records, PIECES)
        # A row for each piece of a file: one for 64 MB of it.
        listed = found.groupBy("capture_file").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "start", "stop", "n"))).alias("pieces"))
    return listed.mapInArrow(_cutter(split_bytes), RANGES).repartition(tasks, "capture_file", "start")


def _find_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds where the first record at or behind `at` starts (-1: not found), where the last one before `until` ends, and the number of records between."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            system, local = file_system(r["capture_file"])
            with system.open_input_file(local) as file:
                little, nano, _ = file_header(file.read(FILE_HEADER), r["capture_file"])
                record = struct.Struct(("<" if little else ">") + "IIII")
                start = r["at"] if r["at"] == FILE_HEADER else _first_record(file, record, 10**9 if nano else 10**6, r["at"], r["size"])
                at, n = start, 0
                block, base = b"", 0
                while 0 <= at < r["until"] and at + RECORD_HEADER <= r["size"]:
                    if at + RECORD_HEADER > base + len(block):
                        file.seek(at)
                        block, base = file.read(BATCH_BYTES), at
                    at += RECORD_HEADER + record.unpack_from(block, at - base)[2]
                    n += 1
            last = r["until"] >= r["size"]
            rows.append(r | {"start": start, "stop": r["size"] if last and start >= 0 else at, "n": n})
        yield pa.Table.from_pylist(rows, schema=pa.schema([(f, pa.string() if f == "capture_file" else pa.int64()) for f in (x.split()[0] for x in PIECES.split(", "))])).to_batches()[0]


def _first_record(file, record: struct.Struct, fractions: int, at: int, size: int) -> int:
    """The first byte from `at` on from which CHAIN plausible headers follow each other, or fewer up to the end of the file."""
    file.seek(FILE_HEADER)
    begin = record.unpack(file.read(RECORD_HEADER))[0]
    file.seek(at)
    block = file.read(LONGEST_RECORD + BATCH_BYTES)

    def plausible(place: int) -> int:
        """Where the record at this place of the block ends; -1 if that is none."""
        seconds, fraction, stored, original = record.unpack_from(block, place)
        good = fraction < fractions and 0 < stored <= min(LONGEST_RECORD, original) and abs(seconds - begin) <= FURTHEST_SECONDS
        return place + RECORD_HEADER + stored if good else -1

    for place in range(min(len(block) - RECORD_HEADER + 1, LONGEST_RECORD + RECORD_HEADER)):
        end = place
        for _ in range(CHAIN):
            if at + end == size or end + RECORD_HEADER > len(block):
                break
            end = plausible(end)
            if end < 0 or at + end > size:
                end = -1
                break
        if end >= 0 and (end > place or at + end == size):
            return at + place
    return -1


def _decode(spark: SparkSession, files: DataFrame, instance_id: str, split_bytes: int, tasks: int | None) -> DataFrame:
    frames = _ranges(spark, files, split_bytes, tasks).mapInArrow(range_reader(), PACKETS)
    return frames.withColumn("instance_id", F.lit(instance_id))


def _cutter(split_bytes: int):
    schema = pa.schema([
        ("capture_file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("first_frame", pa.int64()),
        ("little", pa.bool_()), ("nano", pa.bool_()), ("link_type", pa.int32()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, *pieces in zip(*(c.to_pylist() for c in batch.columns)):
                system, local = file_system(path)
                with system.open_input_file(local) as file:
                    little, nano, link = file_header(file.read(FILE_HEADER), path)
                    ranges = _joined(pieces[0], size) if pieces else []
                    if ranges:
                        size = FILE_HEADER  # nothing is left to cut
                    start, frame, at, first = FILE_HEADER, 1, FILE_HEADER, 1
                    order = "<" if little else ">"
                    block, base = b"", 0
                    while size > split_bytes and at + RECORD_HEADER <= size:
                        if at - start >= split_bytes:
                            ranges.append((start, at, first))
                            start, first = at, frame
                        if at + RECORD_HEADER > base + len(block):  # heads are walked in memory: one request per block, not per record
                            file.seek(at)
                            block, base = file.read(BATCH_BYTES), at
                        (stored,) = struct.unpack_from(order + "I", block, at - base + 8)
                        at += RECORD_HEADER + stored
                        frame += 1
                    if not ranges or size > FILE_HEADER:
                        ranges.append((start, size, first))
                rows = [
                    {"capture_file": path, "start": a, "stop": b, "first_frame": n, "little": little, "nano": nano, "link_type": link}
                    for a, b, n in ranges
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cut


def _joined(pieces: list[dict], size: int) -> list[tuple[int, int, int]]:
    """Pieces as ranges (start, stop, number of the first frame), if each begins where the one before it ends; else none."""
    ranges, frame, end = [], 1, FILE_HEADER
    for piece in pieces:
        if piece["start"] != end:
            return []
        if piece["stop"] > piece["start"]:
            ranges.append((piece["start"], piece["stop"], frame))
        frame, end = frame + piece["n"], piece["stop"]
    return ranges if end == size else []


def file_header(head: bytes, path: str) -> tuple[bool, bool, int]:
    if len(head) == FILE_HEADER:
        for little in (True, False):
            order = "<" if little else ">"
            magic, = struct.unpack(order + "I", head[:4])
            if magic in (MICRO_MAGIC, NANO_MAGIC):
                return little, magic == NANO_MAGIC, struct.unpack(order + "I", head[20:24])[0] & 0x0FFFFFFF
    raise ValueError(f"not a capture file: {path}")


def range_reader(rest_only: bool = False):
    names = [f.name for f in PACKETS.fields]
    schema = pa.schema([
        ("capture_file", pa.string()), ("frame_no", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("cap_len", pa.int32()),
        ("orig_len", pa.int32()), ("link_type", pa.int32()), ("data", pa.binary()),
    ])

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, columns)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                record = struct.Struct(("<" if r["little"] else ">") + "IIII")
                system, local = file_system(r["capture_file"])
                with system.open_input_file(local) as file:
                    file.seek(r["start"])
                    left, buffer, frame = r["stop"] - r["start"], b"", r["first_frame"]
                    while left > 0:
                        # At least one record: a record longer than the buffer makes the next read longer.
                        chunk = file.read(min(left, BATCH_BYTES))
                        if not chunk:
                            break
                        left -= len(chunk)
                        buffer += chunk
                        rows, at = [], 0
                        while at + RECORD_HEADER <= len(buffer):
                            seconds, fraction, stored, original = record.unpack_from(buffer, at)
                            stop = at + RECORD_HEADER + stored
                            if stop > len(buffer):
                                break
                            micros = seconds * 1_000_000 + (fraction // 1000 if r["nano"] else fraction)
                            rows.append((r["capture_file"], frame, micros, stored, original, r["link_type"], buffer[at + RECORD_HEADER : stop]))
                            frame += 1
                            at = stop
                        buffer = buffer[at:]
                        if rows and not rest_only:
                            yield flush(rows)
                    if rest_only and buffer:
                        left_over = [[r["capture_file"]], [r["stop"] - len(buffer)], [len(buffer)]]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in left_over], names=["capture_file", "at", "bytes"])

    return read
