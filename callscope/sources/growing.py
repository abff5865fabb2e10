"""Captures that are still being written, as a stream: what has been read of each file is the stream's offset, so each frame comes once."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from callscope.schemas import PACKETS
from callscope.sources.pcap import BATCH_BYTES, FILE_HEADER, RECORD_HEADER, SPLIT_BYTES, file_header, range_reader
from callscope.sources.storage import file_system, qualified

NAME = "growing_captures"


@dataclass
class CaptureRange(InputPartition):
    """Whole records of one file, from a byte and a frame number on."""

    capture_file: str
    start: int
    stop: int
    first_frame: int


class GrowingCaptures(DataSource):
    """
    The capture files of a folder (option ``path``), new ones and what is added to old ones.

    ``max_bytes`` bounds what a micro-batch takes, over all files (0: all there is). It doesn't go with the trigger ``availableNow``, which asks for the end only once.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return PACKETS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], int(self.options.get("max_bytes", "0")), int(self.options.get("split_bytes", str(SPLIT_BYTES))))


class GrowingReader(DataSourceStreamReader):
    """
    Offsets are {file: {byte, frame}}: the end of the last whole record, and the number of the next frame.

    To find the end of what is new, the heads of new records are walked, not their frames; on the way the places are noted where the new part can be cut for
    several tasks. A stream that starts again walks old heads once more, and reads on where its checkpoint says.
    """

    def __init__(self, path: str, max_bytes: int, split_bytes: int):
        self.path, self.max_bytes, self.split_bytes = path, max_bytes, split_bytes
        self.at: dict[str, dict] = {}
        self.cuts: dict[str, list[tuple[int, int]]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, local = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(local, allow_not_found=True))
        prefix = self.path.rstrip("/")
        left = self.max_bytes or None
        for info in sorted((i for i in found if i.is_file and not i.base_name.startswith((".", "_"))), key=lambda i: i.base_name):
            name = f"{prefix}/{info.base_name}"
            before = self.at.get(name, {"byte": 0, "frame": 1})
            now = self._whole_records(system, info, name, before, left)
            if now["byte"]:
                self.at[name] = now
            if left is not None:
                left -= now["byte"] - before["byte"]
                if left <= 0:
                    break
        return {name: dict(place) for name, place in self.at.items()}

    def _whole_records(self, system, info, name: str, place: dict, most: int | None) -> dict:
        """How far whole records reach, from a place on; one record at least, if there is one, then as many as fit into `most`."""
        at, frame = place["byte"], place["frame"]
        if info.size < FILE_HEADER or info.size <= at:
            return place
        with system.open_input_file(info.path) as file:
            little, _, _ = file_header(file.read(FILE_HEADER), name)
            head = struct.Struct("<8xI" if little else ">8xI")
            at = max(at, FILE_HEADER)
            cuts = self.cuts.setdefault(name, [])
            cut, block, base = at, b"", 0
            while at + RECORD_HEADER <= info.size:
                if at + RECORD_HEADER > base + len(block):
                    file.seek(at)
                    block, base = file.read(BATCH_BYTES), at
                stop = at + RECORD_HEADER + head.unpack_from(block, at - base)[0]
                if stop > info.size or (most is not None and stop - place["byte"] > most and at > max(place["byte"], FILE_HEADER)):
                    break
                at, frame = stop, frame + 1
                if at - cut >= self.split_bytes:
                    cuts.append((at, frame))
                    cut = at
        return {"byte": at, "frame": frame}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for name, place in end.items():
            was = start.get(name, {"byte": 0, "frame": 1})
            points = [(max(was["byte"], FILE_HEADER), was["frame"])]
            points += [c for c in self.cuts.get(name, []) if points[0][0] < c[0] < place["byte"]]
            points.append((place["byte"], place["frame"]))
            out += [CaptureRange(name, a, b, frame) for (a, frame), (b, _) in zip(points, points[1:]) if a < b]
            # What a stream that starts again has behind it needn't be walked again.
            if place["byte"] > self.at.get(name, {"byte": 0})["byte"]:
                self.at[name] = dict(place)
        return out

    def read(self, partition: CaptureRange) -> Iterator[pa.RecordBatch]:
        system, local = file_system(partition.capture_file)
        with system.open_input_file(local) as file:
            little, nano, link = file_header(file.read(FILE_HEADER), partition.capture_file)
        row = {
            "capture_file": partition.capture_file, "start": partition.start, "stop": partition.stop, "first_frame": partition.first_frame, "little": little, "nano": nano, "link_type": link,
        }
        yield from range_reader()(iter([pa.RecordBatch.from_pylist([row])]))

    def commit(self, end: dict) -> None:
        for name, place in end.items():
            self.cuts[name] = [c for c in self.cuts.get(name, []) if c[0] > place["byte"]]


def stream_growing_captures(spark: SparkSession, path: str, instance_id: str = "default", max_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames of the captures in a folder, as they are written: whole records only, each once, also over restarts from a checkpoint."""
    spark.dataSource.register(GrowingCaptures)
    frames = spark.readStream.format(NAME).option("path", qualified(spark, path)).option("max_bytes", max_bytes).option("split_bytes", split_bytes).load()
    return frames.withColumn("instance_id", F.lit(instance_id))
