"""Streams whose keys are dealt into shares, and the files that their micro-batches take."""

from datetime import datetime, timedelta

import pandas as pd
import pytest

from callscope.queries.events import files_of_piece, in_pieces, small_streams
from callscope.queries.tables import streamed_frames
from callscope.sources.storage import files_below
from callscope.streaming.calls import CallSessions
from callscope.streaming.fragments import Reassembly, stream_datagrams
from callscope.streaming.calls import use_rocksdb
from callscope.streaming.media import CARRIED, PACKET, REGISTER, EndpointOwners
from callscope.streaming.shares import KEY


class Held:
    """Value and map states, timers and the calls they get, in one."""

    def __init__(self):
        self.values, self.maps, self.timers, self.asked = {}, {}, set(), 0

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                handle.asked += 1
                return handle.values.get(name)

            def update(self, value):
                handle.values[name] = value

            def clear(self):
                handle.values.pop(name, None)

        return Value()

    def getMapState(self, name, key, value):
        rows = self.maps.setdefault(name, {})

        class Map:
            def getValue(self, key):
                return rows.get(key)

            def updateValue(self, key, value):
                rows[key] = value

            def removeKey(self, key):
                rows.pop(key, None)

        return Map()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def frames(processor, rows, ms):
    columns = [KEY, *processor.columns]
    data = pd.DataFrame([{**dict.fromkeys(columns), **r} for r in rows], columns=columns)
    return list(processor.handleInputRows((0,), iter([data[: len(data) // 2], data[len(data) // 2 :]]), At(ms)))


def started(processor):
    handle = Held()
    processor.init(handle)
    return handle


def test_calls_of_many_keys_in_one_call():
    """One call for a share: one frame of results, one timer, and at the timer only the calls that are due."""
    processor = CallSessions(1_000_000, None, False)
    handle = started(processor)
    message = {"opens": True, "closes": False, "sip_from": "f", "sip_to": "t"}
    found = frames(processor, [{KEY: f'["i","{n}"]', "us": n * 1000, "frame_no": n, **message} for n in range(500)], 0)
    assert len(found) == 1 and handle.asked == 1 and list(found[0]["kind"]) == ["insert"] * 500
    assert handle.timers == {1001} and len(handle.maps["states"]) == 500
    # The first hundred calls have been silent for longer than a second.
    late = list(processor.handleExpiredTimer((0,), At(1100), None))
    assert len(late) == 1 and list(late[0]["state"]) == ["timedout"] * 100
    assert handle.timers - {1001} == {1101}
    # A closing message takes its key's moment away, and what is due meanwhile is done in the same call.
    closing = frames(processor, [{KEY: '["i","300"]', "us": 400_000, "frame_no": 900, **message, "opens": False, "closes": True}], 1150)
    assert sorted(zip(closing[0][KEY], closing[0]["state"])) == sorted([('["i","300"]', "finished"), *((f'["i","{n}"]', "timedout") for n in range(100, 150))])
    list(processor.handleExpiredTimer((0,), At(5000), None))
    assert "moments" not in handle.values


def test_endpoints_of_a_share_are_told_apart():
    processor = EndpointOwners(None)
    handle = started(processor)
    rows = [{KEY: f'["i","10.0.0.{n}","9"]', "kind": REGISTER, "us": 0, "frame_no": n, "call_id": f"c{n}"} for n in range(50)]
    rows += [{KEY: f'["i","10.0.0.{n}","9"]', "kind": PACKET, "us": 5_000, "frame_no": 100 + n, "seq": n, **dict.fromkeys(CARRIED[:4], None)} for n in range(80)]
    assert frames(processor, rows, 1) == [] and handle.timers == {5}
    found = list(processor.handleExpiredTimer((0,), At(5), None))
    assert [(r.frame_no - 100, r.call_id, r.seq) for r in found[0].itertuples()] == [(n, f"c{n}" if n < 50 else None, n) for n in range(80)]
    assert len(handle.maps["states"]) == 50


def test_pieces_of_a_share_leave_the_state():
    processor = Reassembly(30_000_000)
    handle = started(processor)
    rows = [
        {KEY: f'["{n}"]', "us": 1000, "at": k, "fragment_offset": 8 * k, "more_fragments": k == 0, "data": bytes([n % 250]) * 8} for n in range(450) for k in range(2)
    ]
    assert frames(processor, rows, 0) == [] and len(handle.maps["data"]) == 900
    found = list(processor.handleExpiredTimer((0,), At(1), None))
    assert [len(x) for x in found] == [200, 200, 50]
    assert all(r.payload == bytes([int(r.key_text[2:-2]) % 250]) * 16 for x in found for r in x.itertuples())
    assert not handle.maps["data"] and not handle.maps["states"] and not handle.values


def test_keys_keep_their_types_and_nulls(spark, tmp_path):
    use_rocksdb(spark)
    schema = "a binary, b string, c bigint, frame_no bigint, ts timestamp, fragment_offset int, more_fragments boolean, ip_payload binary"
    at = datetime(2024, 1, 1)
    keys = [(b"\xff\x00", "x", 1), (b"\xff\x00", "x", None), (None, "x", 1), (None, None, None), (b"", '"],["', -(1 << 60))]
    data = [(*k, 2 * n + i, at + timedelta(seconds=n), 8 * i, i == 0, bytes([n]) * 8) for n, k in enumerate(keys) for i in range(2)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(None, None, None, None, at + timedelta(days=1), None, None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = stream_datagrams(stream, ["a", "b", "c"], lateness="1 second")
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.a and bytes(r.a), r.b, r.c) if r.a != b"" else (b"", r.b, r.c) for r in got} == set(keys)
    assert {bytes(r.payload) for r in got} == {bytes([n]) * 16 for n in range(5)}


def write_events(spark, path, seconds):
    rows = [(n, datetime(2024, 1, 1) + timedelta(seconds=s), n % 7, "view", 1.0, '{"k": 1}') for n, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(ts AS timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(f"{path}/events.parquet")


def test_a_micro_batch_is_a_piece_of_many_files(spark, tmp_path):
    """Each quarter of the time is as many files as a micro-batch takes, also one that has few rows or none."""
    from pyspark.sql import functions as F

    write_events(spark, tmp_path, [*range(100), 210, *range(300, 401)])
    frames, seen = streamed_frames(spark, str(tmp_path), rows_of_file=20), []

    def note(batch, number):
        seen.append(tuple(batch.agg(F.count("*"), F.min("frame_no"), F.max("frame_no")).first()))

    frames.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    assert [s for s in seen if s[0]] == [(100, 0, 99), (1, 100, 100), (101, 101, 201)]
    folder, files = in_pieces(spark, str(tmp_path), rows_of_file=20)
    assert files == 3 and len(files_below(spark, folder, ".parquet")) == 12 and spark.read.parquet(folder).count() == 202
    assert [files_of_piece(n, 4, 10) for n in (0, 1, 40, 41, 400)] == [1, 1, 1, 2, 10]


@pytest.mark.parametrize("given,wanted", [("2", 2), ("4", 4), ("100", 8)])
def test_state_has_a_partition_for_each_core(spark, given, wanted):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, given)
    try:
        with small_streams(spark):
            assert int(spark.conf.get(name)) == wanted
        assert spark.conf.get(name) == given
    finally:
        spark.conf.set(name, before)
