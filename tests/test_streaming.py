"""Streams give what the batch operators give."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from callscope.operators.sessions import sessionize
from callscope.plans.reports import incremental_counters
from callscope.sinks.tables import CallsTable
from callscope.sources.pcap import load_packets
from callscope.operators.upsert import INSERT, RETRACT, UPDATE
from callscope.streaming.calls import LATE, CounterListener, stream_sessions, table_changes, use_rocksdb, write_calls
from tests import capture as c
from tests.test_operators import at, keyed_rows, us

SCHEMA = "instance_id string, call_id string, ts timestamp, frame_no long, e string, sip_from string, sip_to string"


@pytest.mark.parametrize("shuffled", [False, True])
def test_sessions_over_many_batches(spark, tmp_path, shuffled):
    """One file per micro-batch, in time order or with rows of all times in each: the calls are those of the batch operator."""
    use_rocksdb(spark)
    rows, timeout = keyed_rows(3), 30_000_000
    data = [("i", k, at(t), i, e, "f" * (i % 7), "t") for k, t, i, e in rows]
    df = spark.createDataFrame(data, SCHEMA)
    arriving = random.Random(1).sample(data, len(data)) if shuffled else data
    for n in range(5):
        part = arriving[n * 80 : (n + 1) * 80]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    opens, closes = F.col("e") == "open", F.col("e") == "close"
    want = sessionize(df, ["call_id"], ["ts", "frame_no"], opens, closes, timeout).collect()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    table = CallsTable(spark, str(tmp_path / "calls"))
    query = write_calls(stream_sessions(stream, opens, closes, timeout, "0 seconds"), table, str(tmp_path / "progress"), availableNow=True)
    query.awaitTermination()
    got = table.read().collect()
    key = lambda r: (r[0], r[1])
    assert sorted(((r.call_id, us(r.start_timestamp), r.state) for r in got), key=key) == sorted(
        ((r.call_id, us(r.start_ts), r.state) for r in want), key=key
    )
    ends = {(r.call_id, us(r.start_ts)): us(r.last_ts) for r in want if r.state != "active"}
    assert {(r.call_id, us(r.start_timestamp)): us(r.end_timestamp) for r in got if r.state != "active"} == ends
    longest = df.groupBy("call_id").agg(F.max(F.length("sip_from")).alias("n")).collect()
    assert all(max(len(g.sip_from) for g in got if g.call_id == r.call_id) <= r.n for r in longest)
    # Reading, compacting and reading again give the same table.
    table.compact()
    assert sorted(map(str, table.read().collect())) == sorted(map(str, got))


def test_rows_too_late_are_handed_on(spark, tmp_path):
    """What is older than the state is kept beside the table, and the calls that ended long ago leave the state."""
    use_rocksdb(spark)
    data = [("i", "a", at(0), 0, "open", "f", "t"), ("i", "a", at(5_000_000), 1, "close", "f", "t"), ("i", "b", at(500_000_000), 2, "open", "f", "t")]
    pieces = [data, [("i", "b", at(501_000_000), 3, "other", "f", "t")], [("i", "a", at(2_000_000), 4, "close", "late", "t"), ("i", "b", at(502_000_000), 5, "close", "f", "t")]]
    for part in pieces:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = CallsTable(spark, str(tmp_path / "calls"))
    changes = stream_sessions(stream, F.col("e") == "open", F.col("e") == "close", 30_000_000, "0 seconds", keep_us=60_000_000)
    write_calls(changes, table, str(tmp_path / "progress"), availableNow=True).awaitTermination()
    assert {(r.call_id, r.state, us(r.end_timestamp)) for r in table.read().collect()} == {("a", "finished", 5_000_000), ("b", "finished", 502_000_000)}
    late = spark.read.parquet(f"{table.path}/late").collect()
    assert [(r.call_id, r.kind, r.call_seq, r.state, r.sip_from) for r in late] == [("a", LATE, 4, "close", "late")]


CHANGE = "instance_id string, call_id string, call_seq long, kind string, start_us long, last_us long, at_us long, state string, sip_from string, sip_to string, n_rows long, revision long"


def change(call, kind, at_us, state, sip_from="f", revision=0):
    return ("i", call, 0, kind, 0, at_us, at_us, state, sip_from, "t", 1, revision)


def epoch_us(ts):
    return None if ts is None else (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def batches_of_calls():
    """Ends before the updates they follow, updates before their insert, a call that never was one, and one that was retracted and came back."""
    return [
        [change("late-update", INSERT, 0, "active"), change("late-update", UPDATE, 30, "finished")],
        [change("early-update", UPDATE, 15, "active", "a longer one"), change("no-insert", UPDATE, 5, "active")],
        [change("late-update", UPDATE, 20, "active", "longest of them")],
        [change("early-update", INSERT, 10, "active"), change("back", RETRACT, 40, "finished", None, 1), change("gone", RETRACT, 9, "active", None, 2)],
        [change("back", INSERT, 0, "active", "first"), change("back", UPDATE, 40, "finished", "first and wrong")],
        [change("back", INSERT, 0, "active", "new", 1), change("back", UPDATE, 25, "timedout", "newer", 1), change("gone", INSERT, 1, "active", "x", 1)],
    ]


@pytest.mark.parametrize("seed", range(4))
def test_calls_table_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    batches = [(n, rows) for n, rows in enumerate(batches_of_calls())]
    if seed:
        draw.shuffle(batches)
    table = CallsTable(spark, str(tmp_path / "calls"))
    for n, rows in batches:
        table.append(table_changes(spark.createDataFrame(rows, CHANGE)), n // 2, f"w{n % 2}")
        if draw.random() < 0.5:
            table.compact()
    got = {(r.call_id, r.state, r.sip_from, epoch_us(r.updated_at), epoch_us(r.end_timestamp)) for r in table.read().collect()}
    assert got == {
        ("late-update", "finished", "longest of them", 30, 30), ("early-update", "active", "a longer one", 15, None), ("back", "timedout", "newer", 25, 25),
    }
    table.compact()
    assert {(r.call_id, r.state, r.sip_from) for r in table.read().collect()} == {g[:3] for g in got}


def test_base_without_rows(spark, tmp_path):
    table = CallsTable(spark, str(tmp_path / "calls"))
    table.append(table_changes(spark.createDataFrame([change("a", UPDATE, 5, "finished")], CHANGE)))
    table.compact()
    assert table.read().count() == 0
    table.append(table_changes(spark.createDataFrame([change("a", INSERT, 0, "active")], CHANGE)))
    table.compact()
    assert [(r.state, epoch_us(r.end_timestamp)) for r in table.read().collect()] == [("finished", 5)]


def test_published_table_is_never_missing(spark, tmp_path):
    table, name = CallsTable(spark, str(tmp_path / "calls")), f"calls_{tmp_path.name.replace('-', '_')}"
    table.publish(name)
    assert spark.table(name).count() == 0
    table.append(table_changes(spark.createDataFrame([change("a", INSERT, 0, "active")], CHANGE)))
    before = spark.table(name)
    table.publish(name)
    assert spark.table(name).count() == 1 and before.count() == 0


def test_arriving_captures(spark, tmp_path):
    rng, reports = random.Random(0), []
    listener = CounterListener(lambda name, values: reports.append((name, values["received"])))
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    for n in range(3):
        c.write_pcap(tmp_path / "in" / f"{n}.pcap", [(i * 1000, rng.randbytes(60)) for i in range(20)])
    frames = incremental_counters(load_packets(spark, stream=str(tmp_path / "in"), files_per_batch=1, tasks=2))
    query = (
        frames.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("capture_file", "frame_no").distinct().count() == 60
    import time

    for _ in range(50):
        if sum(n for _, n in reports) == 60:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(n for _, n in reports) == 60


def test_growing_captures(spark, tmp_path):
    """Files that grow between micro-batches, cut anywhere: each frame comes once, with its number, also after a restart."""
    from callscope.sources.growing import stream_growing_captures

    draw = random.Random(9)
    (tmp_path / "in").mkdir()
    records = {n: [(i * 1000 + n, draw.randbytes(draw.randrange(1, 300))) for i in range(60)] for n in range(2)}
    whole = {}
    for n, rows in records.items():
        c.write_pcap(tmp_path / f"{n}.pcap", rows)
        whole[n] = (tmp_path / f"{n}.pcap").read_bytes()
    rows = []

    def run(steps):
        frames = stream_growing_captures(spark, str(tmp_path / "in"), max_bytes=2500, split_bytes=700)
        query = (
            frames.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
            .trigger(processingTime="100 milliseconds").start()
        )
        for step in steps:
            for n, size in step.items():
                (tmp_path / "in" / f"{n}.pcap").write_bytes(whole[n][:size])
            query.processAllAvailable()
            rows.append(spark.read.schema("frame_no long").parquet(str(tmp_path / "out")).count())
        query.stop()

    run([{0: 10}, {0: 3000}, {0: 3010, 1: 24}])
    run([{0: len(whole[0]), 1: 5000}, {1: len(whole[1])}])
    found = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        found.setdefault(int(r.capture_file.split("/")[-1][0]), []).append((r.frame_no, bytes(r.data)))
    assert {n: sorted(x) for n, x in found.items()} == {n: list(enumerate((d for _, d in rows), 1)) for n, rows in records.items()}
    assert rows[0] == 0 < rows[1] <= rows[2] < rows[3] < rows[4] == 120


def test_compaction_works_out_changes_once(spark, tmp_path, monkeypatch):
    """Changes none of which is retracted or has statistics are folded as they are; others are worked out once for the rows and their history."""
    from callscope.sinks import tables

    calls = []
    monkeypatch.setattr(tables, "needed_changes", lambda *a, **b: calls.append(b["heavy"]) or needed(*a, **b))
    needed, table = tables_needed_changes(), CallsTable(spark, str(tmp_path / "calls"))
    table.append(table_changes(spark.createDataFrame([change("a", INSERT, 0, "active"), change("b", INSERT, 0, "active")], CHANGE)), 0, "w")
    table.compact()
    table.append(table_changes(spark.createDataFrame([change("a", UPDATE, 5, "finished")], CHANGE)), 1, "w")
    table.compact()
    assert not calls and {(r.call_id, r.state) for r in table.read().collect()} == {("a", "finished"), ("b", "active")}
    # The history keeps the changes of both, in its two parts.
    assert spark.read.parquet(f"{table.path}/base/{table._base()}/history").groupBy("part").count().collect() != []
    table.append(table_changes(spark.createDataFrame([change("b", RETRACT, 1, "active", None, 1)], CHANGE)), 2, "w")
    table.compact()
    assert calls == [[]] and {(r.call_id, r.state) for r in table.read().collect()} == {("a", "finished")}
    # What was retracted stays so when its changes come again.
    table.append(table_changes(spark.createDataFrame([change("b", UPDATE, 9, "finished"), change("b", INSERT, 0, "active")], CHANGE)), 3, "w")
    assert {r.call_id for r in table.read().collect()} == {"a"}


def tables_needed_changes():
    from callscope.operators.upsert import needed_changes

    return needed_changes
