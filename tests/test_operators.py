"""Ordered operators against folds in plain Python, with and without keys cut into slots."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callscope.operators.attach import attach_asof, endpoint_intervals
from callscope.operators.filters import source_filter
from callscope.operators.fragments import datagrams, fragment_counters
from callscope.operators.nest import nest, unnest
from callscope.operators.sequence import expected_packets, stream_statistics
from callscope.operators.sessions import sessionize, state_counts
from callscope.operators.slots import KeySlots
from callscope.operators.upsert import check_states, fold_changes
from tests.test_pipeline import stream_fold

T0 = datetime(2024, 1, 1)
CUT = [(10**6, 1), (3, 7_000_000), (3, 60_000_000)]


def at(us):
    return T0 + timedelta(microseconds=us)


def us(ts):
    return (ts - T0) // timedelta(microseconds=1)


def keyed_rows(seed, n=400):
    """Rows of a few keys, one of them with a third of all."""
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 500_000, 3_000_000, 31_000_000 if rng.random() < 0.1 else 10])
        out.append((rng.choice(["hot", "hot", "a", "b", "c", "d"]), t, i, rng.choice(["open", "close", "x", "x", "x"])))
    return out


@pytest.mark.parametrize("hot_rows,slot_us", CUT)
def test_sessions(spark, hot_rows, slot_us):
    rows, timeout = keyed_rows(1), 30_000_000
    df = spark.createDataFrame([(k, at(t), i, e) for k, t, i, e in rows], "k string, ts timestamp, no long, e string")
    calls = sessionize(df, ["k"], ["ts", "no"], F.col("e") == "open", F.col("e") == "close", timeout, hot_rows=hot_rows, slot_us=slot_us)
    got = sorted((r.k, us(r.start_ts), us(r.last_ts), r.n_rows, r.state, r.end_ts and us(r.end_ts)) for r in calls.collect())
    active, done = {}, []
    end = max(r[1] for r in rows)
    for k, t, _, e in rows:
        if k in active and t - active[k][1] > timeout:
            done.append((k, *active.pop(k), "timedout"))
        if k not in active and e == "open":
            active[k] = [t, t, 0]
        if k in active:
            active[k][1:] = [t, active[k][2] + 1]
            if e == "close":
                done.append((k, *active.pop(k), "finished"))
    done += [(k, *v, "timedout" if end - v[1] > timeout else "active") for k, v in active.items()]
    assert got == sorted((k, a, b, n, s, None if s == "active" else b) for k, a, b, n, s in done)
    counts = state_counts(calls).first()
    assert counts.total_calls == len(done) == counts.active_calls + counts.finished_calls + counts.timedout_calls


def test_timeout_is_strict(spark):
    rows = [("k", at(0), 1, "open"), ("k", at(30_000_000), 2, "x"), ("k", at(60_000_001), 3, "x"), ("k", at(60_000_002), 4, "open")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, no long, e string")
    calls = sessionize(df, ["k"], ["ts", "no"], F.col("e") == "open", F.lit(False), 30_000_000, close_at_end=True).orderBy("start_ts").collect()
    assert [(us(r.start_ts), us(r.last_ts), r.state) for r in calls] == [(0, 30_000_000, "timedout"), (60_000_002, 60_000_002, "finished")]
    never = sessionize(df, ["k"], ["ts", "no"], F.col("e") == "open", F.lit(False), 0).collect()
    assert [(r.n_rows, r.state) for r in never] == [(4, "active")]


SEQUENCES = {
    "wrap": [65534, 65535, 0, 1],
    "half": [32766, 32767, 32768, 32769],
    "first_max": [65535, 0, 1],
    "duplicate": [5, 6, 6, 7, 5],
    "reorder": [10, 12, 11, 13],
    "loss": [100, 105, 110],
    "one": [7],
    "back": [3, 2, 1, 65535],
}


@pytest.mark.parametrize("hot_rows,slot_us", CUT)
def test_sequences(spark, hot_rows, slot_us):
    rng = random.Random(4)
    streams = {k: [(i * 2_500_000, s) for i, s in enumerate(v)] for k, v in SEQUENCES.items()}
    t, seq, hot = 0, 65000, []
    for _ in range(1500):
        t += rng.randrange(0, 90_000)
        seq += rng.choice([0, 1, 1, 1, 2, 3, -1, -2])
        hot.append((t, seq % 65536))
    streams["hot"] = hot
    rows = [(k, at(a), i, s) for k, v in streams.items() for i, (a, s) in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, no long, seq int")
    got = stream_statistics(df, ["k"], ["ts", "no"], hot_rows=hot_rows, slot_us=slot_us).collect()
    found = {r.k: (r.packet_count, r.lost_packets, r.out_of_order_count, r.duplicate_count, r.max_delta_ms, r.min_delta_ms) for r in got}
    assert found == {k: stream_fold(v) for k, v in streams.items()}
    assert found["wrap"][1:4] == (0, 0, 0) and found["half"][1:4] == (0, 0, 0)


def test_more_packets_than_numbers(spark):
    n = 70_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 20_000).alias("ts"), "id", (F.col("id") % 65536).cast("int").alias("seq"))
    r = stream_statistics(df, ["k"], ["ts", "id"], hot_rows=1000, slot_us=60_000_000).first()
    assert (r.packet_count, r.lost_packets, r.duplicate_count, r.out_of_order_count) == (n, 0, 0, 0)
    assert (r.min_delta_ms, r.max_delta_ms, r.avg_delta_ms) == (20.0, 20.0, 20.0)


def test_expected_packets(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 00:00:02' AS b, timestamp'2024-01-01 00:00:01' AS c")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = row.select(expected_packets(a, b, F.lit(20)), expected_packets(a, c, F.lit(0)), expected_packets(b, a, F.lit(20)), expected_packets(a, c, F.lit(30)))
    assert list(got.first()) == [100, 50, 0, 33]


@pytest.mark.parametrize("hot_rows,slot_us", CUT)
def test_attach(spark, hot_rows, slot_us):
    rows = keyed_rows(2)
    df = spark.createDataFrame([(k, at(t), i, e) for k, t, i, e in rows], "k string, ts timestamp, no long, e string")
    ended = F.struct((F.col("ts") + F.expr("interval 20 seconds")).alias("o0"), F.lit(0).cast("long").alias("o1"))
    registrations = df.filter("e = 'open'").withColumn("owner", F.col("no")).withColumn("ended", F.when(F.col("no") % 2 == 0, ended))
    found = attach_asof(df.filter("e <> 'open'"), registrations, ["k"], ["ts", "no"], ["owner"], until="ended", hot_rows=hot_rows, slot_us=slot_us)
    got = {r.no: r.owner for r in found.collect()}
    want, last = {}, {}
    for k, t, i, e in rows:
        if e == "open":
            last[k] = (t, i)
        else:
            own = last.get(k)
            want[i] = None if own is None or (own[1] % 2 == 0 and (t, i) > (own[0] + 20_000_000, 0)) else own[1]
    assert got == want
    spans = endpoint_intervals(registrations, ["k"], ["ts", "no"], hot_rows=hot_rows, slot_us=slot_us).collect()
    following = {}
    for k in {r[0] for r in rows}:
        mine = [(t, i) for kk, t, i, e in rows if kk == k and e == "open"]
        following.update({i: nxt[0] for (_, i), nxt in zip(mine, mine[1:])})
    assert {r.no: us(r.valid_to) for r in spans if r.valid_to is not None} == following


def test_rows_without_key_and_hot_count(spark):
    df = spark.createDataFrame([(None, 1)] + [("a", i) for i in range(10)] + [("b", 1)], "k string, v long")
    slots = KeySlots(df, ["k"], F.col("v"), 4, 5)
    assert slots.any_hot and sorted((r.k, r["__slot"]) for r in slots.rows.filter("k = 'a'").distinct().collect())[-1] == ("a", 2)
    assert slots.rows.filter("k is null").count() == 1 and slots.rows.filter("(k = 'b' or k is null) and __slot is not null").isEmpty()
    nulls = KeySlots(df.withColumn("k", F.lit(None).cast("string")), ["k"], F.col("v"), 4, 5)
    assert nulls.any_hot and nulls.rows.filter("__slot is not null").count() == 12
    assert not KeySlots(df, ["k"], F.col("v"), 4, 50).any_hot


@pytest.mark.parametrize("hot_rows,width", [(10**6, 1), (1, 2)])
def test_upsert(spark, hot_rows, width):
    rng = random.Random(9)
    keys = [f"k{i}" for i in range(8)]
    table = {k: dict(f="x" * rng.randrange(5), s3="", st=rng.choice(["active", "finished"]), fx=1) for k in keys[:3]}
    current = spark.createDataFrame([(k, v["f"], v["s3"], v["st"], v["fx"]) for k, v in table.items()], "k string, f string, s3 string, state string, fx int")
    changes = []
    for i in range(150):
        kind = rng.choice(["insert", "update"])
        state = "active" if kind == "insert" else rng.choice(["active", "active", "finished", "timedout"])
        changes.append((rng.choice(keys + ["k0"] * 8), rng.choice("abc") * rng.randrange(1, 12), rng.choice(["", f"s{i}"]), state, i, kind, i))
    for k, f, s3, st, fx, kind, _ in changes:
        row = table.get(k)
        if row is None:
            if kind == "insert":
                table[k] = dict(f=f, s3=s3, st=st, fx=fx)
            continue
        if kind == "insert" and row["st"] != "active":
            continue
        row["f"] = f if len(f) > len(row["f"]) else row["f"]
        row["s3"] = s3 or row["s3"]
        if kind == "update":
            row["st"] = st
    df = spark.createDataFrame(changes, "k string, f string, s3 string, state string, fx int, kind string, no long")
    got = fold_changes(current, df, ["k"], "no", longest=["f"], non_empty=["s3"], fixed=["fx"], hot_rows=hot_rows, slot_width=width).collect()
    assert {r.k: dict(f=r.f, s3=r.s3, st=r.state, fx=r.fx) for r in got} == table
    check_states(current).count()
    with pytest.raises(Exception, match="unknown state"):
        check_states(current.withColumn("state", F.lit("odd"))).collect()


def test_nest_keeps_everything(spark):
    """One row per key, however many items."""
    df = spark.range(12_000).select(F.when(F.col("id") % 7 < 6, 0).alias("k"), "id")
    nested = nest(df, ["k"], F.struct(F.col("id").alias("v"))).collect()
    assert sorted((r.k is None, len(r["items"])) for r in nested) == [(False, 10_286), (True, 1714)]
    assert all([i.v for i in r["items"]] == sorted(i.v for i in r["items"]) for r in nested)
    assert sorted(r.v for r in unnest(nest(df, ["k"], F.struct(F.col("id").alias("v")))).collect()) == list(range(12_000))


def fragments(spark, rows):
    data = [(s, "d", 17, 7, o, m, bytearray(d), at(t), n) for s, o, m, d, t, n in rows]
    return spark.createDataFrame(data, "src_ip string, dst_ip string, ip_proto long, ip_id long, fragment_offset long, more_fragments boolean, ip_payload binary, ts timestamp, frame_no long")


def fragment_fold(rows, timeout=30_000_000):
    state, out = {}, []
    for s, o, m, d, t, n in rows:
        b = state.get(s)
        if b is None or t - b["t"] > timeout:
            b = state[s] = {"t": t, "n": n, "p": {}, "total": 0, "count": 0, "data": None}
            out.append((s, b))
        b["count"] += 1
        b["p"].pop(o, None)
        b["p"][o] = d
        if not m:
            b["total"] = o + len(d)
        pos = 0
        while pos < b["total"] and b["p"].get(pos):
            pos += len(b["p"][pos])
        if b["total"] and pos >= b["total"] and all(a + len(x) <= b["total"] for a, x in b["p"].items()):
            buffer = bytearray(b["total"])
            for a, x in b["p"].items():
                buffer[a : a + len(x)] = x
            b["data"] = bytes(buffer)
            del state[s]
    return sorted((s, b["n"], b["count"], b["data"]) for s, b in out)


@pytest.mark.parametrize("hot_rows,slot_us", [(10**6, 1), (5, 20_000_000), (5, 3_000_000)])
def test_fragments(spark, hot_rows, slot_us):
    rng, rows, n, t = random.Random(1), [], 0, 0
    for k in range(60):
        total = rng.choice([24, 40, 64])
        data = bytes(rng.randrange(256) for _ in range(total))
        pieces = [(o, o + 8 < total, data[o : o + 8]) for o in range(0, total, 8)]
        rng.shuffle(pieces)
        if rng.random() < 0.3:
            pieces.pop()
        if rng.random() < 0.3:
            pieces.append(pieces[0])
        if rng.random() < 0.2:
            pieces.insert(1, (4, True, b"over"))
        for o, m, d in pieces:
            n, t = n + 1, t + rng.randrange(4_000_000)
            rows.append(("hot" if k % 3 else f"s{k}", o, m, d, t, n))
    found = datagrams(fragments(spark, rows), hot_rows=hot_rows, slot_us=slot_us)
    got = sorted((r.src_ip, r.datagram, r.n_fragments, r.payload and bytes(r.payload)) for r in found.collect())
    assert got == fragment_fold(rows)


def test_fragment_vectors(spark):
    data = bytes(range(48))
    two = [("a", 0, True, data[:24], 0, 1), ("a", 24, False, data[24:], 1, 2)]
    three = [("b", 32, False, data[32:], 2, 3), ("b", 0, True, data[:16], 3, 4), ("b", 16, True, data[16:32], 4, 5)]
    lost = [("c", 0, True, data[:24], 5, 6)]
    found = datagrams(fragments(spark, two + three + lost), timeout_us=10_000, capture_end_us=F.lit(us(T0) + 2**60))
    assert {r.src_ip: (r.status, r.payload and bytes(r.payload)) for r in found.collect()} == {
        "a": ("reassembled", data), "b": ("reassembled", data), "c": ("timeout", None),
    }
    assert list(fragment_counters(found).first()) == [6, 2, 1, 0, 0]


@pytest.mark.parametrize("hot_rows,slot_us", [(10**6, 1), (1, 1_000_000)])
def test_fragments_of_two_captures(spark, hot_rows, slot_us):
    """Frame numbers start again in a second file, and the same id comes round; one datagram begins in one file and ends in the next."""
    rows = [("a", 0, True, b"first---", 0, 1), ("a", 8, False, b"end1", 1, 2), ("a", 0, True, b"rotated-", 2, 3)]
    rows += [("a", 8, False, b"end2", 3, 1), ("a", 0, True, b"second--", 4, 2), ("a", 8, True, b"middle--", 5, 3), ("a", 16, False, b"end3", 6, 4), ("a", 8, False, b"end4", 7_000_000, 1), ("a", 0, True, b"last----", 7_000_001, 2)]
    found = datagrams(fragments(spark, rows), hot_rows=hot_rows, slot_us=slot_us).collect()
    assert sorted((bytes(r.payload), r.n_fragments, r.status) for r in found) == [
        (b"first---end1", 2, "reassembled"), (b"last----end4", 2, "reassembled"), (b"rotated-end2", 2, "reassembled"), (b"second--middle--end3", 3, "reassembled"),
    ]


def test_source_filter(spark):
    df = spark.createDataFrame([("udp", 47), ("tcp", 6)], "proto string, ip_proto int")
    assert [source_filter(df, p).count() for p in (None, "", "udp", "proto = 'tcp'", F.col("proto") == "x")] == [2, 2, 1, 1, 0]
    assert source_filter(df, "udp", mirror_mode=True).count() == 1
    with pytest.raises(ValueError):
        source_filter(df, "proto = 'tcp'", mirror_mode=True)
