"""A generated capture through the whole analysis, against a fold that goes packet by packet."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from callscope.functions.privacy import PrivacyRules
from callscope.operators.packets import mirror_sessions
from callscope.options import Options
from callscope.plans.calls import analyse_calls, call_packets
from callscope.plans.reports import call_lookup, calls_by_state, worst_loss_first
from callscope.sinks.pcap import write_capture_files
from callscope.sinks.tables import CallsTable, call_changes, call_statistics, detected_calls, write_call_packets, write_outputs
from callscope.sources.pcap import load_packets, read_pcap, unread_bytes
from tests import capture as c

S = 1_000_000
T0 = 1_700_000_000 * S


def build_events(seed, n_calls=12):
    """(us, kind, ...) in time order: messages and media of calls that overlap, reuse endpoints, time out, and come back."""
    rng = random.Random(seed)
    events = []
    for k in range(n_calls):
        start = T0 + rng.randrange(0, 600) * S + rng.randrange(S)
        call_id = f"call-{k % 9}"
        ip, port = f"10.0.0.{rng.randrange(1, 4)}", 10000 + 2 * rng.randrange(4)
        other = 20000 + k
        if rng.random() < 0.2:
            events.append((start - 2 * S, "sip", "OPTIONS", call_id, None))
        events.append((start, "sip", "INVITE", call_id, (ip, port, 20)))
        events.append((start + S, "sip", "SIP/2.0 200 OK", call_id, ("10.9.0.1", other, 30) if rng.random() < 0.7 else None))
        length = rng.randrange(3, 90)
        seq, ssrc = rng.randrange(65500, 65536), 1000 + k
        at = start + 2 * S
        for i in range(length):
            at += rng.choice([20_000, 20_000, 40_000, 2 * S]) + rng.randrange(1000)
            if rng.random() < 0.03:
                at += 70 * S
            step = rng.choice([0, 1, 1, 1, 1, 2, -1])
            seq += step
            events.append((at, "rtp", ip, port, seq & 0xFFFF, ssrc))
            if rng.random() < 0.3:
                events.append((at + 7, "rtp", "10.77.0.1", 7, i, ssrc + 500, "10.9.0.1", other))
        if rng.random() < 0.6:
            events.append((at + S, "sip", rng.choice(["BYE", "CANCEL"]), call_id, None))
            events.append((at + 2 * S, "sip", "SIP/2.0 200 OK", call_id, None))
    events.sort(key=lambda e: e[0])
    return events


def frames_of(events):
    out = []
    for e in events:
        if e[1] == "sip":
            body = c.sdp(*e[4]) if e[4] else ""
            long_from = "A <sip:a@x>;tag=" + "x" * (e[0] % 5)
            out.append((e[0], c.frame("1.1.1.1", 5060, "2.2.2.2", 5060, c.sip(e[2], e[3], sip_from=long_from, body=body))))
        else:
            src = (e[6], e[7]) if len(e) > 6 else ("10.50.0.1", 40000)
            out.append((e[0], c.frame(src[0], src[1], e[2], e[3], c.rtp(e[4], e[5]))))
    return out


def fold(events, timeout):
    """Calls and streams, one event at a time."""
    active, owner, done = {}, {}, []

    def finish(call, end, state):
        call.update(end=end, state=state)
        done.append(call)
        del active[call["id"]]
        for e in [e for e, o in owner.items() if o is call]:
            del owner[e]

    for e in events:
        us = e[0]
        for call in [x for x in active.values() if us - x["last"] > timeout]:
            finish(call, call["last"], "timedout")
        if e[1] == "sip":
            call = active.get(e[3])
            if call is None:
                if e[2] != "INVITE":
                    continue
                call = active[e[3]] = {"id": e[3], "start": us, "ptime": 20, "streams": {}, "n": 0, "from": ""}
            call["last"] = us
            call["n"] += 1
            new_from = "A <sip:a@x>;tag=" + "x" * (us % 5)
            if len(new_from) > len(call["from"]):
                call["from"] = new_from
            if e[4]:
                owner[e[4][:2]] = call
                call["ptime"] = e[4][2]
            if e[2] in ("BYE", "CANCEL"):
                finish(call, us, "finished")
        else:
            src = (e[6], e[7]) if len(e) > 6 else ("10.50.0.1", 40000)
            call = owner.get((e[2], e[3])) or owner.get(src)
            if call is None:
                continue
            call["last"] = us
            call["n"] += 1
            call["streams"].setdefault(e[5], []).append((us, e[4]))
    end = max(e[0] for e in events)
    for call in list(active.values()):
        finish(call, end, "finished")
    return done


def stream_fold(packets):
    seqs, deltas, late, dup, seen, top = [], [], 0, 0, set(), None
    ext = None
    for i, (us, seq) in enumerate(packets):
        ext = seq if ext is None else ext + ((seq - last + 32768) % 65536 - 32768)
        last = seq
        if ext in seen:
            dup += 1
        elif top is not None and ext < top:
            late += 1
        seen.add(ext)
        seqs.append(ext)
        top = ext if top is None else max(top, ext)
        if i:
            deltas.append(us - packets[i - 1][0])
    lost = max(max(seqs) - seqs[0] + 1 - len(seen), 0)
    return len(packets), lost, late, dup, max([0, *deltas]) / 1000, (min(deltas) if deltas else 0) / 1000


@pytest.mark.parametrize("seed,hot_rows,slot_us", [(1, 10**6, S), (2, 3, 5 * S)])
def test_capture_to_calls(spark, tmp_path, seed, hot_rows, slot_us):
    events = build_events(seed)
    c.write_pcap(tmp_path / "a.pcap", frames_of(events))
    packets = read_pcap(spark, str(tmp_path / "a.pcap"), split_bytes=2000)
    options = Options("5060-5060", call_timeout_us=60 * S, hot_rows=hot_rows, slot_us=slot_us)
    result = analyse_calls(packets.checkpoint(), options)
    want = fold(events, 60 * S)
    calls = result.calls.withColumns({"s": F.unix_micros("start_ts"), "e": F.unix_micros("end_ts")}).collect()
    got = sorted((r.call_id, r.s, r.e, r.state, r.ptime_ms, r.sip_packets + r.media_packets, r.sip_from) for r in calls)
    assert got == sorted((w["id"], w["start"], w["end"], w["state"], w["ptime"], w["n"], w["from"]) for w in want)
    streams = result.streams.withColumn("s", F.unix_micros("start_ts")).collect()
    got = sorted(
        (r.call_id, r.s, r.ssrc, r.packet_count, r.lost_packets, r.out_of_order_count, r.duplicate_count, r.max_delta_ms, r.min_delta_ms)
        for r in streams
    )
    assert got == sorted((w["id"], w["start"], k, *stream_fold(p)) for w in want for k, p in w["streams"].items())


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    events = build_events(5)
    path = tmp_path_factory.mktemp("cap") / "a.pcap"
    c.write_pcap(path, frames_of(events))
    packets = load_packets(spark, path=str(path)).checkpoint()
    rules = PrivacyRules(for_call_id="call-[0-3]")
    options = Options("5060-5060", call_timeout_us=60 * S, privacy=rules)
    return events, packets, options, analyse_calls(packets, options)


def test_packets_of_calls(spark, tmp_path, analysis):
    events, packets, options, result = analysis
    rows = call_packets(result, options)
    private = {f"call-{i}" for i in range(4)}
    assert rows.filter(F.col("method").isNull() & F.col("call_id").isin(*private)).isEmpty()
    write_call_packets(rows, str(tmp_path / "parquet"))
    stored = spark.read.parquet(str(tmp_path / "parquet"))
    assert stored.count() == rows.count()
    write_capture_files(spark, rows, str(tmp_path / "files"))
    back = read_pcap(spark, str(tmp_path / "files" / "*.pcap"))
    assert back.count() == rows.count()
    one = rows.filter("call_file = '%s'" % c.file_name("call-5")).orderBy("ts", "frame_no").select("data").collect()
    again = back.filter(F.col("capture_file").endswith(c.file_name("call-5"))).orderBy("frame_no").select("data").collect()
    assert [bytes(r.data) for r in one] == [bytes(r.data) for r in again]
    # One file per call, under the call's own name.
    names = {r.call_file for r in rows.select("call_file").distinct().collect()}
    assert {p.name for p in (tmp_path / "files").glob("*.pcap")} == names


def test_zeroed_media(analysis):
    events, packets, options, result = analysis
    from dataclasses import replace

    rows = call_packets(result, replace(options, privacy_mode="zero"))
    media = rows.filter(F.col("method").isNull() & F.col("clear_media"))
    assert not media.isEmpty()
    assert {bytes(r.data)[-20:] for r in media.select("data").collect()} == {bytes(20)}
    assert media.filter(F.octet_length("data") != F.col("cap_len")).isEmpty()


def test_tables(spark, tmp_path, analysis):
    events, packets, options, result = analysis
    write_outputs(result.calls, result.streams, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "detected_calls"), header=True).count() == result.calls.count()
    statistics = spark.read.csv(str(tmp_path / "call_statistics"), header=True)
    assert statistics.columns == call_statistics(result.streams).columns
    assert statistics.count() == result.streams.count()
    assert len(detected_calls(result.calls).columns) == 6

    write_outputs(result.calls, result.streams, str(tmp_path), sink="table")
    table = CallsTable(spark, str(tmp_path / "sip_calls"))
    stored = table.read()
    want = {(r.call_id, r.call_seq): r.state for r in result.calls.collect()}
    assert {(r.call_id, r.call_seq): r.state for r in stored.collect()} == want
    table.compact()
    table.append(call_changes(result.calls, result.streams))
    assert {(r.call_id, r.call_seq): r.state for r in table.read().collect()} == want
    assert calls_by_state(stored, "finished").count() == sum(s == "finished" for s in want.values())
    losses = [r.lost_packets for r in worst_loss_first(stored, 0).collect()]
    assert losses == sorted(losses, reverse=True) and losses
    assert '"ssrc"' in call_lookup(stored, "call-1").first().rtp_stats


def test_mirrored_and_fragmented(spark, tmp_path):
    body = c.sdp("10.0.0.1", 10000)
    invite = c.frame("1.1.1.1", 5060, "2.2.2.2", 5060, c.sip("INVITE", "m", body=body))
    other = c.frame("1.1.1.1", 5060, "2.2.2.2", 5060, c.sip("INVITE", "other"))
    datagram = c.udp(4000, 10000, c.rtp(1, 9, b"\x11" * 60))
    pieces = [datagram[i : i + 24] for i in range(0, len(datagram), 24)]
    records = [(T0, c.mirror2(invite, 5, 100)), (T0 + 1, c.mirror2(other, 6, 100))]
    for i, piece in list(enumerate(pieces))[::-1]:
        inner = c.ether(c.ip4("3.3.3.3", "10.0.0.1", 17, piece, ident=77, more=i < len(pieces) - 1, offset=24 * i))
        records.append((T0 + 10 + len(records), c.mirror2(inner, 5, 100)))
    # An outer mirror packet that was itself cut in two.
    outer = c.mirror2(c.frame("3.3.3.3", 4000, "10.0.0.1", 10000, c.rtp(2, 9)), 5, 100)
    whole = outer[34:]
    for i, (a, b) in enumerate([(0, 40), (40, len(whole))]):
        records.append((T0 + 100 + i, c.ether(c.ip4("9.0.0.1", "9.0.0.2", 47, whole[a:b], ident=5, more=i == 0, offset=a))))
    c.write_pcap(tmp_path / "m.pcap", records)
    options = Options("5060-5061", mirror_enabled=True, mirror_span_ids="5", mirror_vlans="0x64", reassemble=True)
    result = analyse_calls(read_pcap(spark, str(tmp_path / "m.pcap")).checkpoint(), options)
    assert [r.call_id for r in result.calls.collect()] == ["m"]
    stream = result.streams.collect()
    assert [(r.ssrc, r.packet_count, r.lost_packets) for r in stream] == [(9, 2, 0)]
    sessions = mirror_sessions(result.timeline.filter("method is not null"), ["call_id"], ["ts", "frame_no"]).collect()
    assert [(r.call_id, r.span_id, r.vlan, r.version, r.packet_count) for r in sessions] == [("m", 5, 100, 1, 1)]


def test_source_takes_media_of_timed_out_calls(spark, tmp_path):
    """A call goes silent; later its endpoint gets media from the endpoint of a live call, which that media keeps alive."""
    second = 1_000_000
    invite = lambda name, ip, port: c.frame("1.1.1.1", 5060, "2.2.2.2", 5060, c.sip("INVITE", name, body=c.sdp(ip, port)))
    records = [(T0, invite("silent", "10.0.0.1", 10000)), (T0 + second, invite("live", "10.0.0.2", 20000)), (T0 + 8 * second, invite("live", "10.0.0.2", 20000))]
    records += [(T0 + (10 + i) * second, c.frame("10.0.0.2", 20000, "10.0.0.1", 10000, c.rtp(i, 5))) for i in range(9)]
    c.write_pcap(tmp_path / "s.pcap", records)
    options = Options("5060-5061", call_timeout_us=5 * second)
    result = analyse_calls(read_pcap(spark, str(tmp_path / "s.pcap")).checkpoint(), options)
    got = {(r.call_id, r.call_seq): (r.media_packets, r.state) for r in result.calls.collect()}
    assert got.pop(("silent", 0)) == (0, "timedout")
    assert sum(n for n, _ in got.values()) == 9 and {k for k, _ in got} == {"live"}
    assert [(r.call_id, r.packet_count, r.lost_packets) for r in result.streams.collect()] == [("live", 9, 0)]


@pytest.mark.parametrize("order,nano", [("<", False), (">", False), ("<", True), (">", True)])
def test_capture_formats(spark, tmp_path, order, nano):
    records = [(T0 + i * 1000, bytes([i]) * (i + 1)) for i in range(50)]
    c.write_pcap(tmp_path / "x.pcap", records, order=order, nano=nano)
    rows = read_pcap(spark, str(tmp_path / "x.pcap"), split_bytes=300).orderBy("frame_no").collect()
    assert [(int(r.ts.timestamp() * 1e6 + 0.5), bytes(r.data)) for r in rows] == records
    assert [r.frame_no for r in rows] == list(range(1, 51))


def test_large_capture_is_cut_without_a_pass_over_it(spark, tmp_path):
    """Pieces find their first record by themselves; payloads that look like record headers don't mislead, and a file that can't be cut so is still read."""
    from callscope.sources import pcap

    draw = random.Random(4)
    fake = struct.pack("<IIII", T0 // 1_000_000, 5, 60, 60)
    records = [(T0 + i * 1000, draw.randbytes(draw.randrange(1, 1400)) + fake * draw.choice([0, 0, 1, 40])) for i in range(800)]
    c.write_pcap(tmp_path / "x.pcap", records)
    c.write_pcap(tmp_path / "decoy.pcap", [(T0, fake * 3), *[(T0 + i, (struct.pack("<IIII", T0 // 1_000_000, 5, 16, 16) + bytes(16)) * 60) for i in range(40)]])
    c.write_pcap(tmp_path / "empty.pcap", [])
    c.write_pcap(tmp_path / "long.pcap", [(T0, b"x" * 100_000), (T0 + 1, b"y"), (T0 + 2, b"z" * 50_000)])
    for split in (700, 5000, 100_000, 1 << 26):
        rows = read_pcap(spark, str(tmp_path / "*.pcap"), split_bytes=split)
        found = {}
        for r in sorted(rows.collect(), key=lambda r: r.frame_no):
            found.setdefault(r.capture_file.split("/")[-1], []).append((r.frame_no, bytes(r.data)))
        assert found["x.pcap"] == list(enumerate((d for _, d in records), 1))
        assert len(found["decoy.pcap"]) == 41 and [len(d) for _, d in found["long.pcap"]] == [100_000, 1, 50_000] and "empty.pcap" not in found
    size = (tmp_path / "x.pcap").stat().st_size
    pieces = [{"at": 24, "start": 24, "stop": 90, "n": 2}, {"at": 80, "start": 90, "stop": size, "n": 3}]
    assert pcap._joined(pieces, size) == [(24, 90, 1), (90, size, 3)]
    assert pcap._joined([pieces[0], pieces[1] | {"start": 91}], size) == []


def test_very_long_call_is_written_by_many_tasks(spark, tmp_path):
    second = 1_000_000
    packets = [(i * second, bytes([i % 250]) * 20, "long.pcap") for i in range(300)] + [(i * second, b"s" * 20, "short.pcap") for i in range(40)]
    rows = spark.createDataFrame(packets, "us long, data binary, call_file string").selectExpr(
        "timestamp_micros(us) AS ts", "us AS frame_no", "length(data) AS orig_len", "1 AS link_type", "data", "call_file"
    )
    write_capture_files(spark, rows, str(tmp_path / "out"), hot_rows=100, slot_us=60 * second)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == [*(f"long~{k:04d}.pcap" for k in range(5)), "short.pcap"]
    back = read_pcap(spark, str(tmp_path / "out" / "long*.pcap")).orderBy("capture_file", "frame_no").collect()
    assert [bytes(r.data) for r in back] == [d for _, d, n in packets if n == "long.pcap"]


def test_cut_off_capture(spark, tmp_path):
    records = [(T0 + i, bytes([i]) * 40) for i in range(30)]
    c.write_pcap(tmp_path / "cut.pcap", records)
    data = (tmp_path / "cut.pcap").read_bytes()
    (tmp_path / "cut.pcap").write_bytes(data[:-7])
    c.write_pcap(tmp_path / "whole.pcap", records)
    for split in (200, 1 << 20):
        assert read_pcap(spark, str(tmp_path / "*.pcap"), split_bytes=split).count() == 59
        assert [(r.at, r.bytes) for r in unread_bytes(spark, str(tmp_path / "*.pcap"), split_bytes=split).collect()] == [(len(data) - 56, 49)]


def test_one_source_only(spark):
    with pytest.raises(ValueError):
        load_packets(spark)
