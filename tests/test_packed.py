"""Packed rows and states, and timelines whose settled parts are put aside, against the same work without them."""

import random
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
import pytest

from callscope.operators.upsert import RETRACT
from callscope.streaming.calls import CallSessions
from callscope.streaming.media import AT_ENDPOINTS, OWNED, PACKET, REGISTER, WITHDRAW, CallEndpoints, EndpointOwners
from callscope.streaming.shares import KEY, PACKED, PACKS, SHARE, PackedProcessor, ShareProcessor, arrow_schema, names, of_bytes, pack, to_bytes, unpack
from callscope.streaming.timeline import Timeline
from tests.test_shares import At, Held
from tests.test_timeline import TIMEOUT, draw_rows


class Counts(ShareProcessor):
    columns, found = ("n",), ("total",)

    def take(self, key, held, rows, watermark_ms):
        total = int(held or 0) + sum(n for (n,) in rows)
        return (str(total) if total else None), None, [(total,)]


class Asked(Held):
    """Counts the reads and writes of maps."""

    def getMapState(self, name, key, value):
        inner, handle = super().getMapState(name, key, value), self

        class Map:
            def __getattr__(self, what):
                handle.asked += 1
                return getattr(inner, what)

        return Map()


def test_states_of_many_keys_are_few_packs():
    processor, handle = PackedProcessor(Counts(), arrow_schema(f"{KEY} string, total long")), Asked()
    processor.init(handle)

    def call(rows):
        frame = pd.DataFrame({PACKED: [to_bytes(pa.table({KEY: [f'["{k}"]' for k, _ in rows[a::2]], "n": [n for _, n in rows[a::2]]})) for a in (0, 1)]})
        out = list(processor.handleInputRows((0,), iter([frame]), At(0)))
        return {k: n for f in out for data in f[PACKED] for k, n in zip(*of_bytes(data).to_pydict().values())}

    rows = [(k, k + 1) for k in range(3000)]
    assert call(rows) == {f'["{k}"]': k + 1 for k in range(3000)} and handle.asked <= 2 * PACKS + 1
    before = handle.asked
    assert call([(5, 1), (7, -8)]) == {'["5"]': 7, '["7"]': 0} and handle.asked - before <= 4 + 1
    # A key without state leaves its pack, and a pack without keys the map.
    call([(k, -k - 1 if k not in (5, 7) else 0) for k in range(3000) if k not in (5, 7)] + [(5, -7)])
    assert not handle.maps["states"]


def test_rows_come_back_from_packs():
    n = 5000
    table = pa.table({SHARE: pa.array([i * 7 % 13 for i in range(n)], pa.int32()), KEY: [f"k{i}" for i in range(n)], "n": [i if i % 3 else None for i in range(n)]})
    packed = pa.Table.from_batches(pack(iter(table.to_batches(max_chunksize=900))))
    assert packed.num_rows == 13 and packed.column(SHARE).to_pylist() == list(range(13))
    back = pa.Table.from_batches(unpack(iter(packed.select([PACKED]).to_batches())))
    assert sorted(back.to_pylist(), key=lambda r: int(r[KEY][1:])) == table.drop_columns([SHARE]).to_pylist()


def media_rows(seed, n=150):
    """Rows of a call as ``CallSessions`` takes them, in order of time."""
    draw, out = random.Random(seed), []
    for us, no, kind, registered, text in draw_rows(seed, n):
        if kind == "media":
            out.append((us, no, False, False, None, None, None, *registered, draw.choice([no, no, no - 2]) % 65536, draw.choice([1, 2]), "s", "d"))
        else:
            out.append((us, no, kind == "open", kind == "close", text, "t", draw.choice([None, 20, 30]), *[None] * 6))
    return out


@pytest.mark.parametrize("seed", range(16))
def test_parts_put_aside_change_nothing(seed, monkeypatch):
    """Batches in order of time and with late rows: the same changes as when the whole timeline is read each time."""
    rows, draw = media_rows(seed), random.Random(seed)
    arriving = sorted(enumerate(rows), key=lambda r: r[0] + draw.choice([0, 0, 0, 0, draw.choice([0, 30, 90]) if seed % 2 else 0]))
    found, sizes = [], []
    for whole in (True, False):
        with monkeypatch.context() as patch:
            if whole:
                patch.setattr(Timeline, "put_aside", lambda self, before_us: None)
            processor, held, out, newest = CallSessions(TIMEOUT, None, True), None, [], 0
            for start in range(0, len(rows), 10):
                batch = [r for _, r in arriving[start : start + 10]]
                # Microseconds of the rows are milliseconds of the watermark, so that batches end before it.
                scaled = [(r[0] * 1000, *r[1:7], r[7] and r[7] * 1000, *r[8:]) for r in batch]
                processor.timeout_us = TIMEOUT * 1000
                held, due, some = processor.take("k", held, scaled, newest)
                out.append((due, some))
                newest = max(newest, *(r[0] for r in batch))
            last = Timeline.of(held)
            sizes.append((len(last.messages), len(last.aside)))
            last.recall()
            found.append((out, last.known, last.messages, last.media))
    assert found[0] == found[1]
    assert sizes[0][1] == 0 < sizes[1][1] and sizes[1][0] < sizes[0][0]
    assert seed % 2 or not any(c[1] == RETRACT for _, some in found[0][0] for c in some)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("keep_us", [None, 10**9])
def test_registrations_with_messages_put_aside(seed, keep_us):
    draw = random.Random(seed)
    rows = [(n * 10, n, draw.random() < 0.3, draw.random() < 0.2, f'[["10.0.0.{draw.randrange(5)}","{draw.randrange(3)}"]]' if draw.random() < 0.8 else "[]") for n in range(120)]
    arriving = sorted(rows, key=lambda r: r[1] + draw.choice([0, 0, 0, 60 if seed % 2 else 0]))
    processor, held, known = CallEndpoints(keep_us), None, {}
    for start in range(0, len(rows), 8):
        held, _, out = processor.take("k", held, arriving[start : start + 8], 0)
        for kind, ip, port, us, no, *ended in out:
            known.pop((ip, port, us, no), None)
            if kind == REGISTER:
                known[ip, port, us, no] = ended
    want, own, is_open = {}, [], False
    for us, no, opens, closes, endpoints in rows:
        is_open = is_open or opens
        for ip, port in eval(endpoints) if is_open else []:
            want[ip, port, us, no] = [None, None]
            own.append((ip, port, us, no))
        if closes:
            want |= {x: [us, no] for x in own} if is_open else {}
            is_open, own = False, []
    assert known == want


def looked_up(rows, keep_us, watermarks, forward=False):
    """Rows (key, kind, us, frame_no, call, ended_us, ended_no) in as many calls as there are watermarks."""
    processor, handle = EndpointOwners(keep_us, forward), Held()
    processor.init(handle)
    size, out = -(-len(rows) // len(watermarks)), []
    for n, at in enumerate(watermarks):
        part = rows[n * size : (n + 1) * size]
        columns = dict(zip((KEY, "kind", "us", "frame_no", "call_id", "ended_us", "ended_no"), zip(*part)))
        tables = [pa.table({c: pa.array(v) for c, v in columns.items()})] if part else []
        for table in processor.work(tables, at):
            assert table.schema == arrow_schema(f"{KEY} string, {AT_ENDPOINTS}") and table.column_names[1:] == names(AT_ENDPOINTS)
            out += table.to_pylist()
    return out, handle


@pytest.mark.parametrize("seed", range(10))
def test_owners_of_packets_looked_up_at_once(seed):
    """Against the newest registration found for each packet by itself."""
    draw = random.Random(seed)
    rows, registered = [], {}
    for n in range(600):
        key, us = f'["e{draw.randrange(6)}"]', n * 1000 + draw.choice([0, 0, 7000])
        kind = draw.choices([REGISTER, PACKET, WITHDRAW], [3, 8, 1])[0]
        if kind == WITHDRAW and registered.get(key):
            place = draw.choice(sorted(registered[key]))
            del registered[key][place]
            rows.append((key, WITHDRAW, *place, None, None))
        elif kind == REGISTER:
            place, ended = (us, n, f"c{draw.randrange(4)}"), draw.choice([(None, None), (us + 9000, n + 1)])
            registered.setdefault(key, {})[place] = ended
            rows.append((key, REGISTER, *place, *ended))
        else:
            rows.append((key, PACKET, us, n, None, None, None))
    rows.append(('["e1"]', OWNED, 5, 10_000, "c9", None, None))
    want = {(10_000, "c9", None, None)}
    for key, kind, us, no, *_ in rows:
        if kind == PACKET:
            places = sorted(registered.get(key, {}))
            i = bisect_right([p[:2] for p in places], (us, no)) - 1
            ended = registered[key][places[i]] if i >= 0 else (None, None)
            none = i < 0 or (ended[0] is not None and (us, no) > ended)
            want.add((no, None, None, None) if none else (no, places[i][2], *places[i][:2]))
    # Nothing is looked up before all rows are there, then all at once.
    out, handle = looked_up(rows, None, [-1, -1, -1, 10**6])
    assert {(r["frame_no"], r["call_id"], r["registered_us"], r["registered_no"]) for r in out} == want and len(out) == len(want)
    assert all((r["kind"] == OWNED) == (r["call_id"] is not None) for r in out) and not handle.maps["waiting"] and not handle.values
    forwarded, _ = looked_up(rows, None, [-1, -1, -1, 10**6], forward=True)
    assert [r["frame_no"] for r in forwarded if r["kind"] in (REGISTER, WITHDRAW)] == [r[3] for r in rows if r[1] in (REGISTER, WITHDRAW)]


def test_packets_wait_in_segments_and_old_registrations_go():
    rows = [('["a"]', REGISTER, 1000, 1, "c", 9000, 9), *[('["a"]', PACKET, n * 1000, n, None, None, None) for n in range(2, 30)]]
    out, handle = looked_up(rows, 5000, [0, 12, 12, 40, 41])
    assert [(r["frame_no"], r["call_id"]) for r in sorted(out, key=lambda r: r["frame_no"])] == [(n, "c" if n <= 9 else None) for n in range(2, 30)]
    assert not handle.maps["states"] and not handle.maps["waiting"] and not handle.values


def test_streams_work_out_registrations_once(spark, tmp_path):
    """Four stateful operators, and owned packets of one source don't meet in one share."""
    from callscope.queries.tables import _streamed
    from callscope.plans.calls import closes, opens
    from callscope.streaming.calls import use_rocksdb
    from callscope.streaming.media import stream_calls
    from tests.test_shares import write_events

    use_rocksdb(spark)
    write_events(spark, tmp_path, range(100))
    messages, packets, _ = _streamed(spark, str(tmp_path))
    plan = stream_calls(messages, packets, opens(), closes(), 10**9)._jdf.queryExecution().analyzed().toString()
    # The messages are dealt once, for two of them.
    assert plan.count("TransformWithStateInPySpark") == 4
