"""The state of a streamed call, row by row in any order, against folds of the rows in time order."""

import random

import pytest

from callscope.operators.sessions import ACTIVE, FINISHED, TIMED_OUT
from callscope.operators.upsert import INSERT, RETRACT, UPDATE
from callscope.streaming.statistics import StreamSummary, minus, union, wrap16
from callscope.streaming.timeline import Timeline

TIMEOUT = 100


def plain_sessions(rows, timeout, now):
    """(start, last, state, messages, from) by walking (us, no, kind, registered, text) in order; kind is open, close, other or media."""
    out, current, before, closed, since, seen = [], None, None, False, None, []
    for us, no, kind, registered, text in sorted(rows):
        if before is None or closed or us - before > timeout:
            if current and current[2] == ACTIVE:
                current[2] = TIMED_OUT
            current, closed, since = None, False, (us, no)
        if kind == "media":
            if current and registered >= since:
                current[1] = us
        else:
            if current is None and kind == "open":
                current = [us, us, ACTIVE, 0, text]
                out.append(current)
            if current:
                current[1], current[3] = us, current[3] + 1
                current[4] = text if len(text) > len(current[4]) else current[4]
            if kind == "close":
                closed = True
                if current:
                    current[2] = FINISHED
                    current = None
        before = us
    if out and out[-1][2] == ACTIVE and now - out[-1][1] > timeout:
        out[-1][2] = TIMED_OUT
    return [tuple(x) for x in out]


def draw_rows(seed, n=60):
    draw = random.Random(seed)
    rows, us, opened, ended = [], 0, None, True
    for no in range(n):
        us += draw.choice([1, 5, 20, 60, 150])
        kind = draw.choices(["open", "close", "other", "media"], [2, 1, 2, 6])[0]
        if kind == "open" and ended:
            opened, ended = (us, no), False
        if kind == "media" and (opened is None or ended):
            kind = "other"
        rows.append((us, no, kind, opened if kind == "media" else None, "t" * draw.randrange(6)))
        if kind == "close":
            ended = True
    return rows


def fold_changes(changes):
    """The calls that a reader of all changes sees: (start, end, state, from)."""
    retracted = {}
    for c in changes:
        if c[1] == RETRACT:
            retracted[c[0]] = max(retracted.get(c[0], 0), c[9])
    live = [c for c in changes if c[1] != RETRACT and c[9] >= retracted.get(c[0], 0)]
    out = {}
    for c in sorted(live, key=lambda c: (c[4], c[1] == UPDATE, c[5] != ACTIVE)):
        start, end, state, text = out.get(c[0], (c[2], None, ACTIVE, ""))
        text = c[6] if len(c[6] or "") > len(text) else text
        out[c[0]] = (start, c[4] if c[5] != ACTIVE else end, c[5] if c[1] == UPDATE else state, text)
    return sorted(out.values())


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("batch", [1, 7, 60])
def test_any_order_gives_the_sessions_of_time_order(seed, batch):
    rows = draw_rows(seed)
    now = rows[-1][0]
    want = plain_sessions(rows, TIMEOUT, now)
    shuffled = rows[:]
    if seed % 3:
        random.Random(seed).shuffle(shuffled)
    timeline, changes, newest = Timeline(), [], 0
    for start in range(0, len(shuffled), batch):
        timeline = Timeline.of(timeline.text())
        for us, no, kind, registered, text in shuffled[start : start + batch]:
            newest = max(newest, us)
            if kind == "media":
                timeline.add_media(us, no, registered, TIMEOUT)
            else:
                timeline.add_message(us, no, kind == "open", kind == "close", text, None)
        changes += timeline.advance(TIMEOUT, newest)
    found = timeline.known
    assert [(s.start_us, s.last_us, s.state, s.n_rows, s.sip_from) for s in found] == want
    assert fold_changes(changes) == sorted((a, b if c != ACTIVE else None, c, e) for a, b, c, _, e in want)
    # The state holds stretches of media, not packets.
    assert len(timeline.media) <= sum(k != "media" for _, _, k, _, _ in rows) + 12


def test_in_time_order_nothing_is_retracted():
    rows = draw_rows(3)
    timeline, kinds = Timeline(), set()
    for us, no, kind, registered, text in rows:
        if kind == "media":
            timeline.add_media(us, no, registered, TIMEOUT)
        else:
            timeline.add_message(us, no, kind == "open", kind == "close", text, None)
        kinds |= {c[1] for c in timeline.advance(TIMEOUT, us)}
    assert kinds == {INSERT, UPDATE}


def test_forgetting_leaves_later_calls_alone():
    rows = draw_rows(5, 200)
    now = rows[-1][0]
    whole, kept, changes = Timeline(), Timeline(), []
    for us, no, kind, registered, text in rows:
        for timeline in (whole, kept):
            if kind == "media":
                timeline.add_media(us, no, registered, TIMEOUT)
            else:
                timeline.add_message(us, no, kind == "open", kind == "close", text, None)
        changes += kept.advance(TIMEOUT, us)
        kept.forget(us - 2 * TIMEOUT)
        assert kept.due(TIMEOUT, 2 * TIMEOUT) is None or kept.due(TIMEOUT, 2 * TIMEOUT) >= us
    assert fold_changes(changes) == sorted((a, b if c != ACTIVE else None, c, e) for a, b, c, _, e in plain_sessions(rows, TIMEOUT, now))
    assert len(kept.messages) < len(whole.messages) / 2


def plain_statistics(packets):
    """(count, lost, late, copies) by unwrapping one number after the other."""
    ext, highest, seen, late, last = 0, None, set(), 0, None
    first = None
    for seq in packets:
        ext = ext + wrap16(seq - last) if last is not None else seq
        first = ext if first is None else first
        if ext not in seen and highest is not None and ext < highest:
            late += 1
        seen.add(ext)
        highest = ext if highest is None else max(highest, ext)
        last = seq
    return len(packets), max(highest - first + 1 - len(seen), 0), late, len(packets) - len(seen)


@pytest.mark.parametrize("seed", range(20))
def test_summaries_join_to_that_of_the_whole(seed):
    draw = random.Random(seed)
    numbers, n = [], 65000
    for _ in range(300):
        n += draw.choice([1, 1, 1, 1, 2, 3, 0, -1, -2, draw.choice([40, -40])])
        numbers.append(n % 65536)
    times = sorted(draw.randrange(10_000) for _ in numbers)
    cuts = sorted({0, len(numbers), *draw.sample(range(1, 300), draw.choice([1, 5, 60]))})
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        part = StreamSummary.of(numbers[a], times[a])
        for seq, us in zip(numbers[a + 1 : b], times[a + 1 : b]):
            part.add(seq, us)
        parts.append(StreamSummary(*part.listed()))
    while len(parts) > 1:  # in any nesting
        i = draw.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i].then(parts[i + 1])]
    found = parts[0].statistics()
    assert (found["packet_count"], found["lost_packets"], found["out_of_order_count"], found["duplicate_count"]) == plain_statistics(numbers)
    deltas = [b - a for a, b in zip(times, times[1:])]
    assert (found["min_delta_ms"], found["max_delta_ms"]) == (min(deltas) / 1000, max(deltas) / 1000)
    assert found["avg_delta_ms"] == pytest.approx(sum(deltas) / len(deltas) / 1000)


def test_a_regular_stream_is_one_run():
    summary = StreamSummary.of(65530, 0)
    for i in range(1, 200_000):
        summary.add((65530 + i) % 65536, i * 20)
    assert summary.in_order == [[0, 199_999]] and not summary.late and summary.statistics()["lost_packets"] == 0


def test_runs():
    draw = random.Random(2)
    for _ in range(300):
        a, b = ({draw.randrange(30) for _ in range(draw.randrange(20))} for _ in range(2))
        runs = lambda x: union([], [[i, i] for i in x])
        numbers = lambda r: {i for f, e in r for i in range(f, e + 1)}
        assert numbers(union(runs(a), runs(b))) == a | b and numbers(minus(runs(a), runs(b))) == a - b
