"""The timeline of one call as a stream knows it, in whatever order its rows arrive, and the changes that a new row brings."""

from __future__ import annotations

import json
import pickle
from bisect import insort
from dataclasses import dataclass, field

from callscope.operators.sessions import ACTIVE, FINISHED, TIMED_OUT
from callscope.operators.sequence import DEFAULT_PTIME_MS
from callscope.operators.upsert import INSERT, RETRACT, UPDATE
from callscope.streaming.statistics import StreamSummary

#: Calls that start in one microsecond are told apart by their number there.
SAME_START = 16


@dataclass
class Session:
    """One call: position and texts of its opening message, and what has been seen since."""

    start_us: int
    opened_from: str | None
    opened_to: str | None
    last_us: int
    sip_from: str | None
    sip_to: str | None
    n_rows: int = 0
    state: str = ACTIVE
    name: int = 0
    ptime_ms: int | None = None
    statistics: str | None = None
    start_no: int = 0
    nth: int = 0
    boundary: tuple[int, int] = (-(1 << 62), 0)

    def listed(self) -> tuple:
        return (
            self.start_us, self.opened_from, self.opened_to, self.last_us, self.sip_from, self.sip_to, self.n_rows, self.state, self.name, self.ptime_ms, self.statistics, self.start_no, self.nth,
            self.boundary,
        )


def _longer(old: str | None, new: str | None) -> str | None:
    return new if new is not None and new != old and len(new.encode()) > len((old or "").encode()) else old


def _listed(streams: dict[int, list[list]]) -> dict[int, list[tuple]]:
    return {ssrc: [(*p[:6], p[6].listed()) for p in parts] for ssrc, parts in streams.items()}


def _of_listed(streams: dict[int, list[tuple]]) -> dict[int, list[list]]:
    return {ssrc: [[*p[:6], StreamSummary(*p[6])] for p in parts] for ssrc, parts in streams.items()}


@dataclass
class Timeline:
    """
    What the state of a call holds: its messages in order, the stretches of its media, and the calls that were handed on.

    A message is (us, frame_no, opens, closes, sip_from, sip_to, ptime). A stretch [us, frame_no, last us, registered us, registered frame_no] stands for media packets that the
    call got by one registration, none of them silent for longer than the timeout, however many: its two ends say all that sessions
    need of it. A late message or packet changes the lists, and the calls are derived anew: stretches merge, calls split or grow together.

    `streams` holds for each SSRC what its packets add up to, in their order: parts [registered us, registered frame_no, us, frame_no, source, destination, StreamSummary], a new one where
    packets come by another registration or after a silence that may have ended the call. Parts that follow each other in one call are joined.

    `aside` holds earlier parts of the timeline, which end with a closing message (`floor`) and are read again only for rows of their time.
    """

    messages: list[tuple] = field(default_factory=list)
    media: list[list] = field(default_factory=list)
    known: list[Session] = field(default_factory=list)
    revision: int = 0
    floor: tuple[int, int] = (-(1 << 62), 0)
    streams: dict[int, list[list]] = field(default_factory=dict)
    aside: list[bytes] = field(default_factory=list)

    @staticmethod
    def of(text: bytes | None) -> Timeline:
        if text is None:
            return Timeline()
        messages, media, known, revision, floor, streams, aside = pickle.loads(text)
        return Timeline(messages, media, [Session(*s) for s in known], revision, floor, _of_listed(streams), aside)

    def text(self) -> bytes:
        known = [s.listed() for s in self.known]
        return pickle.dumps((self.messages, self.media, known, self.revision, self.floor, _listed(self.streams), self.aside), protocol=5)

    def put_aside(self, before_us: int) -> None:
        """
        Put aside what ends with the last closing message before a moment.

        A closing message is a break whatever comes after it, so that the rest is a timeline of its own, whose floor is the message. Nothing may lie on both sides of it.
        """
        for i in range(len(self.messages) - 1, -1, -1):
            us, frame_no, _, closes, *_ = self.messages[i]
            if not closes or us >= before_us or (i + 1 < len(self.messages) and self.messages[i + 1][0] <= us):
                continue
            ends = [(x[0], x[2]) for x in self.media] + [(p[2], p[6].last_us) for parts in self.streams.values() for p in parts]
            if not all((a < us and b < us) or (a > us and b > us) for a, b in ends):
                continue
            # Parts of streams keep the order in which they came.
            if any(p[2] > us > q[2] for parts in self.streams.values() for p, q in zip(parts, parts[1:])):
                continue
            early, late = {}, {}
            for ssrc, parts in self.streams.items():
                for p in parts:
                    (early if p[2] < us else late).setdefault(ssrc, []).append(p)
            known = [s.listed() for s in self.known if s.start_us <= us]
            self.aside.append(pickle.dumps((self.messages[: i + 1], [x for x in self.media if x[0] < us], known, self.floor, _listed(early)), protocol=5))
            self.messages, self.media = self.messages[i + 1 :], [x for x in self.media if x[0] > us]
            self.known, self.streams, self.floor = [s for s in self.known if s.start_us > us], late, (us, frame_no)
            return

    def recall(self) -> None:
        """Take all that was put aside back."""
        for text in reversed(self.aside):
            messages, media, known, self.floor, streams = pickle.loads(text)
            self.messages, self.media, self.known = messages + self.messages, media + self.media, [Session(*s) for s in known] + self.known
            for ssrc, parts in _of_listed(streams).items():
                self.streams[ssrc] = parts + self.streams.get(ssrc, [])
        self.aside = []

    def add_message(self, us: int, frame_no: int, opens: bool, closes: bool, sip_from: str | None, sip_to: str | None, ptime: int | None = None) -> None:
        insort(self.messages, (us, frame_no, opens, closes, sip_from, sip_to, ptime), key=lambda m: m[:2])

    def add_packet(self, ssrc: int, seq: int, us: int, frame_no: int, registered: tuple[int, int], source: str, destination: str, timeout_us: int) -> None:
        """A media packet's number, for the statistics of its stream; one that comes late counts where it comes."""
        parts = self.streams.setdefault(ssrc, [])
        if parts and tuple(parts[-1][:2]) == registered and (timeout_us <= 0 or us - parts[-1][6].last_us <= timeout_us):
            parts[-1][6].add(seq, us)
        else:
            parts.append([*registered, us, frame_no, source, destination, StreamSummary.of(seq, us)])

    def add_media(self, us: int, frame_no: int, registered: tuple[int, int], timeout_us: int) -> None:
        """One packet. Stretches of one registration that come within the timeout of each other become one."""
        own = [x for x in self.media if (x[3], x[4]) == registered]
        near = [x for x in own if timeout_us <= 0 or (x[0] - us <= timeout_us and us - x[2] <= timeout_us)]
        merged = [us, frame_no, us, *registered]
        for x in near:
            if (x[0], x[1]) < (merged[0], merged[1]):
                merged[0], merged[1] = x[0], x[1]
            merged[2] = max(merged[2], x[2])
        if near:
            self.media = [x for x in self.media if not any(x is y for y in near)]
        insort(self.media, merged, key=lambda m: m[:2])

    def sessions(self, timeout_us: int, now_us: int | None) -> list[Session]:
        """
        The calls of the timeline: opened by an opening message, ended by a closing one or a silence longer than the timeout.

        Open calls are judged at `now_us`. Media counts for a call if it was registered after the break before the call.
        """
        points = [(m[0], m[1], 0, m) for m in self.messages]
        for x in self.media:
            points += [(x[0], x[1], 1, x), (x[2], x[1] if x[0] == x[2] else 1 << 62, 2, x)]
        points.sort(key=lambda p: p[:3])
        found: list[Session] = []
        current: Session | None = None
        held_until: int | None = None  # the last activity up to here, and as far as a stretch that has begun reaches
        closed, boundary, before = False, self.floor, self.floor
        for us, frame_no, kind, row in points:
            silent = held_until is not None and timeout_us > 0 and us - held_until > timeout_us
            if closed or silent:
                if current is not None:
                    current.state, current = TIMED_OUT, None
                boundary, closed = before, False
            if kind == 0:
                if current is None and row[2]:
                    current = Session(us, row[4], row[5], us, row[4], row[5], start_no=frame_no, boundary=boundary)
                    found.append(current)
                if current is not None:
                    current.ptime_ms = row[6] if row[6] is not None else current.ptime_ms
                    current.last_us, current.n_rows = max(current.last_us, us), current.n_rows + 1
                    current.sip_from, current.sip_to = _longer(current.sip_from, row[4]), _longer(current.sip_to, row[5])
                if row[3]:
                    closed = True
                    if current is not None:
                        current.last_us, current.state, current = us, FINISHED, None
                before = (us, frame_no)
            else:
                if current is not None and (row[3], row[4]) > boundary:
                    current.last_us = max(current.last_us, us)
                before = max(before, (us, frame_no))
            held_until = max(us if held_until is None else held_until, us, row[2] if kind else us)
        if current is not None and timeout_us > 0 and now_us is not None and now_us - current.last_us > timeout_us:
            current.state = TIMED_OUT
        at: dict[int, int] = {}
        for s in found:
            k = at[s.start_us] = at.get(s.start_us, -1) + 1
            s.name = s.start_us * SAME_START + k
        return found

    def call_statistics(self, sessions: list[Session]) -> None:
        """Give each call the statistics of its streams (JSON, in order of SSRC), after joining the parts that follow each other in it."""
        items: dict[int, list[dict]] = {}
        for ssrc, parts in self.streams.items():
            joined: list[list] = []
            owners: list[Session | None] = []
            for part in parts:
                began = [s for s in sessions if (s.start_us, s.start_no) <= (part[2], part[3])]
                owner = began[-1] if began and tuple(part[:2]) > began[-1].boundary and part[2] <= began[-1].last_us else None
                if joined and owner is not None and owners[-1] is owner:
                    joined[-1] = [*part[:2], *joined[-1][2:6], joined[-1][6].then(part[6])]
                else:
                    joined.append(part)
                    owners.append(owner)
            self.streams[ssrc] = joined
            for part, owner in zip(joined, owners):
                if owner is not None:
                    ptime = owner.ptime_ms if owner.ptime_ms is not None and owner.ptime_ms > 0 else DEFAULT_PTIME_MS
                    expected = max(0, int((owner.last_us - owner.start_us) / 1000.0 / ptime + 0.5))
                    items.setdefault(owner.name, []).append(
                        {"ssrc": f"{ssrc:08x}", "src_endpoint": part[4], "dst_endpoint": part[5], **part[6].statistics(), "expected_packets": expected, "ptime_ms": ptime}
                    )
        for s in sessions:
            s.statistics = json.dumps(sorted(items[s.name], key=lambda x: x["ssrc"])) if s.name in items else None

    def advance(self, timeout_us: int, now_us: int | None, always: bool = False) -> list[tuple]:
        """
        Changes (call_seq, kind, start_us, last_us, at_us, state, sip_from, sip_to, n_rows, revision, rtp_statistics, nth) since the last time.

        What only goes on (texts that grow, a call that ends) is an update. If a call that was handed on is another now, or none, it is
        retracted, which takes back all its earlier changes, and what is left of it is handed on anew. Statistics go along with updates; those of a call that has ended, or with `always` of any call, are an update too when packets
        came that had waited. `nth` orders updates that tell of the same moment.
        """
        out: list[tuple] = []
        new = self.sessions(timeout_us, now_us)
        if self.streams:
            self.call_statistics(new)
        old = {s.name: s for s in self.known}
        gone = [s for s in self.known if s.name not in {n.name for n in new}]
        wrong = {s.name for s in new if s.name in old and not _goes_on(old[s.name], s)}
        if gone or wrong:
            self.revision += 1
            for s in [*gone, *(old[n] for n in sorted(wrong))]:
                out.append((s.name, RETRACT, s.start_us, s.last_us, s.last_us, s.state, None, None, 0, self.revision, None, 0))
        for s in new:
            was = old.get(s.name) if s.name not in wrong else None
            if was is None:
                out.append((s.name, INSERT, s.start_us, s.start_us, s.start_us, ACTIVE, s.opened_from, s.opened_to, 1, self.revision, None, 0))
            seen = (ACTIVE, s.opened_from, s.opened_to) if was is None else (was.state, was.sip_from, was.sip_to)
            s.nth = was.nth if was is not None and was.last_us == s.last_us else 0
            measured = (always or s.state != ACTIVE) and s.statistics != (was and was.statistics)
            if seen != (s.state, s.sip_from, s.sip_to) or measured:
                s.nth += 1
                out.append((s.name, UPDATE, s.start_us, s.last_us, s.last_us, s.state, s.sip_from, s.sip_to, s.n_rows, self.revision, s.statistics, s.nth))
        self.known = new
        return out

    def forget(self, before_us: int) -> None:
        """Leave out the calls that ended before a moment, with all that lies before the calls that stay."""
        stay = [s for s in self.known if s.state == ACTIVE or s.last_us >= before_us]
        limit = min([before_us, *(s.start_us for s in stay)])
        self.known = [s for s in self.known if s.start_us >= limit]
        self.messages = [m for m in self.messages if m[0] >= limit]
        self.media = [x for x in self.media if x[2] >= limit]
        self.streams = {k: kept for k, parts in self.streams.items() if (kept := [p for p in parts if p[6].last_us >= limit])}
        self.floor = max(self.floor, (limit, -1))

    @property
    def empty(self) -> bool:
        return not (self.messages or self.media or self.known or self.aside)

    def due(self, timeout_us: int, keep_us: int | None) -> int | None:
        """The next moment at which something changes if nothing arrives: the open call times out, or ended calls need not be kept any longer."""
        moments = [s.last_us + timeout_us for s in self.known if s.state == ACTIVE and timeout_us > 0]
        if keep_us is not None and not moments and not self.empty:
            last = max([m[0] for m in self.messages] + [x[2] for x in self.media])
            moments.append(last + keep_us + max(timeout_us, 0))
        return max(moments, default=None)


def _goes_on(old: Session, new: Session) -> bool:
    """True if a call handed on as `old` becomes `new` by an update, or by nothing."""
    if (old.opened_from, old.opened_to) != (new.opened_from, new.opened_to):
        return False
    if old.state != ACTIVE:
        return (old.state, old.last_us, old.sip_from, old.sip_to) == (new.state, new.last_us, new.sip_from, new.sip_to)
    return new.last_us >= old.last_us and _longer(old.sip_from, new.sip_from) == new.sip_from and _longer(old.sip_to, new.sip_to) == new.sip_to
