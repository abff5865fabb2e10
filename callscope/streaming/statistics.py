"""What is known of a stretch of a packet stream, in a form that stretches that follow each other can be joined by: exact, and as small as the stream is regular."""

from __future__ import annotations

from dataclasses import dataclass, field


def wrap16(difference: int) -> int:
    """A difference of 16-bit numbers taken the short way round."""
    return (difference + 32768) % 65536 - 32768


Runs = list[list[int]]  # numbers as [first, last] of runs, in order, with gaps between


def union(a: Runs, b: Runs) -> Runs:
    out: Runs = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def minus(a: Runs, b: Runs) -> Runs:
    """The numbers of `a` that are not in `b`."""
    out: Runs = []
    i = 0
    for first, last in a:
        while i < len(b) and b[i][1] < first:
            i += 1
        k = i
        while k < len(b) and b[k][0] <= last:
            if b[k][0] > first:
                out.append([first, b[k][0] - 1])
            first = max(first, b[k][1] + 1)
            k += 1
        if first <= last:
            out.append([first, last])
    return out


def below(a: Runs, limit: int) -> tuple[Runs, Runs]:
    """The numbers under `limit`, and the others."""
    return [[f, min(e, limit - 1)] for f, e in a if f < limit], [[max(f, limit), e] for f, e in a if e >= limit]


def size(a: Runs) -> int:
    return sum(last - first + 1 for first, last in a)


@dataclass
class StreamSummary:
    """
    Packets in their order: 16-bit numbers unwrapped against the first one (which is 0), and the times between them.

    A number counts where it comes first: in order if it was the largest until then, else late. Both kinds are kept as runs, so a stream without
    loss is one run, however long.
    """

    first_seq: int
    last_seq: int
    first_us: int
    last_us: int
    count: int = 1
    last: int = 0
    in_order: Runs = field(default_factory=lambda: [[0, 0]])
    late: Runs = field(default_factory=list)
    least_us: int | None = None
    most_us: int | None = None

    @staticmethod
    def of(seq: int, us: int) -> StreamSummary:
        return StreamSummary(seq, seq, us, us)

    @property
    def highest(self) -> int:
        return self.in_order[-1][1]

    def add(self, seq: int, us: int) -> None:
        """The next packet."""
        at = self.last + wrap16(seq - self.last_seq)
        if at == self.highest + 1:
            self.in_order[-1][1] = at
        elif at > self.highest:
            self.in_order.append([at, at])
        elif minus(minus([[at, at]], self.in_order), self.late):
            self.late = union(self.late, [[at, at]])
        delta = us - self.last_us
        self.least_us = delta if self.least_us is None else min(self.least_us, delta)
        self.most_us = delta if self.most_us is None else max(self.most_us, delta)
        self.last_seq, self.last_us, self.last, self.count = seq, us, at, self.count + 1

    def then(self, other: StreamSummary) -> StreamSummary:
        """This stretch and the one that follows it, as one."""
        shift = self.last + wrap16(other.first_seq - self.last_seq)
        moved = lambda runs: [[a + shift, b + shift] for a, b in runs]
        known = union(self.in_order, self.late)
        behind, ahead = below(minus(moved(other.in_order), known), self.highest)
        between = other.first_us - self.last_us
        deltas = [x for x in (self.least_us, self.most_us, other.least_us, other.most_us, between) if x is not None]
        return StreamSummary(
            self.first_seq, other.last_seq, self.first_us, other.last_us, self.count + other.count, other.last + shift,
            union(self.in_order, ahead), union(union(self.late, minus(moved(other.late), known)), behind), min(deltas), max(deltas),
        )

    def statistics(self) -> dict:
        """The counts and times of the delivered record. The span goes from the stream's first number to its largest."""
        distinct = size(self.in_order) + size(self.late)
        known = self.count - 1
        return {
            "packet_count": self.count,
            "lost_packets": max(self.highest + 1 - distinct, 0),
            "out_of_order_count": size(self.late),
            "duplicate_count": self.count - distinct,
            "max_delta_ms": max(self.most_us or 0, 0) / 1000.0,
            "min_delta_ms": (self.least_us or 0) / 1000.0,
            "avg_delta_ms": (self.last_us - self.first_us) / known / 1000.0 if known else 0.0,
        }

    def listed(self) -> list:
        return [self.first_seq, self.last_seq, self.first_us, self.last_us, self.count, self.last, self.in_order, self.late, self.least_us, self.most_us]
