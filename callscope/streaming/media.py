"""Media of streamed calls: endpoints follow the messages, packets follow the endpoints, sessions follow both.

Three kinds of state in a row, each keyed by what its rows share: the messages of a call tell which endpoints it holds and until when; an endpoint
tells whose its packets are, first by their destination, then by their source; and the call's timeline takes its messages and its packets.
"""

from __future__ import annotations

import json
import pickle
from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from callscope.functions.values import micros
from callscope.streaming.calls import deal_media, deal_messages, sessions_of
from callscope.streaming.rows import plain_columns
from callscope.streaming.shares import KEY, Dealt, ShareProcessor, arrow_schema, deal, in_shares, names, of_bytes, to_bytes

REGISTER, WITHDRAW, PACKET, OWNED = range(4)
REGISTERED = "kind int, ip string, port string, us long, frame_no long, ended_us long, ended_no long"
#: What is carried along with a packet.
CARRIED = ("src_ip", "src_port", "dst_ip", "dst_port", "seq", "ssrc")
PACKETS = (
    "us long, frame_no long, call_id string, registered_us long, registered_no long, "
    "src_ip string, src_port int, dst_ip string, dst_port int, seq int, ssrc long"
)
#: Registrations and packets of endpoints.
AT_ENDPOINTS = f"kind int, ended_us long, ended_no long, {PACKETS}"


class CallEndpoints(ShareProcessor):
    """The endpoints that the messages of a call name while it is open, each with the message that ended the call."""

    columns, found = ("us", "frame_no", "opens", "closes", "endpoints"), names(REGISTERED)

    def __init__(self, keep_us: int | None):
        self.keep_us = keep_us

    @staticmethod
    def derived(messages: list) -> dict[str, list]:
        """Registrations by their name: [ip, port, us, frame_no, ended us, ended frame_no]. Endpoints count from the first opening message to the next closing one."""
        found: dict[str, list] = {}
        is_open, own = False, []
        for us, frame_no, opens, closes, endpoints in messages:
            is_open = is_open or opens
            if is_open:
                for ip, port in endpoints:
                    row = [ip, port, us, frame_no, None, None]
                    found[f"{ip} {port} {us} {frame_no}"] = row
                    own.append(row)
            if closes:
                for row in own if is_open else []:
                    row[4:] = us, frame_no
                is_open, own = False, []
        return found

    def take(self, key: str, held_text: bytes | None, rows: list[tuple], watermark_ms: int) -> tuple[bytes | None, int | None, list[tuple]]:
        # `aside` holds messages and registrations up to a closing message (`until`), each part as bytes: read again only for rows of their time.
        messages, known, aside, until = pickle.loads(held_text) if held_text is not None else ([], {}, [], None)
        rows = [r for r in rows if r[2] or r[3] or r[4] not in (None, "[]")]
        if aside and (self.keep_us is not None or any(r[0] <= until for r in rows)):
            parts = [*map(pickle.loads, aside)]
            messages, known, aside, until = [m for p in parts for m in p[0]] + messages, {k: v for p in parts for k, v in p[1].items()} | known, [], None
        for us, frame_no, opens, closes, endpoints in rows:
            insort(messages, [us, frame_no, bool(opens), bool(closes), json.loads(endpoints or "[]")], key=lambda m: m[:2])
        now = self.derived(messages)
        out = [(WITHDRAW, *row) for name, row in known.items() if name not in now]
        out += [(REGISTER, *row) for name, row in now.items() if known.get(name) != row]
        due = None
        closing = [i for i, m in enumerate(messages) if m[3]]
        if self.keep_us is not None:
            # What lies before the last closing message that is old enough changes nothing any more.
            old = [i for i in closing if messages[i][0] + self.keep_us < watermark_ms * 1000]
            if old:
                messages = messages[old[-1] + 1 :]
                now = self.derived(messages)
            due = next(((m[0] + self.keep_us) // 1000 + 1 for m in messages if m[3]), None)
        elif closing:
            end, us = closing[-1] + 1, messages[closing[-1]][0]
            if end == len(messages) or messages[end][0] > us:
                aside.append(pickle.dumps((messages[:end], {k: v for k, v in now.items() if v[2] <= us}), protocol=5))
                messages, now, until = messages[end:], {k: v for k, v in now.items() if v[2] > us}, us
        return pickle.dumps((messages, now, aside, until), protocol=5) if messages or aside else None, due, out


class EndpointOwners(ShareProcessor):
    """
    Whose the packets of an endpoint are: of the newest registration at or before them, unless its call had ended.

    Packets wait until the watermark has passed them, so registrations may come behind packets by the lateness. Registrations stay for packets that come
    even later; of those older than `keep_us` only the newest. The registrations of an endpoint are its state; packets wait for the whole share in segments, one for each call, and are looked up
    all at once. With `forward`, registrations are handed on, too, for a second look-up.
    """

    columns = found = tuple(names(AT_ENDPOINTS))
    schema = arrow_schema(f"{KEY} string, {AT_ENDPOINTS}")
    _REGISTRATION = (KEY, "kind", "us", "frame_no", "call_id", "ended_us", "ended_no")

    def __init__(self, keep_us: int | None, forward: bool = False):
        self.keep_us, self.forward = keep_us, forward

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "segment long", "packets binary")

    def work(self, tables: Iterable[pa.Table], watermark_ms: int) -> Iterator[pa.Table]:
        value = self.moments.get()
        # Segments: [number, first and last microsecond] of what waits.
        timer, due, segments = json.loads(value[0]) if value is not None else (None, {}, [])
        changes: dict[str, list[tuple]] = {}
        ready, later = [], []
        for table in tables:
            table = self._typed(table)
            kinds = table.column("kind").to_numpy()
            registrations = table.filter(pa.array(kinds < PACKET))
            for own, *row in zip(*plain_columns(registrations, self._REGISTRATION)):
                changes.setdefault(own, []).append(row)
            if self.forward and registrations.num_rows:
                yield registrations
            if (kinds == OWNED).any():
                yield table.filter(pa.array(kinds == OWNED))
            self._parted(table.filter(pa.array(kinds == PACKET)), watermark_ms, ready, later)
        stay = []
        for n, first, last in segments:
            if first // 1000 > watermark_ms:
                stay.append([n, first, last])
                continue
            self._parted(of_bytes(self.waiting.getValue((n,))[0]), watermark_ms, ready, later)
            self.waiting.removeKey((n,))
        if later:
            rest = pa.concat_tables(later)
            us, n = rest.column("us").to_numpy(), max((s[0] for s in segments), default=-1) + 1
            self.waiting.updateValue((n,), (to_bytes(rest),))
            stay.append([n, int(us.min()), int(us.max())])
        touched = {*changes, *(key for key, at in due.items() if at <= watermark_ms)}
        for table in ready:
            touched.update(pc.unique(table.column(KEY)).to_pylist())
        texts = {key: self._held(key) for key in touched}
        registered = {key: json.loads(text) for key, text in texts.items() if text is not None}
        for key, rows in changes.items():
            registered[key] = self._changed(registered.get(key, []), rows)
        for table in ready:
            yield self._owned(table, registered)
        for key in touched:
            held = self._recent(registered.get(key, []), watermark_ms)
            self._hold(key, texts[key], json.dumps(held) if held else None)
            if self.keep_us is not None and held and held[-1][3] is not None:
                due[key] = max((held[-1][3] + self.keep_us) // 1000 + 1, watermark_ms + 1)
            else:
                due.pop(key, None)
        wanted = min([*due.values(), *(s[1] // 1000 for s in stay)], default=None)
        self._wake(timer, wanted, watermark_ms)
        if wanted is None:
            self.moments.clear()
        else:
            self.moments.update((json.dumps([wanted, due, stay]),))

    def _typed(self, table: pa.Table) -> pa.Table:
        """All columns in their types; those that aren't there are null."""
        n = table.num_rows
        columns = [table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(n, f.type) for f in self.schema]
        return pa.Table.from_arrays(columns, schema=self.schema)

    @staticmethod
    def _parted(packets: pa.Table, watermark_ms: int, ready: list[pa.Table], later: list[pa.Table]) -> None:
        waits = packets.column("us").to_numpy() // 1000 > watermark_ms
        for to, some in ((ready, ~waits), (later, waits)):
            if some.any():
                to.append(packets if some.all() else packets.filter(pa.array(some)))

    @staticmethod
    def _changed(held: list[list], rows: list[tuple]) -> list[list]:
        """Registrations [us, frame_no, call_id, ended_us, ended_no] of an endpoint, in order, after some were added, changed or withdrawn."""
        places = {(us, frame_no, call_id): ended for us, frame_no, call_id, *ended in held}
        for kind, us, frame_no, call_id, *ended in rows:
            places.pop((us, frame_no, call_id), None)
            if kind == REGISTER:
                places[us, frame_no, call_id] = ended
        return [[*place, *places[place]] for place in sorted(places)]

    def _recent(self, held: list[list], watermark_ms: int) -> list[list]:
        if self.keep_us is None:
            return held
        limit = watermark_ms * 1000 - self.keep_us
        old = [i for i, r in enumerate(held) if r[0] < limit]
        held = held[old[-1] :] if old else held
        return [] if len(held) == 1 and held[0][3] is not None and held[0][3] < limit else held

    def _owned(self, packets: pa.Table, registered: dict[str, list[list]]) -> pa.Table:
        """Packets with the call that holds their endpoint, if one does."""
        keys = packets.column(KEY).combine_chunks().dictionary_encode()
        lists = [registered.get(key, []) for key in keys.dictionary.to_pylist()]
        rows = [r for held in lists for r in held]
        if not rows:
            return packets
        ends = [r[3] for r in rows]
        by_us, by_no, ended_us, ended_no = (
            np.array(x, np.int64) for x in ([r[0] for r in rows], [r[1] for r in rows], [e or 0 for e in ends], [r[4] or 0 for r in rows])
        )
        ended = np.array([e is not None for e in ends])
        of_key = np.repeat(np.arange(len(lists)), [len(held) for held in lists])
        key = keys.indices.to_numpy().astype(np.int64)
        us, no = packets.column("us").to_numpy(), packets.column("frame_no").to_numpy()
        n = len(rows)
        # Registrations and packets in one order; a registration goes before a packet of its place.
        order = np.lexsort((np.repeat([0, 1], [n, len(us)]), np.concatenate([by_no, no]), np.concatenate([by_us, us]), np.concatenate([of_key, key])))
        newest = np.maximum.accumulate(np.where(order < n, order, -1))
        owner = np.empty(len(us), np.int64)
        owner[order[order >= n] - n] = newest[order >= n]
        at = np.maximum(owner, 0)
        over = ended[at] & ((us > ended_us[at]) | ((us == ended_us[at]) & (no > ended_no[at])))
        none = (owner < 0) | (of_key[at] != key) | over
        at = pa.array(at, mask=none)
        given = {
            "kind": pa.array(np.where(none, PACKET, OWNED), pa.int32()),
            "call_id": pa.array([r[2] for r in rows], pa.string()).take(at),
            "registered_us": pa.array(by_us).take(at), "registered_no": pa.array(by_no).take(at),
        }
        return pa.Table.from_arrays([given[f.name] if f.name in given else packets.column(f.name) for f in self.schema], schema=self.schema)


def stream_registrations(messages: DataFrame, opens: Column, closes: Column, lateness: str, keep_us: int | None = None, ts: str = "ts") -> DataFrame:
    """The key of the call and ``REGISTERED`` (and withdrawals of some), from a stream of messages with instance_id, call_id, frame_no and ``endpoints``; messages may come in any order."""
    return registrations_of(deal_messages(messages, opens, closes, lateness, ts), keep_us)


def registrations_of(messages: Dealt, keep_us: int | None) -> DataFrame:
    found = in_shares([messages], CallEndpoints(keep_us), REGISTERED)
    return found.withColumn("port", F.col("port").cast("int"))


def stream_media(packets: DataFrame, registrations: DataFrame, lateness: str, keep_us: int | None = None, ts: str = "ts") -> DataFrame:
    """
    instance_id and ``PACKETS``: each media packet of a stream with the call that owns its destination, else that which owns its source; others drop out.

    Both look-ups are keyed by endpoint. Registrations and packets that have their owner pass through the second one, the latter by their destination, so that a source of very many packets
    only gets those that are looked up there.
    """
    endpoint = ["instance_id", "ip", "port"]
    register = registrations.select(*endpoint, "kind", "us", "frame_no", "call_id", "ended_us", "ended_no")
    arrived = packets.withColumn("event_ts", F.col(ts).cast("timestamp")).withWatermark("event_ts", lateness).select(
        "instance_id", F.col("dst_ip").alias("ip"), F.col("dst_port").cast("int").alias("port"), F.lit(PACKET).alias("kind"),
        micros("event_ts").alias("us"), F.col("frame_no").cast("bigint").alias("frame_no"),
        "src_ip", F.col("src_port").cast("int").alias("src_port"), "dst_ip", F.col("dst_port").cast("int").alias("dst_port"), "seq", "ssrc",
    )
    dealt = [deal(rows, endpoint, rows.columns[3:]) for rows in (register, arrived)]
    by_dst = in_shares(dealt, EndpointOwners(keep_us, forward=True), AT_ENDPOINTS)
    asks = F.col("kind") == PACKET
    by_dst = by_dst.withColumns({"ip": F.when(asks, F.col("src_ip")).otherwise(F.col("ip")), "port": F.when(asks, F.col("src_port")).otherwise(F.col("port"))})
    by_src = in_shares([deal(by_dst, endpoint, names(AT_ENDPOINTS))], EndpointOwners(keep_us), AT_ENDPOINTS)
    return by_src.filter(F.col("call_id").isNotNull()).select("instance_id", *names(PACKETS))


def stream_calls(
    messages: DataFrame, packets: DataFrame, opens: Column, closes: Column, timeout_us: int, lateness: str = "10 seconds", keep_us: int | None = None, always: bool = False
) -> DataFrame:
    """Changes of calls from streams of messages and of media packets: media refreshes the calls that own its endpoints, as messages do, and its streams have statistics."""
    # Dealt once: the endpoints of calls and their timelines take the same messages.
    dealt = deal_messages(messages, opens, closes, lateness)
    media = stream_media(packets, registrations_of(dealt, keep_us), lateness, keep_us)
    return sessions_of([dealt, deal_media(media)], timeout_us, keep_us, always)
