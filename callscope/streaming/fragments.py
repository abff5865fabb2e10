"""Reassembly of IPv4 fragments in a stream: an open datagram for each key, its pieces apart from it, and a timer for its age."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from callscope.functions.values import micros
from callscope.operators.fragments import FRAGMENT_KEYS, TIMEOUT_US, Datagram
from callscope.streaming.shares import ShareProcessor, deal, in_shares, names

FOUND = "datagram long, datagram_us long, last_us long, last_at long, n_fragments long, status string, payload binary"


class Reassembly(ShareProcessor):
    """
    The fragments of keys. Those that the watermark has passed are taken in order of time; a datagram ends when it is complete, or too old.

    Payloads lie in a map of their own, each written once and read once; what is rewritten from batch to batch are numbers.
    """

    columns, found = ("us", "at", "fragment_offset", "more_fragments", "data"), names(FOUND)
    # Payloads are large.
    rows_out = 200

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.data = handle.getMapState("data", "key string, us long, at long", "data binary")

    def _end(self, key: str, held: dict, status: str) -> tuple:
        """The open datagram as a row; its payload, put together in order of arrival, and its pieces leave the state."""
        was = Datagram.of(held["open"])
        payload = None
        if status == "reassembled":
            whole = bytearray(was.total)
            # Of an offset the last piece counts, and where pieces overlap the later one.
            newest = {offset: (us, at) for us, at, offset in sorted(held["seen"])}
            for (us, at), offset in sorted((place, offset) for offset, place in newest.items()):
                piece = self.data.getValue((key, us, at))[0]
                whole[offset : offset + len(piece)] = piece
            payload = bytes(whole[: was.total])
        for us, at, _ in held["seen"]:
            self.data.removeKey((key, us, at))
        last = max(s[:2] for s in held["seen"])
        row = (was.first_at, was.first_us, *last, len(held["seen"]), status, payload)
        held["open"], held["seen"] = None, []
        return row

    def take(self, key: str, held_text: str | None, rows: list[tuple], watermark_ms: int) -> tuple[str | None, int | None, list[tuple]]:
        held = json.loads(held_text) if held_text is not None else {"waiting": [], "open": None, "seen": []}
        for us, at, offset, more, data in rows:
            if data is not None:
                self.data.updateValue((key, us, at), (bytes(data),))
                held["waiting"].append([us, at, offset, len(data), bool(more)])
        out, waiting = [], []
        for us, at, offset, length, more in sorted(held["waiting"]):
            if us // 1000 > watermark_ms:
                waiting.append([us, at, offset, length, more])
                continue
            if held["open"] is not None and us - held["open"]["first_us"] > self.timeout_us:
                out.append(self._end(key, held, "timeout"))
            now = Datagram.of(held["open"]) if held["open"] is not None else Datagram(us, at)
            complete = now.add(offset, length, more)
            held["open"] = now.state()
            held["seen"].append([us, at, offset])
            if complete:
                out.append(self._end(key, held, "reassembled"))
        held["waiting"] = waiting
        if held["open"] is not None and watermark_ms * 1000 - held["open"]["first_us"] > self.timeout_us:
            out.append(self._end(key, held, "timeout"))
        moments = [w[0] // 1000 for w in waiting[:1]]
        if held["open"] is not None:
            moments.append((held["open"]["first_us"] + self.timeout_us) // 1000 + 1)
        return json.dumps(held) if moments else None, min(moments, default=None), out


def stream_datagrams(
    fragments: DataFrame, keys: Sequence[str] = FRAGMENT_KEYS, at: str = "frame_no", ts: str = "ts", data: str = "ip_payload",
    lateness: str = "10 seconds", timeout_us: int = TIMEOUT_US,
) -> DataFrame:
    """
    The datagrams of a stream of fragments as they end: keys, then ``FOUND``, with ``status`` reassembled or timeout.

    Fragments may come in any order within the lateness: they wait until the watermark has passed them. One that comes later still counts where it arrives. What is open stays in the state
    until the watermark has passed its age. Rows without payload only move the watermark on. The state is bounded by what arrives within the lateness and the timeout. Needs the RocksDB state store.
    """
    rows = fragments.withColumn("event_ts", F.col(ts).cast("timestamp")).withWatermark("event_ts", lateness).select(
        *keys, micros("event_ts").alias("us"), F.col(at).cast("bigint").alias("at"), F.col("fragment_offset").cast("bigint").alias("fragment_offset"),
        "more_fragments", F.col(data).alias("data"),
    )
    processor = Reassembly(timeout_us)
    return in_shares([deal(rows, keys, processor.columns)], processor, FOUND)
