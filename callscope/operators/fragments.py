"""Reassembly of IPv4 fragments.

Which datagram a fragment belongs to depends on what arrived before it (a datagram ends when it is complete, or too old), so a
small fold walks the fragments of each key in arrival order. Spark sorts and spreads them; the fold sees offsets and lengths as
Arrow batches and holds one open datagram. Payloads are put together by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.octets import part, zero_bytes
from callscope.functions.values import micros
from callscope.operators.settle import settle
from callscope.operators.slots import MINUTE_US, SLOT, KeySlots

FRAGMENT_KEYS = ["src_ip", "dst_ip", "ip_proto", "ip_id"]
TIMEOUT_US = 30_000_000

_STATE = "struct<first_us:bigint,first_at:bigint,total:bigint,pieces:map<bigint,bigint>>"


class Datagram:
    """The open datagram of one key: length by offset."""

    __slots__ = ("first_us", "first_at", "total", "pieces")

    def __init__(self, first_us: int, first_at: int, total: int = 0, pieces: dict[int, int] | None = None):
        self.first_us, self.first_at, self.total, self.pieces = first_us, first_at, total, pieces or {}

    @staticmethod
    def of(state: dict) -> Datagram:
        return Datagram(state["first_us"], state["first_at"], state["total"], dict(state["pieces"]))

    def add(self, offset: int, length: int, more: bool) -> bool:
        """Take a fragment; one that was at its offset is replaced. True if the datagram is complete now."""
        self.pieces[offset] = length
        if not more:
            self.total = offset + length
        return self.complete()

    def complete(self) -> bool:
        position = 0
        while position < self.total:
            length = self.pieces.get(position, 0)
            if length == 0:
                return False
            position += length
        return self.total > 0 and all(o + n <= self.total for o, n in self.pieces.items())

    def state(self) -> dict:
        pieces = sorted(self.pieces.items())
        return {"first_us": self.first_us, "first_at": self.first_at, "total": self.total, "pieces": pieces}


def _walker(keys: Sequence[str], timeout_us: int):
    """Fold over batches sorted by keys, slot and arrival; adds the datagram of each fragment."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_one, schema, out_type = None, None, None, None

        def chunk_end() -> dict:
            # What the next slot of this key starts with.
            values = dict(zip([*keys, SLOT], key))
            state = open_one.state() if open_one else {"first_us": -1, "first_at": -1, "total": 0, "pieces": []}
            return {**values, "__out": state}

        for batch in batches:
            if schema is None:
                out_type = batch.schema.field("__in").type
                schema = pa.schema(
                    [
                        *batch.schema, pa.field("__datagram", pa.int64()), pa.field("__datagram_us", pa.int64()), pa.field("completes", pa.bool_()),
                        pa.field("__out", out_type),
                    ]
                )
            columns = [batch.column(n).to_pylist() for n in (*keys, SLOT)]
            rows = zip(*columns, *(batch.column(n).to_pylist() for n in ("__us", "__at", "fragment_offset", "__length", "more_fragments", "__in")))
            numbers, times, done, ends = [], [], [], []
            for *this_key, us, at, offset, length, more, carried in rows:
                if this_key != key:
                    if key is not None and key[-1] is not None:
                        ends.append(chunk_end())
                    key, open_one = this_key, None
                if carried is not None:
                    if carried["first_at"] >= 0:
                        open_one = Datagram.of(carried)
                    numbers.append(None)
                    times.append(None)
                    done.append(None)
                    continue
                if open_one is None or us - open_one.first_us > timeout_us:
                    open_one = Datagram(us, at)
                complete = open_one.add(offset, length, more)
                numbers.append(open_one.first_at)
                times.append(open_one.first_us)
                done.append(complete)
                if complete:
                    open_one = None
            added = [pa.array(numbers, pa.int64()), pa.array(times, pa.int64()), pa.array(done, pa.bool_()), pa.nulls(batch.num_rows, out_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema=schema)
            if ends:
                yield pa.RecordBatch.from_pylist(ends, schema=schema)
        if key is not None and key[-1] is not None:
            yield pa.RecordBatch.from_pylist([chunk_end()], schema=schema)

    return walk


def assign_datagrams(
    fragments: DataFrame,
    keys: Sequence[str] = FRAGMENT_KEYS,
    at: str = "frame_no",
    ts: str = "ts",
    data: str = "ip_payload",
    timeout_us: int = TIMEOUT_US,
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """Add ``datagram`` and ``datagram_us`` (number and time of its first fragment) and ``completes`` to fragments.

    Numbers start again in each capture file, and IP ids come round, so only time and number together name a datagram; one may begin in one file and end in the next.

    A key with very many fragments is cut into time slots that are walked side by side. A slot needs the open datagram the slot before
    it ends with; as one rarely reaches far, the slots are walked again with the states found until these no longer change.
    """
    rows = fragments.withColumns({
        "__us": micros(ts),
        "__at": F.col(at).cast("bigint"),
        "__length": F.octet_length(data).cast("bigint"),
        "fragment_offset": F.col("fragment_offset").cast("bigint"),
    })
    slots = KeySlots(rows, keys, F.col("__us"), slot_us, hot_rows)
    rows = slots.rows
    states = _settled_states(rows, keys, timeout_us) if slots.any_hot else None
    walked = _walk(rows, states, keys, timeout_us)
    return walked.filter(F.col("__datagram").isNotNull()).withColumnsRenamed({"__datagram": "datagram", "__datagram_us": "datagram_us"}).drop(
        "__us", "__at", "__length", "__in", "__out", SLOT
    )


def _walk(rows: DataFrame, states: DataFrame | None, keys: Sequence[str], timeout_us: int) -> DataFrame:
    rows = rows.withColumn("__in", F.lit(None).cast(_STATE))
    if states is not None:
        rows = rows.unionByName(states, allowMissingColumns=True)
    added = [
        T.StructField("__datagram", T.LongType()),
        T.StructField("__datagram_us", T.LongType()),
        T.StructField("completes", T.BooleanType()),
        T.StructField("__out", rows.schema["__in"].dataType),
    ]
    # Rows that carry a state have no value in the other columns.
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*rows.schema.fields, *added]])
    # The state row of a slot comes first: it has no time.
    ordered = rows.repartition(*keys, SLOT).sortWithinPartitions(*keys, SLOT, F.col("__us").asc_nulls_first(), "__at")
    return ordered.mapInArrow(_walker(keys, timeout_us), schema)


def _settled_states(rows: DataFrame, keys: Sequence[str], timeout_us: int) -> DataFrame:
    """The open datagram each slot of a hot key starts with."""
    light = rows.filter(F.col(SLOT).isNotNull()).select(
        *keys, SLOT, "__us", "__at", "__length", "fragment_offset", "more_fragments"
    )
    light = light.checkpoint()
    slots = light.select(*keys, SLOT).distinct().checkpoint()
    states = None
    while True:
        ends = _walk(light, states, keys, timeout_us).filter(F.col("__out").isNotNull()).select(*keys, SLOT, "__out")
        starts = _next_starts(slots, ends, keys).checkpoint()
        if states is not None:
            # Maps do not compare; their JSON text, built from sorted pieces, does.
            text = F.to_json("__in")
            changed = starts.select(*keys, SLOT, text.alias("now")).join(
                states.select(*keys, SLOT, text.alias("was")), [*keys, SLOT]
            ).filter("now <> was")
            if changed.isEmpty():
                return starts
        states = starts


def _next_starts(slots: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(SLOT)
    shifted = slots.join(ends, [*keys, SLOT], "left").withColumn("__in", F.lag("__out").over(along))
    empty = F.expr(f"cast(named_struct('first_us', -1L, 'first_at', -1L, 'total', 0L, 'pieces', map()) as {_STATE})")
    return shifted.select(*keys, SLOT, F.coalesce("__in", empty).alias("__in"))


def datagrams(
    fragments: DataFrame,
    keys: Sequence[str] = FRAGMENT_KEYS,
    at: str = "frame_no",
    ts: str = "ts",
    data: str = "ip_payload",
    keep: Sequence[str] = (),
    timeout_us: int = TIMEOUT_US,
    capture_end_us=None,
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """One row per datagram: first and last time, number of fragments, ``status`` and, when complete, its payload.

    A later fragment replaces an earlier one at its offset and wins where they overlap. ``keep`` columns are those of the
    first-arrived fragment. ``status`` is ``reassembled``, ``timeout`` or ``active``.
    """
    if capture_end_us is None:
        capture_end_us = fragments.agg(F.max(micros(ts)).alias("end")).scalar()
    rows = assign_datagrams(fragments, keys, at, ts, data, timeout_us, hot_rows, slot_us)
    rows = rows.withColumn("__pos", F.struct(micros(ts).alias("us"), F.col(at).alias("at")))
    group = [*keys, "datagram_us", "datagram"]
    # Copies of one fragment collapse before they meet; what is left of a datagram is bounded by the 13-bit offset.
    offsets = rows.groupBy(*group, "fragment_offset").agg(
        F.max_by(F.struct(F.col("__pos").alias("at"), F.col(data).alias("data"), "more_fragments"), "__pos").alias("piece"),
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        F.max("__pos").alias("last_at"),
        F.max("completes").alias("complete"),
        F.max(F.when(~F.col("more_fragments"), F.struct(F.col("__pos").alias("at"), (F.col("fragment_offset") + F.octet_length(data)).alias("end")))).alias("total"),
        F.min_by(F.struct(F.col("__pos").alias("at"), *keep), "__pos").alias("kept"),
    )
    whole = offsets.groupBy(*group).agg(
        F.sum("n").alias("n_fragments"),
        F.min("first").alias("first_ts"),
        F.max("last").alias("last_ts"),
        F.max("last_at").getField("at").alias("last_at"),
        F.max("complete").alias("complete"),
        F.max("total").getField("end").alias("total"),
        F.min_by("kept", "kept.at").alias("kept"),
        F.array_sort(F.collect_list(F.struct("piece.at", "fragment_offset", "piece.data"))).alias("pieces"),
    )
    payload = F.aggregate(
        "pieces",
        zero_bytes(F.col("total")),
        lambda whole_data, p: F.overlay(whole_data, p["data"], (p["fragment_offset"] + F.lit(1)).cast("int"), F.octet_length(p["data"])),
    )
    timed_out = capture_end_us - micros("first_ts") > F.lit(timeout_us)
    status = F.when(F.col("complete"), "reassembled").when(timed_out, "timeout").otherwise("active")
    return whole.select(
        *keys,
        "datagram",
        "first_ts",
        "last_ts",
        "last_at",
        "n_fragments",
        status.alias("status"),
        F.when(F.col("complete"), payload).alias("payload"),
        *[F.col(f"kept.{c}").alias(c) for c in keep],
    )


def fragment_counters(rows: DataFrame) -> DataFrame:
    """Totals over the result of ``datagrams``, one row. Nothing is ever dropped here for want of room."""
    return rows.agg(
        F.coalesce(F.sum("n_fragments"), F.lit(0)).cast("bigint").alias("total"),
        F.count_if(F.col("status") == "reassembled").alias("reassembled"),
        F.count_if(F.col("status") == "timeout").alias("timeout"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.lit(0).cast("bigint").alias("dropped"),
    )


def rebuild_frame(data: Column, ip_at: Column, payload_at: Column, payload: Column) -> Column:
    """The frame of a fragment as that of the whole IPv4 packet: lower layers and header kept, length set, flags cleared."""
    total = payload_at - ip_at + F.octet_length(payload)
    length = F.unhex(F.lpad(F.hex(F.pmod(total, F.lit(65536)).cast("bigint")), 4, "0"))
    kept = [part(data, 0, ip_at + F.lit(2)), part(data, ip_at + F.lit(4), 2), part(data, ip_at + F.lit(8), payload_at - ip_at - F.lit(8))]
    return F.concat(kept[0], length, kept[1], zero_bytes(F.lit(2)), kept[2], payload)


def reassemble(
    packets: DataFrame,
    at: str = "frame_no",
    ts: str = "ts",
    scope: Sequence[str] = (),
    timeout_us: int = TIMEOUT_US,
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """Replace the fragments of IP-decoded packets by whole packets.

    A whole packet takes its columns from the first-arrived fragment, its time from the last one, and stands where it was completed. Fragments
    of incomplete datagrams drop out.
    """
    fragment = F.col("more_fragments") | (F.col("fragment_offset") != 0)
    keys = [*scope, *FRAGMENT_KEYS]
    replaced = {*keys, at, ts, "ip_payload", "more_fragments", "fragment_offset"}
    keep = [c for c in packets.columns if c not in replaced]
    whole = datagrams(packets.filter(fragment), keys, at, ts, "ip_payload", keep, timeout_us, F.lit(0), hot_rows, slot_us)
    # Only complete ones are used, whose status does not depend on where the capture ends.
    whole = whole.filter("status = 'reassembled'").select(
        *keys,
        F.col("last_at").alias(at),
        F.col("last_ts").alias(ts),
        F.col("payload").alias("ip_payload"),
        F.lit(False).alias("more_fragments"),
        F.lit(0).cast("bigint").alias("fragment_offset"),
        *keep,
    )
    if "data" in keep:
        size = F.octet_length("data")
        whole = settle(whole, {"data": rebuild_frame(F.col("data"), F.col("ip_at"), F.col("ip_payload_at"), F.col("ip_payload"))})
        whole = whole.withColumns({"cap_len": size, "orig_len": size})
    return packets.filter(~fragment).unionByName(whole.select(*packets.columns))
