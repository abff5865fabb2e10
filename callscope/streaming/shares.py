"""State of many keys in one call: keys are dealt into shares, and a stateful processor is called for a share.

Spark calls a processor for each key that has rows or a timer, and a call costs milliseconds, whatever it does: frames for its rows, round trips for its
timestamps, one result batch. With a million small keys that is all the time there is. A share's call takes the rows of all its keys and hands on all that becomes of them.

Rows go to a share, and come from it, packed: many of them are one row of Arrow bytes for Spark, which would turn each row of a stateful operator into a named tuple and back. States of keys
are held in packs, as a round trip to the state costs more than most keys' work.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from callscope.streaming.rows import plain_columns, plain_rows

#: Shares of a stream, and thereby its most tasks; it must stay the same as long as a checkpoint lives.
SHARES = 256
#: Packs that the states of a share's keys lie in; it must stay the same, too.
PACKS = 32
#: Rows and bytes that a task gathers before it packs them by share.
PACKED_ROWS, PACKED_BYTES = 100_000, 1 << 24
#: Spark hands rows on as named tuples, whose names must not begin with an underscore.
KEY, SHARE, PACKED = "key_text", "share_no", "packed_rows"


class ShareProcessor(StatefulProcessor):
    """
    Holds a text (or bytes) for each key of a share, and the moments at which keys want to be called without rows; the share's timer is the first of them.

    A subclass says in `take` what becomes of one key. Only the states of keys that have rows, or are due, are asked for and written.
    """

    #: The columns of a row that `take` gets, and those of the rows it hands on.
    columns: Sequence[str] = ()
    found: Sequence[str] = ()
    #: Rows of one result frame.
    rows_out = 5000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "key string", "held string")
        self.moments = handle.getValueState("moments", "held string")

    def take(self, key: str, held: str | bytes | None, rows: list[tuple], watermark_ms: int) -> tuple[str | bytes | None, int | None, list[tuple]]:
        """From the state and the new rows of a key: its state (none: forget it), the moment in milliseconds at which it is due, and rows to hand on."""
        raise NotImplementedError

    def _held(self, key: str) -> str | bytes | None:
        was = self.states.getValue((key,))
        return was[0] if was is not None else None

    def _hold(self, key: str, was: str | bytes | None, held: str | bytes | None) -> None:
        if held is not None and held != was:
            self.states.updateValue((key,), (held,))
        elif held is None and was is not None:
            self.states.removeKey((key,))

    def _wake(self, timer: int | None, wanted: int | None, watermark_ms: int) -> None:
        """The share's timer: the one that was, and the one that is wanted now."""
        if wanted != timer:
            if timer is not None and timer > watermark_ms:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)

    def work(self, tables: Iterable[pa.Table], watermark_ms: int) -> Iterator[list[tuple] | pa.Table]:
        """What becomes of rows of the share (``KEY`` and some of ``columns``; the others are null), and of keys that are due."""
        arrived: dict[str, list[tuple]] = {}
        for table in tables:
            for own, *row in zip(*plain_columns(table, (KEY, *self.columns))):
                arrived.setdefault(own, []).append(row)
        value = self.moments.get()
        timer, due = json.loads(value[0]) if value is not None else (None, {})
        before = (timer, dict(due))
        for key, at in due.items():
            if at <= watermark_ms:
                arrived.setdefault(key, [])
        out: list[tuple] = []
        for key, rows in arrived.items():
            was = self._held(key)
            held, moment, found = self.take(key, was, rows, watermark_ms)
            self._hold(key, was, held)
            if moment is not None:
                due[key] = max(moment, watermark_ms + 1)
            else:
                due.pop(key, None)
            out += [(key, *row) for row in found]
            if len(out) >= self.rows_out:
                yield out
                out = []
        wanted = min(due.values(), default=None)
        self._wake(timer, wanted, watermark_ms)
        if not due:
            self.moments.clear()
        elif (wanted, due) != before:
            self.moments.update((json.dumps([wanted, due]),))
        if out:
            yield out

    def _frame(self, out: list[tuple] | pa.Table) -> pd.DataFrame:
        if isinstance(out, pa.Table):
            out = list(zip(*plain_columns(out, (KEY, *self.found))))
        return pd.DataFrame(out, columns=[KEY, *self.found], dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        columns = (KEY, *self.columns)
        tables = (pa.table(dict(zip(columns, ([*c] for c in zip(*plain_rows([frame], columns)))))) for frame in rows if len(frame))
        yield from map(self._frame, self.work(tables, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from map(self._frame, self.work([], timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


class Packs:
    """The map of a share's states, as packs of keys: each is read once in a call, and written once if it changed."""

    def __init__(self, stored):
        self.stored = stored
        self.read: dict[int, dict[str, str | bytes]] = {}
        self.changed: set[int] = set()

    def _pack(self, key: str) -> tuple[int, dict[str, str | bytes]]:
        n = crc32(key.encode()) % PACKS
        if n not in self.read:
            was = self.stored.getValue((n,))
            self.read[n] = pickle.loads(was[0]) if was is not None else {}
        return n, self.read[n]

    def getValue(self, key: tuple[str]) -> tuple[str | bytes] | None:
        _, pack = self._pack(key[0])
        return (pack[key[0]],) if key[0] in pack else None

    def updateValue(self, key: tuple[str], value: tuple[str | bytes]) -> None:
        n, pack = self._pack(key[0])
        pack[key[0]] = value[0]
        self.changed.add(n)

    def removeKey(self, key: tuple[str]) -> None:
        n, pack = self._pack(key[0])
        if pack.pop(key[0], None) is not None:
            self.changed.add(n)

    def write(self) -> None:
        for n in sorted(self.changed):
            if self.read[n]:
                self.stored.updateValue((n,), (pickle.dumps(self.read[n], protocol=5),))
            else:
                self.stored.removeKey((n,))
        self.read, self.changed = {}, set()


class _PackedHandle:
    """A handle whose map ``states`` lies in packs."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.packs = Packs(handle.getMapState("states", "pack int", "held binary"))

    def getMapState(self, name: str, key: str, value: str):
        return self.packs if name == "states" else self.handle.getMapState(name, key, value)

    def __getattr__(self, name: str):
        return getattr(self.handle, name)


class PackedProcessor(StatefulProcessor):
    """A processor as Spark calls it: packed rows in, packed rows out."""

    def __init__(self, inner: ShareProcessor, found: pa.Schema):
        self.inner, self.found = inner, found

    def init(self, handle: StatefulProcessorHandle) -> None:
        packed = _PackedHandle(handle)
        self.packs = packed.packs
        self.inner.init(packed)

    def _packed(self, tables: Iterable[pa.Table], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for out in self.inner.work(tables, timerValues.getCurrentWatermarkInMs()):
            if not isinstance(out, pa.Table):
                out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), self.found)], schema=self.found)
            yield pd.DataFrame({PACKED: [to_bytes(out)]})
        self.packs.write()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        yield from self._packed((of_bytes(x) for frame in rows for x in frame[PACKED]), timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._packed([], timerValues)

    def close(self) -> None:
        self.inner.close()


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def of_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as one row of bytes for each share; a task gathers some before."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACKED_ROWS or size >= PACKED_BYTES:
            yield from _by_share(held)
            held, rows, size = [], 0, 0
    if rows:
        yield from _by_share(held)


def _by_share(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    shares = table.column(SHARE).to_numpy()
    order = np.argsort(shares, kind="stable")
    shares, table = shares[order], table.drop_columns([SHARE]).take(pa.array(order)).combine_chunks()
    starts = [0, *(np.flatnonzero(np.diff(shares)) + 1).tolist(), len(shares)]
    packed = [to_bytes(table.slice(a, b - a)) for a, b in zip(starts, starts[1:])]
    yield pa.record_batch([pa.array(shares[starts[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=[SHARE, PACKED])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of packed ones."""
    for batch in batches:
        for data in batch.column(0):
            yield from of_bytes(data.as_buffer()).to_batches()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _fields(schema: str) -> list[list[str]]:
    return [f.split() for f in schema.split(", ")]


def names(schema: str) -> list[str]:
    """Column names of a schema written as ``a long, b string``."""
    return [f[0] for f in _fields(schema)]


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in _fields(schema)])


@dataclass(frozen=True)
class Dealt:
    """Packed rows by share, and the keys that they were dealt by."""

    rows: DataFrame
    keys: list[T.StructField]


def deal(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: int = SHARES) -> Dealt:
    """
    Deal rows into shares of their keys, and pack them.

    Keys are told apart by their text; null is a key like others. Several processors may be called for what was dealt once: it is shuffled once.
    """
    own = [rows.schema[k] for k in keys]
    text = F.to_json(F.array(*[(F.hex(k.name) if isinstance(k.dataType, T.BinaryType) else F.col(k.name)).cast("string") for k in own]))
    dealt = rows.withColumn(KEY, text).select(F.pmod(F.xxhash64(KEY), F.lit(shares)).cast("int").alias(SHARE), KEY, *columns)
    return Dealt(dealt.mapInArrow(pack, f"{SHARE} int, {PACKED} binary").repartition(SHARE), own)


def in_shares(dealt: Sequence[Dealt], processor: ShareProcessor, found: str) -> DataFrame:
    """Call the processor for the rows of each share, dealt by the same keys: the keys, in their types, and the columns of ``found``."""
    rows, own = dealt[0].rows, dealt[0].keys
    for more in dealt[1:]:
        rows = rows.unionByName(more.rows)
    out = rows.groupBy(SHARE).transformWithStateInPandas(
        PackedProcessor(processor, arrow_schema(f"{KEY} string, {found}")), outputStructType=f"{PACKED} binary", outputMode="append", timeMode="eventTime"
    ).mapInArrow(unpack, f"{KEY} string, {found}")
    parts = F.from_json(KEY, T.ArrayType(T.StringType()))
    values = [(F.unhex(parts[i]) if isinstance(k.dataType, T.BinaryType) else parts[i].cast(k.dataType)).alias(k.name) for i, k in enumerate(own)]
    return out.select(*values, *names(found))
