"""Sessions per key: opened by one kind of row, closed by another or by inactivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.values import micros, position
from callscope.operators.slots import MINUTE_US, SLOT, KeySlots, before, running

ACTIVE, FINISHED, TIMED_OUT = "active", "finished", "timedout"


def mark_sessions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    opens: Column,
    closes: Column,
    timeout_us: int = 0,
    ts: str = "ts",
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """Add ``call_seq``, ``in_call`` and ``since`` to every row.

    A new ``call_seq`` begins after a closing row and after a silence longer than ``timeout_us`` (0 or less: never). Within
    one ``call_seq`` the session starts at the first opening row; ``in_call`` is false before it. ``since`` is the position of
    the first row of the ``call_seq``. ``order`` must start with ``ts``.
    """
    marked = df.withColumns({"__us": micros(ts), "__opens": F.coalesce(opens, F.lit(False)), "__closes": F.coalesce(closes, F.lit(False))})
    slots = KeySlots(marked, keys, F.col("__us"), slot_us, hot_rows)
    marked, window = slots.rows, slots.window(order)

    broken = F.lag("__closes").over(window) | _silent(F.col("__us") - F.lag("__us").over(window), timeout_us)
    marked = marked.withColumn("__break", F.coalesce(broken, F.lit(False)).cast("int"))
    marked = marked.withColumn("__seg", F.sum("__break").over(running(window)))
    marked = marked.withColumn("__open_seg", F.max(F.when(F.col("__opens"), F.col("__seg"))).over(running(window)))
    first_of_key = F.col(SLOT).isNull() & (F.row_number().over(window) == 1)
    marked = marked.withColumn("__starts", F.when((F.col("__break") == 1) | first_of_key, position(order)))
    marked = marked.withColumn("__since", F.max("__starts").over(running(window)))

    def carry(ends, along):
        boundary = F.lag("last_closes").over(along) | _silent(F.col("first_us") - F.lag("last_us").over(along), timeout_us)
        ends = ends.withColumn("step", F.coalesce(boundary, F.lit(False)).cast("int"))
        shift = F.sum("step").over(running(along)) + F.coalesce(F.sum("breaks").over(before(along)), F.lit(0))
        ends = ends.withColumn("__shift", shift)
        begins = F.when((F.col("step") == 1) | (F.row_number().over(along) == 1), F.col("first_at"))
        ends = ends.withColumn("begins", begins)
        since = F.greatest(F.max("begins").over(running(along)), F.max("since").over(before(along)))
        ends = ends.withColumn("__carried_since", since)
        return ends.withColumn("__carried_open", F.max(F.col("open_seg") + F.col("__shift")).over(before(along)))

    marked = slots.carry(
        marked,
        [
            F.min("__us").alias("first_us"),
            F.max("__us").alias("last_us"),
            F.max_by("__closes", position(order)).alias("last_closes"),
            F.sum("__break").alias("breaks"),
            F.max("__open_seg").alias("open_seg"),
            F.min(position(order)).alias("first_at"),
            F.max("__since").alias("since"),
        ],
        carry,
        ["__shift", "__carried_open", "__carried_since"],
    )
    shift = F.coalesce("__shift", F.lit(0))
    open_seg = F.greatest(F.col("__open_seg") + shift, F.col("__carried_open"))
    call_seq = (F.col("__seg") + shift).cast("bigint")
    return marked.withColumns({
        "call_seq": call_seq,
        "in_call": F.coalesce(open_seg == call_seq, F.lit(False)),
        "since": F.coalesce("__since", "__carried_since"),
    }).drop(
        "__us", "__opens", "__closes", "__break", "__seg", "__open_seg", "__starts", "__since",
        "__shift", "__carried_open", "__carried_since", SLOT,
    )


def session_state(closed: Column, last_us: Column, capture_end_us: Column, timeout_us: int, close_at_end: bool) -> Column:
    """State of a session from its closing flag and its last activity."""
    idle = _silent(capture_end_us - last_us, timeout_us)
    return F.when(closed, FINISHED).when(idle, TIMED_OUT).otherwise(FINISHED if close_at_end else ACTIVE)


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    opens: Column,
    closes: Column,
    timeout_us: int,
    ts: str = "ts",
    capture_end_us: Column | None = None,
    close_at_end: bool = False,
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per session: start, end (null while active), last activity, state, row count and ``extra`` aggregates.

    ``capture_end_us`` is the moment the open sessions are judged at; default is the newest row.
    """
    if capture_end_us is None:
        capture_end_us = df.agg(F.max(micros(ts)).alias("end")).scalar()
    marked = mark_sessions(
        df.withColumn("__is_close", F.coalesce(closes, F.lit(False))), keys, order, opens, closes, timeout_us, ts, hot_rows, slot_us
    )
    calls = (
        marked.filter("in_call")
        .groupBy(*keys, "call_seq")
        .agg(
            F.min(F.col(ts)).alias("start_ts"),
            F.max(F.col(ts)).alias("last_ts"),
            F.count(F.lit(1)).alias("n_rows"),
            F.max("__is_close").alias("__closed"),
            *extra,
        )
        .withColumn("__end_us", capture_end_us)
    )
    state = session_state(F.col("__closed"), micros("last_ts"), F.col("__end_us"), timeout_us, close_at_end)
    calls = calls.withColumn("state", state)
    end_of_capture = F.timestamp_micros("__end_us").cast(df.schema[ts].dataType)
    end_ts = (
        F.when(F.col("__closed") | (F.col("state") == TIMED_OUT), F.col("last_ts"))
        .when(F.col("state") == FINISHED, end_of_capture)
    )
    return calls.withColumn("end_ts", end_ts).drop("__closed", "__end_us")


def state_counts(calls: DataFrame) -> DataFrame:
    """Total and per-state numbers of calls, one row."""
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"),
        *[F.count(F.when(F.col("state") == s, 1)).alias(f"{s}_calls") for s in (ACTIVE, FINISHED, TIMED_OUT)],
    )


def _silent(gap_us: Column, timeout_us: int) -> Column:
    return gap_us > F.lit(timeout_us) if timeout_us > 0 else F.lit(False)
