"""Statistics of numbered packet streams: loss, duplicates, reordering, inter-arrival time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.values import endpoint_text, micros, position, wrap16
from callscope.operators.slots import MINUTE_US, SLOT, KeySlots, before, running

DEFAULT_PTIME_MS = 20


def unwrap_sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seq: str = "seq",
    ts: str = "ts",
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """Add ``ext_seq`` (64-bit number without wrap), ``delta_us`` (since the previous packet) and ``late``.

    A packet is ``late`` when an earlier arrival of its stream has a higher number.
    """
    return _unwrap(KeySlots(df.withColumn("__us", micros(ts)), keys, F.col("__us"), slot_us, hot_rows), order, seq).drop(SLOT)


def _unwrap(slots: KeySlots, order: Sequence[str], seq: str) -> DataFrame:
    packets, window = slots.rows, slots.window(order)
    step = F.coalesce(wrap16(F.col(seq) - F.lag(seq).over(window)), F.lit(0)).cast("bigint")
    packets = packets.withColumns({"__step": step, "delta_us": F.col("__us") - F.lag("__us").over(window)})
    packets = packets.withColumn("__ext", F.first(seq).over(running(window)) + F.sum("__step").over(running(window)))
    packets = packets.withColumn("__max", F.max("__ext").over(before(window)))

    def carry(ends, along):
        # Where a slot goes on from the one before it, against where its own count began.
        jump = F.lag("last_ext").over(along) + wrap16(F.col("first_seq") - F.lag("last_seq").over(along)) - F.col("first_seq")
        ends = ends.withColumn("jump", F.coalesce(jump, F.lit(0)))
        ends = ends.withColumn("__shift", F.sum("jump").over(running(along)))
        return ends.withColumns({
            "__carried_max": F.max(F.col("max_ext") + F.col("__shift")).over(before(along)),
            "__carried_us": F.lag("last_us").over(along),
        })

    packets = slots.carry(
        packets,
        [
            F.min_by(seq, position(order)).alias("first_seq"),
            F.max_by(seq, position(order)).alias("last_seq"),
            F.max_by("__ext", position(order)).alias("last_ext"),
            F.max("__ext").alias("max_ext"),
            F.max("__us").alias("last_us"),
        ],
        carry,
        ["__shift", "__carried_max", "__carried_us"],
    )
    shift = F.coalesce("__shift", F.lit(0))
    ext = F.col("__ext") + shift
    highest = F.greatest(F.col("__max") + shift, F.col("__carried_max"))
    return packets.withColumns({
        "ext_seq": ext.cast("bigint"),
        "delta_us": F.coalesce(F.col("delta_us"), F.col("__us") - F.col("__carried_us")),
        "late": F.coalesce(ext < highest, F.lit(False)),
    }).drop("__us", "__step", "__ext", "__max", "__shift", "__carried_max", "__carried_us")


def inter_arrival(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ts: str = "ts",
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """Add ``delta_us``, the time since the previous row of the key (null on the first)."""
    slots = KeySlots(df.withColumn("__us", micros(ts)), keys, F.col("__us"), slot_us, hot_rows)
    rows = slots.rows.withColumn("delta_us", F.col("__us") - F.lag("__us").over(slots.window(order)))
    rows = slots.carry(
        rows,
        [F.max("__us").alias("last_us")],
        lambda ends, along: ends.withColumn("__carried_us", F.lag("last_us").over(along)),
        ["__carried_us"],
    )
    return rows.withColumn("delta_us", F.coalesce(F.col("delta_us"), F.col("__us") - F.col("__carried_us"))).drop(
        "__us", "__carried_us", SLOT
    )


def delta_columns(total: str, known: str, smallest: str, largest: str) -> dict[str, Column]:
    """Min, max and mean inter-arrival in ms; 0 where there was no second packet. Negative times never raise the maximum."""
    return {
        "max_delta_ms": F.greatest(F.coalesce(F.col(largest), F.lit(0)), F.lit(0)) / F.lit(1000.0),
        "min_delta_ms": F.coalesce(F.col(smallest), F.lit(0)) / F.lit(1000.0),
        "avg_delta_ms": F.when(F.col(known) > 0, F.col(total) / F.col(known) / F.lit(1000.0)).otherwise(F.lit(0.0)),
    }


def delta_statistics(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str = "ts", hot_rows: int | None = None, slot_us: int = MINUTE_US
) -> DataFrame:
    """Packet count and inter-arrival min, max and mean per key."""
    rows = inter_arrival(df, keys, order, ts, hot_rows, slot_us)
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("delta_us").alias("__total"),
        F.count("delta_us").alias("__known"),
        F.min("delta_us").alias("__smallest"),
        F.max("delta_us").alias("__largest"),
    )
    return totals.select(
        *keys,
        "packet_count",
        *[c.alias(n) for n, c in delta_columns("__total", "__known", "__smallest", "__largest").items()],
    )


def stream_statistics(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seq: str = "seq",
    ts: str = "ts",
    first_of: Sequence[str] = (),
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """One row per stream: counts, loss, duplicates, reordering and inter-arrival times.

    ``first_of`` names columns whose value on the first packet is kept.
    """
    slots = KeySlots(df.withColumn("__us", micros(ts)), keys, F.col("__us"), slot_us, hot_rows)
    packets = _unwrap(slots, order, seq)

    def numbers(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.sum("n").alias("n"),
            F.min_by("late", "at").alias("late"),
            F.sum("total").alias("total"),
            F.sum("known").alias("known"),
            F.min("smallest").alias("smallest"),
            F.max("largest").alias("largest"),
            F.min("at").alias("at"),
            *[F.min_by(c, "at").alias(c) for c in first_of],
        )

    single = packets.select(
        *keys, SLOT, "ext_seq", "late", *first_of,
        position(order).alias("at"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("delta_us").alias("total"),
        F.col("delta_us").isNotNull().cast("bigint").alias("known"),
        F.col("delta_us").alias("smallest"),
        F.col("delta_us").alias("largest"),
    )
    # Rows are already together by keys and slot, so this first step moves nothing. Only a hot stream, cut into slots,
    # can hold one number twice afterwards.
    distinct = numbers(single, [*slots.group, "ext_seq"])
    if slots.any_hot:
        across = numbers(distinct.filter(F.col(SLOT).isNotNull()), [*keys, "ext_seq"])
        distinct = distinct.filter(F.col(SLOT).isNull()).drop(SLOT).unionByName(across)

    streams = distinct.groupBy(*keys).agg(
        F.sum("n").alias("packet_count"),
        F.count(F.lit(1)).alias("distinct_count"),
        F.sum(F.col("late").cast("bigint")).alias("out_of_order_count"),
        F.max("ext_seq").alias("last_ext"),
        F.min_by("ext_seq", "at").alias("first_ext"),
        F.sum("total").alias("total"),
        F.sum("known").alias("known"),
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
        F.min("at").getField("o0").alias("first_ts"),
        *[F.min_by(c, "at").alias(c) for c in first_of],
    )
    span = F.col("last_ext") - F.col("first_ext") + F.lit(1)
    return streams.select(
        *keys,
        *first_of,
        "first_ts",
        "packet_count",
        F.greatest(span - F.col("distinct_count"), F.lit(0)).cast("bigint").alias("lost_packets"),
        "out_of_order_count",
        (F.col("packet_count") - F.col("distinct_count")).cast("bigint").alias("duplicate_count"),
        *[c.alias(n) for n, c in delta_columns("total", "known", "smallest", "largest").items()],
    )


def with_endpoints(df: DataFrame) -> DataFrame:
    """Add source and destination as ``ip:port`` text."""
    return df.withColumns({
        "src_endpoint": endpoint_text("src_ip", "src_port"),
        "dst_endpoint": endpoint_text("dst_ip", "dst_port"),
    })


def effective_ptime(ptime_ms: Column) -> Column:
    """The packet time, or the default where it is missing or not positive."""
    return F.when(ptime_ms > 0, ptime_ms).otherwise(F.lit(DEFAULT_PTIME_MS))


def expected_packets(start: Column, end: Column, ptime_ms: Column) -> Column:
    """Call length in packet times, rounded half up; 0 for calls without length."""
    length_ms = (micros(end) - micros(start)) / F.lit(1000.0)
    return F.when(length_ms > 0, F.round(length_ms / effective_ptime(ptime_ms)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
