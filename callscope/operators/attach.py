"""Attach packets to the owner of an endpoint at their moment (as-of join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.values import micros, position
from callscope.operators.slots import MINUTE_US, SLOT, KeySlots, before, running
from callscope.sources.storage import stored

OWNER = "__owner"


def attach_asof(
    probes: DataFrame,
    registrations: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    owner: Sequence[str],
    ts: str = "ts",
    until: str | None = None,
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """Give each probe the ``owner`` columns of the newest registration of its key at or before it (null without one).

    A null in a key equals nothing: such probes stay, without an owner.

    Both sides carry ``keys`` and the ``order`` columns (``ts`` first). ``until`` names a registration column with a
    struct comparable to ``order``: the owner loses the key after it, and no earlier owner gets it back.

    Both sides are merged into one timeline per key, so the work is linear: no pair of probe and registration is ever formed.
    """
    mine = [F.col(c).alias(c) for c in owner] + ([F.col(until).alias("__until")] if until else [])
    left = probes.withColumn("__probe", F.lit(True))
    right = registrations.dropna(subset=list(keys)).select(*keys, *order, F.struct(*mine).alias(OWNER), F.lit(False).alias("__probe"))
    timeline = left.unionByName(right, allowMissingColumns=True)
    slots = KeySlots(timeline, keys, micros(ts), slot_us, hot_rows)
    # A registration counts from its own position on.
    window = slots.window([*order, "__probe"])
    timeline = slots.rows.withColumn("__last", F.last(OWNER, ignorenulls=True).over(running(window)))
    timeline = slots.carry(
        timeline,
        [F.max_by(OWNER, F.when(F.col(OWNER).isNotNull(), position(order))).alias("newest")],
        lambda ends, along: ends.withColumn("__carried", F.last("newest", ignorenulls=True).over(before(along))),
        ["__carried"],
    )
    held = F.coalesce("__last", "__carried")
    found = timeline.filter("__probe").withColumn("__held", held)
    if until:
        over = F.col("__held.__until").isNotNull() & (position(order) > F.col("__held.__until"))
        found = found.withColumn("__held", F.when(~over, F.col("__held")))
    found = found.drop(OWNER, "__probe", "__last", "__carried", SLOT)
    return found.withColumns({c: F.col("__held").getField(c) for c in owner}).drop("__held")


def attach_media(
    packets: DataFrame,
    registrations: DataFrame,
    order: Sequence[str],
    owner: Sequence[str],
    ts: str = "ts",
    until: str | None = None,
    scope: Sequence[str] = (),
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """Attach packets by destination endpoint, those left over by source endpoint; packets without an owner drop out.

    ``scope`` holds further key columns of both sides, such as the instance.
    """

    shared = (registrations, order, owner, ts, until, scope, hot_rows, slot_us)
    # Read three times below; packets are looked up by destination only once.
    by_dst = stored(attach_side(packets, "dst", *shared), "by-destination")
    taken = F.col(owner[0]).isNotNull()
    by_src = attach_side(by_dst.filter(~taken).drop(*owner), "src", *shared)
    return by_dst.filter(taken).withColumn("matched_by", F.lit("dst")).unionByName(
        by_src.filter(taken).withColumn("matched_by", F.lit("src"))
    )


def attach_side(
    packets: DataFrame,
    side: str,
    registrations: DataFrame,
    order: Sequence[str],
    owner: Sequence[str],
    ts: str = "ts",
    until: str | None = None,
    scope: Sequence[str] = (),
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """The owner of each packet's endpoint on one side (``dst`` or ``src``), null without one."""
    keys = [*scope, f"{side}_ip", f"{side}_port"]
    named = registrations.withColumnsRenamed({"ip": f"{side}_ip", "port": f"{side}_port"})
    return attach_asof(packets, named, keys, order, owner, ts, until, hot_rows, slot_us)


def endpoint_intervals(
    registrations: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ts: str = "ts",
    ends: str | None = None,
    hot_rows: int | None = None,
    slot_us: int = MINUTE_US,
) -> DataFrame:
    """Add ``valid_from`` and ``valid_to``: an owner holds its endpoint until the next registration or its own end."""
    slots = KeySlots(registrations, keys, micros(ts), slot_us, hot_rows)
    rows = slots.rows.withColumn("__next", F.lead(ts).over(slots.window(order)))
    rows = slots.carry(
        rows,
        [F.min(ts).alias("first_ts")],
        lambda ends, along: ends.withColumn("__after", F.lead("first_ts").over(along)),
        ["__after"],
    )
    upper: Column = F.coalesce("__next", "__after")
    if ends:
        upper = F.least(upper, F.col(ends))
    return rows.withColumns({"valid_from": F.col(ts), "valid_to": upper}).drop("__next", "__after", SLOT)


def first_per_owner(registrations: DataFrame, owner: Sequence[str], endpoint: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each endpoint of an owner once, with the position it was first seen at (``first_``-prefixed order columns)."""
    first = registrations.groupBy(*owner, *endpoint).agg(F.min(position(order)).alias("__at"))
    return first.select(*owner, *endpoint, *[F.col(f"__at.o{i}").alias(f"first_{c}") for i, c in enumerate(order)])
