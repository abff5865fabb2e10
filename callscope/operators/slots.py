"""Ordered window work on keys of any size.

A plain window over a key sorts all rows of that key in one task. Here keys holding very many rows ("hot" keys) are
cut into time slots, so that each task sorts one slot. What a row needs from earlier (or later) slots is one summary row per slot: the
summaries are windowed per key, and joined back as carried values.

Whether there are hot keys is counted first, on the key columns alone. Without any, an operator is its plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLOT = "__slot"
MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US

#: A key with more rows than this is cut into slots.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """The keys with more than ``hot_rows`` rows, with their row count ``n``; null is a key like others.

    Counting combines before its shuffle, so a hot key costs no more than any other here.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.lit(hot_rows))


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that adds ``columns`` of the one row per group in ``groups``; nulls in ``keys`` equal nulls, as in a groupBy."""
    named = groups.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *columns)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(named, same, "left").drop(*[f"__of_{k}" for k in keys])


class KeySlots:
    """Rows of a DataFrame with their slot: null for ordinary keys, ``position_us div width_us`` for hot ones.

    ``position_us`` must not decrease along the order used later. Rows with a null in their key are one group, as in a groupBy.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], position_us: Column, width_us: int = MINUTE_US, hot_rows: int | None = None
    ):
        self.keys = list(keys)
        hot = hot_keys(df, keys, HOT_ROWS if hot_rows is None else hot_rows)
        self.any_hot = not hot.isEmpty()
        if self.any_hot:
            # One row per hot key: Spark broadcasts them if they are few, else it splits the hot keys' partitions.
            slot = F.when(F.col("__hot"), F.floor(position_us / F.lit(width_us)).cast("bigint"))
            marked = join_groups(df, hot.select(*keys, F.lit(True).alias("__hot")), self.keys, ["__hot"])
            self.rows = marked.withColumn(SLOT, slot).drop("__hot")
        else:
            self.rows = df.withColumn(SLOT, F.lit(None).cast("bigint"))

    @property
    def group(self) -> list[str]:
        """The columns that rows of one task share."""
        return [*self.keys, SLOT] if self.any_hot else self.keys

    def window(self, order: Sequence[str]) -> WindowSpec:
        """Window over one key within one slot."""
        return Window.partitionBy(*self.group).orderBy(*order)

    def carry(
        self,
        df: DataFrame,
        summary: Sequence[Column],
        carry: Callable[[DataFrame, WindowSpec], DataFrame],
        columns: Sequence[str],
    ) -> DataFrame:
        """Summarise each slot, let ``carry`` window the summaries along a key, and join ``columns`` back to the rows.

        The carried columns are null for ordinary keys and, as a rule, in the first slot.
        """
        if not self.any_hot:
            return df.withColumns({c: F.lit(None) for c in columns})
        slots = df.filter(F.col(SLOT).isNotNull()).groupBy(*self.group).agg(*summary)
        along = Window.partitionBy(*self.keys).orderBy(SLOT)
        carried = carry(slots, along).select(*self.group, *columns)
        # df is already partitioned by keys and slot; only the summaries move.
        return join_groups(df, carried, self.group, columns)


def running(window: WindowSpec) -> WindowSpec:
    """Everything up to and with the current row."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(window: WindowSpec) -> WindowSpec:
    """Everything before the current row."""
    return window.rowsBetween(Window.unboundedPreceding, -1)
