"""Fold ordered inserts and updates into a keyed table.

The rows already in the table join the timeline of their key as its earliest entry, so that a batch of inserts and updates is one window
and one aggregation: no join, and no driver-side loop over statements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators.sessions import ACTIVE, FINISHED, TIMED_OUT
from callscope.operators.slots import KeySlots, before, join_groups

INSERT, UPDATE, RETRACT, STORED = "insert", "update", "retract", "stored"
STATES = (ACTIVE, FINISHED, TIMED_OUT)


def fold_changes(
    current: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: str,
    longest: Sequence[str] = (),
    non_empty: Sequence[str] = (),
    newest: Sequence[str] = (),
    fixed: Sequence[str] = (),
    state: str = "state",
    kind: str = "kind",
    hot_rows: int | None = None,
    slot_width: int = 100_000,
) -> DataFrame:
    """The table after ``changes``, applied in the order of the whole-number column ``order``.

    An insert creates the row. On an existing row it merges only while the state is active, and does not touch the state. An
    update merges in every state and sets it; without a row it does nothing. ``longest`` columns take a strictly longer text,
    ``non_empty`` columns the newest text that is not empty, ``newest`` columns the newest value given by an update,
    and ``fixed`` columns stay as the creating insert set them.
    """
    columns = [*keys, *longest, *non_empty, *newest, *fixed, state]
    stored = current.select(*columns, F.lit(None).cast("bigint").alias("__at"), F.lit(STORED).alias("__kind"))
    incoming = changes.select(*columns, F.col(order).cast("bigint").alias("__at"), F.col(kind).alias("__kind"))
    timeline = stored.unionByName(incoming).withColumn("__slot_at", F.coalesce("__at", F.lit(-1)))
    slots = KeySlots(timeline, keys, F.col("__slot_at"), slot_width, hot_rows)
    timeline, window = slots.rows, slots.window(["__slot_at"])

    stored_or_insert = F.col("__kind") != UPDATE
    # An update counts for the state only once the row exists, so the first row or insert comes along.
    timeline = timeline.withColumn("__made", F.max(stored_or_insert).over(before(window)))
    timeline = slots.carry(
        timeline,
        [F.min(F.when(stored_or_insert, F.col("__slot_at"))).alias("made_at")],
        lambda ends, along: ends.withColumn("__carried_made", F.min("made_at").over(before(along))),
        ["__carried_made"],
    )
    exists = F.coalesce("__made", F.lit(False)) | F.col("__carried_made").isNotNull()
    timeline = timeline.withColumn("__exists", exists).filter(stored_or_insert | F.col("__exists"))
    creates = (F.col("__kind") == STORED) | ((F.col("__kind") == INSERT) & ~F.col("__exists"))
    # What sets the state: the stored row, the creating insert, and every update.
    timeline = timeline.withColumn("__sets", F.when(creates | (F.col("__kind") == UPDATE), F.col(state)))
    timeline = timeline.withColumn("__state_before", F.last("__sets", ignorenulls=True).over(before(window)))
    timeline = timeline.drop("__carried_made")
    timeline = slots.carry(
        timeline,
        [F.max_by("__sets", F.when(F.col("__sets").isNotNull(), F.col("__slot_at"))).alias("newest_state")],
        lambda ends, along: ends.withColumn("__carried_state", F.last("newest_state", ignorenulls=True).over(before(along))),
        ["__carried_state"],
    )
    state_before = F.coalesce("__state_before", "__carried_state")
    applied = timeline.filter((F.col("__kind") == UPDATE) | creates | (state_before == ACTIVE))

    at = F.col("__slot_at")

    def earliest_longest(column: str) -> Column:
        value = F.when(F.col(column).isNotNull(), F.struct(F.char_length(column), -at))
        return F.max_by(column, value).alias(column)

    def latest(column: str, when: Column) -> Column:
        return F.max_by(column, F.when(when, at)).alias(column)

    updates_or_creates = (F.col("__kind") == UPDATE) | creates
    return applied.groupBy(*keys).agg(
        *[earliest_longest(c) for c in longest],
        *[
            F.coalesce(F.max_by(c, F.when((F.col(c) != "") & F.col(c).isNotNull(), at)), F.min_by(c, F.when(creates, at))).alias(c)
            for c in non_empty
        ],
        *[latest(c, F.col(c).isNotNull() & updates_or_creates) for c in newest],
        *[F.min_by(c, F.when(creates, at)).alias(c) for c in fixed],
        F.max_by("__sets", F.when(F.col("__sets").isNotNull(), at)).alias(state),
    )


def without_retracted(changes: DataFrame, keys: Sequence[str], kind: str = "kind", revision: str = "revision") -> DataFrame:
    """
    Changes that no retraction took back, retractions left out.

    A retraction takes back all changes of its key with a smaller revision, whenever they arrive. Retractions are few: one number for each key that has some.
    """
    newest = changes.filter(F.col(kind) == RETRACT).groupBy(*keys).agg(F.max(revision).alias("__retracted"))
    marked = join_groups(changes.filter(F.col(kind) != RETRACT), newest, keys, ["__retracted"])
    return marked.filter(F.col("__retracted").isNull() | (F.col(revision) >= F.col("__retracted"))).drop("__retracted")


def needed_changes(changes: DataFrame, keys: Sequence[str], order: str, heavy: Sequence[str], kind: str = "kind", revision: str = "revision") -> DataFrame:
    """
    Of all changes of some keys, those that may still decide something: folding them gives the same as folding all, whatever arrives later.

    A change that was retracted can't come back, so only the retractions themselves stay. Of the ``heavy`` columns an update keeps its value only if no later update of its key has one:
    where it is applied, the later one is too. The rest is kept: a late insert or update needs the states around its place.
    """
    retractions = changes.filter(F.col(kind) == RETRACT).groupBy(*keys).agg(F.max(revision).alias(revision))
    rows = without_retracted(changes, keys, kind, revision)
    retractions = retractions.withColumn(kind, F.lit(RETRACT))
    if not heavy:
        return rows.unionByName(retractions, allowMissingColumns=True)
    is_update = F.col(kind) == UPDATE
    newest = rows.filter(is_update).groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__newest_{c}") for c in heavy])
    marked = join_groups(rows, newest, keys, [f"__newest_{c}" for c in heavy])
    beaten = {c: F.when(~is_update | (F.col(order) >= F.col(f"__newest_{c}")), F.col(c)) for c in heavy}
    return marked.withColumns(beaten).select(*rows.columns).unionByName(retractions, allowMissingColumns=True)


def check_states(df: DataFrame, state: str = "state") -> DataFrame:
    """Fail the job on a state outside the allowed ones."""
    known = F.col(state).isin(*STATES)
    message = F.concat(F.lit("unknown state: "), F.coalesce(F.col(state), F.lit("null")))
    return df.withColumn(state, F.when(known, F.col(state)).otherwise(F.raise_error(message).cast("string")))
