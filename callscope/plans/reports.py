"""Reports over the calls table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.nest import unnest


def calls_by_state(calls: DataFrame, state: str = "active", start: str = "start_timestamp") -> DataFrame:
    """Calls of one state, newest first."""
    return calls.filter(F.col("state") == state).orderBy(F.col(start).desc())


def call_lookup(calls: DataFrame, call_id: str, statistics: str = "rtp_statistics") -> DataFrame:
    """One call with its statistics as readable JSON."""
    pretty = F.to_json(statistics, {"pretty": "true"})
    return calls.filter(F.col("call_id") == call_id).select("call_id", "sip_from", "sip_to", pretty.alias("rtp_stats"))


def worst_loss_first(calls: DataFrame, more_than: int = 10, items: str = "rtp_statistics") -> DataFrame:
    """Streams that lost more than ``more_than`` packets, worst first."""
    streams = unnest(calls, items).filter(F.col("lost_packets") > more_than)
    return streams.orderBy(F.col("lost_packets").desc())


def incremental_counters(df: DataFrame, name: str = "capture") -> DataFrame:
    """Attach received and truncated counters to a running query, read by a listener or an ``Observation``."""
    return df.observe(
        name,
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("cap_len") < F.col("orig_len")).alias("truncated"),
    )
