"""Names of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscope.queries import events as e
from callscope.queries import outputs as o
from callscope.queries import tables as t

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "sessionize_events": e.sessionize_events,
        "closed_calls": e.closed_calls,
        "null_groups": e.null_groups,
        "state_counts": e.state_counts_query,
        "active_calls": e.active_calls,
        "inter_arrival": e.inter_arrival_query,
        "sequence_stats": e.sequence_stats,
        "unwrap_sequence": e.unwrapped,
        "worst_loss": e.worst_loss,
        "expected_packets": e.expected_packets_query,
        "stream_endpoints": e.stream_endpoints,
        "asof_attach": e.asof_attach,
        "attach_media": e.attach_both_sides,
        "endpoint_intervals": e.intervals,
        "endpoint_first_seen": e.endpoint_first_seen,
        "media_sessions": e.media_sessions,
        "mirror_sessions": e.mirror_sessions_query,
        "capture_counters": e.capture_counters_query,
        "csv_format": e.csv_format,
        "stream_sessionize": e.stream_sessionize,
        "longest_text": t.longest_text,
        "upsert_orders": t.upsert_orders,
        "calls_of_streams": t.calls_of_streams,
        "calls_any_order": t.calls_any_order,
        "nest_streams": t.nest_streams,
        "nest_unnest": t.nest_unnest,
        "unnest_lines": t.unnest_lines,
        "call_lookup": t.call_lookup_query,
        "privacy_case": t.privacy_case,
        "port_range": t.port_range,
        "media_candidates": t.media_candidates,
        "id_list_filter": t.id_list_filter,
        "header_parse": t.header_parse,
        "sdp_parse": t.sdp_parse,
        "output_names": t.output_names,
        "rtp_decode": t.rtp_decode,
        "payload_zero": t.payload_zero,
        "ip_decode": t.ip_decode,
        "mirror_decode": t.mirror_decode,
        "fragment_reassembly": t.fragment_reassembly,
        "stream_reassembly": t.stream_reassembly,
        "fragment_counters": t.fragment_counters_query,
        "call_analysis": t.call_analysis,
        "call_streams": t.call_streams_query,
        "stream_call_streams": t.stream_call_streams,
        "stream_call_analysis": t.stream_call_analysis,
        "pcap_roundtrip": t.pcap_roundtrip,
        "call_index": o.call_index,
        "call_statistics_table": o.call_statistics_table,
        "call_packet_table": o.call_packet_table,
        "table_statistics": o.table_statistics,
        "filtered_source": o.filtered_source,
        "arriving_captures": o.arriving_captures,
        "rebuilt_packets": o.rebuilt_packets,
        "analysis_counters": o.analysis_counters,
        "mirrored_calls": o.mirrored_calls,
    }
