"""From captured frames to calls, media streams and the packets of each call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.octets import part, rest
from callscope.functions.naming import output_filename, s3_location
from callscope.functions.privacy import privacy_decision, zero_payload
from callscope.functions.sdp import DEFAULT_PTIME, explode_endpoints, parse_bodies
from callscope.functions.sip import is_answer, parse_messages, valid_messages
from callscope.functions.values import micros, position
from callscope.operators.attach import attach_media, attach_side
from callscope.operators.fragments import FRAGMENT_KEYS, fragment_counters, reassemble
from callscope.operators.fragments import datagrams as fragment_datagrams
from callscope.operators.filters import is_media_candidate, is_signalling, non_empty, source_filter
from callscope.operators.packets import IP_COLUMNS, capture_counters, decapsulate, decode_ip, decode_rtp, decode_transport, is_fragment, mirror_sessions
from callscope.operators.sequence import effective_ptime, expected_packets, stream_statistics, with_endpoints
from callscope.operators.settle import settle
from callscope.operators.sessions import FINISHED, TIMED_OUT, mark_sessions, session_state
from callscope.options import Options
from callscope.sources.storage import stored

CALL = ["instance_id", "call_id"]
#: Frames of several captures may share a time and a number.
ORDER = ["ts", "frame_no", "capture_file"]
FRAME = ["instance_id", *ORDER]
OWNER = ["call_id", "registered"]


@dataclass(frozen=True)
class CallAnalysis:
    """The tables of one analysis. Counters, fragments and mirror sessions are computed when they are read."""

    datagrams: DataFrame
    messages: DataFrame
    registrations: DataFrame
    timeline: DataFrame
    calls: DataFrame
    streams: DataFrame
    counters: DataFrame
    fragments: DataFrame | None
    mirror_sessions: DataFrame


def _with_instance(packets: DataFrame, options: Options) -> DataFrame:
    return packets if "instance_id" in packets.columns else packets.withColumn("instance_id", F.lit(options.instance_id))


def decode_datagrams(packets: DataFrame, options: Options) -> DataFrame:
    """TCP and UDP payloads of captured frames, opened and reassembled as the options say."""
    whole = dict(scope=["instance_id"], timeout_us=options.fragment_timeout_us, hot_rows=options.hot_rows, slot_us=options.slot_us)
    rows = decode_ip(_with_instance(packets, options))
    if options.mirror_enabled:
        rows = source_filter(rows, options.source_filter, mirror_mode=True)
        if options.reassemble:
            rows = reassemble(rows, **whole)
        rows = decapsulate(rows, options.mirror_span_ids, options.mirror_vlans)
        # Only opened frames are decoded anew: a reassembled packet has no frame of its own.
        opened = decode_ip(rows.filter(F.col("mirror").isNotNull()).drop(*IP_COLUMNS))
        rows = rows.filter(F.col("mirror").isNull()).unionByName(opened)
    if options.reassemble:
        rows = reassemble(rows, **whole)
    rows = decode_rtp(decode_transport(rows).filter(non_empty()))
    if not options.mirror_enabled:
        rows = source_filter(rows, options.source_filter)
    if "mirror" not in rows.columns:
        rows = rows.withColumn("mirror", F.lit(None).cast("struct<version:int,span_id:int,vlan:int,direction:int,ts32:bigint>"))
    # The payload is part of the frame; its place is enough.
    return rows.withColumn("payload_size", F.octet_length("payload")).drop("ip_payload", "payload")


def fragment_summary(packets: DataFrame, options: Options, capture_end_us: Column) -> DataFrame:
    """Counters of the fragments of captured frames, one row: of the frames themselves and, in mirror mode, of those opened."""
    keys = ["instance_id", *FRAGMENT_KEYS]
    timing = dict(timeout_us=options.fragment_timeout_us, hot_rows=options.hot_rows, slot_us=options.slot_us)
    rows = decode_ip(_with_instance(packets, options))
    found = fragment_datagrams(rows.filter(is_fragment()), keys, capture_end_us=capture_end_us, **timing).select("n_fragments", "status")
    if options.mirror_enabled:
        rows = decapsulate(reassemble(rows, scope=["instance_id"], **timing), options.mirror_span_ids, options.mirror_vlans)
        opened = decode_ip(rows.filter(F.col("mirror").isNotNull()).drop(*IP_COLUMNS))
        inner = fragment_datagrams(opened.filter(is_fragment()), keys, capture_end_us=capture_end_us, **timing)
        found = found.unionByName(inner.select("n_fragments", "status"))
    return fragment_counters(found)


def payload_of_frame() -> Column:
    return part(F.col("data"), F.col("payload_at"), F.col("payload_size"))


def signalling_messages(datagrams: DataFrame, options: Options) -> DataFrame:
    """Valid messages with their endpoints and packet time."""
    signalling = settle(datagrams.filter(is_signalling(options.ports)), {"payload": payload_of_frame()})
    messages = valid_messages(parse_messages(signalling, compat=options.compat_body)).drop("payload")
    return parse_bodies(messages).withColumn("is_answer", is_answer(F.col("method")))


def opens() -> Column:
    return F.col("method") == "INVITE"


def closes() -> Column:
    return F.col("method").isin("BYE", "CANCEL")


def endpoint_registrations(messages: DataFrame, options: Options) -> DataFrame:
    """Endpoints named by messages of open calls, with the position of the message that ended the call (``ended``)."""
    marked = mark_sessions(messages, CALL, ORDER, opens(), closes(), 0, hot_rows=options.hot_rows, slot_us=options.slot_us)
    marked = marked.filter("in_call")
    ends = marked.filter(closes()).groupBy(*CALL, "call_seq").agg(F.min(position(ORDER)).alias("ended"))
    rows = explode_endpoints(marked.select(*CALL, "call_seq", *ORDER, "endpoints"), options.skip_port_zero)
    rows = rows.join(ends, [*CALL, "call_seq"], "left").withColumn("registered", position(ORDER))
    return rows.drop("call_seq")


def call_timeline(messages: DataFrame, media: DataFrame, options: Options) -> DataFrame:
    """Messages and attached media of each call, numbered by call instance; what belongs to no open call drops out.

    Rows are light: they name their frame, and do not hold it.
    """
    sip = messages.select(
        *CALL, *ORDER, "method", "sip_from", "sip_to", "ptime", "mirror", F.lit(None).cast(_position_type(media)).alias("registered"),
        F.lit(None).cast("int").alias("seq"), F.lit(None).cast("bigint").alias("ssrc"),
        "src_ip", "src_port", "dst_ip", "dst_port",
    )
    rows = sip.unionByName(media, allowMissingColumns=True)
    marked = mark_sessions(rows, CALL, ORDER, opens(), closes(), options.call_timeout_us, hot_rows=options.hot_rows, slot_us=options.slot_us)
    # A timeout also took the endpoints of the call away: media must have been registered since.
    current = F.col("registered").isNull() | (F.col("registered") >= F.col("since"))
    return marked.filter(F.col("in_call") & current)


def summarise_calls(timeline: DataFrame, capture_end_us: Column, options: Options) -> DataFrame:
    """One row per call instance."""
    at, is_sip = position(ORDER), F.col("method").isNotNull()
    start = F.when(opens(), at)

    def longest(column: str) -> Column:
        rank = F.struct(F.octet_length(column), -micros("ts"), -F.col("frame_no"))
        return F.max_by(column, F.when(is_sip, rank)).alias(column)

    calls = timeline.groupBy(*CALL, "call_seq").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("last_ts"),
        F.max(F.coalesce(closes(), F.lit(False))).alias("__closed"),
        longest("sip_from"),
        longest("sip_to"),
        F.min_by("sip_from", start).alias("first_from"),
        F.min_by("sip_to", start).alias("first_to"),
        F.coalesce(F.max_by("ptime", F.when(F.col("ptime").isNotNull(), at)), F.lit(DEFAULT_PTIME)).alias("ptime_ms"),
        F.count_if(is_sip).alias("sip_packets"),
        F.count_if(~is_sip).alias("media_packets"),
    )
    calls = calls.withColumn("__end_us", capture_end_us)
    calls = calls.withColumn(
        "state", session_state(F.col("__closed"), micros("last_ts"), F.col("__end_us"), options.call_timeout_us, options.close_at_end)
    )
    ended_itself = F.col("__closed") | (F.col("state") == TIMED_OUT)
    end = F.when(ended_itself, F.col("last_ts")).when(F.col("state") == FINISHED, F.timestamp_micros("__end_us"))
    uploads = options.upload and options.s3_uri and options.s3_region
    filename = output_filename(F.col("call_id"))
    return calls.withColumns({
        "end_ts": end,
        "output_filename": filename,
        "s3_location": s3_location(F.lit(options.s3_uri), filename) if uploads else F.lit(""),
        "clear_media": privacy_decision(options.privacy, F.col("call_id"), F.col("first_from"), F.col("first_to")),
        "ptime_ms": effective_ptime(F.col("ptime_ms")),
    }).drop("__closed", "__end_us")


def call_streams(timeline: DataFrame, calls: DataFrame, capture_end_us: Column, options: Options) -> DataFrame:
    """One row per call instance and SSRC, with the columns of its call."""
    keys = [*CALL, "call_seq", "ssrc"]
    media = with_endpoints(timeline.filter(F.col("seq").isNotNull()))
    media = media.select(*keys, *ORDER, "seq", "src_endpoint", "dst_endpoint")
    streams = stream_statistics(
        media, keys, ORDER, first_of=["src_endpoint", "dst_endpoint"], hot_rows=options.hot_rows, slot_us=options.slot_us
    )
    of_call = calls.select(
        *CALL, "call_seq", "start_ts", F.coalesce("end_ts", F.timestamp_micros(capture_end_us)).alias("end_ts"),
        "output_filename", "sip_from", "sip_to", "ptime_ms", "s3_location",
    )
    joined = streams.join(of_call, [*CALL, "call_seq"])
    return joined.withColumn("expected_packets", expected_packets(F.col("start_ts"), F.col("end_ts"), F.col("ptime_ms")))


def analyse_calls(packets: DataFrame, options: Options, capture_end_us: Column | None = None) -> CallAnalysis:
    """Build all tables of an analysis.

    Each step reads the one before more than once, so the steps are stored (below ``spark.checkpoint.dir``): frames are decoded
    once, later steps read only the columns they use, and a lost executor costs one step.
    """
    datagrams = stored(decode_datagrams(packets, options), "datagrams")
    if capture_end_us is None:
        # Taken once: calls and streams use the number, not the captures.
        capture_end_us = F.lit(packets.agg(F.max(micros("ts"))).first()[0]).cast("bigint")
    messages = stored(signalling_messages(datagrams, options).drop("data", "body"), "messages")
    registrations = stored(endpoint_registrations(messages, options), "registrations")
    candidates = datagrams.filter(is_media_candidate(options.ports)).select(
        *FRAME, "src_ip", "src_port", "dst_ip", "dst_port", "seq", "ssrc", "mirror"
    )
    looked_up = dict(until="ended", scope=["instance_id"], hot_rows=options.hot_rows, slot_us=options.slot_us)
    media = stored(attach_media(candidates, registrations, ORDER, OWNER, **looked_up), "media")
    timeline = stored(call_timeline(messages, media.drop("matched_by"), options), "timeline")
    timeline = _settled_timeline(messages, media, timeline, registrations, options, looked_up)
    calls = stored(summarise_calls(timeline, capture_end_us, options), "calls")
    streams = call_streams(timeline, calls, capture_end_us, options)
    counters = capture_counters(packets)
    fragments = fragment_summary(packets, options, capture_end_us) if options.reassemble else None
    mirrored = timeline if options.mirror_media else timeline.filter(F.col("method").isNotNull())
    spans = mirror_sessions(mirrored, [*CALL, "call_seq"], ORDER)
    return CallAnalysis(datagrams, messages, registrations, timeline, calls, streams, counters, fragments, spans)


def _settled_timeline(messages: DataFrame, media: DataFrame, timeline: DataFrame, registrations: DataFrame, options: Options, looked_up: dict) -> DataFrame:
    """
    The timeline after all media that was missed has been tried by its source.

    A call that has timed out holds no endpoint: its media is tried again by the source, and what that finds may keep other calls open. Each
    pass moves packets from destination to source only, so there are as many passes as calls that wait for each other, and usually none. A pass
    looks at the calls that the one before it changed, those that lost packets and those that got some, and writes their rows only.
    """
    media_parts, parts, changed = [media], [timeline], []

    def newest(tables: list[DataFrame]) -> DataFrame:
        """Each call's rows from the last table that it was changed in."""
        out = tables[0]
        for calls, table in zip(changed, tables[1:]):
            out = out.join(calls, CALL, "left_anti").unionByName(table)
        return out

    while not (missed := stored(missed_media(media_parts[-1], parts[-1]), "missed")).isEmpty():
        again = attach_side(missed.drop(*OWNER, "matched_by"), "src", registrations, ORDER, OWNER, **looked_up)
        found = stored(again.filter(F.col(OWNER[0]).isNotNull()).withColumn("matched_by", F.lit("src")), "found")
        calls = stored(missed.select(*CALL).unionByName(found.select(*CALL)).distinct(), "changed")
        own = newest(media_parts).join(calls, CALL, "left_semi").join(missed.select(*FRAME), FRAME, "left_anti")
        media_parts.append(stored(own.unionByName(found), "media"))
        rows = call_timeline(messages.join(calls, CALL, "left_semi"), media_parts[-1].drop("matched_by"), options)
        parts.append(stored(rows, "timeline"))
        changed.append(calls)
    return stored(newest(parts), "timeline") if changed else timeline


def call_packets(analysis: CallAnalysis, options: Options) -> DataFrame:
    """The frames of each call: messages always, media unless the privacy rules drop or clear it."""
    names = analysis.calls.select(*CALL, "call_seq", "output_filename", "clear_media")
    rows = analysis.timeline.select(*CALL, "call_seq", *ORDER, "method").join(names, [*CALL, "call_seq"])
    file = F.when(F.col("call_seq") == 0, F.col("output_filename")).otherwise(
        F.concat(F.regexp_replace("output_filename", r"\.pcap$", ""), F.lit("-"), F.col("call_seq").cast("string"), F.lit(".pcap"))
    )
    rows = rows.withColumn("call_file", file)
    hidden = F.col("clear_media") & F.col("method").isNull()
    if options.privacy_mode == "drop":
        rows = rows.filter(~hidden)
    # Frames come back in only here, by their number.
    frames = analysis.datagrams.select(*FRAME, "cap_len", "orig_len", "link_type", "data", "payload_at", "payload_size")
    rows = rows.join(frames, FRAME)
    if options.privacy_mode == "zero":
        end = F.col("payload_at") + F.col("payload_size")
        rows = settle(rows, {"payload": payload_of_frame()})
        cleared = F.concat(part(F.col("data"), 0, F.col("payload_at")), zero_payload(F.col("payload")), rest(F.col("data"), end))
        rows = settle(rows, {"data": F.when(hidden, cleared).otherwise(F.col("data"))}).drop("payload")
    return rows.drop("payload_at", "payload_size")


def missed_media(media: DataFrame, timeline: DataFrame) -> DataFrame:
    """Packets attached by their destination that the timeline left out, as the call had timed out."""
    return media.filter("matched_by = 'dst'").join(timeline.filter("method IS NULL").select(*FRAME), FRAME, "left_anti")


def _position_type(media: DataFrame):
    return media.schema["registered"].dataType
