"""Queries over orders, customers, texts, and packets made from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.naming import output_filename, s3_location
from callscope.functions.privacy import PrivacyRules, privacy_decision, zero_payload
from callscope.functions.sdp import explode_endpoints, parse_bodies
from callscope.functions.sip import is_answer, parse_messages, valid_messages
from callscope.functions.values import endpoint_text, micros
from callscope.operators.filters import id_list_column, is_media_candidate, is_signalling, mirror_allowed, non_empty, parse_port_range
from callscope.operators.fragments import datagrams, fragment_counters
from callscope.operators.nest import json_int, nest, unnest
from callscope.operators.packets import decapsulate, decode_ip, decode_rtp, decode_transport, is_fragment
from callscope.operators.upsert import INSERT, UPDATE, fold_changes
from callscope.options import Options
from callscope.plans.calls import analyse_calls, closes, decode_datagrams, opens, signalling_messages
from callscope.plans.reports import call_lookup
from callscope.queries import frames as f
from callscope.queries.events import DAY_US, events, files_of_piece, k, load, numbered, small_streams
from callscope.schemas import SIP_CALLS
from callscope.sinks.pcap import write_capture_files
from callscope.sources.pcap import read_pcap
from callscope.sinks.tables import CallsTable
from callscope.sources.storage import files_below, scratch_table, shared_folder
from callscope.streaming.calls import write_calls
from callscope.streaming.fragments import stream_datagrams
from callscope.streaming.media import stream_calls


def longest_text(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.struct(F.octet_length("text"), -F.col("turn"))
    rows = load(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), rank).alias("t"))
    return rows.select("conv_id", "t.turn", F.octet_length("t.text").alias("bytes"), F.col("t.text").alias("longest"))


def order_changes(orders: DataFrame) -> DataFrame:
    """Each order as a call that opens with its year (the table has a folder for each start date) and, unless it is open still, ends."""
    key, at = F.col("o_orderkey"), F.unix_micros(F.date_trunc("year", F.col("o_orderdate").cast("timestamp")))
    ends = F.array(F.lit(INSERT), F.lit(UPDATE))
    kinds = F.when(F.col("o_orderstatus") == "O", F.slice(ends, 1, 1)).otherwise(ends)
    rows = orders.withColumn("kind", F.explode(kinds))
    update = F.col("kind") == UPDATE
    return rows.select(
        F.col("o_orderpriority").alias("instance_id"), key.cast("string").alias("call_id"), F.lit(0).cast("bigint").alias("call_seq"), "kind", at.alias("start_us"), at.alias("last_us"),
        F.when(update, at + key).otherwise(at).alias("at_us"), F.when(~update, "active").when(F.col("o_orderstatus") == "F", "finished").otherwise("timedout").alias("state"),
        F.when(update, F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string")).alias("sip_from"),
        F.lit("").alias("sip_to"), F.lit(1).cast("bigint").alias("n_rows"),
    )


def calls_of_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Three streams with checkpoints of their own into one calls table, folded after the second, read through the catalog at the end."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = scratch_table(spark, "calls-of-streams")
    table = CallsTable(spark, f"{folder}/sip_calls")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    for k in range(3):
        part = spark.readStream.schema(schema).parquet(f"{sf}/orders.parquet*").filter(F.col("o_orderkey") % 3 == k)
        write_calls(order_changes(part), table, f"{folder}/progress-{k}", availableNow=True).awaitTermination()
        if k == 1:
            table.compact()
    name = f"calls_{uuid.uuid4().hex}"
    table.publish(name)
    return spark.table(name).select("call_id", "instance_id", F.unix_micros("start_timestamp").alias("start_us"), F.unix_micros("end_timestamp").alias("end_us"), "state", "sip_from")


def calls_any_order(spark: SparkSession, sf: str) -> DataFrame:
    """
    A call for each customer, changed by each of its orders: two writers on the same calls, batches in no order of time (updates before the
    insert they need, ends before the updates they follow), folded after some of them. Every third order inserts, the others update.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = scratch_table(spark, "calls-any-order")
    table = CallsTable(spark, f"{folder}/sip_calls")
    orders, key = load(spark, sf, "orders"), F.col("o_orderkey")
    update, at = key % 3 != 0, F.timestamp_micros(key * 1_000_000)
    end = update & (key % 5 == 0)
    changes = orders.select(
        F.col("o_custkey").cast("string").alias("call_id"), F.lit("i").alias("instance_id"), F.lit(0).cast("bigint").alias("call_seq"),
        F.timestamp_micros(F.lit(0)).alias("start_timestamp"), F.when(end, at).alias("end_timestamp"), F.concat(F.lit("from order "), key.cast("string")).alias("pcap_filename"),
        F.concat("o_orderpriority", F.repeat(F.lit("x"), (key % F.lit(7)).cast("int"))).alias("sip_from"), F.lit("").alias("sip_to"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("s3://b/"), key.cast("string"))).alias("s3_location"),
        F.when(end, "finished").otherwise("active").alias("state"), F.lit(None).cast(SIP_CALLS["rtp_statistics"].dataType).alias("rtp_statistics"),
        at.alias("created_at"), at.alias("updated_at"), F.when(update, UPDATE).otherwise(INSERT).alias("kind"), key.alias("change_no"), F.lit(0).cast("bigint").alias("revision"),
    )
    for n in range(6):
        part = changes.filter(F.pmod(F.xxhash64("change_no"), F.lit(6)) == n)
        table.append(part, n // 2, f"writer-{n % 2}")
        if n in (0, 3):
            table.compact()
    return table.read().select(
        F.col("call_id").cast("bigint").alias("custkey"), "pcap_filename", "sip_from", "s3_location", "state", F.unix_micros("end_timestamp").alias("end_us"), F.unix_micros("updated_at").alias("updated_us"),
    )


def upsert_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders upserted into a stored table of every second customer, so that there are keys with a row and without one."""
    orders, customers = load(spark, sf, "orders"), load(spark, sf, "customer")
    current = customers.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("call_id"), F.substring("c_name", F.lit(1), (F.col("c_custkey") % F.lit(18)).cast("int")).alias("sip_from"),
        F.lit("").alias("s3_location"), F.lit(0).cast("bigint").alias("ended"), F.lit(0).cast("bigint").alias("started"),
        F.when(F.col("c_custkey") % 4 == 0, "active").otherwise("finished").alias("state"),
    )
    update, order = F.col("o_orderkey") % F.lit(3) == 0, F.col("o_orderkey")
    changes = orders.select(
        F.col("o_custkey").alias("call_id"),
        F.concat("o_orderpriority", F.repeat(F.lit("x"), (order % F.lit(7)).cast("int"))).alias("sip_from"),
        F.when(order % 5 == 0, "").otherwise(F.concat(F.lit("s3://b/"), order.cast("string"))).alias("s3_location"),
        F.when(update & (order % 2 == 0), order).alias("ended"),
        order.alias("started"),
        F.when(~update, "active").when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "active").otherwise("timedout").alias("state"),
        F.when(update, UPDATE).otherwise(INSERT).alias("kind"),
        order.alias("change_no"),
    )
    return fold_changes(
        current, changes, ["call_id"], "change_no", longest=["sip_from"], non_empty=["s3_location"], newest=["ended"], fixed=["started"]
    )


def nested_lines(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("lost_packets"))
    return nest(load(spark, sf, "lineitem"), ["l_orderkey"], item)


def nest_streams(spark: SparkSession, sf: str) -> DataFrame:
    return nested_lines(spark, sf).select("l_orderkey", F.to_json("items").alias("rtp_statistics"))


def nest_unnest(spark: SparkSession, sf: str) -> DataFrame:
    rows = nested_lines(spark, sf).select("l_orderkey", F.explode("items").alias("i")).withColumn("json", F.to_json("i"))
    lost = json_int("json", "lost_packets")
    rows = rows.select("l_orderkey", F.col("i.l_linenumber").alias("l_linenumber"), lost.alias("lost_packets"))
    return rows.filter(F.col("lost_packets") > 40).orderBy(F.col("lost_packets").desc())


def unnest_lines(spark: SparkSession, sf: str) -> DataFrame:
    return unnest(nested_lines(spark, sf)).filter("lost_packets <= 3")


def call_lookup_query(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of one call as readable JSON (blanks taken out again to compare)."""
    calls = nested_lines(spark, sf).select(
        F.col("l_orderkey").cast("string").alias("call_id"), F.lit("a").alias("sip_from"), F.lit("b").alias("sip_to"), F.col("items").alias("rtp_statistics")
    )
    found = call_lookup(calls, "7")
    return found.withColumn("rtp_stats", F.regexp_replace("rtp_stats", r"\s", ""))


def privacy_case(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer")
    values = F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit("sip:"), F.col("c_nationkey").cast("string"), F.lit("@x"))
    rules = {
        "everything": PrivacyRules(no_media=True, except_call_id=".*"),
        "targets": PrivacyRules(for_call_id="[05]$", for_from="^BUILD", for_to="sip:1[0-9]@"),
        "exceptions": PrivacyRules(except_call_id="7$", except_from="AUTO.*E"),
        "both": PrivacyRules(for_from="^(BUILD|MACH)", except_call_id="[2-4]$", for_to="sip:3@"),
        "none": PrivacyRules(),
    }
    return rows.select("c_custkey", *[privacy_decision(r, *values).alias(n) for n, r in rules.items()])


def _with_ports(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_orderkey") % F.lit(65536)).cast("int").alias("src_port"),
        (F.col("l_partkey") * F.lit(31) % F.lit(65536)).cast("int").alias("dst_port"),
        F.when(F.col("l_returnflag") == "A", "tcp").otherwise("udp").alias("proto"),
        F.when(F.col("l_linestatus") == "O", F.encode(F.lit("x"), "UTF-8")).otherwise(F.encode(F.lit(""), "UTF-8")).alias("payload"),
    )


def port_range(spark: SparkSession, sf: str) -> DataFrame:
    ports = parse_port_range(" 5060 - 5560 ")
    return _with_ports(spark, sf).filter(is_signalling(ports) & non_empty()).select("l_orderkey", "l_linenumber", "src_port", "dst_port")


def media_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_ports(spark, sf).filter(is_media_candidate(parse_port_range("5060-5560")))
    return rows.groupBy(F.col("dst_port").alias("port")).agg(F.count(F.lit(1)).alias("packets"))


def id_list_filter(spark: SparkSession, sf: str) -> DataFrame:
    mirror = F.struct(F.col("s_nationkey").alias("span_id"), (F.col("s_suppkey") % F.lit(8)).cast("int").alias("vlan"))
    rows = load(spark, sf, "supplier").withColumn("mirror", mirror).filter(mirror_allowed("1, 5,0x0A , 0x10,zz,70000", "1,2,3,0x4,5,"))
    text = F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" ,0x"), F.hex("s_suppkey"), F.lit(",bad,,70000,0x1FFFF"))
    return rows.select("s_suppkey", "s_nationkey", F.array_join(id_list_column(text).cast("array<string>"), ",").alias("ids"))


def header_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations")
    body = F.encode("text", "UTF-8")
    size = F.octet_length("text")
    length = F.when(F.col("turn") % 4 == 3, None).when(F.col("turn") % 4 == 2, size + F.lit(100)).otherwise(size)
    first = F.when(F.col("turn") == 0, "INVITE sip:b SIP/2.0").when(F.col("role") == "assistant", "SIP/2.0 200 OK").otherwise("bye sip:b SIP/2.0")
    call_id = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("@é"))
    sip_from = F.when(F.col("conv_id") % 11 == 5, "").otherwise(F.concat(F.lit("<sip:"), "role", F.lit(">;tag=é")))
    payload = f.sip(first, call_id, sip_from, F.lit("B <sip:b>"), body, length)
    messages = valid_messages(parse_messages(rows.select("conv_id", "turn", payload.alias("payload"))))
    return messages.select(
        "conv_id", "turn", "method", "call_id", "sip_from", "sip_to", "content_length", is_answer(F.col("method")).alias("is_answer"),
        F.col("body").cast("string").alias("body"),
    )


def _sdp_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % F.lit(256)).cast("string"), F.lit("."), k().cast("string"))
    text = F.concat(
        F.lit("v=0\r\nc=IN IP4 1.1.1.1\r\nc=IN IP4 "), ip, F.lit("\r\nm=audio "), (F.lit(10000) + e % F.lit(20000)).cast("string"), F.lit(" RTP/AVP 0\r\n"),
        F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("a=ptime:"), (e % F.lit(5) * F.lit(10)).cast("string"), F.lit("\r\na=ptime:x\r\n"))),
        F.lit("m=video "), (F.lit(30000) + e % F.lit(40000)).cast("string"), F.lit(" RTP/AVP 31\nc=IN IP4 10.9.9.9 \r\n"),
        F.when(e % 2 == 0, "a=inactive\r\n").otherwise("a=sendrecv\r\n"),
    )
    return events(spark, sf).withColumn("body", F.encode(text, "UTF-8"))


def sdp_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = explode_endpoints(parse_bodies(_sdp_rows(spark, sf)))
    return rows.select("event_id", "m_index", "ip", "port", "ptime")


def output_names(spark: SparkSession, sf: str) -> DataFrame:
    name = output_filename(F.col("c_name"))
    prefix = F.when(F.col("c_custkey") % 3 == 0, "s3://bucket").when(F.col("c_custkey") % 3 == 1, "s3://bucket/a/b").otherwise("file:///x")
    return load(spark, sf, "customer").select("c_custkey", name.alias("filename"), s3_location(prefix, name).alias("s3_location"))


def rtp_decode(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    first = F.when(e % 10 == 9, 0x40).otherwise(0x80)
    payload = f.rtp(F.col("seq"), e * F.lit(40009) % F.lit(2**32), f.octets("AABB"), first)
    rows = numbered(spark, sf).withColumn("payload", F.when(e % 13 == 0, F.substring(payload, 1, 11)).otherwise(payload))
    return decode_rtp(rows.select("event_id", "payload")).filter(F.col("seq").isNotNull()).select("event_id", "seq", "ssrc")


def payload_zero(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    csrc, padded, extended = e % F.lit(3), e % F.lit(2), F.floor(e / F.lit(2)) % F.lit(2)
    media = F.repeat(F.lit("5A"), k().cast("int"))
    payload = f.join(
        f.be(F.lit(0x80) + csrc + padded * F.lit(32) + extended * F.lit(16), 1), f.octets("00"), f.be(F.col("seq"), 2), f.octets("00000000"),
        f.be(e, 4), F.unhex(F.repeat(F.lit("11223344"), csrc.cast("int"))),
        F.when(extended == 1, f.octets("ABCD000155667788")).otherwise(f.octets("")), F.unhex(media),
        F.when(padded == 1, f.octets("00000004")).otherwise(f.octets("")),
    )
    rows = numbered(spark, sf).select("event_id", payload.alias("payload"))
    return rows.select("event_id", F.lower(F.hex(zero_payload(F.col("payload")))).alias("cleared"))


def _event_frames(spark: SparkSession, sf: str, payload, src_port=None, dst_port=None, flags=0) -> DataFrame:
    """Ethernet frames from user 10.0.x.y to 10.1.0.k."""
    src, dst = F.lit(0x0A000000) + F.col("user_id") % F.lit(65536), F.lit(0x0A010000) + k()
    data = f.ethernet(f.ipv4(src, dst, 17, f.udp(src_port, dst_port, payload), F.col("event_id") % F.lit(65536), flags))
    rows = numbered(spark, sf).withColumn("data", data)
    return rows.withColumns({
        "cap_len": F.octet_length("data"), "orig_len": F.octet_length("data"), "link_type": F.lit(1), "instance_id": F.lit("events"),
    })


def ip_decode(spark: SparkSession, sf: str) -> DataFrame:
    flags = F.when(F.col("event_id") % 7 == 0, 0x2000).when(F.col("event_id") % 7 == 1, 5).otherwise(0)
    port = F.lit(1024) + F.col("event_id") % F.lit(60000)
    rows = _event_frames(spark, sf, F.encode("event_type", "UTF-8"), port, F.lit(5060), flags)
    # Link padding after the packet, as on short Ethernet frames.
    rows = decode_ip(rows.withColumn("data", F.concat("data", f.octets("000000")))).withColumn("is_fragment", is_fragment())
    rows = decode_transport(rows)
    return rows.select(
        "event_id", endpoint_text("src_ip", "src_port").alias("src"), endpoint_text("dst_ip", "dst_port").alias("dst"), "proto", "ip_id",
        "is_fragment", F.col("payload").cast("string").alias("payload"),
    )


def mirror_decode(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    span, vlan = e % F.lit(1024), F.col("user_id") % F.lit(4096)
    kind2 = f.join(f.octets("100088BE"), f.be(e, 4), f.be(F.lit(0x1000) + vlan, 2), f.be(span, 2), f.octets("00000001"))
    flags = (e % F.lit(2)) * F.lit(8) + F.when(e % 8 == 5, 1).otherwise(0)
    kind3 = f.join(
        f.octets("100022EB"), f.be(e, 4), f.be(F.lit(0x2000) + vlan, 2), f.be(span, 2), f.be(e * F.lit(1009), 4), f.octets("0064"), f.be(flags, 2),
        F.when(e % 8 == 5, f.octets("0102030405060708")).otherwise(f.octets("")),
    )
    head = (
        F.when(e % 4 == 0, f.octets("000088BE")).when(e % 4 == 1, kind3).when(e % 4 == 2, kind2).otherwise(f.octets("00000800"))
    )
    inner = f.ethernet(f.ipv4(F.lit(0x0A000001), F.lit(0x0A000002), 17, f.udp(F.lit(1), F.lit(2), F.encode("event_type", "UTF-8"))))
    data = f.ethernet(f.ipv4(F.lit(0x09000001), F.lit(0x09000002), 47, f.join(head, inner)))
    rows = events(spark, sf).select("event_id", "ts", F.lit(1).alias("link_type"), data.alias("data"))
    rows = rows.withColumns({"cap_len": F.octet_length("data"), "orig_len": F.octet_length("data")})
    return decapsulate(decode_ip(rows)).select("event_id", "mirror.*", "cap_len")


def document_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in pieces of 1480 bytes, out of order; every ninth one misses its last piece, every fifth has its first one twice."""
    docs = load(spark, sf, "documents").withColumns({"data": F.encode("text", "UTF-8"), "size": F.octet_length("text")})
    pieces = F.ceil(F.greatest(F.col("size"), F.lit(1)) / F.lit(1480)).cast("int")
    rows = docs.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - F.lit(1)))).withColumn("n", pieces)
    twice = F.when((F.col("doc_id") % 5 == 0) & (F.col("piece") == 0) & (F.col("n") > 1), 2).otherwise(1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), twice)))
    last = F.col("piece") == F.col("n") - F.lit(1)
    rows = rows.filter(~((F.col("doc_id") % 9 == 0) & last))
    # Odd documents arrive back to front.
    place = F.when(F.col("doc_id") % 2 == 1, F.col("n") - F.col("piece")).otherwise(F.col("piece"))
    at = F.col("doc_id") * F.lit(1_000_000) + place * F.lit(2) + F.col("copy")
    return rows.select(
        "doc_id",
        at.alias("frame_no"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + at).alias("ts"),
        (F.col("piece") * F.lit(1480)).alias("fragment_offset"),
        (~last).alias("more_fragments"),
        F.substring("data", F.col("piece") * F.lit(1480) + F.lit(1), F.lit(1480)).alias("ip_payload"),
        "size",
    )


def _reassembled(spark: SparkSession, sf: str) -> DataFrame:
    shared_folder(spark)
    end = F.lit(1_700_000_000_000_000 + 10**15)
    return datagrams(document_fragments(spark, sf), ["doc_id"], capture_end_us=end)


def fragment_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    rows = _reassembled(spark, sf)
    return rows.select("doc_id", "n_fragments", "status", F.octet_length("payload").alias("size"), F.md5("payload").alias("digest"))


def stream_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    """The datagrams of ``fragment_reassembly`` by Structured Streaming: fragments in files that each hold some of all times, a third per micro-batch, and at the end a row that moves time past all timeouts."""
    folder = scratch_table(spark, "fragments")
    rows = document_fragments(spark, sf)
    files = files_of_piece(load(spark, sf, "documents").count(), 3, 20_000)
    rows.repartition(3 * files, F.pmod(F.xxhash64("frame_no"), F.lit(64 * files))).write.parquet(folder)
    end = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.timestamp_micros(F.lit(1_700_000_000_000_000 + 10**15)).alias("ts") for f in rows.schema.fields]
    spark.range(1).select(*end).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    found, out = stream_datagrams(stream, ["doc_id"], lateness="30 days"), scratch_table(spark, "datagrams")
    with small_streams(spark):
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("doc_id", "n_fragments", "status", F.octet_length("payload").alias("size"), F.md5("payload").alias("digest"))


def fragment_counters_query(spark: SparkSession, sf: str) -> DataFrame:
    return fragment_counters(_reassembled(spark, sf))


def call_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A capture made from events: ``signup`` invites and names the user's own endpoint, ``error`` says bye, the rest are media."""
    return _frames_of(numbered(spark, sf))


def _frames_of(rows: DataFrame) -> DataFrame:
    """The frames of numbered events."""
    user, e = F.col("user_id"), F.col("event_id")
    body = F.encode(
        F.concat(
            F.lit("v=0\r\nc=IN IP4 10.2."), F.floor(user / F.lit(256)).cast("string"), F.lit("."), (user % F.lit(256)).cast("string"),
            F.lit("\r\nm=audio 4000 RTP/AVP 0\r\na=ptime:30\r\n"),
        ),
        "UTF-8",
    )
    kind = F.col("event_type")
    line = F.when(kind == "signup", "INVITE sip:b SIP/2.0").otherwise("BYE sip:b SIP/2.0")
    message = f.sip(line, F.concat(F.lit("user-"), user.cast("string")), F.concat(F.lit("<sip:u>;tag="), e.cast("string")), F.lit("<sip:b>"), body, F.octet_length(body))
    media = f.rtp(F.col("seq"), user, f.octets("AABBCCDD"))
    signalling = kind.isin("signup", "error")
    src, dst = F.lit(0x0A010000), F.lit(0x0A020000) + user % F.lit(65536)
    payload = F.when(signalling, f.udp(F.lit(5060), F.lit(5060), message)).otherwise(f.udp(F.lit(9), F.lit(4000), media))
    rows = rows.withColumn("data", f.ethernet(f.ipv4(src, dst, 17, payload)))
    return rows.select(
        F.lit("events").alias("capture_file"), "frame_no", F.col("ts").cast("timestamp").alias("ts"), F.octet_length("data").alias("cap_len"),
        F.octet_length("data").alias("orig_len"), F.lit(1).alias("link_type"), "data", F.lit("events").alias("instance_id"), "user_id", "event_id",
    )


def _analysis(spark: SparkSession, sf: str):
    return analyse_calls(call_frames(spark, sf).drop("user_id", "event_id"), Options("5060-5060", call_timeout_us=DAY_US, close_at_end=False))


def call_analysis(spark: SparkSession, sf: str) -> DataFrame:
    calls = _analysis(spark, sf).calls
    user = F.regexp_extract("call_id", "[0-9]+", 0).cast("bigint")
    return calls.select(
        user.alias("user_id"), micros("start_ts").alias("start_us"), micros("last_ts").alias("last_us"), "state", "sip_packets", "media_packets",
        "ptime_ms", "sip_from", "output_filename",
    )


def call_streams_query(spark: SparkSession, sf: str) -> DataFrame:
    streams = _analysis(spark, sf).streams
    return streams.select(
        F.col("ssrc").alias("user_id"), micros("start_ts").alias("start_us"), "packet_count", "lost_packets", "out_of_order_count", "duplicate_count",
        "max_delta_ms", "min_delta_ms", "avg_delta_ms", "src_endpoint", "dst_endpoint",
    )


def streamed_frames(spark: SparkSession, sf: str, pieces: int = 4, rows_of_file: int = 100_000) -> DataFrame:
    """The frames of ``call_frames`` as a stream: one micro-batch after the other, each holding a quarter of the time."""
    made = numbered(spark, sf)
    folder = scratch_table(spark, "frames")
    first, last, n_rows = made.agg(F.min(micros("ts")), F.max(micros("ts")), F.count(F.lit(1))).first()
    files = files_of_piece(n_rows, pieces, rows_of_file)
    piece = F.least(F.floor((micros("ts") - first) * pieces / (last - first)), F.lit(pieces - 1))
    for n in range(pieces):
        # Events are dealt to the files' tasks, which make the frames.
        part = made.filter(piece == n).select("event_id", "frame_no", "seq", "user_id", "event_type", "ts")
        part = _frames_of(part.repartition(files) if files > 1 else part.coalesce(1)).drop("user_id", "event_id")
        part.write.mode("append").parquet(folder)
        # A micro-batch takes a number of files: empty ones fill up a piece of few rows, or none.
        for _ in range(files * (n + 1) - len(files_below(spark, folder, ".parquet"))):
            spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _streamed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Options]:
    """Messages and media packets of the streamed frames."""
    options = Options("5060-5060", call_timeout_us=DAY_US, close_at_end=False)
    datagrams = decode_datagrams(streamed_frames(spark, sf), options)
    return signalling_messages(datagrams, options), datagrams.filter(is_media_candidate(options.ports)), options


def _streamed_calls(spark: SparkSession, sf: str) -> DataFrame:
    messages, packets, options = _streamed(spark, sf)
    changes = stream_calls(messages, packets, opens(), closes(), options.call_timeout_us, lateness="0 seconds", always=True)
    folder = scratch_table(spark, "stream-calls")
    table = CallsTable(spark, f"{folder}/sip_calls")
    with small_streams(spark):
        write_calls(changes, table, f"{folder}/progress", availableNow=True).awaitTermination()
    return table.read()


def stream_call_streams(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of ``call_streams`` by Structured Streaming, from the calls table."""
    streams = unnest(_streamed_calls(spark, sf), "rtp_statistics")
    return streams.select(
        F.conv("ssrc", 16, 10).cast("bigint").alias("user_id"), micros("start_timestamp").alias("start_us"), "packet_count", "lost_packets", "out_of_order_count", "duplicate_count",
        "max_delta_ms", "min_delta_ms", "avg_delta_ms", "src_endpoint", "dst_endpoint",
    )


def stream_call_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of ``call_analysis`` by Structured Streaming: messages and media of a stream of frames into the calls table."""
    return _streamed_calls(spark, sf).select(
        F.regexp_extract("call_id", "[0-9]+", 0).cast("bigint").alias("user_id"), micros("start_timestamp").alias("start_us"),
        micros("end_timestamp").alias("end_us"), "state", "sip_from", F.col("pcap_filename").alias("output_filename"),
    )


def pcap_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of each user into a capture file, and all files back into rows."""
    rows = call_frames(spark, sf).withColumn("call_file", F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(".pcap")))
    folder = scratch_table(spark, "captures")
    write_capture_files(spark, rows, folder)
    back = read_pcap(spark, f"{folder}/*.pcap")
    user = F.regexp_extract("capture_file", r"user-([0-9]+)[.]", 1).cast("bigint")
    return back.select(user.alias("user_id"), "frame_no", micros("ts").alias("us"), "cap_len", "link_type")
