"""Headers of captured frames as columns: link layer, mirror encapsulation, IP and transport.

Every step is a projection of byte expressions over the whole table; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.octets import bits, ipv4_text, ipv6_groups, ipv6_text, number, part, rest
from callscope.operators.filters import mirror_allowed
from callscope.operators.settle import settle

# Link types, ether types and protocol numbers.
ETHERNET, RAW_IP, LINUX_COOKED = 1, 101, 113
IPV4, IPV6, VLAN_TAGS = 0x0800, 0x86DD, (0x8100, 0x88A8)
TCP, UDP, GRE = 6, 17, 47
EXTENSION_HEADERS = (0, 43, 60)
MIRROR_12, MIRROR_3 = 0x88BE, 0x22EB


def decode_ip(df: DataFrame, data: str = "data") -> DataFrame:
    """Add the IP columns: version, src_ip, dst_ip, ip_proto, ip_id, more_fragments, fragment_offset, ip_payload, and the
    byte positions of the IP packet and its payload in the frame.

    Frames without an IPv4 or IPv6 header drop out.
    """
    frame, link = F.col(data), F.col("link_type")
    tags = F.when(~number(frame, 12, 2).isin(*VLAN_TAGS), 0).when(number(frame, 16, 2).isin(*VLAN_TAGS), 2).otherwise(1)
    start = F.when(link == ETHERNET, F.lit(14) + F.lit(4) * tags).when(link == LINUX_COOKED, F.lit(16)).when(link == RAW_IP, F.lit(0))
    df = settle(df, {"ip_at": start.cast("int")})
    at = F.col("ip_at")
    df = settle(df, {
        "__first": number(frame, at, 1),
        "__ether": number(frame, at - F.lit(2), 2),
        "__flags": number(frame, at + F.lit(6), 2),
    })
    nibble = bits(F.col("__first"), 4, 15)
    raw = link == RAW_IP
    version = F.when((nibble == 4) & (raw | (F.col("__ether") == IPV4)), 4).when((nibble == 6) & (raw | (F.col("__ether") == IPV6)), 6)
    df = settle(df, {"version": version}).filter(F.col("version").isNotNull())

    v4, flags, size = F.col("version") == 4, F.col("__flags"), F.octet_length(frame)
    # Extension headers of IPv6 may follow each other: (protocol, offset) steps over at most three.
    first6 = F.struct(number(frame, at + F.lit(6), 1).alias("proto"), (at + F.lit(40)).cast("bigint").alias("at"))
    chain = F.aggregate(
        F.sequence(F.lit(1), F.lit(3)),
        first6,
        lambda h, _: F.when(
            h["proto"].isin(*EXTENSION_HEADERS),
            F.struct(
                number(frame, h["at"], 1).alias("proto"),
                (h["at"] + F.lit(8) * (number(frame, h["at"] + F.lit(1), 1) + F.lit(1))).alias("at"),
            ),
        ).otherwise(h),
    )
    df = settle(df, {
        "__chain": F.when(~v4, chain),
        "__src4": F.when(v4, number(frame, at + F.lit(12), 4)),
        "__dst4": F.when(v4, number(frame, at + F.lit(16), 4)),
        "__src6": F.when(~v4, ipv6_groups(frame, at + F.lit(8))),
        "__dst6": F.when(~v4, ipv6_groups(frame, at + F.lit(24))),
        "__size": number(frame, F.when(v4, at + F.lit(2)).otherwise(at + F.lit(4)), 2),
    })
    length = F.col("__size")
    end = F.when(v4, at + length).otherwise(at + F.lit(40) + length)
    df = settle(df, {
        "src_ip": F.when(v4, ipv4_text(F.col("__src4"))).otherwise(ipv6_text(F.col("__src6"))),
        "dst_ip": F.when(v4, ipv4_text(F.col("__dst4"))).otherwise(ipv6_text(F.col("__dst6"))),
        "ip_proto": F.when(v4, number(frame, at + F.lit(9), 1)).otherwise(F.col("__chain.proto")),
        "ip_id": F.when(v4, number(frame, at + F.lit(4), 2)),
        "more_fragments": F.when(v4, bits(flags, 13, 1) == 1).otherwise(False),
        "fragment_offset": F.when(v4, bits(flags, 0, 8191) * F.lit(8)).otherwise(0),
        "ip_payload_at": F.when(v4, at + F.lit(4) * bits(F.col("__first"), 0, 15)).otherwise(F.col("__chain.at")).cast("int"),
        # Bytes after the IP packet are link padding; a length of 0 means "to the end of the frame".
        "__end": F.when(length > 0, F.least(end, size)).otherwise(size),
    })
    payload = part(frame, F.col("ip_payload_at"), F.greatest(F.col("__end") - F.col("ip_payload_at"), F.lit(0)).cast("int"))
    df = settle(df, {"ip_payload": payload})
    return df.drop("__first", "__ether", "__flags", "__chain", "__src4", "__dst4", "__src6", "__dst6", "__size", "__end")


def is_fragment() -> Column:
    return F.col("more_fragments") | (F.col("fragment_offset") != 0)


def decode_transport(df: DataFrame) -> DataFrame:
    """Add proto, src_port, dst_port, payload and its byte position in the frame; rows other than TCP and UDP drop out."""
    data, tcp = F.col("ip_payload"), F.col("ip_proto") == TCP
    size = F.octet_length(data)
    proto = F.when(tcp & (size >= 20), "tcp").when((F.col("ip_proto") == UDP) & (size >= 8), "udp")
    length, size = number(data, 4, 2), F.octet_length(data)
    df = settle(df, {
        "proto": proto,
        "src_port": number(data, 0, 2).cast("int"),
        "dst_port": number(data, 2, 2).cast("int"),
        "__head": F.when(tcp, F.lit(4) * bits(number(data, 12, 1), 4, 15)).otherwise(8),
        "__end": F.when(~tcp & (length >= 8), F.least(length, size)).otherwise(size),
    }).filter(F.col("proto").isNotNull())
    payload = part(data, F.col("__head"), F.greatest(F.col("__end") - F.col("__head"), F.lit(0)).cast("int"))
    at = (F.col("ip_payload_at") + F.col("__head")).cast("int")
    return settle(df, {"payload": payload, "payload_at": at}).drop("__head", "__end")


def mirror_header(kind: Column, header: Column) -> tuple[Column, Column]:
    """Metadata and size of a mirror header of kind 1, 2 or 3; null metadata where it is not valid."""
    word0, word1 = number(header, 0, 2), number(header, 2, 2)
    version, size = bits(word0, 12, 15), F.octet_length(header)
    flags = number(header, 10, 2)
    length = F.when(kind == 1, 0).when(kind == 2, 8).when(bits(flags, 0, 1) == 1, 20).otherwise(12)

    def meta(version, span, vlan, direction, ts32):
        return F.struct(
            version.cast("int").alias("version"),
            span.cast("int").alias("span_id"),
            vlan.cast("int").alias("vlan"),
            direction.cast("int").alias("direction"),
            ts32.cast("bigint").alias("ts32"),
        )

    zero = F.lit(0)
    # The mirrored frame must not be empty.
    valid = size > length
    metadata = (
        F.when(valid & (kind == 1), meta(F.lit(1), zero, zero, zero, zero))
        .when(valid & (kind == 2) & (version == 1), meta(version, bits(word1, 0, 1023), bits(word0, 0, 4095), zero, zero))
        .when(
            valid & (kind == 3) & (version == 2),
            meta(version, bits(word1, 0, 1023), bits(word0, 0, 4095), bits(flags, 3, 1), number(header, 4, 4)),
        )
    )
    return metadata, length


def decapsulate(df: DataFrame, span_ids: str = "", vlans: str = "") -> DataFrame:
    """Open mirrored frames: ``data`` becomes the inner frame, ``mirror`` its metadata.

    Takes the output of ``decode_ip``. Rows other than GRE pass unchanged with a null ``mirror``; GRE rows that hold no
    valid, allowed mirrored frame drop out. The IP columns of opened rows are still those of the outer packet.
    """
    gre, data = F.col("ip_proto") == GRE, F.col("ip_payload")
    df = settle(df, {"__flags": F.when(gre, number(data, 0, 2)), "__of": F.when(gre, number(data, 2, 2))})
    checksum, routing, key, sequence, ack = (bits(F.col("__flags"), s, 1) == 1 for s in (15, 14, 13, 12, 7))
    header = F.lit(4)
    for present in (checksum | routing, key, sequence, ack):
        header = header + F.when(present, 4).otherwise(0)
    of = F.col("__of")
    kind = F.when(of == MIRROR_3, 3).when((of == MIRROR_12) & sequence, 2).when(of == MIRROR_12, 1)
    df = settle(df, {"__kind": F.when(gre, kind), "__body": F.when(gre, rest(data, header))})
    metadata, length = mirror_header(F.col("__kind"), F.col("__body"))
    df = settle(df, {"mirror": F.when(gre, metadata), "__inner": F.when(gre, rest(F.col("__body"), length))})
    opened, size = F.col("mirror").isNotNull(), F.octet_length("__inner")
    df = df.filter(~gre | opened).filter(mirror_allowed(span_ids, vlans))
    return settle(df, {
        "data": F.when(opened, F.col("__inner")).otherwise(F.col("data")),
        "cap_len": F.when(opened, size).otherwise(F.col("cap_len")),
        "orig_len": F.when(opened, size).otherwise(F.col("orig_len")),
        "link_type": F.when(opened, F.lit(ETHERNET)).otherwise(F.col("link_type")),
    }).drop("__flags", "__of", "__kind", "__body", "__inner")


IP_COLUMNS = [
    "version", "src_ip", "dst_ip", "ip_proto", "ip_id", "more_fragments", "fragment_offset", "ip_payload", "ip_at", "ip_payload_at",
]


def decode_rtp(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add seq and ssrc; both are null on payloads that are no RTP (shorter than 12 bytes, or another version)."""
    data = F.col(payload)
    rtp = (F.octet_length(data) >= 12) & (bits(number(data, 0, 1), 6, 3) == 2)
    return settle(df, {
        "seq": F.when(rtp, number(data, 2, 2)).cast("int"),
        "ssrc": F.when(rtp, number(data, 8, 4)),
    })


def capture_counters(df: DataFrame) -> DataFrame:
    """Received and truncated frames and the time they span, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("cap_len") < F.col("orig_len")).alias("truncated"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def mirror_sessions(df: DataFrame, keys: list[str], order: list[str], mirror: str = "mirror") -> DataFrame:
    """Per call and span id: VLAN, version and time of the first packet, and the packet count."""
    at = F.struct(*order)
    return (
        df.filter(F.col(mirror).isNotNull())
        .groupBy(*keys, F.col(f"{mirror}.span_id").alias("span_id"))
        .agg(
            F.min_by(F.col(f"{mirror}.vlan"), at).alias("vlan"),
            F.min_by(F.col(f"{mirror}.version"), at).alias("version"),
            F.min(order[0]).alias("first_seen"),
            F.count(F.lit(1)).alias("packet_count"),
        )
    )
