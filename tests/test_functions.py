"""Known input and output of the column functions."""

import pytest
from pyspark.sql import functions as F

from callscope.functions import naming, sdp, sip, values
from callscope.functions.privacy import PrivacyRules, privacy_decision, zero_payload
from callscope.operators import filters
from callscope.operators.packets import decode_ip, decode_rtp, decode_transport, decapsulate, mirror_header
from callscope.options import Options
from tests import capture as c

DESK = '"Front desk, floor 2" <sip:desk-2@hotel.test;transport=udp>;tag=qq-17'
ROOM = "<sips:room.214@[2001:db8::7]:5061>"
# Message lines, and (method, call id, from, to, body): the usual form, short names in odd order and case, blanks around values, two lengths of which the
# last counts, a start line without a code, a first name without a value, no start line.
MESSAGES = [
    (
        ["REFER sips:room.214@hotel.test SIP/2.0", f"To: {ROOM}", "Via: SIP/2.0/UDP 10.9.8.7", f"From: {DESK}", "Content-Length: 5", "Call-ID: 7/f00d~x%20y", "", "k=v;rest."],
        ("REFER", "7/f00d~x%20y", DESK, ROOM, "k=v;r"),
    ),
    (
        ["message tel:+31-20 SIP/2.0", "L: 0", "I: 0000-17", "T: <tel:+31-20>", "F: <tel:112>;tag=0", "", "ignored"],
        ("MESSAGE", "0000-17", "<tel:112>;tag=0", "<tel:+31-20>", ""),
    ),
    (
        ["PRACK y SIP/2.0", "From: \t two  words  <sip:w@x.test> ; tag=9 ", "Call-ID:\t9@@9 ", "To:<sip:z@x.test>  ", ""],
        ("PRACK", "9@@9", "two  words  <sip:w@x.test> ; tag=9", "<sip:z@x.test>", None),
    ),
    (
        ["SIP/2.0 487 Request Terminated", "content-length: 70", "CALL-id: late:1", "tO: a", "fROM: b", "Content-Length: 2", "", "tail"],
        ("STATUS_487", "late:1", "b", "a", "ta"),
    ),
    (["SIP/2.0", "To: q", "Call-ID: p", "From: r"], ("STATUS_UNKNOWN", "p", "r", "q", None)),
    (["ACK 0", "i:", "Call-ID: second", "To: 1", "From: 2", "", "i: third"], ("ACK", "second", "2", "1", None)),
    (["", "From: nobody"], ("", None, None, None, None)),
]


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_sip_headers(spark, eol):
    df = spark.createDataFrame([(i, bytearray(eol.join(m).encode())) for i, (m, _) in enumerate(MESSAGES)], "i int, payload binary")
    rows = sip.parse_messages(df).orderBy("i").collect()
    got = [(r.method, r.call_id, r.sip_from, r.sip_to, None if r.body is None else bytes(r.body).decode()) for r in rows]
    assert got == [w for _, w in MESSAGES]
    assert sip.valid_messages(sip.parse_messages(df)).count() == 6


def test_compat_body(spark):
    message = c.sip("INVITE", "x", body="0123456789")
    df = spark.createDataFrame([(bytearray(message),)], "payload binary")
    assert bytes(sip.parse_messages(df).first().body) == b"0123456789"
    # Six CRLF lines of head: the body starts six bytes early and loses as many at its end.
    assert bytes(sip.parse_messages(df, compat=True).first().body) == message[-16:-6]


# Session text, endpoints, packet time: address of the session or of the stream, inactive streams, bad and repeated times, ports out of range, no address.
SDP = [
    ("s=-\nc=IN IP4 203.0.113.77\nt=0 0\na=ptime:10\nm=audio 41234 RTP/SAVP 111\n", [("203.0.113.77", 41234)], 10),
    ("c=IN IP4 198.51.100.9\nm=video 6 RTP/AVP 96\na=inactive\nm=audio 8 RTP/AVP 8\na=ptime:15\na=ptime:fast", [("198.51.100.9", 8)], 15),
    ("c=IN IP4 203.0.113.1\nm=audio 12 x\nc=IN IP4 203.0.113.2\na=ptime:  5 \nm=text 14 x", [("203.0.113.2", 12), ("203.0.113.1", 14)], 5),
    ("m=audio 9 x\na=inactive\na=ptime:120\nc=IN IP4 203.0.113.3\nm=image 9 x\na=inactive", [], 120),
    ("c=IN IP4 203.0.113.4\ns=nothing\n", [], None),
    ("m=audio 16 x\na=sendrecv\n", [], None),
    ("c=IN IP4 203.0.113.5\nm=audio -1 x\nm=\nm=audio 65536 x\nm=video 0 x\nc=IN IP6 fe80::5", [("203.0.113.5", 0)], None),
]


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_sdp(spark, eol):
    df = spark.createDataFrame([(i, bytearray(t.replace("\n", eol).encode())) for i, (t, _, _) in enumerate(SDP)], "i int, body binary")
    rows = sdp.parse_bodies(df).orderBy("i").collect()
    assert [([(e.ip, e.port) for e in r.endpoints], r.ptime) for r in rows] == [w[1:] for w in SDP]
    assert sdp.explode_endpoints(sdp.parse_bodies(df), skip_port_zero=True).count() == sum(port > 0 for _, ends, _ in SDP for _, port in ends)


def test_port_range():
    assert [filters.parse_port_range(t) for t in ("1-65535", "7-7", "\t90 -\t91 ")] == [(1, 65535), (7, 7), (90, 91)]
    for bad in ("", "-", "9", "9-", "-9", "9-8", "8-9-10", "port", "0x9-0x10", "0-1", "65535-65536"):
        with pytest.raises(ValueError):
            filters.parse_port_range(bad)


def test_id_lists(spark):
    cases = {"": [], "0": [0], "9,8,8": [9, 8, 8], "\t7, 65535 ": [7, 65535], "0xA,0xffff,11": [10, 65535, 11], "65536,0x10000,-3,q,0x,12": [12]}
    assert {t: filters.parse_id_list(t) for t in cases} == cases
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.v for r in df.select("t", filters.id_list_column(F.col("t")).alias("v")).collect()} == cases


def test_mirror_allow_list(spark):
    """Every combination of a list that is absent, unreadable, with the id, and without it."""
    row = spark.sql("SELECT named_struct('span_id', 77, 'vlan', 4001) AS mirror")
    spans, vlans = {"": True, "?": True, "3,0x4d": True, "76,78": False}, {"": True, "?": True, "4001": True, "0xFA0": False}
    got = {(s, v): row.filter(filters.mirror_allowed(s, v)).count() == 1 for s in spans for v in vlans}
    assert got == {(s, v): a and b for s, a in spans.items() for v, b in vlans.items()}


def test_privacy(spark):
    """Rules that ask for privacy, and exceptions, each alone and together, that fit or don't."""
    row = spark.sql("SELECT 'hall-0042' AS c, '<sip:ward3@clinic.test>' AS f, '<tel:+41-44>' AS t")
    hits, misses = {"call_id": "^hall-", "from": "ward[0-9]", "to": r"\+41"}, {"call_id": "^door", "from": "^ward", "to": "sip:"}
    cases = [(PrivacyRules(), False), (PrivacyRules(no_media=True), True)]
    for name in hits:
        cases += [
            (PrivacyRules(**{f"for_{name}": hits[name]}), True),
            (PrivacyRules(**{f"for_{name}": misses[name]}), False),
            (PrivacyRules(**{f"except_{name}": misses[name]}), True),
            (PrivacyRules(**{f"for_{name}": hits[name], f"except_{name}": hits[name]}), False),
            (PrivacyRules(no_media=True, **{f"except_{name}": hits[name]}), True),
        ]
    got = row.select(*[privacy_decision(r, F.col("c"), F.col("f"), F.col("t")).alias(f"v{i}") for i, (r, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]
    import re

    with pytest.raises(re.error):
        PrivacyRules(for_to="[")


def test_zero_payload(spark):
    """Packets are put together from a head, listed sources, an extension, a payload and padding; only the payload is cleared."""
    stamp = bytes(range(1, 12))

    def packet(payload, sources=b"", extension=b"", padding=b""):
        first = 0x80 | (0x20 if padding else 0) | (0x10 if extension else 0) | len(sources) // 4
        return bytes([first]) + stamp, sources, extension, payload, padding

    three, words = bytes(range(50, 62)), b"\xbe\xde\0\2" + bytes(range(70, 78))
    made = [packet(b"voice"), packet(b"voice", three), packet(b"voice", extension=words), packet(b"voice", three, words, b"\0\0\3"), packet(b"", three), packet(b"x" * 200, padding=b"\1")]
    cases = {b"".join(p): p[0] + p[1] + p[2] + bytes(len(p[3])) + p[4] for p in made}
    short = bytes([0x80]) + stamp[:6]
    cases[short] = short
    whole = bytes([0xA0]) + stamp + b"voice" + bytes([200])  # more padding than there is: all of it is payload
    cases[whole] = bytes([0xA0]) + stamp + bytes(6)
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "p binary")
    got = df.select("p", zero_payload(F.col("p")).alias("v")).collect()
    assert {bytes(r.p): bytes(r.v) for r in got} == cases


def test_mirror_headers(spark):
    """Heads are built bit by bit from their fields."""

    def two(version, vlan, span):
        return ((version << 28 | vlan << 16 | span) << 32 | 0x00ABCDEF).to_bytes(8, "big")

    def three(version, vlan, span, direction, ts, platform=b""):
        return ((version << 28 | vlan << 16 | span) << 32 | ts).to_bytes(8, "big") + (0x0BAD << 16 | direction << 3 | bool(platform)).to_bytes(4, "big") + platform

    inner = b"\x5a" * 20
    cases = [
        (2, two(1, 4094, 1023), (1, 1023, 4094, 0, 0)),
        (2, two(1, 0, 1), (1, 1, 0, 0, 0)),
        (3, three(2, 3001, 512, 0, 0xFEDCBA98), (2, 512, 3001, 0, 0xFEDCBA98)),
        (3, three(2, 1, 2, 1, 3, platform=b"platform"), (2, 2, 1, 1, 3)),
        (1, b"", (1, 0, 0, 0, 0)),
        (2, two(3, 4, 5), None),
        (3, three(1, 4, 5, 0, 6), None),
    ]
    df = spark.createDataFrame([(i, k, bytearray(h + inner)) for i, (k, h, _) in enumerate(cases)], "i int, k int, h binary")
    meta, _ = mirror_header(F.col("k"), F.col("h"))
    rows = df.select("i", meta.alias("m")).orderBy("i").collect()
    assert [None if r.m is None else (r.m.version, r.m.span_id, r.m.vlan, r.m.direction, r.m.ts32) for r in rows] == [w for *_, w in cases]


def _packets(spark, frames, link=1):
    rows = [(i, bytearray(f), len(f), len(f), link) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "frame_no long, data binary, cap_len int, orig_len int, link_type int")


def test_decode(spark):
    frames = [
        c.ether(c.ip4("1.2.3.4", "5.6.7.8", 17, c.udp(5060, 9, b"hello")) + b"\0" * 9),
        c.ether(c.ip4("1.2.3.4", "5.6.7.8", 6, c.tcp(80, 5060, b"tcp!")), vlan=7),
        c.ether(c.ip6("2001:db8::1", "::ffff:1.2.3.4", 17, c.udp(1, 65535, b"v6"))),
        c.ether(c.ip6("fe80::1:0:0:1", "::", 0, bytes([17, 0]) + bytes(6) + c.udp(2, 3, b"ext"))),
        c.ether(c.ip4("1.2.3.4", "5.6.7.8", 1, b"icmp")),
        b"\x02" * 12 + b"\x08\x06arp",
        b"short",
    ]
    rows = decode_transport(decode_ip(_packets(spark, frames))).orderBy("frame_no").collect()
    got = [(r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.proto, bytes(r.payload)) for r in rows]
    assert got == [
        ("1.2.3.4", 5060, "5.6.7.8", 9, "udp", b"hello"),
        ("1.2.3.4", 80, "5.6.7.8", 5060, "tcp", b"tcp!"),
        ("2001:db8::1", 1, "1.2.3.4", 65535, "udp", b"v6"),
        ("fe80::1:0:0:1", 2, "::", 3, "udp", b"ext"),
    ]
    raw = decode_transport(decode_ip(_packets(spark, [c.ip4("1.1.1.1", "2.2.2.2", 17, c.udp(1, 2, b"x"))], link=101))).first()
    assert (raw.src_ip, bytes(raw.payload)) == ("1.1.1.1", b"x")
    assert all(bytes(f)[r.payload_at : r.payload_at + len(r.payload)] == bytes(r.payload) for f, r in zip(frames, rows))


def test_decapsulate(spark):
    inner = c.frame("3.3.3.3", 1, "4.4.4.4", 2, b"in")
    gre = lambda kind, body: c.ether(c.ip4("9.0.0.1", "9.0.0.2", 47, kind + body))
    frames = [c.mirror2(inner, 5, 100), gre(b"\0\0\x88\xbe", inner), gre(b"\0\0\x08\0", inner), gre(b"\0\0\x88\xbe", b""), inner]
    rows = decapsulate(decode_ip(_packets(spark, frames))).orderBy("frame_no").collect()
    assert [(r.frame_no, r.mirror and (r.mirror.span_id, r.mirror.vlan)) for r in rows] == [(0, (5, 100)), (1, (0, 0)), (4, None)]
    assert {bytes(r.data) for r in rows} == {inner} and {r.cap_len for r in rows} == {len(inner)}


def test_rtp(spark):
    payloads = [c.rtp(65534, 305419896), b"\x80" * 11, b"\x40" * 12]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, payload binary")
    assert [(r.seq, r.ssrc) for r in decode_rtp(df).orderBy("i").collect()] == [(65534, 305419896), (None, None), (None, None)]


def test_names(spark):
    row = spark.sql("SELECT 'call' AS c, 'f.pcap' AS f")
    prefixes = {"s3://b": "s3://b/f.pcap", "s3://b/": "s3://b/f.pcap", "s3://b/p": "s3://b/p/f.pcap", "s3://b/p/q/": "s3://b/p/q/f.pcap", "http://b": "", "s3:///p": ""}
    got = row.select(naming.output_filename(F.col("c")), *[naming.s3_location(F.lit(p), F.col("f")) for p in prefixes]).first()
    assert list(got) == [c.file_name("call"), *prefixes.values()]


def test_values(spark):
    row = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS t, 255L AS n, 1.005D AS x")
    got = row.select(values.rfc3339("t"), values.hex8("n"), values.fixed2("x"), values.endpoint_text(F.lit("::1"), F.lit(5))).first()
    assert list(got) == ["2024-01-02T03:04:05Z", "000000ff", got[2], "::1:5"]
    wrap = spark.range(1).select(*[values.wrap16(F.lit(d)) for d in (1, -1, 65535, -65535, 32768, 0)]).first()
    assert list(wrap) == [1, -1, -1, 1, -32768, 0]
    text = spark.range(1).select(values.longer_of(F.lit("é"), F.lit("ab")), values.longer_of(F.lit("ab"), F.lit("cd")), values.non_empty_or(F.lit(""), F.lit("x"))).first()
    assert list(text) == ["ab", "ab", "x"]


def test_options():
    for bad in (dict(sip_ports="x"), dict(sip_ports="1-2", upload=True), dict(sip_ports="1-2", mirror_enabled=True, source_filter="tcp"), dict(sip_ports="1-2", privacy_mode="no")):
        with pytest.raises(ValueError):
            Options(**bad)
