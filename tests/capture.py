"""Frames built in plain Python, and a brute-force fold over them, to check the engine against."""

import hashlib
import ipaddress
import struct


def ip4(src, dst, proto, payload, ident=1, more=False, offset=0):
    flags = (0x2000 if more else 0) | (offset // 8)
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), ident, flags, 64, proto, 0)
    return head + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + payload


def ip6(src, dst, proto, payload):
    return struct.pack(">IHBB", 6 << 28, len(payload), proto, 64) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + payload


def udp(sport, dport, payload):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def tcp(sport, dport, payload):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 0, 0, 0, 0) + payload


def ether(packet, vlan=None):
    kind = 0x0800 if packet[0] >> 4 == 4 else 0x86DD
    tag = b"" if vlan is None else struct.pack(">HH", 0x8100, vlan)
    return b"\x02" * 12 + tag + struct.pack(">H", kind) + packet


def frame(src, sport, dst, dport, payload, **kw):
    return ether(ip4(src, dst, 17, udp(sport, dport, payload), **kw))


def rtp(seq, ssrc, payload=b"\xaa" * 20):
    return struct.pack(">BBHII", 0x80, 0, seq & 0xFFFF, 0, ssrc) + payload


def sip(method, call_id, sip_from="A <sip:a@x>", sip_to="B <sip:b@x>", body="", eol="\r\n"):
    first = method if method.startswith("SIP/2.0") else f"{method} sip:b@x SIP/2.0"
    lines = [first, f"Call-ID: {call_id}", f"From: {sip_from}", f"To: {sip_to}", f"Content-Length: {len(body)}", "", body]
    return eol.join(lines).encode()


def sdp(ip, port, ptime=20):
    return f"v=0\r\nc=IN IP4 {ip}\r\nm=audio {port} RTP/AVP 0\r\na=ptime:{ptime}\r\n"


def mirror2(inner, span, vlan):
    gre = struct.pack(">HHI", 0x1000, 0x88BE, 7)
    return ether(ip4("9.0.0.1", "9.0.0.2", 47, gre + struct.pack(">HHI", 1 << 12 | vlan, span, 0) + inner))


def write_pcap(path, records, link=1, order="<", nano=False):
    """``records``: (microseconds, frame)."""
    with open(path, "wb") as out:
        out.write(struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link))
        for us, data in records:
            fraction = us % 1_000_000 * (1000 if nano else 1)
            out.write(struct.pack(order + "IIII", us // 1_000_000, fraction, len(data), len(data)) + data)


def file_name(call_id):
    return hashlib.sha256(call_id.encode()).hexdigest()[:16] + ".pcap"
