"""Argument checks and row filters of the packet path."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_port_range(text: str) -> tuple[int, int]:
    """``START-END`` with 1 <= START <= END <= 65535."""
    match = re.fullmatch(r"\s*([0-9]+)\s*-\s*([0-9]+)\s*", text)
    if not match:
        raise ValueError(f"expected START-END, got {text!r}")
    start, end = int(match[1]), int(match[2])
    if not 1 <= start <= end <= 65535:
        raise ValueError(f"ports must rise within 1..65535, got {text!r}")
    return start, end


def parse_id_list(text: str) -> list[int]:
    """Decimal or ``0x`` numbers up to 65535 between commas; anything else is skipped."""
    numbers = []
    for token in (t.strip(" \t\r\n") for t in text.split(",")):
        if re.fullmatch(r"[0-9]+", token):
            value = int(token)
        elif re.fullmatch(r"0x[0-9a-fA-F]+", token):
            value = int(token, 16)
        else:
            continue
        if value <= 65535:
            numbers.append(value)
    return numbers


def id_list_column(text: Column) -> Column:
    """``parse_id_list`` over a text column."""

    def value(token: Column) -> Column:
        hex_digits = F.regexp_extract(token, "^0x([0-9a-fA-F]+)$", 1)
        decimal = F.regexp_extract(token, "^([0-9]+)$", 1).try_cast("bigint")
        from_hex = F.when(F.length(F.ltrim(hex_digits, F.lit("0"))) <= 4, F.conv(hex_digits, 16, 10).try_cast("bigint"))
        return F.coalesce(decimal, from_hex).try_cast("int")

    tokens = F.transform(F.split(text, ","), lambda t: F.regexp_replace(t, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    return F.filter(F.transform(tokens, value), lambda v: v <= 65535)


def in_ports(port: str, ports: tuple[int, int]) -> Column:
    return F.col(port).between(*ports)


def is_signalling(ports: tuple[int, int]) -> Column:
    """Source or destination port within the signalling range."""
    return in_ports("src_port", ports) | in_ports("dst_port", ports)


def is_media_candidate(ports: tuple[int, int]) -> Column:
    """UDP outside the signalling range."""
    return (F.col("proto") == "udp") & ~is_signalling(ports)


def non_empty(payload: str = "payload") -> Column:
    return F.octet_length(payload) > 0


def allowed(column: str | Column, ids: str | Sequence[int]) -> Column:
    """Membership in an id list; an empty list, or one without a valid number, lets everything pass."""
    numbers = parse_id_list(ids) if isinstance(ids, str) else list(ids)
    value = F.col(column) if isinstance(column, str) else column
    return value.isin(numbers) if numbers else F.lit(True)


def mirror_allowed(span_ids: str = "", vlans: str = "", mirror: str = "mirror") -> Column:
    """Span id and VLAN both allowed; rows that were not mirrored pass."""
    passes = allowed(f"{mirror}.span_id", span_ids) & allowed(f"{mirror}.vlan", vlans)
    return F.col(mirror).isNull() | passes


def truncated() -> Column:
    return F.col("cap_len") < F.col("orig_len")


def source_filter(df: DataFrame, predicate: str | Column | None, mirror_mode: bool = False) -> DataFrame:
    """Restrict rows at the source. Mirror mode takes its own filter (GRE) and no other."""
    if mirror_mode:
        if predicate is not None and not (isinstance(predicate, str) and predicate in ("", "udp")):
            raise ValueError("a source filter cannot be combined with mirror mode")
        return df.filter("ip_proto = 47")
    if predicate is None or (isinstance(predicate, str) and predicate == ""):
        return df
    if isinstance(predicate, str) and predicate == "udp":
        predicate = "proto = 'udp'"
    return df.filter(predicate)
