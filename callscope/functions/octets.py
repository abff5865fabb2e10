"""Numbers and addresses at byte offsets of a binary column. Offsets count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(data: Column, offset: Column | int, length: Column | int) -> Column:
    """``length`` bytes from ``offset``."""
    return F.substring(data, _lit(offset) + F.lit(1), _lit(length))


def rest(data: Column, offset: Column | int) -> Column:
    """All bytes from ``offset``."""
    return F.substring(data, _lit(offset) + F.lit(1), F.octet_length(data))


def number(data: Column, offset: Column | int, length: int) -> Column:
    """Big-endian unsigned number of up to 7 bytes; null where the data ends before it."""
    have = F.octet_length(data) >= _lit(offset) + F.lit(length)
    return F.when(have, F.conv(F.hex(part(data, offset, length)), 16, 10).cast("bigint"))


def bits(value: Column, shift: int, mask: int) -> Column:
    """The bits of ``value`` under ``mask`` after a right shift."""
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def ipv4_text(address: Column) -> Column:
    """Dotted text of an address number."""
    return F.concat_ws(".", *[bits(address, s, 255).cast("string") for s in (24, 16, 8, 0)])


def ipv6_groups(data: Column, offset: Column | int) -> Column:
    """Eight hex groups of 16 bytes, without leading zeros."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(14), F.lit(2)), lambda i: F.lower(F.hex(number(data, _lit(offset) + i, 2)))
    )
    return F.array_join(groups, ":")


def ipv6_text(groups: Column) -> Column:
    """Address text of ``ipv6_groups``: the longest run of zero groups shortened, mapped IPv4 addresses dotted."""
    # The longest run that occurs is replaced, at its first place; a loop keeps the generated code small.
    runs = F.array(*[F.lit(rf"^(?:(.*?):)??0(?::0){{{run - 1}}}(?::(.*))?$") for run in range(8, 1, -1)])
    text = F.aggregate(
        runs, groups, lambda t, run: F.when(t.contains("::"), t).otherwise(F.regexp_replace(t, run, F.lit("$1::$2")))
    )
    last = F.conv(F.concat(*[F.lpad(F.split_part(groups, F.lit(":"), F.lit(i)), 4, "0") for i in (7, 8)]), 16, 10).cast("bigint")
    return F.when(groups.startswith("0:0:0:0:0:ffff:"), ipv4_text(last)).otherwise(text)


def zero_bytes(count: Column) -> Column:
    """``count`` zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), count.cast("int")))


def latin1(data: Column) -> Column:
    """Text with one character per byte, so that character positions are byte positions."""
    return F.decode(data, "ISO-8859-1")


def utf8(text: Column) -> Column:
    """Undo ``latin1``: the same bytes read as UTF-8."""
    return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def _lit(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value
