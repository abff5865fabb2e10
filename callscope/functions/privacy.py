"""Whether media of a call is kept, and clearing of media bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions.octets import bits, number, part, rest, zero_bytes


@dataclass(frozen=True)
class PrivacyRules:
    """Patterns are searched anywhere in the value."""

    no_media: bool = False
    for_call_id: str | None = None
    for_from: str | None = None
    for_to: str | None = None
    except_call_id: str | None = None
    except_from: str | None = None
    except_to: str | None = None

    def __post_init__(self) -> None:
        for pattern in (*self.targets, *self.exceptions):
            if pattern:
                re.compile(pattern)

    @property
    def targets(self) -> tuple[str | None, ...]:
        return self.for_call_id, self.for_from, self.for_to

    @property
    def exceptions(self) -> tuple[str | None, ...]:
        return self.except_call_id, self.except_from, self.except_to


def privacy_decision(rules: PrivacyRules, call_id: Column, sip_from: Column, sip_to: Column) -> Column:
    """True where media is cleared. Order: everything; exceptions keep; targets clear; unmet exceptions clear; else keep."""
    if rules.no_media:
        return F.lit(True)
    values = (call_id, sip_from, sip_to)

    def any_match(patterns: tuple[str | None, ...]) -> Column:
        hit = F.lit(False)
        for pattern, value in zip(patterns, values):
            if pattern:
                hit = hit | value.rlike(pattern)
        return F.coalesce(hit, F.lit(False))

    otherwise = any(rules.exceptions)
    return F.when(any_match(rules.exceptions), False).when(any_match(rules.targets), True).otherwise(otherwise)


def payload_bounds(payload: Column) -> tuple[Column, Column]:
    """Start and end of the media bytes of an RTP packet; null where there is nothing to clear."""
    size = F.octet_length(payload)
    first = number(payload, 0, 1)
    fixed = F.lit(12) + F.lit(4) * bits(first, 0, 15)
    extended = bits(first, 4, 1) == 1
    words = number(payload, fixed + F.lit(2), 2)
    start = F.when(extended, fixed + F.lit(4) * (words + F.lit(1))).otherwise(fixed)
    pad = number(payload, size - F.lit(1), 1)
    padded = (bits(first, 5, 1) == 1) & (pad > 0) & (pad <= size - start)
    end = F.when(padded, size - pad).otherwise(size)
    valid = (size >= 12) & (start <= size)
    return F.when(valid, start), F.when(valid, end)


def zero_payload(payload: Column) -> Column:
    """Media bytes set to zero; header, padding and length unchanged."""
    start, end = payload_bounds(payload)
    cleared = F.concat(part(payload, F.lit(0), start), zero_bytes(end - start), rest(payload, end))
    return F.when(start < end, cleared).otherwise(payload)
