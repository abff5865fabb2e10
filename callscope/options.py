"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass, field

from callscope.functions.privacy import PrivacyRules
from callscope.operators.filters import parse_port_range
from callscope.operators.slots import MINUTE_US

SECOND_US = 1_000_000


@dataclass(frozen=True)
class Options:
    """Parameters of a call analysis. Times are event time."""

    sip_ports: str
    call_timeout_us: int = 5 * 60 * SECOND_US
    close_at_end: bool = True
    mirror_enabled: bool = False
    mirror_span_ids: str = ""
    mirror_vlans: str = ""
    #: A predicate over datagrams; ``udp`` for UDP only. Empty lets everything pass.
    source_filter: str = ""
    reassemble: bool = False
    fragment_timeout_us: int = 30 * SECOND_US
    privacy: PrivacyRules = field(default_factory=PrivacyRules)
    #: ``drop`` leaves media of private calls out, ``zero`` clears its bytes.
    privacy_mode: str = "drop"
    s3_uri: str = ""
    s3_region: str = ""
    upload: bool = False
    #: Names the frames of a table that has no ``instance_id`` of its own.
    instance_id: str = "default"
    #: Media counts for the mirror sessions of a call, too.
    mirror_media: bool = False
    skip_port_zero: bool = False
    compat_body: bool = False
    hot_rows: int | None = None
    slot_us: int = MINUTE_US

    def __post_init__(self) -> None:
        parse_port_range(self.sip_ports)
        if self.privacy_mode not in ("drop", "zero"):
            raise ValueError("privacy_mode is 'drop' or 'zero'")
        if self.upload and not self.s3_uri.startswith("s3://"):
            raise ValueError("upload needs an s3:// uri")
        if self.mirror_enabled and self.source_filter not in ("", "udp"):
            raise ValueError("a source filter cannot be combined with mirror mode")

    @property
    def ports(self) -> tuple[int, int]:
        return parse_port_range(self.sip_ports)
