"""Output names of calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def output_filename(call_id: Column, started_us: Column | None = None) -> Column:
    """First 16 hex digits of the id's SHA-256 with ``.pcap``; an empty id takes a name from its start time."""
    if started_us is not None:
        nameless = F.concat(F.lit("unknown_call_"), (started_us * F.lit(1000)).cast("string"))
        call_id = F.when(call_id == "", nameless).otherwise(call_id)
    return F.concat(F.substring(F.sha2(call_id, 256), 1, 16), F.lit(".pcap"))


def s3_location(prefix: Column, filename: Column) -> Column:
    """Object address below ``s3://bucket[/prefix]``; empty for other prefixes."""
    bucket = F.regexp_extract(prefix, "^s3://([^/]+)", 1)
    folder = F.regexp_extract(prefix, "(?s)^s3://[^/]+/(.+)$", 1)
    slash = F.when((folder == "") | folder.endswith("/"), F.lit("")).otherwise(F.lit("/"))
    return F.when(bucket == "", F.lit("")).otherwise(F.concat(F.lit("s3://"), bucket, F.lit("/"), folder, slash, filename))
