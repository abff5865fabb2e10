"""Media endpoints and packet time of SDP bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.octets import latin1
from callscope.operators.settle import settle

DEFAULT_PTIME = 20
BLANK = r"[ \t\r\f\x0B]"
# The lines that matter. Greedy starts find the last one of its kind.
IP4_LINE = r"(?s)^.*\nc=IN IP4 +([^\n]+)"
PTIME_LINE = rf"(?s)^.*\na=ptime:{BLANK}*([+-]?[0-9]+)(?:\n|$)"
PORT_FIELD = r"^[^\s]*[^\S\n]+([0-9]+)(?:\s|$)"
INACTIVE = "\na=inactive"


def normal_text(body: Column) -> Column:
    """The body with trimmed lines, each after a line feed."""
    return F.concat(F.lit("\n"), F.regexp_replace(F.btrim(latin1(body)), rf"{BLANK}*\n{BLANK}*", "\n"))


def last_ip(text: Column) -> Column:
    """Value of the last IPv4 connection line; null without one."""
    return F.nullif(F.regexp_extract(text, IP4_LINE, 1), F.lit(""))


def ptime(text: Column) -> Column:
    """The last whole-number ``a=ptime:``; null without one."""
    return F.regexp_extract(text, PTIME_LINE, 1).try_cast("int")


def endpoints(media: Column, session_ip: Column) -> Column:
    """``array<struct<m_index, ip, port>>`` of the active ones of the media blocks (texts after their ``m=``)."""

    def block(text: Column, index: Column) -> Column:
        return F.struct(
            (index + F.lit(1)).cast("int").alias("m_index"),
            F.regexp_extract(text, IP4_LINE, 1).alias("ip"),
            F.when(~text.contains(INACTIVE), F.regexp_extract(text, PORT_FIELD, 1).try_cast("int")).alias("port"),
        )

    def with_session(e: Column) -> Column:
        return F.struct(e["m_index"], F.when(e["ip"] != "", e["ip"]).otherwise(session_ip).alias("ip"), e["port"])

    found = F.transform(F.transform(media, block), with_session)
    return F.filter(found, lambda e: e["ip"].isNotNull() & (e["port"] <= 65535))


def parse_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``endpoints`` and ``ptime`` to messages with a body."""
    df = settle(df, {"__text": normal_text(F.col(body))})
    df = settle(df, {"__blocks": F.split("__text", "\nm="), "ptime": ptime(F.col("__text"))})
    split = F.col("__blocks")
    df = settle(df, {"__media": F.slice(split, 2, F.size(split)), "__session_ip": last_ip(F.element_at(split, 1))})
    none = F.expr("cast(array() as array<struct<m_index:int,ip:string,port:int>>)")
    found = F.coalesce(endpoints(F.col("__media"), F.col("__session_ip")), none)
    return settle(df, {"endpoints": found}).drop("__text", "__blocks", "__media", "__session_ip")


def explode_endpoints(df: DataFrame, skip_port_zero: bool = False) -> DataFrame:
    """One row per endpoint of each message: the registrations."""
    rows = df.withColumn("__e", F.explode("endpoints")).select("*", "__e.m_index", "__e.ip", "__e.port").drop("__e", "endpoints")
    return rows.filter(F.col("port") > 0) if skip_port_zero else rows
