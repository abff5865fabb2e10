"""Fields of SIP messages as expressions over a binary payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.octets import latin1, utf8
from callscope.operators.settle import settle

# Header names with their short forms.
CALL_ID = ("Call-ID", "i")
FROM = ("From", "f")
TO = ("To", "t")
CONTENT_LENGTH = ("Content-Length", "l")

BLANK = r"[ \t\r\f\x0B]"
#: The first blank line, with the line end before it.
BLANK_LINE = rf"(?:\A|\n){BLANK}*(?:\n|\z)"


def first_line(head: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(head, "\n", 1), rf"^{BLANK}+|{BLANK}+$", ""))


def method(head: Column) -> Column:
    """``STATUS_<code>`` of a response, else the first word in capitals."""
    line = first_line(head)
    words = F.split(line, " ", 3)
    status = F.when(F.size(words) > 1, F.concat(F.lit("STATUS_"), words.getItem(1))).otherwise("STATUS_UNKNOWN")
    return F.when(line.startswith("SIP/2.0"), status).otherwise(F.upper(words.getItem(0)))


def header(head: Column, names: tuple[str, ...]) -> Column:
    """First non-empty value of a header; null without one."""
    pattern = rf"(?imd)^{BLANK}*(?:{'|'.join(names)}):{BLANK}*([^\s][^\n]*)"
    value = F.regexp_replace(F.regexp_extract(head, pattern, 1), rf"{BLANK}+$", "")
    return F.nullif(utf8(value), F.lit(""))


def content_length(head: Column) -> Column:
    """The last Content-Length that is a number of up to 18 digits; null without one."""
    # The greedy start finds the last line.
    pattern = rf"(?is)^.*\n{BLANK}*(?:{'|'.join(CONTENT_LENGTH)}):{BLANK}*([0-9]{{1,18}})(?![0-9])"
    return F.regexp_extract(F.concat(F.lit("\n"), head), pattern, 1).try_cast("bigint")


def parse_messages(df: DataFrame, payload: str = "payload", compat: bool = False) -> DataFrame:
    """Add method, call_id, sip_from, sip_to, content_length and body to rows with a SIP payload.

    ``body`` is null without a Content-Length or a blank line, empty for length 0, and what there is when it is cut short.
    ``compat`` starts it one byte early per CRLF line of the head, as the original does.
    """
    data, text = F.col(payload), F.col("__text")
    df = settle(df, {"__text": latin1(data)})
    df = settle(df, {
        "__blank_at": F.regexp_instr(text, F.lit(BLANK_LINE)),
        "__blank": F.length(F.regexp_extract(text, BLANK_LINE, 0)),
    })
    found = F.col("__blank_at") > 0
    body_at = F.col("__blank_at") + F.col("__blank")
    if compat:
        body_at = body_at - F.regexp_count(F.substring(text, F.lit(1), body_at - F.lit(1)), F.lit("\r\n"))
    df = settle(df, {
        "__head": F.when(found, F.substring(text, F.lit(1), F.col("__blank_at") - F.lit(1))).otherwise(text),
        "__body_at": body_at,
    })
    head = F.col("__head")
    df = settle(df, {
        "method": method(head),
        "call_id": header(head, CALL_ID),
        "sip_from": header(head, FROM),
        "sip_to": header(head, TO),
        "content_length": content_length(head),
    })
    size = F.least(F.col("content_length"), F.lit(2**31 - 1)).cast("int")
    body = F.when(F.col("content_length") == 0, F.substring(data, 1, 0)).when(
        found & (F.col("content_length") > 0), F.substring(data, F.col("__body_at"), size)
    )
    return settle(df, {"body": body}).drop("__text", "__blank_at", "__blank", "__head", "__body_at")


def valid_messages(df: DataFrame) -> DataFrame:
    """Messages with Call-ID, From and To."""
    return df.filter(F.col("call_id").isNotNull() & F.col("sip_from").isNotNull() & F.col("sip_to").isNotNull())


def is_answer(method_col: Column) -> Column:
    return method_col.startswith("STATUS_200")
