"""Personal data in texts: patterns propose spans, validators confirm them, context words adjust the score. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on each side in which context words count, what they add to a score, and the score from which a span is reported.
WINDOW = 40
CONTEXT_BONUS = 0.4
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """
    A kind of personal data. `hint` is a cheap test that all texts with a match pass; `score` is what a confirmed match has without context; base kinds are reported whatever their score.

    Quantifiers are possessive, and a match may begin only where its run begins or the last match ended: the same matches as with plain
    greedy ones, but long runs are walked once.
    """

    name: str
    pattern: str
    hint: str
    score: float
    context: str
    base: bool = True


EMAIL = Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(__pii_text, '@')", 0.9, "mail|contact|write")
IP = Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "__pii_digit", 0.6, "ip|host|server|address|login")
CARD = Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "__pii_digit", 0.8, "card|visa|master|credit|payment|konto|carte|tarjeta")
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(__pii_text, '+')", 0.7, "phone|call|tel|mobile|fax")
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "__pii_digit", 0.9, "iban|bank|account|konto|cuenta|compte", False)
SSN = Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "__pii_digit", 0.3, "ssn|social security|tax", False)
LOCAL = Kind("local", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "__pii_digit", 0.2, "phone|call|tel|mobile|fax", False)
#: In the order in which spans with one start are listed.
KINDS = (EMAIL, IP, CARD, PHONE, IBAN, SSN, LOCAL)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits' check sum, every second one from the right doubled, ends in zero."""

    def share(i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")  # i-th digit from the right
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + share(i)) % 10 == 0


def mod_97(account: Column) -> Column:
    """True if an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 when divided by 97."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")

    def value(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)

    return F.aggregate(signs, F.lit(0), lambda r, c: F.when(value(c) > 9, r * 100 + value(c)).otherwise(r * 10 + value(c)) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of each kind."""
    n = F.length(digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int") <= 255))
    if kind == "card":
        return (n >= 12) & (n <= 19) & F.when((n >= 12) & (n <= 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        return (F.length(plain) <= 34) & mod_97(plain)
    return F.lit(True)


def _matches(kind: Kind, order: int) -> Column:
    """
    Spans of one kind (start, rank, end, kind, score, base), confirmed ones only, in code points with the end exclusive.

    The text's pieces between matches and the matches themselves add up to the places of both.
    """
    pattern = kind.pattern.replace("\\", "\\\\").replace("'", "\\'")
    zipped = (
        f"transform(array(struct(regexp_extract_all(__pii_text, '{pattern}', 0) AS m, split(__pii_text, '{pattern}', -1) AS p)), z -> "
        "aggregate(sequence(0, size(z.m) - 1), struct(0 AS at, CAST(array() AS array<struct<start:int,found:string>>) AS list), "
        "(a, i) -> struct(a.at + length(z.p[i]) + length(z.m[i]) AS at, concat(a.list, array(struct(a.at + length(z.p[i]) AS start, z.m[i] AS found))) AS list), a -> a.list))[0]"
    )
    # sequence(0, -1) counts down, so texts without a match are left out first.
    listed = F.expr(f"CASE WHEN {kind.hint} AND __pii_text RLIKE '{pattern}' THEN {zipped} ELSE CAST(array() AS array<struct<start:int,found:string>>) END")

    def span(x: Column) -> Column:
        around = F.lower(F.substring(F.col("__pii_text"), F.greatest(F.lit(1), x.start + 1 - WINDOW), F.length(x.found) + F.least(x.start, F.lit(WINDOW)) + WINDOW))
        score = F.lit(kind.score) + F.when(around.rlike(rf"\b(?:{kind.context})"), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            x.start.cast("long").alias("start"), F.lit(order).alias("rank"), (x.start + F.length(x.found)).cast("long").alias("end"),
            F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"), F.lit(kind.base).alias("base"),
        )

    return F.transform(F.filter(listed, lambda x: confirmed(kind.name, x.found)), span)


def _with_spans(docs: DataFrame, text_col: str, least_score: float) -> DataFrame:
    """`docs` with the column __pii_spans; names of its own start with __pii_, so no column of the table is in the way."""
    hinted = docs.withColumn("__pii_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__pii_digit", F.col("__pii_text").rlike("[0-9]"))
    by_kind = hinted.withColumns({f"__pii_{k.name}": _matches(k, i) for i, k in enumerate(KINDS)})
    joined = by_kind.withColumn("__pii_base", F.concat(*(f"__pii_{k.name}" for k in KINDS if k.base))).withColumn("__pii_more", F.concat(*(f"__pii_{k.name}" for k in KINDS if not k.base)))
    fit = F.filter("__pii_more", lambda x: (x.score >= least_score) & ~F.exists("__pii_base", lambda b: (b.start < x.end) & (x.start < b.end)))
    return joined.withColumn("__pii_spans", F.sort_array(F.concat("__pii_base", fit)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """
    One row for each row of `docs`: id and spans (array of start, rank, end, kind, score, base), by start, then as KINDS are listed.

    Each kind's matches are leftmost and do not overlap; unconfirmed ones are dropped and not tried again. Base spans are all reported; others
    if their score is `least_score` or more and no base span overlaps them. A null text has no spans; every row is one row, without a shuffle.
    """
    return _with_spans(docs, text_col, least_score).select(F.col(id_col).alias("id"), F.col("__pii_spans").alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark like <EMAIL> for each span; of spans that overlap, the first stands for all."""
    empty = F.expr("CAST(array() AS array<struct<before:bigint,start:bigint,kind:string>>)")
    # Each entry has the end of what went before, so that pieces are cut once.
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("list")),
        lambda a, x: F.struct(
            F.greatest(a.at, x.end).alias("at"),
            F.when(x.start < a.at, a.list).otherwise(F.concat(a.list, F.array(F.struct(a.at.alias("before"), x.start.alias("start"), x.kind.alias("kind"))))).alias("list"),
        ),
    )
    pieces = F.transform(
        merged.list, lambda x: F.concat(F.substring(text, (x.before + 1).cast("int"), (x.start - x.before).cast("int")), F.lit("<"), F.upper(x.kind), F.lit(">"))
    )
    rest = F.substring(text, (merged.at + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", least_score: float = LEAST_SCORE) -> DataFrame:
    """All rows of `docs` with the personal data in their texts marked out; null texts stay null, and `chars_col`, if there, becomes the new length."""
    spans = F.col("__pii_spans")
    marked = _with_spans(docs, text_col, least_score).withColumn("__pii_marked", F.when(F.col(text_col).isNotNull(), redacted(F.col(text_col), spans)))
    if chars_col in docs.columns:
        length = F.when((F.size(spans) > 0) & F.col(text_col).isNotNull(), F.length("__pii_marked")).otherwise(F.col(chars_col))
        marked = marked.withColumn(chars_col, length.cast(docs.schema[chars_col].dataType))
    return marked.withColumn(text_col, F.col("__pii_marked")).select(*docs.columns)
