"""Quality rules over whole texts, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.sources.storage import stored

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: A line is removed if it stands in over this many documents of its host, and over this share of them.
LINE_DOCUMENTS = 20
LINE_SHARE = 0.01
#: A document is rejected if removed lines held over this share of its words.
MOST_REMOVED = 0.6
#: Up to so many different repeated windows are looked up one by one; beyond that, windows are sorted with their places. Both give the same.
LOOK_UP = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def normal_line(line: Column) -> Column:
    """Lines count as the same without regard to case, digits and the width of gaps."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), GAP, " "), "[0-9]+", "0"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """
    `docs` with words (array), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines (array of key and number of words).

    Windows of three words are compared by a 64-bit hash. A null text has no words. All in one pass over each row, without a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("_words", words_of(F.col(text_col))).withColumn(
        "_lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    )
    windows = split.withColumn("n_words", F.size("_words")).withColumn(
        "_windows",
        F.expr("CASE WHEN n_words < 3 THEN array() ELSE transform(sequence(0, n_words - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"),
    )
    ordered = windows.withColumn("_sorted", F.sort_array("_windows"))
    repeated = ordered.withColumn("_repeated", F.expr("array_distinct(filter(_sorted, (h, i) -> i > 0 AND h = _sorted[i - 1]))"))
    looked_up = "filter(sequence(0, n_words - 3), i -> array_contains(_repeated, _windows[i]))"
    # Windows sorted with their places: repeated ones stand side by side. `s` names the sorted array, so that it is made once.
    placed = "sort_array(transform(_windows, (h, i) -> struct(h, i)))"
    beside = "(i > 0 AND x.h = s[i - 1].h) OR (i < size(s) - 1 AND x.h = s[i + 1].h)"
    sorted_out = f"sort_array(transform(array({placed}), s -> transform(filter(s, (x, i) -> {beside}), x -> x.i))[0])"
    places = repeated.withColumn("_places", F.expr(f"CASE WHEN size(_repeated) = 0 THEN array() WHEN size(_repeated) <= {LOOK_UP} THEN {looked_up} ELSE {sorted_out} END"))
    covered = "aggregate(_places, struct(0 AS ends, 0 AS n), (a, p) -> struct(p + 3 AS ends, a.n + p + 3 - greatest(a.ends, p) AS n), a -> a.n)"
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    return places.withColumns({
        "n_words": F.col("n_words").cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(covered).cast("long"),
        "lines": F.transform("_lines", lambda line: F.struct(F.xxhash64(normal_line(line)).alias("key"), F.size(words_of(line)).alias("words"))),
    }).drop("_words", "_lines", "_windows", "_sorted", "_repeated", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def common_lines(lines: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """
    (host, key) of lines (host, text_key, lines) in over `documents` distinct documents of a host and over `share` of these; null is a host like others.

    Rows with the same text are one document, and a document's line counts once. Copies and counts are put together where the rows are read, so a
    text or a line that all rows share costs each task one row.
    """
    once = lines.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    seen = once.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.key))).alias("key"))
    often = seen.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > documents)
    hosts = lines.groupBy("host").agg(F.count_distinct("text_key").alias("of")).withColumnRenamed("host", "_host")
    return often.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") > share * F.col("of")).select("host", "key")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, most_removed: float = MOST_REMOVED) -> DataFrame:
    """
    One row for each row of `docs`: id, the measures, base_failed, removed_lines (array of keys), removed_words, and kept.

    A row is kept if it passes the base rules and removed lines held at most `most_removed` of its words. Repeated rows are judged alike;
    nulls count as above; an empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    keyed = measured(named).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).drop("text")
    rows = stored(keyed.withColumn("row", F.monotonically_increasing_id()), "measures")
    common = common_lines(rows, documents, share).select(F.col("host").alias("_host"), F.col("key").alias("_key"))
    single = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.key", "line.words")
    removed = (
        single.join(common, (F.col("key") == F.col("_key")) & F.col("host").eqNullSafe(F.col("_host")))
        .groupBy("row")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("key").alias("removed_lines"))
    )
    found = rows.join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0))).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("removed_words") <= most_removed * F.col("n_words"))
    return found.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "removed_words", kept.alias("kept"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """
    The rows of `docs` that are kept, without the removed lines; other columns as they are.

    Rows are found again by their ids: rows without an id are left as they are, and rows that share an id lose the lines removed from any of them.
    """
    found = judge(docs, id_col, text_col, host_col, **options).where("id IS NOT NULL")
    by_id = found.groupBy("id").agg(F.max("kept").alias("stays"), F.flatten(F.collect_list(F.coalesce("removed_lines", F.expr("array()")))).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: ~F.array_contains("gone", F.xxhash64(normal_line(line))))
    shorter = F.when(F.size("gone") > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))
    left = rows.join(by_id, F.col("own") == F.col("id"), "left").where(F.coalesce("stays", F.lit(True)))
    return left.select(*[(shorter if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
