"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the more frequent form each of them stands for."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import to_arrow
from callscope.sources.storage import stored

#: Code points that make words: A-Z, a-z and U+00C0 to U+00FF; others stand between words. Only A-Z are lower-cased.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: One run in so many loses a letter.
DAMAGED = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form is so many times as frequent as the word at least.
RATIO = 2
#: A task hands on its counts when it holds so many words, or so many characters of them.
HELD_WORDS = 100_000
HELD_CHARS = 8_000_000
#: Chunks that would bring more pairs together than this are made longer.
CHUNK_PAIRS = 1024


def text_words(doc_id: object, text: str | None) -> Counter:
    """
    Words of a whole text with their numbers, as Latin-1 bytes: maximal runs, of which one in DAMAGED loses a letter.

    Runs of LEAST_LENGTH letters at least. What is lost hangs on the document's id (null is written as an empty one) and the run, so a run is damaged alike wherever it stands in a document.
    """
    found = Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split())
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in found.items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all whole texts, words of `least` occurrences at least. Tasks add up what they read, Spark adds up the tasks."""
    fields = "word string, n bigint"
    schema = to_arrow(fields)

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = [w.decode("latin-1") for w in counts]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        held = 0
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for i in range(batch.num_rows):
                for word, n in text_words(ids[i].as_py(), texts[i].as_py()).items():
                    if word not in counts:
                        held += len(word)
                    counts[word] += n
                if len(counts) >= HELD_WORDS or held >= HELD_CHARS:
                    yield from rows(counts)
                    counts, held = Counter(), 0
        yield from rows(counts)

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    return named.mapInArrow(run, fields).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- words one edit apart ---------------------------------------------------------------------------------------------


def _part(start: Column, size: Column) -> Column:
    return F.substr(F.col("word"), start + 1, size)


def _signatures(words: DataFrame) -> DataFrame:
    """
    (key, place, chunk, word, n): chunks, and the positional grams that can meet them.

    Two words of one edit have lengths m <= k with k - m at most one. The shorter one gives two disjoint chunks of m div 2 letters, its
    first (place 0) and its last (place 1). Of the other one's grams of that size those count that stand where a chunk is if the edit left it whole: an edit behind the first chunk doesn't move it, one before
    the last shifts it by k - m, which is at most one, and every edit is one or the other. Of equal lengths both sides are the same rows. A key is a hash of m, the place and the letters; what meets is verified.
    """
    length = F.char_length("word")
    rows = []
    for chunk, m, shift in ((True, length, 0), (False, length - 1, 1)):
        size = F.floor(m / 2).cast("int")
        for place, start in ((0, F.lit(0)), (1, m - size + shift)):
            key = F.xxhash64(m, F.lit(place), _part(start, size))
            rows.append(F.struct(key.alias("key"), F.lit(place).alias("place"), F.lit(chunk).alias("chunk")))
    return words.select(F.inline(F.array(*rows)), "word", "n")


def _longer(signed: DataFrame) -> DataFrame:
    """The same for signatures whose chunk is too common: the edit stands in the rest of the word, so of two chunks of the rest one is whole too, and both chunks together are the key."""
    m, shift = F.char_length("word") - F.when(F.col("chunk"), 0).otherwise(1), F.when(F.col("chunk"), 0).otherwise(1)
    size = F.floor(m / 2).cast("int")
    half = F.floor((m - size) / 2).cast("int")
    first, last = F.when(F.col("place") == 0, size).otherwise(0), F.when(F.col("place") == 0, m - half).otherwise(m - size - half)
    rows = [F.struct(F.xxhash64(F.col("key"), F.lit(k), _part(start, half)).alias("key"), F.lit(k).alias("place")) for k, start in ((0, first), (1, last + shift))]
    return signed.select(F.inline(F.array(*rows)), "chunk", "word", "n")


def _dropped(words: DataFrame) -> DataFrame:
    """(key, at, word, n): a hash of each word without one letter, for each of its letters (`at` from 1), and of the word itself (`at` 0)."""
    fields = "key bigint, at int, word string, n bigint"
    schema = to_arrow(fields)
    base, modulus = 1_000_003, (1 << 61) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(batch.column("word"), batch.column("n")):
                text = word.as_py()
                # Hashes of what stands before and behind each letter give that of the word without it at once.
                before, powers = [0], [1]
                for c in text:
                    before.append((before[-1] * base + ord(c)) % modulus)
                    powers.append(powers[-1] * base % modulus)
                whole, size = before[-1], len(text)
                keys = [whole]
                for i in range(size):
                    rest = (whole - before[i + 1] * powers[size - i - 1]) % modulus
                    keys.append((before[i] * powers[size - i - 1] + rest) % modulus)
                for start in range(0, size + 1, 10_000):
                    part = keys[start : start + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int64()), pa.array(range(start, start + len(part)), pa.int32()), pa.array([text] * len(part), pa.string()), pa.array([n.as_py()] * len(part), pa.int64())],
                        schema=schema,
                    )

    return words.select("word", "n").mapInArrow(run, fields)


def _pairs(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """(a, n_a, b, n_b) for rows of both sides that meet and are one edit apart, a before b."""
    a, b = F.col("l.word"), F.col("r.word")
    met = left.alias("l").join(right.alias("r"), on & (F.levenshtein(a, b, 1) == 1))
    first = a < b
    return met.select(
        F.when(first, a).otherwise(b).alias("a"), F.when(first, F.col("l.n")).otherwise(F.col("r.n")).alias("n_a"),
        F.when(first, b).otherwise(a).alias("b"), F.when(first, F.col("r.n")).otherwise(F.col("l.n")).alias("n_b"),
    )


def _met(signed: DataFrame, chunk_pairs: int) -> tuple[list[DataFrame], DataFrame]:
    """The pairs of all keys but those that would bring more than `chunk_pairs` together, and the rows of these."""
    signed = stored(signed, "chunks")
    chunks, grams = F.count_if("chunk"), F.count_if(~F.col("chunk"))
    counts = signed.groupBy("key").agg((chunks * (chunks - 1) / 2 + chunks * grams).alias("pairs"))
    usual = signed.join(counts.where(F.col("pairs").between(1, chunk_pairs)), "key", "left_semi")
    chunk, same = usual.where("chunk"), F.col("l.key") == F.col("r.key")
    pairs = [_pairs(chunk, chunk, same & (F.col("l.word") < F.col("r.word"))), _pairs(chunk, usual.where("NOT chunk"), same)]
    return pairs, signed.join(counts.where(F.col("pairs") > chunk_pairs), "key", "left_semi")


def near_words(words: DataFrame, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """
    (a, n_a, b, n_b), each pair of different words of `words` (word, n; each word once) that are one inserted, deleted or replaced letter apart, once, a before b.

    Words meet by chunks of half their letters (`_signatures`). Where so many share a chunk that its pairs would exceed `chunk_pairs`, they meet by two chunks, three quarters of their
    letters (`_longer`). Where even that is too many, words are brought together by what they are without one letter: such groups hold words that are
    near each other, so no group is compared with itself whole. Words of less than two letters have no chunks and go that way too. An empty table gives an empty one.
    """
    found, crowded = _met(_signatures(words.where(F.char_length("word") >= 2)), chunk_pairs)
    more, crowded = _met(_longer(crowded), chunk_pairs)
    rest = crowded.select("word", "n").unionByName(words.where(F.char_length("word") < 3).select("word", "n")).distinct()
    dropped = stored(_dropped(rest), "dropped")
    one_less, same = dropped.where("at > 0"), F.col("l.key") == F.col("r.key")
    found += more + [
        _pairs(one_less, one_less, same & (F.col("l.at") == F.col("r.at")) & (F.col("l.word") < F.col("r.word"))),
        _pairs(dropped.where("at = 0"), one_less, same),
    ]
    pairs = found[0]
    for other in found[1:]:
        pairs = pairs.unionByName(other)
    return pairs.distinct()


def word_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """
    (word, n, n_near, form, form_n, root) for each of `words` (word, n; each word once).

    n_near counts the near words. The form is the near word of largest n (of equals, the first in code-point order) if that n is
    `ratio` times the word's or more, else null. The root is where forms lead in the end, the word itself if it has none.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"), F.first("n").alias("own"))
    formed = -F.col("best.less") >= ratio * F.col("own")
    best = best.select("word", "n_near", F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    best = stored(best, "forms")
    roots = _roots(best.where("form IS NOT NULL").select("word", "form"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): where links (word, form) end. Counts at least double along a link, so there are no rings; each round doubles how far a row has come."""
    reached = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """
    (word, n, n_near, form, form_n, root) for the words of all whole texts that occur `least` times or more.

    Null texts have no words; repeated rows count as often as they stand there; an empty table gives an empty one.
    """
    return word_forms(count_words(docs, id_col, text_col, least), ratio)
