"""Ranked lexical search: an inverted index in segments, searched by accumulators of short lists and skipping over long ones."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.batches import to_arrow
from callscope.sources.storage import stored

#: Bytes that make terms: ASCII letters (lower-cased) and digits, and all beyond ASCII; others stand between terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A segment of the index is closed at so many documents or postings.
SEGMENT_DOCS = 2048
SEGMENT_POSTINGS = 1 << 19
#: Within a segment, lists of up to this share of its documents are short: they are summed before the search.
SHORT = 1 / 16
#: Documents of a block; each long list knows the most occurrences and the least document length in each of its blocks.
BLOCK = 256
#: Items are searched for in blocks of so many, or of so many characters.
ITEMS = 1000
ITEM_CHARS = 4_000_000
RESULTS = 50
#: The first of two rounds of merging results deals those of an item to so many groups.
MERGE = 32

SEGMENT = "n_docs bigint, n_terms bigint, ids array<bigint>, lengths binary, terms array<string>, ends binary, docs binary, tfs binary"
SIZES = "term string, df bigint"


def text_terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in their order, in UTF-8; none of a null text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


class _Segment:
    """Documents in memory until they are handed on as one row of the index."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}
        self.postings = 0

    def add(self, name: int | None, terms: list[bytes]) -> None:
        doc = len(self.ids)
        self.ids.append(name)
        self.lengths.append(len(terms))
        counts = Counter(terms)
        for term, n in counts.items():
            entry = self.lists.get(term)
            if entry is None:
                entry = self.lists[term] = ([], [])
            entry[0].append(doc)
            entry[1].append(n)
        self.postings += len(counts)

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        names = sorted(self.lists)
        ends = np.cumsum([len(self.lists[t][0]) for t in names], dtype=np.int64)
        docs = np.fromiter((d for t in names for d in self.lists[t][0]), np.int32, self.postings)
        tfs = np.fromiter((n for t in names for n in self.lists[t][1]), np.int32, self.postings)
        values = [len(self.ids), sum(self.lengths), self.ids, np.array(self.lengths, np.int64).tobytes(), [t.decode("utf-8", "replace") for t in names], ends.tobytes(), docs.tobytes(), tfs.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


@dataclass(frozen=True)
class Index:
    """Segments (SEGMENT), the number of documents that hold each term (term, df), and the numbers of documents with a term and of all terms."""

    segments: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = SEGMENT_DOCS) -> Index:
    """
    An inverted index over all whole texts, written to the shared folder: tasks turn the documents they read into segments of bounded size, and nothing is shuffled but the terms' document numbers.

    Documents without a term can't be found and are left out. Repeated rows are documents of their own. Ids are whole numbers or null.
    """
    schema = to_arrow(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment()
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for i in range(batch.num_rows):
                terms = text_terms(texts[i].as_py())
                if not terms:
                    continue
                segment.add(ids[i].as_py(), terms)
                if len(segment.ids) >= segment_docs or segment.postings >= SEGMENT_POSTINGS:
                    yield segment.row(schema)
                    segment = _Segment()
        if segment.ids:
            yield segment.row(schema)

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    segments = stored(named.mapInArrow(run, SEGMENT), "segments")
    pairs = to_arrow(SIZES)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends")):
                found = np.diff(np.frombuffer(ends.as_py(), np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays([terms.values.cast(pa.string()), pa.array(found)], schema=pairs)

    counts = segments.select("terms", "ends").mapInArrow(sizes, SIZES)
    frequencies = stored(counts.groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    total = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    return Index(segments, frequencies, total["docs"], total["terms"])


# --- search within a segment ------------------------------------------------------------------------------------------


def length_measure(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document: half of 100 is fixed, half follows its length against the mean length."""
    if len(lengths) and int(lengths.max()) * 50 * n_docs >= 1 << 63:
        return np.array([50 + 50 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 50 + 50 * lengths * n_docs // max(1, n_terms)


def term_score(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term adds to a document's score. It never falls with tf nor rises with m."""
    tf = tf.astype(np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class SegmentSearch:
    """One segment, opened: documents by number, posting lists by term."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, block: int = BLOCK):
        self.ids, self.block = row["ids"], block
        self.m = length_measure(np.frombuffer(row["lengths"], np.int64), n_docs, n_terms)
        self.at = row["at"]
        ends = np.frombuffer(row["ends"], np.int64)
        self.ends, self.starts = ends, np.concatenate([[0], ends])[:-1]
        self.docs, self.tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
        self.bounds: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        i = self.at[term]
        return self.docs[self.starts[i] : self.ends[i]], self.tfs[self.starts[i] : self.ends[i]]

    def block_bounds(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        """The most occurrences and the least m in each block of documents, from the list; 0 occurrences where the list has none."""
        if term not in self.bounds:
            docs, tfs = self.postings(term)
            blocks = len(self.m) // self.block + 1
            most, least = np.zeros(blocks, np.int64), np.full(blocks, np.iinfo(np.int32).max, np.int64)
            np.maximum.at(most, docs // self.block, tfs)
            np.minimum.at(least, docs // self.block, self.m[docs])
            self.bounds[term] = most, least
        return self.bounds[term]

    def best(self, weights: dict[str, int], floor: int, results: int = RESULTS) -> tuple[np.ndarray, np.ndarray]:
        """
        (documents by number, scores): all that score above 0 and at least `floor`, or of these at least the `results` best with all that equal the last of them.

        Short lists are summed first, term at a time, into accumulators in document order. From there on the accumulators are one more list,
        whose scores are bounded block by block like those of the long lists. The search goes document by document over
        blocks of them: a block whose bounds together stay below the floor is skipped in all lists; in the others, the lists that could
        lift a document over the floor by themselves give the candidates, and the rest are only looked into for candidates that they could still lift.
        """
        short, long = [], []
        for term in weights:
            i = self.at.get(term)
            if i is not None and weights[term] > 0:
                (short if self.ends[i] - self.starts[i] <= SHORT * len(self.m) else long).append(term)
        held = np.zeros(len(self.m), np.int64)  # accumulators: one number for each document of the segment
        for term in short:
            docs, tfs = self.postings(term)
            held[docs] += term_score(weights[term], tfs, self.m[docs])
        summed = np.flatnonzero(held)
        blocks = len(self.m) // self.block + 1
        summed_bound = np.zeros(blocks, np.int64)
        np.maximum.at(summed_bound, summed // self.block, held[summed])
        lists = [(summed, held[summed], summed_bound)]
        for term in long:
            most, least = self.block_bounds(term)
            lists.append((self.postings(term)[0], term, np.where(most > 0, term_score(weights[term], most, least), 0)))
        bounds = np.stack([x[2] for x in lists])
        heap_docs, heap_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = bounds.sum(axis=0)
        for block in np.flatnonzero(total >= max(1, floor)):
            if total[block] < floor:  # it has risen since
                continue
            docs, scores = self._block(lists, weights, bounds[:, block], int(block), floor)
            if not len(docs):
                continue
            heap_docs, heap_scores = np.concatenate([heap_docs, docs]), np.concatenate([heap_scores, scores])
            if len(heap_scores) >= results:
                floor = max(floor, int(np.partition(heap_scores, len(heap_scores) - results)[len(heap_scores) - results]))
                keep = heap_scores >= floor
                heap_docs, heap_scores = heap_docs[keep], heap_scores[keep]
        return heap_docs, heap_scores

    def _block(self, lists: list, weights: dict[str, int], bounds: np.ndarray, block: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block that score at least `floor` and above 0, with their scores."""
        order = np.argsort(bounds, kind="stable")  # from the list that matters least
        below = np.cumsum(bounds[order])
        first = int(np.searchsorted(below, max(1, floor)))  # the lists before it can't reach the floor together
        low, high = block * self.block, (block + 1) * self.block
        sums, seen = np.zeros(self.block, np.int64), np.zeros(self.block, bool)
        for k in order[first:]:
            docs, given, _ = lists[k]
            a, b = np.searchsorted(docs, (low, high))
            part = docs[a:b]
            seen[part - low] = True
            sums[part - low] += given[a:b] if isinstance(given, np.ndarray) else self._scores(given, weights, a, b, part)
        candidates = np.flatnonzero(seen)
        for j in range(first - 1, -1, -1):
            candidates = candidates[sums[candidates] + below[j] >= floor]
            if not len(candidates):
                break
            docs, given, _ = lists[order[j]]
            at = np.searchsorted(docs, candidates + low)
            hit = (at < len(docs)) & (docs[np.minimum(at, len(docs) - 1)] == candidates + low) if len(docs) else np.zeros(len(candidates), bool)
            at = at[hit]
            if isinstance(given, np.ndarray):
                sums[candidates[hit]] += given[at]
            else:
                tfs = self.postings(given)[1][at]
                sums[candidates[hit]] += term_score(weights[given], tfs, self.m[candidates[hit] + low])
        candidates = candidates[sums[candidates] >= max(1, floor)]
        return candidates + low, sums[candidates]

    def _scores(self, term: str, weights: dict[str, int], a: int, b: int, docs: np.ndarray) -> np.ndarray:
        return term_score(weights[term], self.postings(term)[1][a:b], self.m[docs])


# --- search over the index --------------------------------------------------------------------------------------------


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """The items with their different terms, some at a time; the driver holds one block."""
    block, size = [], 0
    for row in items.toLocalIterator():
        terms = list(dict.fromkeys(t.decode("utf-8", "replace") for t in text_terms(row["text"])))
        block.append((row["item"], terms))
        size += len(row["text"] or "")
        if len(block) >= ITEMS or size >= ITEM_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(index: Index, block: list[tuple[object, list[str]]], results: int, docs_of_block: int) -> DataFrame:
    """(number of the item in the block, doc_id, score): what the segments' tasks found, `results` for each item from each task at least."""
    spark = index.segments.sparkSession
    wanted = sorted({t for _, terms in block for t in terms})
    # A block's terms, bounded by ITEM_CHARS, go to Spark and their frequencies come back.
    found = index.frequencies.join(spark.createDataFrame([(t,) for t in wanted], "term string"), "term", "left_semi").collect()
    n_docs, n_terms = index.n_docs, index.n_terms
    weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found}
    plans = [{t: weight[t] for t in terms if t in weight} for _, terms in block]
    fields = "item_no int, doc_id bigint, score bigint"
    schema = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[list, list]] = [([], []) for _ in plans]
        floors = [0] * len(plans)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "lengths", "ends", "docs", "tfs")}
                names = batch.column("terms")[i].values
                row["at"] = {t: k for k, t in enumerate(names.to_pylist()) if t in weight}
                segment = SegmentSearch(row, n_docs, n_terms, docs_of_block)
                for k, weights in enumerate(plans):
                    docs, scores = segment.best(weights, floors[k], results)
                    if len(docs):
                        ids, values = best[k]
                        ids += [segment.ids[d] for d in docs]
                        values += scores.tolist()
                        best[k], floors[k] = _cut(ids, values, results)
        for k, (ids, values) in enumerate(best):
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(values, pa.int64())], schema=schema)

    return index.segments.select("ids", "lengths", "terms", "ends", "docs", "tfs").mapInArrow(run, fields)


def _cut(ids: list, values: list, results: int) -> tuple[tuple[list, list], int]:
    """The best `results` of some, by score and then by id, nulls last; and the score that a further one must reach."""
    if len(ids) <= results:
        return (ids, values), 0
    order = sorted(range(len(ids)), key=lambda i: (-values[i], ids[i] is None, ids[i] or 0))[:results]
    return ([ids[i] for i in order], [values[i] for i in order]), values[order[-1]]


def search(index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", results: int = RESULTS, docs_of_block: int = BLOCK) -> DataFrame:
    """
    (item, rank, doc_id, score): for each row of `items` the `results` best documents with a score above 0, equal scores by ascending id (nulls last).

    The terms of an item count once each. Items without a known term have no rows, and each of repeated items has its own. Items are
    searched for in blocks, each in one pass over the index; a task keeps `results` documents for each item of a block, whatever it reads.
    """
    spark = items.sparkSession
    named = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    item_type = named.schema["item"].dataType.simpleString()
    first = (F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], f"item {item_type}, rank int, doc_id bigint, score bigint")
    for block in _item_blocks(named):
        found = stored(_search_block(index, block, results, docs_of_block), "found")
        by_group = Window.partitionBy("item_no", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))).orderBy(*first)
        found = found.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= results)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*first))).where(F.col("rank") <= results)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], f"item_no int, item {item_type}")
        out = out.unionByName(found.join(names, "item_no").select("item", "rank", "doc_id", "score"))
    return out
