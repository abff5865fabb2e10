"""SimHash near-duplicates: fingerprints of whole texts, linked where they differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import map_rows, to_arrow
from callscope.llm.components import connected_components
from callscope.sources.storage import stored

BITS = 64
RADIUS = 3
#: Fingerprints of one tile; a comparison holds two tiles.
TILE = 256
#: Hashes turned into bits at once.
CHUNK = 1 << 14


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """
    The 64-bit SimHash of a whole text, as a signed number.

    A-Z become a-z; words are separated by ASCII white space; every run of `words` words counts, repeats included. A text of
    fewer words is one run, a text without words (or null) has fingerprint zero. A bit is set if it is set in over half of the
    runs' XXH64 values.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    runs = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[k:] for k in range(words))))
    total = max(1, len(found) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in runs), np.uint64, total)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, CHUNK):
        part = hashes[start : start + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint long) per row of `docs`, repeated rows included."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(named, ["text"], lambda text: (fingerprint(text, words),), "fingerprint bigint", ["id"])


def forest(table: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric table of links: as few links as keep all that is connected together."""
    left = np.ones(len(table), bool)
    links = []
    for root in np.flatnonzero(table.any(axis=1)):
        if not left[root]:
            continue
        left[root] = False
        front = [int(root)]
        while front:
            node = front.pop()
            for other in np.flatnonzero(table[node] & left):
                left[other] = False
                links.append((node, int(other)))
                front.append(int(other))
    return links


def _compare(radius: int):
    """Links within each unit of rows, which arrive sorted by unit: the whole unit is one comparison of a tile with itself or another."""
    schema = to_arrow("a bigint, b bigint")
    keys = ["combo", "key", "first_tile", "second_tile"]

    def unit(prints: np.ndarray, tiles: np.ndarray, first: int, second: int) -> Iterator[tuple[int, int]]:
        if len(prints) < 2:
            return
        bits = prints.view(np.uint64)
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
        if first != second:  # pairs inside either tile are compared in that tile's own unit
            near &= tiles[:, None] != tiles[None, :]
        np.fill_diagonal(near, False)
        for i, j in forest(near):
            yield int(prints[i]), int(prints[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "fingerprint", "tile"]]
            rows = np.stack(columns, axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            edges = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            starts = [0, *edges.tolist()]
            found: list[tuple[int, int]] = []
            for s, e in zip(starts, starts[1:]):
                found.extend(unit(rows[s:e, 4].copy(), rows[s:e, 5], rows[s, 2], rows[s, 3]))
            held = [rows[starts[-1] :]]  # the last unit may go on in the next batch; a unit has two tiles at most
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)
        if held and len(held[0]):
            rows = held[0]
            found = list(unit(rows[:, 4].copy(), rows[:, 5], rows[0, 2], rows[0, 3]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def close_pairs(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """
    Links (a, b) between distinct fingerprints (column `fingerprint`) that differ in at most `radius` bits, cut down to a spanning forest of
    each comparison: components are those of all links, and a dense group gives as many links as it has members, not all its pairs.

    Exact: the 64 bits fall into radius + 2 blocks, so two fingerprints within the radius agree in two whole blocks at least. Each
    pair of blocks deals the fingerprints out by their bits there; a key with more than `tile` of them is cut into tiles by
    population count, and tile pairs whose counts differ beyond the radius are skipped, as they hold no link. The others are compared whole, exclusive-or
    and bit counts in numpy. A task holds two tiles at a time, however many fingerprints share a key.
    """
    blocks = radius + 2
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(s, e)) for s, e in zip(edges, edges[1:])]
    signed = [(masks[i] | masks[j]) - (1 << BITS if (masks[i] | masks[j]) >> (BITS - 1) else 0) for i, j in combinations(range(blocks), 2)]
    fp = F.col("fingerprint")
    dealt = (
        prints.select(fp, F.bit_count(fp).cast("int").alias("ones"))
        .select(
            "fingerprint",
            "ones",
            F.explode(F.array(*(F.struct(F.lit(c).alias("combo"), fp.bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(signed)))).alias("k"),
        )
        .select("fingerprint", "ones", "k.combo", "k.key")
    )
    per_ones = dealt.groupBy("combo", "key", "ones").agg(F.count("*").alias("n"))
    shared = (
        per_ones.groupBy("combo", "key")
        .agg(F.sum("n").alias("total"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))).alias("parts"))
        .where("total > 1")  # parts: at most 65 entries, one for each population count
    )
    # A tile is named by its population count and its number among those of that count.
    tiles = F.expr("filter(parts, p -> p.ones = ones)[0].tiles")
    own = F.when(F.col("total") <= tile, F.lit(0)).otherwise(F.expr("ones * 33554432L") + F.pmod(F.xxhash64("fingerprint"), tiles))
    near = F.expr(
        f"flatten(transform(filter(parts, p -> abs(p.ones - ones) <= {radius}), p -> transform(sequence(0, p.tiles - 1), t -> p.ones * 33554432L + t)))"
    )
    units = (
        dealt.join(shared, ["combo", "key"])
        .select("combo", "key", "fingerprint", own.cast("long").alias("tile"), F.when(F.col("total") <= tile, F.array(F.lit(0).cast("long"))).otherwise(near).alias("near"))
        .select("combo", "key", "fingerprint", "tile", F.explode("near").alias("other"))
        .select("combo", "key", F.least("tile", "other").alias("first_tile"), F.greatest("tile", "other").alias("second_tile"), "tile", "fingerprint")
    )
    keys = ["combo", "key", "first_tile", "second_tile"]
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """
    (id, fingerprint, component) per row: component is the smallest id among the rows reachable over links.

    Texts with the same fingerprint are one node, so copies cost nothing in the comparison. Rows with a null id get the component of
    their group (null if no row of it has an id); an empty table gives an empty result; columns other than the two named are not looked at.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "nodes")
    joined = connected_components(close_pairs(nodes, radius, tile))
    groups = (
        joined.join(nodes, F.col("node") == F.col("fingerprint")).groupBy("component").agg(F.min("least").alias("smallest"))
    )
    linked = joined.join(groups, "component").select(F.col("node").alias("fingerprint"), "smallest")
    # Stored, so that the last join is one plain join, whose partition of a text copied very often Spark can split.
    named = stored(nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("smallest", "least").alias("component")), "groups")
    return prints.join(named, "fingerprint").select("id", "fingerprint", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """
    The rows of `docs` with one document of each group of near-duplicates: that with the smallest id.

    Repeated rows of that document, and rows without an id, all stay: nothing tells them apart.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    # The semi side's column is no part of the result, but the condition must not mistake it for one of the table's.
    dropped = found.where(F.col("id") != F.col("component")).select(F.col("id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
