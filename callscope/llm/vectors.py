"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping shards and searched with a growing range."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.batches import to_arrow
from callscope.llm.components import connected_components
from callscope.llm.simhash import forest
from callscope.sources.storage import stored

COSINE = 0.93
#: Vectors of one label are split if there are over so many, and a part of them again if it still has over WHOLE times that; centres a shard is split by, at most; shards a
#: vector goes to in a split. A part that is a little too large stays whole: splitting it doubles its vectors and hardly makes it smaller.
SHARD = 1000
WHOLE = 4
FAN = 128
OVERLAP = 2
#: Splits in a row, at most: what still hangs together then stays whole, however large.
LEVELS = 12
#: Neighbours a vector keeps, candidates they are chosen from, how much nearer a kept neighbour must be to make another one needless, and best ones a search remembers.
DEGREE = 16
CANDIDATES = 48
SLACK = 1.2
BEAM = 32
#: Vectors of a label looked up by brute force to measure its recall, and the recall below which the label is built again with more overlap.
AUDIT = 200
RECALL = 0.95
BLOCK = 128


def unit_rows(table: pa.Table | pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """Vectors of length one, in double precision."""
    values = table.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- one shard --------------------------------------------------------------------------------------------------------


def pruned_graph(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, slack: float = SLACK) -> np.ndarray:
    """
    Neighbours of each row (places in the shard, -1 where there are fewer), chosen from its nearest rows.

    The nearest candidate is taken, and drops all that it is nearer to, by the factor `slack`, than the row itself is: the ones kept lie in
    different directions. Then the next of those left, and so on.
    """
    n, width = len(x), min(candidates, len(x) - 1)
    out = np.full((n, degree), -1, np.int64)
    if width < 1:
        return out
    for start in range(0, n, BLOCK):
        rows = np.arange(start, min(start + BLOCK, n))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        chosen = np.argpartition(-near, width - 1, axis=1)[:, :width]
        order = np.argsort(-np.take_along_axis(near, chosen, 1), axis=1, kind="stable")
        chosen = np.take_along_axis(chosen, order, 1)
        own = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, chosen, 1), 0))
        among = np.sqrt(np.maximum(2 - 2 * np.einsum("ick,idk->icd", x[chosen], x[chosen], optimize=True), 0))
        left = np.ones(chosen.shape, bool)
        at = np.arange(len(rows))
        for k in range(degree):
            pick = left.argmax(axis=1)
            some = left[at, pick]
            out[rows[some], k] = chosen[at[some], pick[some]]
            left &= slack * among[at, pick] > own
            left[at, pick] = False
    return out


def _lists(neighbours: list[np.ndarray], n: int) -> np.ndarray:
    """Adjacency in both directions as one table, -1 where a list ends."""
    a = np.repeat(np.arange(n), [len(v) for v in neighbours])
    b = np.concatenate(neighbours) if n else np.zeros(0, np.int64)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // max(n, 1), both % max(n, 1)
    sizes = np.bincount(a, minlength=n)
    out = np.full((n, max(1, sizes.max(initial=0))), -1, np.int64)
    out[a, np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = b
    return out


def _greedy(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, medoid: int, cosine: float, beam: int, found: np.ndarray, seen: np.ndarray, opened: np.ndarray) -> None:
    """Best-first walks of some queries from the medoid and from themselves; notes what they found, saw and left."""
    best, score = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), -np.inf)
    best[:, 0], score[:, 0] = medoid, x[queries] @ x[medoid]
    best[:, 1], score[:, 1] = queries, 1
    seen[queries, medoid] = seen[queries, queries] = True
    found[queries, medoid] = score[:, 0] >= cosine
    found[queries, queries] = True
    active = np.arange(len(queries))
    while len(active):
        rows = queries[active]
        waiting = np.where((best[active] >= 0) & ~opened[rows[:, None], np.maximum(best[active], 0)], score[active], -np.inf)
        place = waiting.argmax(axis=1)
        going = waiting[np.arange(len(active)), place] > -np.inf
        active, rows, place = active[going], rows[going], place[going]
        if not len(active):
            break
        node = best[active, place]
        opened[rows, node] = True
        next_ = lists[node]
        fresh = (next_ >= 0) & ~seen[rows[:, None], next_]
        near = np.where(fresh, np.einsum("qk,qdk->qd", x[rows], x[next_], optimize=True), -np.inf)
        q, d = np.nonzero(fresh)
        seen[rows[q], next_[q, d]] = True
        found[rows[q], next_[q, d]] = near[q, d] >= cosine
        ids, scores = np.hstack([best[active], np.where(fresh, next_, -1)]), np.hstack([score[active], near])
        top = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
        best[active], score[active] = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)


def _pieces(lists: np.ndarray) -> np.ndarray:
    """For each row, the first row of the piece of the graph it is in."""
    piece = np.full(len(lists), -1, np.int64)
    for root in range(len(lists)):
        front = np.array([root] if piece[root] < 0 else [], np.int64)
        while len(front):
            piece[front] = root
            next_ = np.unique(lists[front])
            front = next_[(next_ >= 0) & (piece[next_] < 0)]
    return piece


def _starts(x: np.ndarray, piece: np.ndarray, cosine: float, found: np.ndarray, seen: np.ndarray) -> None:
    """Notes, for each row as a query, the nearest row of every piece that has any within range: no walk leads from one piece to another."""
    order = np.argsort(piece, kind="stable")
    first = np.flatnonzero(np.diff(piece[order], prepend=-1))
    sizes = np.diff(first, append=len(order))
    for start in range(0, len(x), BLOCK):
        near = x[start : start + BLOCK] @ x[order].T
        q, at = np.nonzero((near >= cosine) & (near == np.repeat(np.maximum.reduceat(near, first, axis=1), sizes, axis=1)))
        found[start + q, order[at]] = seen[start + q, order[at]] = True


def range_search(x: np.ndarray, lists: np.ndarray, cosine: float = COSINE, beam: int = BEAM) -> np.ndarray:
    """
    A table of the pairs found with a cosine of `cosine` or more, each row being a query.

    A query walks greedily from the medoid and from itself, always on from the best of its `beam` best that it hasn't left yet. When it has left all of
    them, the range grows: from every row found within it the walk goes on to all neighbours, until nothing new is within. Where the graph is in several
    pieces, the nearest row of each is one to go on from.
    """
    n = len(x)
    found, seen, opened = (np.zeros((n, n), bool) for _ in range(3))
    if n < 2:
        return found
    medoid = int((x @ x.mean(axis=0)).argmax())
    # Queries don't see each other, so they go in blocks that bound what is gathered at once.
    block = max(16, (1 << 22) // (lists.shape[1] * x.shape[1]))
    for start in range(0, n, block):
        _greedy(x, lists, np.arange(start, min(start + block, n)), medoid, cosine, beam, found, seen, opened)
    piece = _pieces(lists)
    if piece.any():
        _starts(x, piece, cosine, found, seen)
    step = max(1, (1 << 20) // lists.shape[1])
    while True:
        q, node = np.nonzero(found & ~opened)
        if not len(q):
            break
        opened[q, node] = True
        for start in range(0, len(q), step):
            next_ = lists[node[start : start + step]]
            pairs = np.unique((q[start : start + step, None] * n + next_)[next_ >= 0])
            a, b = pairs // n, pairs % n
            fresh = ~seen[a, b]
            a, b = a[fresh], b[fresh]
            seen[a, b] = True
            for s in range(0, len(a), 1 << 16):
                i, j = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                found[i, j] = np.einsum("ik,ik->i", x[i], x[j]) >= cosine
    np.fill_diagonal(found, False)
    return found | found.T


# --- tables -----------------------------------------------------------------------------------------------------------


def usable(vector: str, label: str) -> Column:
    """True for vectors that can be linked: label and all components there, finite, and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def part() -> Column:
    """What vectors must share to be compared: label and length."""
    return F.xxhash64("label", F.size("vector"))


def _assign(rows: DataFrame, overlap: int) -> DataFrame:
    """
    (node, copies, vector, shard) from rows (shard, salt, centre, node, copies, vector) sorted by the first three: the centres of a shard come first
    (centre 0), then its vectors (centre 1), which go to the shards of their `overlap` nearest centres.
    """
    fields = f"node bigint, copies bigint, vector {rows.schema['vector'].dataType.simpleString()}, shard bigint"
    schema = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "salt", "centre")], axis=1)
            x = unit_rows(batch)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            nodes = batch.column("node").to_numpy()
            for s, e in zip([0, *edges], [*edges, len(key)]):
                if tuple(key[s, :2]) != group:
                    group, held = tuple(key[s, :2]), []
                if key[s, 2] == 0:
                    held.append((nodes[s:e], x[s:e]))
                    continue
                if not held:  # nothing was drawn, which is all but impossible: the next split tries again
                    part = batch.slice(s, e - s)
                    yield pa.RecordBatch.from_arrays([part.column(c).cast(schema.field(c).type) for c in ("node", "copies", "vector", "shard")], schema=schema)
                    continue
                names, centres = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                order = np.argsort(names, kind="stable")
                names, centres = names[order], centres[order]
                near = np.argsort(-(x[s:e] @ centres.T), axis=1, kind="stable")[:, :overlap]
                rows_ = np.repeat(np.arange(s, e), near.shape[1])
                part = batch.take(pa.array(rows_))
                # A shard's name: its parent's and its centre's, mixed.
                shard = (key[s, 0].astype(np.uint64) * np.uint64(6364136223846793005)) ^ (names[near.ravel()].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1442695040888963407))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").cast(pa.int64()), part.column("copies").cast(pa.int64()), part.column("vector").cast(schema.field("vector").type), pa.array(shard.view(np.int64))],
                    schema=schema,
                )

    return rows.select("shard", "salt", "centre", "node", "copies", "vector").mapInArrow(run, fields)


def shards(classes: DataFrame, size: int = SHARD, fan: int = FAN, overlap: int = OVERLAP) -> DataFrame:
    """
    (node, copies, vector, shard) from classes (node, copies, label, vector): vectors of different labels or lengths never share a shard.

    A shard over `size` (a part of one: over WHOLE times that) is split by some of its own vectors, those whose ids hash lowest, and each vector goes to its `overlap` nearest of them; this
    goes on until all are small. Each split is dealt out in slices of some ten thousand rows, whose centres travel along, so a label that holds most rows is split by many tasks.
    """
    now = stored(classes.select("node", "copies", "vector", part().alias("shard")), "shards")
    done: DataFrame | None = None
    for level in range(LEVELS):
        sizes = stored(now.groupBy("shard").agg(F.count("*").alias("n")), "shard-sizes")
        large = sizes.where(F.col("n") > (size if level == 0 else WHOLE * size))
        small = now.join(large, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return stored(done, "shards")
        rows = now.join(large, "shard").withColumn("salts", F.ceil(F.col("n") / (20 * size)))
        draw = F.pmod(F.xxhash64("node", "shard"), F.lit(1 << 30)) / float(1 << 30)
        wanted = F.least(F.lit(fan), F.ceil(4 * F.col("n") / size))
        # Some three times as many as wanted are drawn, so that ranking them sorts little.
        drawn = rows.withColumn("draw", draw).where(F.col("draw") < 3 * wanted / F.col("n"))
        rank = F.row_number().over(Window.partitionBy("shard").orderBy("draw", "node"))
        centres = drawn.withColumn("rank", rank).where(F.col("rank") <= wanted).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        members = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
        parts = centres.withColumn("centre", F.lit(0)).select("shard", "salt", "centre", "node", "copies", "vector").unionByName(
            members.withColumn("centre", F.lit(1)).select("shard", "salt", "centre", "node", "copies", "vector")
        )
        dealt = parts.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "centre")
        now = stored(_assign(dealt, overlap), "shards")
    return stored(done.unionByName(now), "shards")


def graph(members: DataFrame) -> DataFrame:
    """(node, neighbours): the robust-pruned lists of each shard, united over the shards of a node."""
    schema = to_arrow("node bigint, neighbours array<bigint>")

    def build(table: pa.Table) -> pa.Table:
        nodes, order = np.unique(table.column("node").to_numpy(), return_index=True)
        picked = pruned_graph(unit_rows(table)[order])
        lists = [nodes[row[row >= 0]] for row in picked]
        return pa.table([pa.array(nodes), pa.array(lists, schema.field(1).type)], schema=schema)

    each = members.select("shard", "node", "vector").groupBy("shard").applyInArrow(build, "node bigint, neighbours array<bigint>")
    return each.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


PAIRS = "a bigint, b bigint, copies_a bigint, copies_b bigint, tree boolean"


def _pairs(nodes: np.ndarray, copies: np.ndarray, x: np.ndarray, found: np.ndarray, cosine: float, schema: pa.Schema) -> pa.Table:
    """The pairs of a symmetric table of links between nodes that are sorted, and which of them are in its spanning forest."""
    a, b = np.nonzero(np.triu(found))
    # Verified: the cosine of exactly these two, in double precision.
    sure = np.concatenate([np.einsum("ik,ik->i", x[a[s : s + 65536]], x[b[s : s + 65536]]) >= cosine for s in range(0, len(a), 65536)] or [np.zeros(0, bool)])
    found[a[~sure], b[~sure]] = found[b[~sure], a[~sure]] = False
    a, b = a[sure], b[sure]
    tree = np.zeros((len(nodes), len(nodes)), bool)
    for i, j in forest(found):
        tree[i, j] = tree[j, i] = True
    return pa.table([pa.array(v) for v in (nodes[a], nodes[b], copies[a], copies[b], tree[a, b])], schema=schema)


def search(members: DataFrame, lists: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Pairs found in each shard (a < b, how many copies each stands for, and whether the pair is in the shard's spanning forest)."""
    schema = to_arrow(PAIRS)

    def find(table: pa.Table) -> pa.Table:
        nodes, order = np.unique(table.column("node").to_numpy(), return_index=True)
        copies, x = table.column("copies").to_numpy()[order], unit_rows(table)[order]
        held = table.column("neighbours").combine_chunks()
        local = []
        for i in order:
            names = held[int(i)].values.to_numpy() if held[int(i)].is_valid else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(nodes, names), len(nodes) - 1)
            local.append(at[nodes[at] == names])
        found = range_search(x, _lists(local, len(nodes)), cosine)
        return _pairs(nodes, copies, x, found, cosine, schema)

    rows = members.join(lists, "node").select("shard", "node", "copies", "vector", "neighbours")
    return rows.groupBy("shard").applyInArrow(find, PAIRS)


def whole(classes: DataFrame, cosine: float = COSINE, size: int = SHARD) -> DataFrame:
    """
    All pairs within range, like those of `search`, by products of tiles.

    A tile holds some `size` vectors of one place (a shard that each vector is in once, cut by ids where it is larger). Each two tiles of a label are compared by a task,
    but for those that no pair can join: the angle between two vectors is at least that between the tiles' centres less the tiles' radii.
    """
    placed = shards(classes, size, overlap=1)
    cuts = placed.groupBy("shard").agg(F.ceil(F.count("*") / size).alias("cuts"))
    cut = placed.join(cuts, "shard").withColumn("tile", F.xxhash64("shard", F.pmod(F.xxhash64("node", F.lit(9)), "cuts")))
    members = stored(cut.join(classes.select("node", part().alias("part")), "node").select("part", "tile", "node", "copies", "vector"), "tiles")
    fields = "part bigint, tile bigint, centre array<double>, radius double"
    schema, pairs_schema = to_arrow(fields), to_arrow(PAIRS)

    def measure(table: pa.Table) -> pa.Table:
        x = unit_rows(table)
        centre = x.sum(axis=0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-9 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        return pa.table([table.column("part")[:1], table.column("tile")[:1], pa.array([centre.tolist()], schema.field(2).type), pa.array([radius])], schema=schema)

    tiles = stored(members.select("part", "tile", "vector").groupBy("part", "tile").applyInArrow(measure, fields), "tile-measures")
    a, b = (tiles.select("part", F.col("tile").alias(name), F.col("centre").alias(f"{name}_centre"), F.col("radius").alias(f"{name}_radius")) for name in ("first", "second"))
    dot = F.aggregate(F.zip_with("first_centre", "second_centre", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    near = apart <= F.col("first_radius") + F.col("second_radius") + float(np.arccos(cosine)) + 1e-6
    couples = stored(a.join(b, "part").where((F.col("first") <= F.col("second")) & near).select("first", "second"), "tile-pairs")

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        order = np.argsort(nodes)
        nodes, copies, x = nodes[order], table.column("copies").to_numpy()[order], unit_rows(table)[order]
        side = table.column("tile").to_numpy()[order]
        found = np.zeros((len(x), len(x)), bool)
        for start in range(0, len(x), BLOCK):
            found[start : start + BLOCK] = x[start : start + BLOCK] @ x.T >= cosine
        if (side != side[0]).any():
            found &= side[:, None] != side[None, :]
        np.fill_diagonal(found, False)
        return _pairs(nodes, copies, x, found | found.T, cosine, pairs_schema)

    rows = couples.join(members, F.col("first") == F.col("tile")).unionByName(couples.where("first < second").join(members, F.col("second") == F.col("tile")))
    return rows.select("first", "second", "tile", "node", "copies", "vector").groupBy("first", "second").applyInArrow(compare, PAIRS)


def audit(classes: DataFrame, pairs: DataFrame, cosine: float = COSINE, queries: int = AUDIT, size: int = SHARD) -> DataFrame:
    """
    (part, n, recall): for each label and length, how many vectors it has and the share of the pairs of some of them (those whose ids hash lowest, found by comparing
    them with all others) that `pairs` has. Parts where they have none are left out. Parts are dealt out in slices of some ten thousand rows, each of which meets all queries.
    """
    named = classes.select(part().alias("part"), "node", "vector")
    sizes = stored(named.groupBy("part").agg(F.count("*").alias("n")), "audit-sizes")
    rows = named.join(sizes, "part").withColumn("salts", F.ceil(F.col("n") / (10 * size)))
    draw = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # Some three times as many as wanted are drawn, so that ranking them sorts little.
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < 3 * queries / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("draw", "node"))
    asked = drawn.withColumn("rank", rank).where(F.col("rank") <= queries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    others = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    columns = ("part", "salt", "asked", "node", "vector")
    dealt = asked.withColumn("asked", F.lit(True)).select(*columns).unionByName(others.withColumn("asked", F.lit(False)).select(*columns))
    schema = to_arrow("part bigint, a bigint, b bigint")

    def meet(table: pa.Table) -> pa.Table:
        x, nodes, query = unit_rows(table), table.column("node").to_numpy(), table.column("asked").to_numpy()
        names, known, rest = nodes[query], x[query], nodes[~query]
        i, j = np.nonzero((x[~query] @ known.T >= cosine) & (rest[:, None] != names[None, :]))
        a, b = np.minimum(rest[i], names[j]), np.maximum(rest[i], names[j])
        return pa.table([pa.array(np.full(len(a), table.column("part")[0].as_py())), pa.array(a), pa.array(b)], schema=schema)

    true = dealt.groupBy("part", "salt").applyInArrow(meet, "part bigint, a bigint, b bigint").distinct()
    hits = true.join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").groupBy("part").agg((F.count("hit") / F.count("*")).alias("recall"))
    return hits.join(sizes, "part").select("part", "n", "recall")


def _of(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """The classes of some parts."""
    return classes.withColumn("part", part()).join(parts.select("part"), "part", "left_semi").drop("part")


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, size: int = SHARD, recall: float = RECALL) -> DataFrame:
    """
    One row for each row of `table`: id, n_links (other rows of its label linked directly), component (smallest id reachable over links).

    Rows with the same label and vector are one class, compared once and counted as often as they occur. Rows that can't be linked (see `usable`) have no
    links and are their own component; a component without any id is null. Recall is measured for each label after each build; labels below `recall` are built again with twice the
    overlap, up to four times the first, and those that this doesn't help are compared whole. All links reported are verified. An empty table gives an empty result.
    """
    kind = table.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    named = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    rows = stored(named.withColumn("usable", usable("vector", "label")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = stored(
        rows.where("usable").groupBy("label", "vector").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies")), "classes"
    )
    overlap, poor, built = OVERLAP, classes, []
    while True:
        members = shards(poor, size, overlap=overlap)
        pairs = stored(
            search(members, graph(members), cosine).groupBy("a", "b").agg(F.first("copies_a").alias("copies_a"), F.first("copies_b").alias("copies_b"), F.max("tree").alias("tree")),
            "pairs",
        )
        built.append(pairs)
        missing = stored(audit(poor, pairs, cosine, size=size).where(F.col("recall") < recall), "recall")
        # More overlap changes nothing where a label is one shard.
        helps = F.lit(overlap < 4 * OVERLAP) & (F.col("n") > size)
        if not missing.where(~helps).isEmpty():
            built.append(stored(whole(_of(poor, missing.where(~helps)), cosine, size), "pairs"))
        again = missing.where(helps)
        if again.isEmpty():
            break
        poor = stored(_of(poor, again), "classes")
        overlap *= 2
    if len(built) > 1:
        each = reduce(DataFrame.unionByName, built)
        pairs = stored(each.groupBy("a", "b").agg(F.first("copies_a").alias("copies_a"), F.first("copies_b").alias("copies_b"), F.max("tree").alias("tree")), "pairs")
    linked = (
        pairs.select(F.col("a").alias("node"), F.col("copies_b").alias("others"))
        .unionByName(pairs.select(F.col("b").alias("node"), F.col("copies_a").alias("others")))
        .groupBy("node")
        .agg(F.sum("others").alias("others"))
    )
    joined = connected_components(pairs.where("tree"))
    smallest = joined.join(classes, "node").groupBy("component").agg(F.min("least").alias("smallest"))
    named = joined.join(smallest, "component").select("node", "smallest")
    per_class = (
        classes.join(linked, "node", "left")
        .join(named, "node", "left")
        .select("label", "vector", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component"))
    )
    valid = rows.where("usable").join(per_class, ["label", "vector"]).select("id", "n_links", "component")
    return valid.unionByName(rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
