"""Toxicity of texts: embeddings of subwords, averaged for a text, into a linear softmax; both are trained together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import map_rows

#: Subwords (character n-grams of these sizes, with the word's edges, and whole words) fall into so many cells by a hash.
CELLS = 1 << 16
SIZES = (3, 4, 5)
#: Numbers in the embedding of a cell.
WIDTH = 4
#: Bound of the fit: so many labelled documents of each class are looked at (those whose ids hash lowest), and their cells come to the driver.
LABELLED_ROWS = 2000
#: The fit goes so often over the texts, or oftener, until it has made so many steps.
EPOCHS = 6
STEPS = 800
RATE = 1.0
BATCH = 32
#: What Adagrad's sums of squares start from: cells met once move little.
START = 1e-5
#: Words are read in pieces of so many characters at most, and texts in blocks of about so many.
PIECE = 1000
BLOCK = 1 << 16

_PRIME = np.uint32(0x9E3779B1)
_POWERS = np.cumprod(np.full(PIECE + 2, _PRIME), dtype=np.uint32)


def _words(text: str) -> Iterator[str]:
    """Words of a whole text in lower case, without signs at their edges; very long ones in pieces."""
    for word in text.lower().split():
        bare = word.strip(".,;:!?\"'()[]{}<>*_-") or word
        if len(bare) <= PIECE:
            yield bare
        else:
            yield from (bare[i : i + PIECE] for i in range(0, len(bare), PIECE))


def _blocks(text: str) -> Iterator[list[str]]:
    block, size = [], 0
    for word in _words(text):
        block.append(word)
        size += len(word) + 1
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _mixed(x: np.ndarray) -> np.ndarray:
    return (((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int64)


def subword_cells(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each block of a whole text: the cells of all its subwords, the number of the word (in the block) each is from, and the number of words."""
    for block in _blocks(text or ""):
        points = np.frombuffer((" " + " ".join(block) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        gap = points == 32
        word = np.cumsum(gap) - 1
        cells, of = [], []
        grams, inside = points[:-1] * _PRIME + points[1:], None
        for size in range(3, max(SIZES) + 1):  # each n-gram is the one before it and a character; no gap stands inside it
            n = max(0, len(points) - size + 1)
            grams = grams[:n] * _PRIME + points[size - 1 :]
            inside = ~gap[1 : n + 1] if inside is None else inside[:n] & ~gap[size - 2 : size - 2 + n]
            if size in SIZES:
                cells.append(_mixed(grams[inside]))
                of.append(word[1 : n + 1][inside])
        starts = np.flatnonzero(gap)[:-1]
        place = np.arange(len(points) - 1) - starts[word[:-1]]
        cells.append(_mixed(np.add.reduceat((points[:-1] + np.uint32(7)) * _POWERS[place], starts, dtype=np.uint32)))
        of.append(np.arange(len(starts)))
        yield np.concatenate(cells), np.concatenate(of), len(starts)


def text_cells(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a text and their weights: each word is the mean of its subwords, the text the mean of its words."""
    total, n = np.zeros(CELLS), 0
    for cells, of, words in subword_cells(text):
        total += np.bincount(cells, 1 / np.bincount(of, minlength=words)[of], minlength=CELLS)
        n += words
    found = np.flatnonzero(total)
    return found.astype(np.uint16), (total[found] / max(1, n)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """
    What a trained model says of each cell: the difference of the two classes' margins, and that of a text without words.

    The softmax is linear in the mean, so the embeddings (`vectors`) and its weights are needed only through their product.
    """

    cells: np.ndarray
    offset: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for cells, of, words in subword_cells(text):
            total += float((np.bincount(of, self.cells[cells], words) / np.bincount(of, minlength=words)).sum())
            n += words
        return float(1 / (1 + np.exp(-np.clip(self.offset + total / max(1, n), -40, 40))))


def train(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """
    Embeddings and softmax fitted together by Adagrad on texts given as (cells, weights) and labels 0 or 1.

    `prior` are the log-odds of label 1 among all labelled rows; those of the texts given (which may hold as many of both classes)
    are replaced by it. Without texts of both classes the model is the prior.
    """
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(CELLS), prior)
    draw = np.random.default_rng(seed)
    table = np.zeros((CELLS, width), np.float32)  # a cell that the fit never meets says nothing
    out, bias = draw.normal(0, 0.5, (width, 2)).astype(np.float32), np.zeros(2, np.float32)
    squares = [np.full_like(x, START) for x in (table, out, bias)]
    epochs = max(epochs, -(-STEPS * BATCH // len(y)))
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for turn in range(epochs):
        order = draw.permutation(len(y))
        step = rate * (1 - turn / epochs)
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            rows = rows[[len(texts[i][0]) > 0 for i in rows]]
            if not len(rows):
                continue
            lengths = np.array([len(texts[i][0]) for i in rows])
            cells = np.concatenate([texts[i][0] for i in rows]).astype(np.int64)
            weights = np.concatenate([texts[i][1] for i in rows])[:, None]
            mean = np.add.reduceat(table[cells] * weights, np.cumsum(lengths) - lengths)
            margin = mean @ out + bias
            margin -= margin.max(axis=1, keepdims=True)
            p = np.exp(margin)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows].astype(int)] -= 1
            p *= share[rows][:, None]
            into = (p @ out.T)
            grads = np.repeat(into, lengths, axis=0) * weights
            by_cell = np.argsort(cells, kind="stable")
            each, first = np.unique(cells[by_cell], return_index=True)
            summed = np.add.reduceat(grads[by_cell], first)
            squares[0][each] += summed**2
            table[each] -= step * summed / np.sqrt(squares[0][each])
            for x, g, s in ((out, mean.T @ p, squares[1]), (bias, p.sum(axis=0), squares[2])):
                s += g**2
                x -= step * g / np.sqrt(s)
    apart = out[:, 1] - out[:, 0]
    return Model((table @ apart).astype(np.float64), float(bias[1] - bias[0]) + prior)


def fit_toxicity(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """
    A model from documents (doc_id, text) and labels (doc_id, toxic).

    Rows without id or label are left out; of several labels of a document the mean decides, and a tie counts as toxic. Of several rows
    with an id one counts, chosen by what it holds. Of each class the `labelled_rows` ids that hash lowest are looked at, whatever the
    size of the tables; the share of toxic ones is counted over all. Without labelled documents every text scores 0.5.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("y"))
    ids = known.join(docs.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_semi")
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.zeros(CELLS), 0.0)
    prior = float(np.log((counts.get(True, 0) + 1) / (counts.get(False, 0) + 1)))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = ids.where("y").orderBy(*order).limit(labelled_rows).unionByName(ids.where("NOT y").orderBy(*order).limit(labelled_rows))
    # Twice `labelled_rows` ids at most, so they may be sent to every task. Copies of an id are one row before anything moves.
    single = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def row(text: str | None) -> tuple[bytes, bytes]:
        return tuple(x.tobytes() for x in text_cells(text))

    rows = map_rows(single, ["text"], row, "cells binary, weights binary", ["doc_id", "y"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    texts = [(np.frombuffer(r["cells"], np.uint16), np.frombuffer(r["weights"], np.float32)) for r in rows]
    return train(texts, np.array([float(r["y"]) for r in rows]), prior)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """
    (id, score) for every row of `docs`, from its whole text alone: the probability that it is toxic.

    Null texts and texts without words have the score of the softmax's constant; repeated rows are scored alike, an empty table gives an empty one.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(named, ["text"], lambda text: (model.score(text),), "score double", ["id"])
