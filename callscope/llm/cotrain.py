"""Document quality by co-training: a classifier of the text and one of the page's metadata teach each other, then score all documents together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import ROWS, to_arrow

#: Bounds of the fit: so many labelled rows, and as many unlabelled ones, are looked at (those whose ids hash lowest), and their features come to the driver.
LABELLED_ROWS = 6000
UNLABELLED_ROWS = 6000
ROUNDS = 4
#: Share of the unlabelled rows that each view labels for the other in a round, at most, and the probability it must be sure of.
SHARE = 0.1
SURE = 0.95
#: Documents below this probability of good quality are rejected.
THRESHOLD = 0.5
PAIR_CELLS = 256
NAME_CELLS = 64
LETTERS = np.zeros(256, np.int8)  # classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 punctuation, 6 beyond ASCII
for _class, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), (32, 9, 10, 11, 12, 13), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], range(128, 256)], 1):
    LETTERS[list(_bytes)] = _class
#: Cell of each pair of bytes, by a multiplicative hash.
PAIRS = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(PAIR_CELLS)).astype(np.int16)


def text_features(text: str | None) -> np.ndarray:
    """Content view: what the words and characters are and how they repeat, over the whole text. A null text is an empty one."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = (text or "").lower().split()
    n, out = len(words), np.zeros(PAIR_CELLS + 8, np.float32)
    if len(data) > 1:
        pairs = PAIRS[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        out[:PAIR_CELLS] = np.sqrt(np.bincount(pairs, minlength=PAIR_CELLS) / len(pairs))
    if n:
        runs = max(1, n - 2)
        out[PAIR_CELLS:] = (
            len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            len(set(zip(words, words[1:], words[2:]))) / runs if n > 2 else 1.0,
            sum(map(len, words)) / n / 10,
            min(1.0, max(map(len, words)) / 40),
            len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0,
            1.0 / n,
            n == 1,
        )
    return out


def _name_cell(value: str | None) -> int:
    h = 2166136261
    for b in ("\0" if value is None else value).encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % NAME_CELLS


def page_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Metadata view: where a page comes from, and its measures (length, lines, shares of letter cases, digits, signs), but none of its words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    classes = np.bincount(LETTERS[data], minlength=7) / n
    lines = (text or "").split("\n")
    filled = [len(x) for x in lines if x.strip()]
    out = np.zeros(2 * NAME_CELLS + 24 + 16, np.float32)
    out[_name_cell(source)] = 1
    out[NAME_CELLS + _name_cell(lang)] = 1
    out[2 * NAME_CELLS + min(23, len(data).bit_length())] = 1
    rest = out[2 * NAME_CELLS + 24 :]
    rest[:7] = classes
    rest[7:14] = np.sqrt(classes)
    rest[14] = np.log1p(len(filled)) / 5
    rest[15] = np.log1p(sum(filled) / max(1, len(filled))) / 8
    return out


# --- one linear classifier with calibrated probabilities -------------------------------------------------------------


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 8) -> np.ndarray:
    """Weights, the last one the constant, by Newton's method; `y` between 0 and 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _probability(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass(frozen=True)
class View:
    """Scaled features, weights, and the line that turns the margin into log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.margin(x) + self.offset


def _fit_view(x: np.ndarray, y: np.ndarray, held: np.ndarray, held_y: np.ndarray, ridge: float) -> View:
    """Fit on (x, y), calibrate on labelled rows that were not fitted."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    weights = _fit_logistic((x - mean) / scale, y, ridge)
    raw = View(mean, scale, weights, 1.0, 0.0)
    # Platt's targets keep the line finite where the held rows are separated.
    good, bad = held_y.sum(), len(held_y) - held_y.sum()
    slope, offset = _fit_logistic(raw.margin(held)[:, None], np.where(held_y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2)), 1e-3)
    return View(mean, scale, weights, max(float(slope), 0.0), float(offset))


@dataclass(frozen=True)
class Model:
    """Both views and the log-odds of good quality among the labelled rows; no views if there was nothing to learn from."""

    text: View | None
    page: View | None
    prior: float

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by the text, by the page, and by both as two independent witnesses."""
        if self.text is None or self.page is None:
            same = np.full(len(text), float(_probability(np.array(self.prior))))
            return same, same, same
        a, b = self.text.log_odds(text), self.page.log_odds(page)
        return _probability(a), _probability(b), _probability(a + b - self.prior)


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, more_text: np.ndarray, more_page: np.ndarray, rounds: int = ROUNDS, ridge: float = 20.0) -> Model:
    """
    Fit both views on labelled rows (in an order that says nothing about them); every fourth is kept for calibration.

    In each round a view labels the unlabelled rows it is most sure of (SURE, and at most SHARE of them in each class's share) for the
    other view, which learns from them with half the weight of its own. Without rows of both classes in both parts, the model is the prior.
    """
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    held = np.arange(len(y)) % 4 == 3
    if any(len(set(part.tolist())) < 2 for part in (y[held], y[~held])):
        return Model(None, None, prior)
    views = {"text": (text, more_text), "page": (page, more_page)}
    given: dict[str, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros(0, np.int64), np.zeros(0)) for k in views}
    fitted: dict[str, View] = {}
    for turn in range(rounds + 1):
        for name, (x, more) in views.items():
            rows, labels = given[name]
            # A pseudo-label of 0.5 +- 0.25 pulls half as hard as a label.
            fitted[name] = _fit_view(np.vstack([x[~held], more[rows]]), np.concatenate([y[~held], 0.25 + 0.5 * labels]), x[held], y[held], ridge)
        if turn == rounds or not len(more_text):
            break
        for name, other in (("text", "page"), ("page", "text")):
            p = _probability(fitted[name].log_odds(views[name][1]))
            most = max(1, int(SHARE * len(p) * (turn + 1) / rounds))
            chosen = []
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                share = max(1, int(most * (y.mean() if label else 1 - y.mean())))
                best = np.argsort(-sure, kind="stable")[:share]
                chosen.append((best[sure[best] >= SURE], label))
            given[other] = (np.concatenate([c for c, _ in chosen]), np.concatenate([np.full(len(c), label) for c, label in chosen]))
    return Model(fitted["text"], fitted["page"], prior)


# --- tables -----------------------------------------------------------------------------------------------------------


def _features(docs: DataFrame) -> DataFrame:
    """
    y, `text_view` and `page_view` (binary, 32-bit numbers), one row for each doc_id of rows (doc_id, text, lang, source, y, mark): that of the lowest mark.

    A task hands on one row for each id, and makes features only of rows with a lower mark than those before, so copies of a row cost it nothing.
    """
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark bigint, y double, text_view binary, page_view binary"
    schema = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for batch in batches:
            ids, marks, y, *columns = (batch.column(c) for c in ("doc_id", "mark", "y", "text", "lang", "source"))
            for i, (name, mark) in enumerate(zip(ids.to_pylist(), marks.to_pylist())):
                if name not in least or mark < least[name][0]:
                    row = [c[i].as_py() for c in columns]
                    least[name] = (mark, y[i].as_py(), text_features(row[0]).tobytes(), page_features(*row).tobytes())
        columns = [list(least), *(zip(*least.values()) if least else [[]] * 4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    each = docs.select("doc_id", "text", "lang", "source", "y", "mark").mapInArrow(run, fields)
    return each.groupBy("doc_id").agg(F.min_by(F.struct("y", "text_view", "page_view"), "mark").alias("row")).select("row.*")


def _lowest(ids: DataFrame, rows: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _matrix(rows: list, column: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r[column]) for r in rows), np.float32).reshape(-1, width)


def fit_quality(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, rounds: int = ROUNDS) -> Model:
    """
    A model from documents (doc_id, text, lang, source) and labels (doc_id, quality).

    Rows without id or label are left out; of several labels of a document the mean decides, and a tie counts as good. Of several
    rows with an id one counts, chosen by what it holds. The bounds say how many rows the fit looks at, whatever the size of the tables.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    )
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    picked = _lowest(ids.join(known, "doc_id").distinct(), labelled_rows)
    spare = _lowest(ids.join(known, "doc_id", "left_anti").distinct(), unlabelled_rows).withColumn("y", F.lit(None).cast("double"))
    # Both lists are bounded by the two parameters, so they may be sent to every task.
    wanted = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(picked.unionByName(spare)), "doc_id")
    rows = _features(wanted.withColumn("mark", F.xxhash64("text", "lang", "source"))).collect()
    # The order of arrival is chance; the features themselves give one that reruns share.
    rows.sort(key=lambda r: (bytes(r["text_view"]), bytes(r["page_view"]), r["y"] is None, r["y"] or 0))
    shuffled = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    have, lack = [r for r in shuffled if r["y"] is not None], [r for r in shuffled if r["y"] is None]
    if not have:
        return Model(None, None, 0.0)
    wide, narrow = len(text_features("")), len(page_features("", None, None))
    return co_train(
        _matrix(have, "text_view", wide), _matrix(have, "page_view", narrow), np.array([r["y"] for r in have]),
        _matrix(lack, "text_view", wide), _matrix(lack, "page_view", narrow), rounds,
    )


def _scores(model: Model, text: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """The three scores of each row of a batch; texts leave the batch one at a time, and features are held of ROWS rows."""
    scores = np.zeros((3, len(text)))
    for start in range(0, len(text), ROWS):
        rows = [(text[i].as_py(), lang[i].as_py(), source[i].as_py()) for i in range(start, min(start + ROWS, len(text)))]
        content, page = np.stack([text_features(r[0]) for r in rows]), np.stack([page_features(*r) for r in rows])
        scores[:, start : start + len(rows)] = model.score(content, page)
    return scores


SCORES = "text_score double, page_score double, quality_score double"


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """
    doc_id with text_score, page_score, quality_score (probabilities of good quality) and kept, for every row of `docs`.

    Null texts are scored as empty ones; null languages and sources are values like others. Where there was nothing to learn from, all rows have the prior's score and are kept.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    target = to_arrow(f"doc_id {kind}, {SCORES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(model, *(batch.column(c) for c in ("text", "lang", "source")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(target.field(0).type), *map(pa.array, scores)], schema=target)

    found = docs.select("doc_id", "text", "lang", "source").mapInArrow(run, f"doc_id {kind}, {SCORES}")
    return found.withColumn("kept", F.lit(model.text is None) | (F.col("quality_score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """
    The rows of `docs` that the classifier, fitted on `labels`, doesn't reject; columns and rows as they are, whatever the columns' names.

    Only text, lang and source go to Python and only scores come back, to the rows that wait in the JVM: no join brings texts and scores together.
    Null texts are scored as empty ones. Where there was nothing to learn from, and in an empty table, all rows stay.
    """
    model = fit_quality(docs, labels)
    if model.text is None:
        return docs

    @F.arrow_udf("boolean")
    def good(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        return pa.array(_scores(model, text, lang, source)[2] >= threshold)

    return docs.where(good("text", "lang", "source"))
