"""Language identification by rank-order profiles of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.batches import map_rows, to_arrow

#: N-grams of one to three letters and word edges fall into so many cells by a hash.
CELLS = 1 << 16
#: Length of a profile.
PROFILE = 400
UNKNOWN = "und"
#: Languages a task counts at once before it hands on what it has.
HELD = 64


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_cells(text: str | None) -> np.ndarray:
    """The cell of every n-gram of a whole text, repeats included: lower case, everything that is no letter is a gap, gaps stand at both ends of words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.zeros(len(points) + 2, np.uint32)
    kept[1:-1] = np.where(_letters()[points], points, 0)
    kept = kept[np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0)])]
    if not kept.any():
        return np.zeros(0, np.int64)
    x = kept.astype(np.uint64)
    one = x[x != 0] * np.uint64(0x9E3779B97F4A7C15)
    two = (x[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[1:] * np.uint64(0x9E3779B97F4A7C15))
    three = (x[:-2] * np.uint64(0x165667B19E3779F9)) ^ two[1:]
    grams = np.concatenate([one, two * np.uint64(0xFF51AFD7ED558CCD), three * np.uint64(0xC4CEB9FE1A85EC53)])
    return ((grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


def ranked_cells(text: str | None, length: int = PROFILE) -> np.ndarray:
    """The text's most frequent cells, most frequent first, ties by cell."""
    counts = np.bincount(ngram_cells(text), minlength=1)
    cells = np.flatnonzero(counts)
    return cells[np.argsort(-counts[cells], kind="stable")[:length]]


@dataclass(frozen=True)
class Profiles:
    """Languages in order of their names, and for each the rank of every cell (`length` for those outside its profile)."""

    names: tuple[str, ...]
    ranks: np.ndarray
    length: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """
        The language whose profile is nearest by out-of-place distance (of equals, the first name), and 1 - distance / greatest possible distance.

        A null text, one without letters, or profiles without languages give UNKNOWN and 0.
        """
        cells = ranked_cells(text, self.length)
        if not len(cells) or not self.names:
            return UNKNOWN, 0.0
        apart = np.abs(self.ranks[:, cells] - np.arange(len(cells))).sum(axis=1)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (len(cells) * self.length))


def count_cells(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, cell, n) over all rows with text and language: each task adds up what it has read, Spark adds up the tasks."""
    schema = to_arrow("lang string, cell int, n bigint")

    def rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(n[cells])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for i in range(batch.num_rows):
                lang = langs[i].as_py()
                if lang not in counts:
                    if len(counts) >= HELD:
                        yield from rows(counts)
                        counts = {}
                    counts[lang] = np.zeros(CELLS, np.int64)
                found = np.bincount(ngram_cells(texts[i].as_py()))
                counts[lang][: len(found)] += found
        yield from rows(counts)

    named = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return named.mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = PROFILE) -> Profiles:
    """Profiles from all rows that have text and language; `length` rows for each language come to the driver."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "cell")
    top = count_cells(docs, text_col, lang_col).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < length).select("lang", "cell", "rank")
    rows = top.collect()
    names = tuple(sorted({r["lang"] for r in rows}))
    ranks = np.full((len(names), CELLS), length, np.int32)
    for r in rows:
        ranks[names.index(r["lang"]), r["cell"]] = r["rank"]
    return Profiles(names, ranks, length)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of `docs`, from its text alone; repeated rows are predicted alike."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(named, ["text"], profiles.predict, "lang_pred string, score double", ["id"])
