"""Secrets in texts: fixed patterns, and strings that look random to character Markov models."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import map_rows

KINDS = ("assign", "access", "hex", "random")
#: The word before the sign in letters of either case; spelled out, as the pattern's own switch would take in letters beyond ASCII.
_WORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]")
ASSIGN = re.compile(rf"(?:{_WORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What the models judge: unbroken strings of letters, digits and the signs of usual encodings.
LEAST_LENGTH = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")

#: Pieces of a string between the signs that paths and names are put together with.
UNBROKEN = re.compile(rf"[A-Za-z0-9+]{{{LEAST_LENGTH},}}")
#: One unbroken piece must be this long: paths and hyphened names are many short ones.
PIECES = re.compile(r"[A-Za-z0-9]{10,}")

#: Bounds of the training samples: documents whose ids hash lowest, and words taken from them.
SAMPLE_DOCS = 2000
SAMPLE_WORDS = 50_000
RANDOM_STRINGS = 4000
#: A string is reported if its log-likelihood ratio is at least this for each character, and it has this many characters and digits or both cases.
LEAST_PER_CHAR = 1.0
BACKOFF = 20.0
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_PLACE = np.full(128, len(SYMBOLS), np.int64)
_PLACE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


def _chain(text: str) -> np.ndarray:
    """Places of a string's symbols, with a mark for both ends and everything else."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inner = np.where(points < 128, _PLACE[np.minimum(points, 127)], len(SYMBOLS))
    return np.concatenate([[len(SYMBOLS)], inner, [len(SYMBOLS)]])


def transitions(strings: list[str]) -> np.ndarray:
    """
    Log-probabilities of a symbol after another. Symbols that a context has shown seldom or never go by how often they occur at all, as BACKOFF
    counts of the context's: so what ordinary strings hardly hold is unlikely anywhere in them.
    """
    size = len(SYMBOLS) + 1
    counts = np.zeros(size * size)
    if strings:
        codes = [_chain(s) for s in strings]
        counts += np.bincount(np.concatenate([c[:-1] * size + c[1:] for c in codes]), minlength=size * size)
    table = counts.reshape(size, size)
    single = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * size)
    return np.log((table + BACKOFF * single) / (table.sum(axis=1, keepdims=True) + BACKOFF))


def random_strings(n: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """Labelled samples of random strings, in the alphabets and lengths that keys come in."""
    draw = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return ["".join(draw.choices(alphabets[k % len(alphabets)], k=draw.randrange(20, 64))) for k in range(n)]


@dataclass(frozen=True)
class Models:
    """How much likelier, in log, a symbol follows another in random strings than in ordinary ones."""

    ratio: np.ndarray

    def score(self, text: str) -> float:
        """Log-likelihood ratio for each character."""
        codes = _chain(text)
        return float(self.ratio[codes[:-1], codes[1:]].sum() / (len(text) + 1))


def _mixed(text: str) -> bool:
    """Digits and letters, or both cases inside: a plain word in capitals, a number or a rule of signs is no key."""
    digits, upper, lower = (any(f(c) for c in text) for f in (str.isdigit, str.isupper, str.islower))
    return digits and (upper or lower) or any(a.islower() and b.isupper() for a, b in zip(text, text[1:]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind; matches that fail their test are not tried again."""
    found = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(w in lower for w in ASSIGN_HINTS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _random_strings_in(run: str, models: Models, least: float) -> list[tuple[int, int]]:
    """(start, end) of what looks random in a run: the run, or else those of its unbroken pieces that are long enough to be judged by themselves."""

    def random_(text: str) -> bool:
        return models.score(text) >= least and any(_mixed(p) for p in PIECES.findall(text))

    if random_(run):
        return [(0, len(run))]
    return [m.span() for m in UNBROKEN.finditer(run) if len(m[0]) < len(run) and random_(m[0])]


def _joined(spans: list[tuple[int, int, str]]) -> list[list[int]]:
    """Where spans lie: [start, end] of each stretch that some of them cover together, in order."""
    out: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def find_secrets(text: str | None, models: Models | None = None, least: float = LEAST_PER_CHAR) -> list[tuple[int, int, str]]:
    """
    (start, end, kind) in code points of all secrets of a whole text, by start, then in the order of KINDS; a null text has none.

    To the base spans the models add strings of 20 or more characters that overlap none of them, look random, and have a long piece that mixes digits and letters or cases.
    Where such a string is ordinary as a whole, like a path, its unbroken pieces of that length are judged alone.
    """
    text = text or ""
    found = base_spans(text)
    if models is not None:
        taken = _joined(found)
        i = 0  # strings come in order, so the spans before one are behind all later ones too
        for m in CANDIDATE.finditer(text):
            for start, end in _random_strings_in(m[0], models, least):
                start, end = m.start() + start, m.start() + end
                while i < len(taken) and taken[i][1] <= start:
                    i += 1
                if i == len(taken) or taken[i][0] >= end:
                    found.append((start, end, "random"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def train_models(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> Models:
    """
    Models of random and ordinary strings. Ordinary ones are labelled samples from `docs`: words outside every base span, too short to be judged themselves, of the
    `sample_docs` documents whose ids hash lowest, up to `words` words that hash lowest of theirs. Without documents, all strings of the random kind score high.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Ids are sorted without their texts; the list is bounded by the parameter, so it may be sent to every task.
    lowest = named.where("id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    picked = named.join(F.broadcast(lowest), "id")

    def ordinary(text: str | None) -> tuple[list[str]]:
        text = text or ""
        spans = base_spans(text)
        kept, at = [], 0
        for start, end, _ in sorted(spans):
            kept.append(text[at:start])
            at = max(at, end)
        kept.append(text[at:])
        return (sorted({w for w in " ".join(kept).split() if len(w) < LEAST_LENGTH}),)

    found = map_rows(picked, ["text"], ordinary, "words array<string>").select(F.explode("words").alias("word"))
    rows = found.distinct().orderBy(F.xxhash64("word"), "word").limit(words).collect()
    return Models(transitions(random_strings()) - transitions([r["word"] for r in rows]))


def secrets(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start,end,kind>>) for every row of `docs`; null texts have none, repeated rows have the same spans, an empty table gives an empty one."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def row(text: str | None) -> tuple:
        return ([{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(text, models)],)

    return map_rows(named, ["text"], row, "spans array<struct<`start`:bigint,`end`:bigint,kind:string>>", ["id"])
