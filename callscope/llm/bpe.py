"""Byte-pair encoding with word ends: a backtracking encoder over longest matches, and a decoder with a table of offsets."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import map_rows

#: Words, and pairs of tokens, whose outcome a worker remembers of late.
CACHE_WORDS = 200_000
#: What this encoder stands for: other tokenizer files are refused.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: Letters and numbers of Unicode versions later than the tokenizers' tables (16), which they take for signs.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def cutters(pattern: str) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """The word pattern for usual text, a search for LATER, and the word pattern for text with some of these."""
    later = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER) + "]"
    careful = pattern
    for kind in (r"\p{L}", r"\p{N}"):
        careful = careful.replace(kind, f"[{kind}--{later}]")
    return regex.compile(pattern), regex.compile(later), regex.compile(careful, regex.V1)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary's strings: itself if printable, else a letter from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class OffsetTable:
    """Strings laid end to end, with the offset of each: a row of ids becomes text by one gather."""

    def __init__(self, strings: list[bytes], between: bytes):
        self.lengths = np.array([len(s) + len(between) for s in strings], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.data = np.frombuffer(b"".join(s + between for s in strings), np.uint8)
        self.between = len(between)

    def join(self, ids: np.ndarray) -> bytes:
        """The strings of `ids`, with `between` between them."""
        parts = []
        for start in range(0, len(ids), 1 << 16):
            part = ids[start : start + (1 << 16)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(self.offsets[part] - (ends - lengths), lengths)
            parts.append(self.data[at].tobytes())
        joined = b"".join(parts)
        return joined[: len(joined) - self.between] if joined else joined


class _Known(dict):
    """What `make` gave for the keys seen of late: those of the last `most` and up to as many before them."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


@dataclass
class Encoder:
    """
    An exact encoder for one vocabulary.

    A word is a row of symbols: its bytes, the last one marked as a word's end. Candidates for a position are the longest token that
    the automaton of all tokens matches there, and that one's shorter prefixes. Two neighbours may stand together only if merging them in rank order would leave them so (`compatible`);
    if no candidate fits, the last token is taken back. A position that led nowhere is not entered again, so the work is linear.
    """

    vocabulary: list[str]
    special: dict[str, int]
    patterns: tuple[regex.Pattern, regex.Pattern, regex.Pattern]
    rank: dict[tuple[int, int], int]
    parts: dict[int, tuple[int, int]]
    born: list[float]
    symbols: list[str]
    shorter: list[int]
    matcher: ahocorasick.Automaton
    text_table: OffsetTable
    number_table: OffsetTable
    sizes: list[int] = field(init=False)
    ends: dict[str, int] = field(init=False)
    most: int = field(init=False)
    paths: dict[str, int] = field(default_factory=dict)
    words: _Known = field(init=False)
    fits: _Known = field(init=False)

    def __post_init__(self):
        self.sizes = [len(s) for s in self.symbols]
        self.most = max(self.sizes)
        self.ends = {chr(ord(s) - 256): i for i, s in enumerate(self.symbols) if len(s) == 1 and ord(s) >= 256}
        self.words = _Known(lambda chunk: tuple(self.encode_chunk(chunk)), CACHE_WORDS)
        self.fits = _Known(lambda pair: self._walk(*pair) == np.inf, CACHE_WORDS)
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    # -- which neighbours may stand together

    def _walk(self, left: int, right: int) -> float:
        """
        When the pair's edge is first merged across, in ranks: infinity if never, and -1 if that happens before both tokens are whole.

        Along the edge stand the last parts of `left` and the first parts of `right`, from single symbols up to the tokens; each
        becomes the next at that one's rank. They merge across as soon as their own rank comes before both of these; on a tie, the leftmost merge is done first.
        """
        ends, starts = [left], [right]
        while ends[-1] in self.parts:
            ends.append(self.parts[ends[-1]][1])
        while starts[-1] in self.parts:
            starts.append(self.parts[starts[-1]][0])
        i, j = len(ends) - 1, len(starts) - 1
        while True:
            across = self.rank.get((ends[i], starts[j]), np.inf)
            grows = self.born[ends[i - 1]] if i else np.inf
            follows = self.born[starts[j - 1]] if j else np.inf
            if not i and not j:
                return across
            if across < grows and across <= follows:
                return -1
            if grows <= follows:
                i -= 1
            else:
                j -= 1

    def compatible(self, left: int, right: int) -> bool:
        return self.fits[left, right]

    # -- encoding

    def encode_symbols(self, word: str) -> list[int]:
        """Tokens of one word given as symbols."""
        sizes, shorter, fits, reach, paths, most = self.sizes, self.shorter, self.fits, self.matcher.longest_prefix, self.paths, self.most
        out: list[int] = []
        dead: set[int] = set()
        rest = word[:most]
        at, last, token = 0, -1, paths[rest[: reach(rest)]]
        while at < len(word):
            while token >= 0:
                end = at + sizes[token]
                if end not in dead and (last < 0 or fits[last, token]):
                    out.append(token)
                    rest = word[end : end + most]
                    at, last, token = end, token, paths[rest[: reach(rest)]]
                    break
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Tokens of a normalised text without white space: the pattern cuts it into words."""
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0250"):  # the usual case: one word, of letters before all of LATER
            data = chunk.encode().decode("latin-1")
            return self.encode_symbols(data[:-1] + chr(256 + ord(data[-1])))
        usual, later, careful = self.patterns
        out: list[int] = []
        for word in (usual if chunk.isascii() or not later.search(chunk) else careful).findall(chunk):
            data = word.encode("utf-8", "surrogatepass").decode("latin-1")
            out += self.encode_symbols(data[:-1] + chr(256 + ord(data[-1]))) if len(data) > 1 else [self.ends[data]]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null is empty. Special tokens' strings in the text become those tokens, as in the library."""
        rows = []
        text = text or ""
        for part in self.splitter.split(text) if self.splitter and any(s in text for s in self.special) else [text]:
            if part in self.special:
                rows.append(np.array([self.special[part]], np.int64))
                continue
            # Lower case goes letter by letter: a sigma at the end of a word is none of its own.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            # These four are white space to str.split, but not to the pattern.
            chunks = [plain] if any(c in plain for c in "\x1c\x1d\x1e\x1f") else plain.split()
            find = self.encode_chunk if len(chunks) == 1 and len(plain) > 1000 else self.words.__getitem__
            rows.append(np.fromiter(chain.from_iterable(map(find, chunks)), np.int64))
        return rows[0] if len(rows) == 1 else np.concatenate(rows)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings with a space between them, in UTF-8: what the library gives for a file without a decoder."""
        return self.text_table.join(ids)

    def numbers(self, ids: np.ndarray) -> bytes:
        """Decimal ids with a space between them."""
        return self.number_table.join(ids)


@lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file (JSON): byte-level BPE with word ends, and without a decoder; other kinds raise ValueError."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    if kinds != NORMALIZERS or model["end_of_word_suffix"] != "</w>" or spec["decoder"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or any(t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} is not a byte-level vocabulary with word ends")
    vocabulary = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = 1 + max(max(vocabulary.values()), max(special.values(), default=0))
    names, symbols = [""] * size, [""] * size
    for name, i in chain(vocabulary.items(), special.items()):
        names[i] = name
    for b, letter in enumerate(byte_letters()):
        symbols[vocabulary[letter]], symbols[vocabulary[letter + "</w>"]] = chr(b), chr(256 + b)
    rank: dict[tuple[int, int], int] = {}
    parts: dict[int, tuple[int, int]] = {}
    born: list[float] = [-1] * size
    for n, merge in enumerate(model["merges"]):
        left, right = (vocabulary[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
        whole = vocabulary[names[left] + names[right]]
        rank.setdefault((left, right), n)
        if whole not in parts:
            parts[whole], born[whole], symbols[whole] = (left, right), n, symbols[left] + symbols[right]
    encoder = Encoder(
        names, special, cutters(pre[0]["pattern"]["Regex"]), rank, parts, born, symbols, [-1] * size, ahocorasick.Automaton(),
        OffsetTable([n.encode() for n in names], b" "), OffsetTable([str(i).encode() for i in range(size)], b" "),
    )
    # A token that merging never builds out of its own symbols is never a match.
    real = {i for i in range(size) if symbols[i] and i not in parts}
    for whole, (left, right) in parts.items():
        if left in real and right in real and encoder._walk(left, right) == born[whole]:
            real.add(whole)
    by_symbols = {symbols[i]: i for i in real}
    encoder.paths[""] = -1
    for text in sorted(by_symbols, key=len):
        encoder.matcher.add_word(text, by_symbols[text])
        before = -1
        for k in range(1, len(text)):  # every path of the automaton, with the longest token on it
            before = encoder.paths.setdefault(text[:k], before)
        encoder.shorter[by_symbols[text]] = before
        encoder.paths[text] = by_symbols[text]
    encoder.matcher.make_automaton()
    return encoder


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, columns of `keep`, ids array<int>) for every row: whole texts, null as empty, repeated rows each; the file at `path` must be on every machine."""
    named = docs.select(F.col(id_col).alias("id"), *(keep or []), F.col(text_col).alias("_text"))
    return map_rows(named, ["_text"], lambda text: (load_encoder(path).encode(text),), "ids array<int>", ["id", *(keep or [])])


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, and both digested where they are."""

    def row(text: str | None) -> tuple:
        encoder = load_encoder(path)
        ids = encoder.encode(text)
        return len(ids), hashlib.sha256(encoder.numbers(ids)).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(named, ["text"], row, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["id"])
