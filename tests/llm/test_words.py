"""Toxicity, spelling variants and ranked search on odd tables, against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import queries as corpus
from callscope.llm import ranked, spelling, toxicity
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


# --- toxicity


def test_subwords_of_whole_texts():
    cells, weights = toxicity.text_cells("Some words, some WORDS")
    assert cells.dtype == np.uint16 and abs(weights.sum() - 1) < 1e-5
    again = toxicity.text_cells("some words some words " * 20000)
    assert set(again[0]) == set(cells) and np.allclose(again[1], weights, atol=1e-5)
    # A misspelt word shares most n-grams of the word, another word none.
    near, other = ({*toxicity.text_cells(w)[0].tolist()} for w in ("worthlessly", "banana"))
    own = {*toxicity.text_cells("worthless")[0].tolist()}
    assert len(own & near) >= 0.7 * len(own) and len(own & other) <= 1
    assert len(toxicity.text_cells(None)[0]) == len(toxicity.text_cells(" \n ")[0]) == 0
    assert len(toxicity.text_cells("x" * 3_000_000)[0]) < 50


def plain_cells(text):
    """N-grams and whole words by slices, in the operator's hash."""
    total, words = Counter(), list(toxicity._words(text or ""))
    for word in words:
        points = [32, *map(ord, word), 32]
        cells = []
        for size in (3, 4, 5):
            for i in range(len(points) - size + 1):
                h = 0
                for p in points[i : i + size]:
                    h = (h * 0x9E3779B1 + p) % 2**32
                cells.append(h)
        h = 0
        for k, p in enumerate(points[:-1], 1):
            h = (h + (p + 7) * pow(0x9E3779B1, k, 2**32)) % 2**32
        cells.append(h)
        for h in cells:
            total[((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 16] += 1 / len(cells)
    return {c: v / len(words) for c, v in total.items()}


def test_cells_are_those_of_a_plain_loop(odd_texts):
    for text in odd_texts:
        if text is None or len(text) < 3000:
            cells, weights = toxicity.text_cells(text)
            want = plain_cells(text)
            assert dict(zip(cells.tolist(), weights.tolist())) == pytest.approx(want, abs=1e-6)


def test_model_score_is_the_softmax_of_the_mean(odd_texts):
    draw = np.random.default_rng(5)
    model = toxicity.Model(draw.normal(size=toxicity.CELLS), -0.3)
    for text in odd_texts:
        cells, weights = toxicity.text_cells(text)
        margin = -0.3 + float((model.cells[cells] * weights).sum())
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-4)


def test_toxicity_learns_spellings_it_never_saw(spark, odd_docs, no_docs):
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = prose(draw, 60).split()
        if i % 4 == 0:
            for _ in range(3):
                words[draw.randrange(60)] = draw.choice(["scoundrel", "scoundrels", "scoundrelly"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows * 2, odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    for _ in range(20):  # an unseen spelling of a toxic word lifts a text, an unseen clean word doesn't
        clean = prose(draw, 57)
        lifted, same = (model.score(f"{clean} {w} {w} {w}") for w in (draw.choice(["scoundrelz", "scoundre1s", "xscoundrel"]), "fdjgabc"))
        assert lifted > 0.5 > same or lifted > 3 * same
    scored = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    empty = {r["score"] for r in scored if r["id"] in (0, 1, 2)}
    assert len(empty) == 1 and toxicity.score_toxicity(no_docs, model).count() == 0
    # Nothing to learn from, or one class only.
    assert toxicity.fit_toxicity(no_docs, known).score("any") == 0.5
    assert toxicity.fit_toxicity(docs, known.where("toxic = 0")).score("any") < 0.5
    assert toxicity.fit_toxicity(docs, known).offset == model.offset and (toxicity.fit_toxicity(docs, known).cells == model.cells).all()


def test_op11(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in corpus.op11_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert len(found) == docs.count()
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [found[d] for d in toxic if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for d, r in found.items())
    bad, good = ([r["score"] for r in held if toxic[r["doc_id"]] == k] for k in (1, 0))
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert above >= 0.88


# --- spelling variants


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def plain_forms(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return out


def rows_of(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_words_of_odd_documents(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()] * 1
    want = plain_words(rows * 3)
    thrice = odd_docs.unionByName(odd_docs).unionByName(odd_docs)
    assert {r["word"]: r["n"] for r in spelling.count_words(thrice).collect()} == want
    assert rows_of(spelling.spelling_variants(thrice)) == plain_forms(want)
    assert spelling.spelling_variants(no_docs).count() == 0


@pytest.mark.parametrize("chunk_pairs", [0, 3, 4096])
def test_near_words_whatever_is_crowded(spark, chunk_pairs):
    draw = random.Random(11)
    words = {"".join(draw.choices("abé", k=draw.randrange(1, 8))) for _ in range(400)} | {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499, ""}
    words |= {"prefix" + "".join(draw.choices("abcdefghij", k=6)) for _ in range(300)} | {"prefixabcdef", "prefixabcdeg", "prefixbcdef"}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = spelling.near_words(table, chunk_pairs).collect()
    listed = sorted(words)
    want = {(a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if one_edit(a, b)}
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want


def test_forms_lead_to_roots(spark):
    # Chains of forms, ties by code point, and a word whose near word isn't frequent enough.
    words = {"aaaaa": 100, "aaaab": 40, "aaabb": 20, "aabbb": 10, "abbbb": 5, "zzzzz": 7, "zzzzy": 6, "qqqqq": 1, "qqqqa": 9, "qqqqb": 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.word_forms(table)) == plain_forms(words)


# --- ranked search


def plain_search(rows, items, results=50):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    docs = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in rows) if t]
    total, df = sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in docs:
            m = 50 + 50 * n * len(docs) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:results], 1)]
    return sorted(out, key=str)


def found_by(index, items, results=50):
    return sorted(((r["item"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(index, items, results=results).collect()), key=str)


def test_search_of_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(ranked, "ITEMS", 4)  # several blocks of items
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "abc a b c"), (2, None), (3, "ÄÖÜ ßtraße İstanbul nothing"), (4, "line other"), (5, " "), (6, rows[6][1]), (6, rows[6][1]), (None, "a B c 1 2"), (7, "zzzzzz")]
    table = spark.createDataFrame(items, "item_id long, text string")
    index = ranked.build_index(odd_docs)
    assert found_by(index, table) == plain_search(rows, items)
    assert found_by(index, table, 3) == plain_search(rows, items, 3)
    assert ranked.search(ranked.build_index(no_docs), table).count() == 0 == ranked.search(index, table.limit(0)).count()


@pytest.mark.parametrize("docs_of_segment, block", [(7, 4), (64, 16), (2048, 256)])
def test_search_skips_nothing_that_counts(spark, docs_of_segment, block):
    """Many documents over frequent and rare terms, segments and blocks of all sizes, results far fewer than matches."""
    draw = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    shares = [1 / (1 + i) for i in range(60)]
    rows = [(i // 2, " ".join(draw.choices(vocabulary, shares, k=draw.choice([1, 3, 10, 40, 200])))) for i in range(500)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 5, 20])))) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table, index = spark.createDataFrame(items, "item_id long, text string"), ranked.build_index(docs, segment_docs=docs_of_segment)
    found = ranked.search(index, table, results=5, docs_of_block=block).collect()
    assert sorted(((r["item"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str) == plain_search(rows, items, 5)


def test_bounds_hold_and_blocks_are_skipped():
    """A floor above a block's bound leaves it unread; every score stays below its bounds."""
    n = 1024
    docs = np.arange(n, dtype=np.int32)
    tfs = np.where(docs < 256, 50, 1).astype(np.int32)
    row = {
        "ids": list(range(n)), "lengths": np.full(n, 60, np.int64).tobytes(), "at": {"a": 0}, "ends": np.array([n], np.int64).tobytes(),
        "docs": docs.tobytes(), "tfs": tfs.tobytes(),
    }
    segment = ranked.SegmentSearch(row, n, 60 * n)
    looked = []
    inner = segment._block
    segment._block = lambda *a: (looked.append(a[3]), inner(*a))[1]
    found, scores = segment.best({"a": 10}, 0, 50)
    assert looked == [0] and len(found) == 256 and scores.min() == scores.max() == ranked.term_score(10, np.array([50]), np.array([100]))[0]


def test_long_lengths_stay_exact():
    lengths = np.array([1, 10**7, 3 * 10**9], np.int64)
    want = [50 + 50 * int(x) * 10**11 // (7 * 10**12) for x in lengths]
    assert ranked.length_measure(lengths, 10**11, 7 * 10**12).tolist() == want
