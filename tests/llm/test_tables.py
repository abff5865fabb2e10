"""Operators on whole tables against plain versions."""

import io
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from callscope.llm import components, cotrain, mixing, simhash, vectors, warc
from tests.llm import brute
from tests.llm.conftest import prose


# --- groups -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(20, 60)] + [(3, 59)], [(5, 5), (None, 1), (7, 6), (7, 6)]])
def test_components(spark, links):
    whole = [(a, b) for a, b in links if a is not None and a != b]
    want = brute.groups({n for x in whole for n in x}, whole)
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == want and found.count() == len(want)


def test_components_any(spark):
    draw = random.Random(6)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    want = brute.groups({n for x in links if x[0] != x[1] for n in x}, links)
    assert {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()} == want


# --- SimHash ----------------------------------------------------------------------------------------------------------


def test_near_duplicates(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    prints = {}
    for r in rows:
        p = brute.simhash(r["text"])
        if r["doc_id"] is not None:
            prints[r["doc_id"]] = p
    want = brute.near_groups(prints)
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["id"] is None:
            assert r["component"] is None or r["component"] in want.values()
        else:
            assert (r["fingerprint"] % (1 << 64), r["component"]) == (prints[r["id"]], want[r["id"]])
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = {r["doc_id"] for r in simhash.one_of_each(odd_docs).collect()}
    assert kept == set(want.values()) | {None}


@pytest.mark.parametrize("tile", [4, 1000])
def test_close_pairs(spark, tile):
    """Large groups in one key, cut into tiles or not, give the components of all pairs."""
    draw = random.Random(8)
    centres = [draw.getrandbits(64) for _ in range(5)]
    prints = {draw.getrandbits(64) for _ in range(200)} | {0, 1, 2**63, 2**64 - 1}
    for c in centres:
        prints |= {c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(5))) for _ in range(60)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = [(r["a"], r["b"]) for r in simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), tile=tile).collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in links)
    want = brute.groups(signed, [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3])
    assert brute.groups(signed, links) == want
    assert len(links) < 60 * 60 * 5 * 10 / 4  # forests, not all pairs


# --- archives ---------------------------------------------------------------------------------------------------------


def pages_of(spark):
    long = "x" * 300_000 + "é"
    rows = [(1, "http://a/", "<p>" + "a" * 200), (2, None, "<p>" + "a" * 200), (3, "http://c/ d\r\nX: y", "<p>" + "a" * 200), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "v", long), (8, "v", long), (9, "w", long), (None, "n", long), (10, "\r\n\r\n", "b\r\n\r\nWARC/1.1\r\n" * 20)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>{i} " + prose(random.Random(i), 60) + "</body></html>") for i in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("extra")).withColumn("digest", F.lit(1)), rows


def test_archives(spark):
    pages, rows = pages_of(spark)
    found = warc.archived_pages(warc.archive_pages(pages)).collect()
    first = {}
    for p, _, html in rows:
        if p is not None and len((html or "").encode()) >= 100:
            first[html] = min(p, first.get(html, p))
    want = []
    for p, _, html in rows:
        again = p is not None and html in first and p > first[html]
        want.append((p, len((html or "").encode()), brute.sha(html or ""), "revisit" if again else "response", first[html] if again else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(want, key=key)
    assert all(r["verified"] for r in found if r["record_type"] == "response")


def test_archives_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived_pages(warc.archive_pages(empty)).count() == 0


def test_several_files(spark):
    pages, rows = pages_of(spark)
    from callscope.sources.storage import scratch_table

    files = warc.write_archives(warc.page_records(pages).coalesce(1), scratch_table(spark, "warc"), file_bytes=2000)
    assert files.count() > 1 and files.agg(F.sum("records")).first()[0] == len(rows) == warc.read_archives(files).count()


def archive(records, dictionary=b"", packed=True):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    head = warc.dictionary_frame(dictionary)
    if dictionary and not packed:
        head = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    return head + b"".join(packer.compress(r) for r in records)


def test_frames():
    samples = [f"<html><body>{i} ".encode() + prose(random.Random(i), 60).encode() for i in range(200)]
    words = warc.train_dictionary(samples)
    assert words
    records = [warc.record_bytes("response", {"WARC-Record-ID": f"<urn:page:{i}>"}, s) for i, s in enumerate(samples)]
    for dictionary, packed in ((words, True), (words, False), (b"", True)):
        data = archive(records, dictionary, packed)
        assert [b for _, b in warc.read_records(io.BytesIO(data))] == samples
    gap = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert len(list(warc.read_records(io.BytesIO(archive(records[:1]) + gap + archive(records[1:2]))))) == 2
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_broken_archives():
    good = warc.record_bytes("response", {"WARC-Record-ID": "<urn:page:1>"}, b"payload")
    broken = [
        archive([good])[:-3], archive([good]) + b"rubbish!", archive([good.replace(b"Content-Length: 7", b"Content-Length: 8")]), archive([good.replace(b"Content-Length: 7", b"Content-Length: -7")]),
        archive([good.replace(b"WARC-Type", b"Type")]), archive([good.replace(b"WARC/1.1", b"HTTP/1.1")]), archive([good[:-2]]), archive([good + good]), archive([good.replace(b": <urn", b" <urn", 1).replace(b"WARC-Record-ID ", b"WARC-Record-ID ")]),
        warc.dictionary_frame(b"x" * 100)[:-5],
    ]
    for data in broken:
        with pytest.raises(warc.BadArchive):
            list(warc.read_records(io.BytesIO(data)))


# --- mixing -----------------------------------------------------------------------------------------------------------


def filled(sizes, weights, total, epochs=3):
    targets, clamped = {}, set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in clamped)
        free = sum(weights[s] for s in sizes if s not in clamped)
        targets = {s: epochs * sizes[s] if s in clamped else rest * weights[s] / free for s in sizes}
        above = {s for s in sizes if targets[s] > epochs * sizes[s]}
        if not above:
            return targets
        clamped |= above


def check_mix(docs, slack):
    rows = mixing.mix(docs).collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    sizes = {}
    for _, text, s in texts:
        sizes[s] = sizes.get(s, 0) + len(brute.words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()))
    assert len(rows) == len(texts)
    got = {s: 0 for s in sizes}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        got[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(got[s] - want[s]) <= slack * max(want[s], 1) + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    return rows


def test_mix(spark):
    draw = random.Random(11)
    rows = [(i, prose(draw, draw.randrange(0, 200)), draw.choice(["a", "a", "a", "a", "a", "b", "ä", "Z", None, "c"])) for i in range(600)] + [(2000, "w " * 30, "tiny"), (2001, None, "none")]
    found = check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.02)
    assert {r["target"] for r in found if r["source"] == "tiny"} == {90.0}


def test_mix_odd(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in odd_docs.collect()}
    assert out.count() == sum(r["repeats"] for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


#: Names that operators use, or used, for columns of their own.
NAMES = ("row", "copies", "content", "number", "_words", "_copy", "_repeats", "_dropped", "_id", "_kept", "_lines", "own", "gone", "stays", "of_id", "rows", "least", "extra", "id", "text_key")


def with_names(docs):
    return docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("mark")).alias(n) for n in NAMES])


def test_mix_of_repeated_ids(spark):
    """A third of the rows share an id and a size, some of them with one text, and tables may have columns of any name."""
    draw = random.Random(13)
    rows = [(1, "w " * 30 if i % 2 else f"x{i} " + "w " * 29, "a") for i in range(400)] + [(2 + i, prose(draw, draw.randrange(1, 60)), draw.choice("aabc")) for i in range(800)]
    rows += [(None, "n " * 7, "b")] * 30 + [(5, rows[403][1], "c")] * 3
    docs = with_names(spark.createDataFrame([(*r, str(i // 2)) for i, r in enumerate(rows)], "doc_id long, text string, source string, mark string").repartition(5))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    by_source = {}
    for r in found:
        by_source.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(target - taken) <= 60 for target, taken in by_source.values()) and sorted(map(str, found)) == sorted(map(str, mixing.mix(docs).collect()))
    whole = {(r["id"], r["source"], r["size"]): [0, set()] for r in found}
    for r in found:
        whole[r["id"], r["source"], r["size"]][0] += r["repeats"]
        whole[r["id"], r["source"], r["size"]][1].add(r["repeats"])
    assert all(max(x) - min(x) <= 1 for _, x in whole.values())
    out, kept = mixing.mixed(docs), {}
    assert out.columns == docs.columns
    originals = {tuple(r) for r in docs.collect()}
    for r in out.collect():
        assert tuple(r) in originals
        key = (r["doc_id"], r["source"], len(brute.words(r["text"])))
        kept[key] = kept.get(key, 0) + 1
    assert kept == {k: n for k, (n, _) in whole.items() if n}


def test_columns_of_any_name_stay(spark):
    from callscope.llm import lines

    draw = random.Random(17)
    texts = ["a long line of words that all share here\n" * 2 + prose(draw, 90) for _ in range(60)] + ["short"] * 3
    docs = with_names(spark.createDataFrame([(i, t, "h", str(i)) for i, t in enumerate(texts)], "doc_id long, text string, source string, mark string"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    single = simhash.one_of_each(docs)
    assert single.columns == docs.columns and {tuple(r) for r in single.collect()} <= {tuple(r) for r in rows.values()} and single.where("text = 'short'").count() == 1
    left = lines.cleaned(docs)
    assert left.columns == docs.columns and left.count() == 60
    for r in left.collect():
        assert "line of words" not in r["text"] and r["text"] in rows[r["doc_id"]]["text"] and all(r[n] == rows[r["doc_id"]][n] for n in docs.columns if n != "text")


def test_numbered(spark):
    names = [f"s{i:04d}" for i in range(500)] + ["ä", "Z", ""]
    draw = random.Random(1)
    draw.shuffle(names)
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "source string")
    got = {r["source"]: r["place"] for r in mixing.numbered(df, F.col("source").asc_nulls_last(), "names").collect()}
    assert got == {n: i for i, n in enumerate([*sorted(names), None])}


# --- vectors ----------------------------------------------------------------------------------------------------------


def vector_rows(n=900, dims=16, seed=2):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims)).astype(np.float32)
    for k in range(0, n, 3):
        x[k] = x[draw.integers(0, n)] + draw.normal(size=dims) * draw.choice([0.01, 0.1, 0.3])
    x[500:560] = x[500] + draw.normal(size=(60, dims)) * 0.02
    x[600:620] = x[600]
    x[620:630] = x[600] * 3
    labels = draw.choice([0, 0, 0, 1, 2], n)
    labels[500:640] = 1
    rows = [(i, x[i].tolist(), int(labels[i])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * dims, 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [None] * dims, 1), (n + 4, [float("inf")] + [1.0] * (dims - 1), 1)]
    rows += [(n + 5, x[500].tolist(), None), (None, x[600].tolist(), 1), (600, x[600].tolist(), 1), (n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [1e-30, 2e-30], 1)]
    return rows


@pytest.mark.parametrize("size", [60, 2000])
def test_vectors(spark, size):
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("extra")).withColumn("id", F.lit(7))
    good = [i for i, (_, v, k) in enumerate(rows) if v and k is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(i, j) for n, i in enumerate(good) for j in good[n + 1 :] if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    degree = {i: 0 for i in range(len(rows))}
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    found = vectors.near_vectors(table, size=size).collect()
    assert len(found) == len(rows)
    assert sum(r["n_links"] for r in found) >= 0.95 * 2 * len(links)
    by_id = {}
    for r in found:
        by_id.setdefault(r["id"], r)
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None and vec_id != 600:
            assert by_id[vec_id]["n_links"] <= degree[i]
            if i not in good:
                assert (by_id[vec_id]["n_links"], by_id[vec_id]["component"]) == (0, vec_id)
    assert by_id[600]["n_links"] == degree[600] and by_id[600]["component"] == 600
    assert by_id[520]["component"] == by_id[540]["component"]


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_search():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 8))
    x[:100] = x[0] + draw.normal(size=(100, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = vectors._lists([row[row >= 0] for row in vectors.pruned_graph(x)], len(x))
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    found = vectors.range_search(x, lists)
    assert not (found & ~want).any() and (found & want).sum() >= 0.98 * want.sum()


@pytest.mark.parametrize("apart", [0.0, 0.25, 1.0])
def test_graph_search_tight_clusters(apart):
    """Clusters that hold more near-copies than a list has candidates: far from each other, or partly within range."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=16) + apart * draw.normal(size=(4, 16))
    x = np.vstack([c + draw.normal(size=(120, 16)) * 0.1 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = vectors._lists([row[row >= 0] for row in vectors.pruned_graph(x)], len(x))
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    found = vectors.range_search(x, lists)
    assert not (found & ~want).any() and (found & want).sum() >= 0.98 * want.sum()


def dense_rows(n=700, dims=32, first=0, label=0, seed=8):
    """Near-copies of one vector, all different and all linked, at no place of their own."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=dims) + draw.normal(size=(n, dims)) * 0.15
    return [(first + i, v.tolist(), label) for i, v in enumerate(x.astype(np.float32))]


def links_of(rows):
    """How many links each row has, by comparing all with all; rows have ids from 0 on and vectors of one length."""
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([k for *_, k in rows])
    return ((x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])).sum(axis=1) - 1


def test_vectors_dense_group(spark):
    """A group of near-copies that no overlap of shards brings together."""
    rows = dense_rows()
    found = {r["id"]: r["n_links"] for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), size=40).collect()}
    want = links_of(rows)
    assert want.mean() > 600 and [found[i] for i in range(len(rows))] == want.tolist()


@pytest.mark.parametrize("size", [40, 5000])
def test_vectors_whole(spark, size):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(300, 8))
    x[:90] = x[0] + draw.normal(size=(90, 8)) * 0.3
    labels = draw.integers(0, 2, len(x))
    classes = spark.createDataFrame([(i, 1, int(labels[i]), x[i].tolist()) for i in range(len(x))], "node long, copies long, label int, vector array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1))) if labels[i] == labels[j]}
    found = vectors.whole(classes, size=size).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)
    assert brute.groups(range(len(x)), [(r["a"], r["b"]) for r in found if r["tree"]]) == brute.groups(range(len(x)), want)


def test_vectors_recall_of_each_label(spark, monkeypatch):
    """A label whose links get lost is found out beside a label that has most links."""
    rows = dense_rows(300) + dense_rows(20, first=300, label=1, seed=9)
    search = vectors.search
    monkeypatch.setattr(vectors, "search", lambda *given: search(*given).where("a < 300"))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    found = {r["id"]: r["n_links"] for r in vectors.near_vectors(table).collect()}
    assert [found[i] for i in range(len(rows))] == links_of(rows).tolist()


# --- quality ----------------------------------------------------------------------------------------------------------


def quality_tables(spark):
    draw = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        good = draw.random() < 0.7
        text = prose(draw, 80) if good else " ".join([prose(draw, 1) + "$$$"] * 80)
        rows.append((i, text, draw.choice(["en", None]), draw.choice(["a", "b", None]), len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int"), rows


def test_quality_repeated_ids(spark, monkeypatch):
    """A picked id counts once, however many rows have it, and its rows don't pull the fit."""
    docs, labels, _ = quality_tables(spark)
    sizes, train = [], cotrain.co_train
    monkeypatch.setattr(cotrain, "co_train", lambda text, page, y, more, *rest: sizes.append((len(text), len(more))) or train(text, page, y, more, *rest))
    model = cotrain.fit_quality(docs, labels)
    copies = docs.where("doc_id IN (1, 2)").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("copy")
    again = cotrain.fit_quality(docs.unionByName(copies).repartition(5), labels)
    assert sizes == [(200, 200)] * 2 and np.allclose(again.text.weights, model.text.weights) and np.allclose(again.page.weights, model.page.weights)
    other = docs.where("doc_id IN (1, 2)").withColumn("text", F.lit("other words"))
    twice = [cotrain.fit_quality(docs.unionByName(other).repartition(n), labels) for n in (2, 5)]
    assert sizes[2:] == [(200, 200)] * 2 and np.allclose(twice[0].text.weights, twice[1].text.weights)


def test_quality(spark, odd_docs, no_docs):
    docs, labels, rows = quality_tables(spark)
    model = cotrain.fit_quality(docs, labels)
    found = {r["doc_id"]: r for r in cotrain.score_quality(docs, model).collect()}
    right = [found[i]["kept"] == ("$" not in t) for i, t, *_ in rows]
    assert np.mean(right) >= 0.98
    assert all(0 <= r[c] <= 1 for r in found.values() for c in ("text_score", "page_score", "quality_score"))
    again = cotrain.fit_quality(docs.repartition(7), labels)
    assert np.allclose(again.text.weights, model.text.weights) and again.prior == model.prior
    assert {r["doc_id"] for r in cotrain.keep_good(docs, labels).collect()} == {i for i, r in found.items() if r["kept"]}
    assert cotrain.score_quality(odd_docs, model).count() == odd_docs.count()
    assert cotrain.keep_good(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert cotrain.keep_good(no_docs, labels).count() == 0 and cotrain.keep_good(docs, labels).columns == docs.columns


def test_co_training_helps():
    """A few labels for one view, many unlabelled rows: what the other view is sure of teaches it."""
    draw = np.random.default_rng(5)
    y = (draw.random(2000) < 0.5).astype(float)
    text = (draw.normal(size=(2000, 30)) + y[:, None] * 0.7).astype(np.float32)
    page = (draw.normal(size=(2000, 3)) + y[:, None] * 1.5).astype(np.float32)
    hits = []
    for rounds in (0, 4):
        model = cotrain.co_train(text[:40], page[:40], y[:40], text[40:1500], page[40:1500], rounds)
        hits.append(((model.score(text[1500:], page[1500:])[2] >= 0.5) == (y[1500:] == 1)).mean())
    assert hits[1] >= hits[0] and hits[1] >= 0.95
