"""Registered queries of this folder and the pipeline, over whole small tables."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from callscope.llm import queries as corpus
from callscope.llm import cotrain, mixing
from tests.compare import check
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(corpus.oracle_sql()))
def test_sql(spark, name):
    assert check(spark, name, SF)[1] == "same"


def test_op2(spark):
    prints = {d: brute.simhash(r["text"]) for d, r in texts(spark).items()}
    groups = brute.near_groups(prints)
    found = corpus.op2_simhash(spark, SF).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == {(d, f"{p:016x}", groups[d]) for d, p in prints.items()}


def test_op3(spark):
    found = {r["doc_id"]: r for r in corpus.op3_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [found[d]["kept"] for d, q in labels.items() if q]
    assert len(found) == 200 and sum(good) >= 0.98 * len(good)


def test_op6(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, r in texts(spark).items():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in corpus.op6_bpe(spark, SF).collect()} == want


def test_op7(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    links, degree = [], {r["vec_id"]: 0 for r in rows}
    by_label = {}
    for r in rows:
        by_label.setdefault(r["label"], []).append(r)
    for group in by_label.values():
        x = np.array([r["embedding"] for r in group], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1))):
            links.append((group[i]["vec_id"], group[j]["vec_id"]))
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    groups = brute.groups(degree, links)
    found = {tuple(r) for r in corpus.op7_vectors(spark, SF).collect()}
    assert found == {(v, n, groups[v], groups[v] == v) for v, n in degree.items()}


def test_op8_op10(spark):
    all_texts = texts(spark)
    for name, plain, kinds in (("op8_secrets", brute.secrets, ("assign", "access", "hex")), ("op10_pii", brute.pii, ("email", "ip", "card", "phone"))):
        found = corpus.queries()[name](spark, SF).collect()
        assert len(found) == len(all_texts)
        for r in found:
            want = plain(all_texts[r["doc_id"]]["text"])
            assert r["base_sha256"] == brute.sha(brute.listed(want))
            assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in want) for k in kinds]
            assert set(brute.listed(want).split(",")) - {""} <= set(r["spans"].split(","))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    scores = {r["doc_id"]: r["kept"] for r in cotrain.score_quality(docs, cotrain.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    kept = {d for d, k in scores.items() if k}
    good = stage["quality"](spark, docs, SF).cache()
    assert {r["doc_id"] for r in good.collect()} == kept
    groups = brute.near_groups({d: brute.simhash(rows[d]["text"]) for d in kept})
    single = stage["near_duplicates"](spark, good, SF).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))
    clean = stage["personal_data"](spark, single, SF).cache()
    after = {r["doc_id"]: r for r in clean.collect()}
    assert set(after) == set(groups.values())
    for d, r in after.items():
        assert (r["text"] == rows[d]["text"]) == (not brute.pii(rows[d]["text"])) or "<" in r["text"]
        assert not brute.pii(r["text"]) and r["n_chars"] == (len(r["text"]) if r["text"] != rows[d]["text"] else rows[d]["n_chars"])
    repeats = {r["id"]: r["repeats"] for r in mixing.mix(clean).collect()}
    drawn = stage["mixing"](spark, clean, SF).cache()
    taken = [r["doc_id"] for r in drawn.collect()]
    assert drawn.columns == docs.columns and {d: taken.count(d) for d in repeats} == repeats
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(taken)
    for r in found:
        assert r["ids"] == library.encode(after[r["doc_id"]]["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_registered():
    names = set(corpus.queries())
    assert names <= set(entry.queries()) and {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
