"""Operators 2 and 6: held-out accuracy, and the forward algorithm against plain sums."""

from itertools import product

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillscope.llm import language_id, quality_knn, sampling, queries


def test_forward_sums_all_segmentations():
    of = language_id.trie(language_id.default_vocabulary())
    rng = np.random.default_rng(1)
    p = np.maximum(rng.random((of.pieces, 2)), 1e-6)
    p /= p.sum(axis=0)

    def piece(part):
        node = 0
        for b in part:
            node = of.step(node, b)
            if not node:
                return -1
        return of.piece_at[node]

    words = [b"the", b"cat", "né".encode(), b"xqz", b"aaaaaa"]
    got = language_id.log_likelihoods(words, p, of)
    for k, w in enumerate(words):
        total = np.zeros(2)
        for cuts in product([0, 1], repeat=len(w) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(w)]
            parts = [piece(w[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            if min(parts) >= 0:
                total += np.prod(p[parts], axis=0)
        assert np.allclose(got[k], np.log(total))


def test_long_words_agree_with_short_ways():
    of = language_id.trie(language_id.default_vocabulary())
    p = np.full((of.pieces, 1), 1 / of.pieces)
    word = b"thecatsatonthemat" * 4
    arcs = of.arcs([word])
    alpha, scale = language_id.forward(arcs, 1, p)
    scaled = np.log(alpha[-1, 0]) + scale[-1, 0]
    assert np.allclose(language_id._one_long(word, p, of), scaled)
    assert np.allclose(language_id.log_likelihoods([word, b"the"], p, of)[0], scaled)


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(language_id.training_rows(spark.read.parquet(f"{brute.SF_CHECK}/documents.parquet")), docs_per_language=60)


def test_language_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{brute.SF_CHECK}/documents.parquet")
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    right, n = language_id.identify(held.withColumn("truth", F.col("lang")), model).agg(F.sum((F.col("truth") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97


def test_language_edge_rows(spark, model):
    rows = language_id.identify(brute.edge_rows(spark), model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["text"] in (None, "", "..."))
    assert all(r["lang_pred"] in model[0].languages for r in rows if r["text"] not in (None, "", "..."))
    kept = language_id.keep_identified(brute.edge_rows(spark), model)
    assert kept.columns == brute.edge_rows(spark).columns and kept.count() <= 6
    assert language_id.identify(brute.edge_rows(spark).limit(0), model).count() == 0


def test_language_without_labels(spark):
    docs = brute.edge_rows(spark)
    empty = language_id.fit(docs.where("lang = 'none'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_languages_of_long_words_are_learned(spark):
    rng = np.random.default_rng(4)
    letters = {"aa": "กขคงจฉชซ", "bb": "ดตถทธนบป", "cc": "abcdefgh"}
    rows = [(i, "".join(rng.choice(list(letters[x]), 90)), x) for i, x in enumerate(["aa", "bb", "cc"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(r[1].encode()) > language_id.LONGEST_TOGETHER and " " not in r[1] for r in rows)
    model = language_id.fit(docs.where("doc_id < 45"))
    names, scores = language_id.predict(model, [r[1] for r in rows if r[0] >= 45])
    assert names == [r[2] for r in rows if r[0] >= 45] and scores.min() > 0.99


def test_expected_counts_of_long_words(monkeypatch):
    of = language_id.trie(language_id.default_vocabulary())
    p = np.full(of.pieces, 1 / of.pieces)
    words = [b"thecatsatonthemat" * 180, "猫が鳴く".encode() * 90, b"the", b"cat"]
    weights = np.array([1.0, 2.0, 3.0, 4.0])
    assert max(map(len, words)) < language_id.WINDOW
    whole = language_id.expected_counts(words, weights, p, of)
    single = sum(language_id.expected_counts([w], weights[k : k + 1], p, of) for k, w in enumerate(words))
    assert np.allclose(whole, single)
    monkeypatch.setattr(language_id, "WINDOW", 500)
    assert np.allclose(language_id.expected_counts(words, weights, p, of), whole, rtol=1e-4, atol=1e-6)


def test_language_repeated_fit_is_equal(spark, model):
    again = language_id.fit(language_id.training_rows(spark.read.parquet(f"{brute.SF_CHECK}/documents.parquet")), docs_per_language=60)
    assert again[0].languages == model[0].languages and np.allclose(again[0].p, model[0].p)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{brute.SF_CHECK}/labels.parquet")
    scored = queries.op6_quality_knn(spark, brute.SF_CHECK).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1].score.to_numpy(), scored[scored.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2 > 0.95
    assert ((scored.predicted == 1) == (scored.score >= 0.5)).all()


def test_quality_edge_rows(spark):
    docs = brute.edge_rows(spark)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (5, 0, 1), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_knn.fit(docs, labels)
    assert sorted(model.labels.tolist()) == [0, 1, 1]  # document 1 stands twice in the table; its greatest label counts
    rows = quality_knn.rate(docs, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    unfitted = quality_knn.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_knn.rate(docs, unfitted).collect()} == {0.5}
    assert quality_knn.rate(docs.limit(0), model).count() == 0


def test_quality_votes_like_plain_cosines():
    texts = [t.encode() for t in brute.random_texts(120)]
    labels = np.array([i % 2 for i in range(100)])
    model = quality_knn.LatentNeighbours(quality_knn.term_counts(texts[:100]), labels)
    got = model.score(texts[100:])
    z = model._unit(model._weighted(quality_knn.term_counts(texts[100:])) @ model.basis)
    for k, v in enumerate(z):
        like = np.maximum(model.known @ v, 1e-6)
        best = np.argsort(-like)[: quality_knn.NEIGHBOURS]
        assert abs(got[k] - (like[best] * labels[best]).sum() / like[best].sum()) < 0.05


def test_many_languages_in_blocks(spark, monkeypatch):
    """More label values than a block and than the terms of an expression: the same answers as in one block."""
    docs = spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet").select("doc_id", "text", F.concat("lang", F.lit("-"), (F.col("doc_id") % 5).cast("string")).alias("lang"))
    one = language_id.fit(docs, docs_per_language=20)
    assert len(one) == 1 and len(one[0].languages) == 20
    want = language_id.identify(docs, one).select("doc_id", "lang_pred", "score").collect()
    monkeypatch.setattr(language_id, "LANGUAGES", 6)
    monkeypatch.setattr(sampling, "TERMS", 3)
    some = language_id.fit(docs, docs_per_language=20)
    assert len(some) == 4 and sorted(x for m in some for x in m.languages) == one[0].languages
    got = language_id.identify(docs, some).select("doc_id", "lang_pred", "score").collect()
    assert [r[:2] for r in map(tuple, got)] == [r[:2] for r in map(tuple, want)]
    assert np.allclose([r["score"] for r in got], [r["score"] for r in want])


def test_words_kept_are_bounded_by_their_bytes(monkeypatch, model):
    monkeypatch.setattr(language_id, "MAX_CACHED_BYTES", 1000)
    fresh = language_id.LanguageModel(model[0].vocabulary, model[0].languages, model[0].p)
    texts = [f"{'x' * 600}{i} and some words" for i in range(6)]
    whole = fresh.log_text(texts)
    fresh = language_id.LanguageModel(model[0].vocabulary, model[0].languages, model[0].p)
    single = np.concatenate([fresh.log_text([t]) for t in texts])
    assert np.allclose(whole, single) and fresh.held < 2000
