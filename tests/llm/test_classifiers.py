from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from salesmart.llm import quality_classifier, toxicity
from salesmart.llm.columns import crc_of_id
from salesmart.llm.labelled import label_sample, labelled_texts, labelled_texts_in_place
from salesmart.llm.queries import op3_quality_classifier, op6_toxicity
from salesmart.llm.texts import pieces

KNN = quality_classifier.KnnSettings(bits=8, width=12, neighbours=3)


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(1, 1), (2, 1), (3, 1), (10, 1), (11, 0), (12, 0), (13, 0), (None, 1), (4, None), (99, 0), (13, 0)]
    return spark.createDataFrame(rows, "doc_id long, y int")


def test_votes_are_exact_cosines(spark, awkward, sample):
    fitted = quality_classifier.fit(awkward, label_sample(sample, "doc_id", "y", 100), settings=KNN)
    assert len(fitted.labels) == 7
    rows = quality_classifier.score(awkward, fitted, ["doc_id", "text", "score"], settings=KNN, score_column="s").collect()
    assert len(rows) == awkward.count()
    for row in rows:
        piece = next(pieces(pa.array([row["text"] or ""])))
        counts = quality_classifier.trigram_counts(piece, KNN.bits)
        if not counts.any():
            assert row["s"] == pytest.approx(fitted.share)
            continue
        vector = (quality_classifier.weighted(counts, fitted.rarity) @ fitted.projection)[0].astype(float)
        similar = [float(vector @ v) / np.linalg.norm(vector) for v in fitted.vectors.astype(float)]
        best = sorted(range(len(similar)), key=lambda k: (-round(similar[k], 5), k))[: KNN.neighbours]
        weights = [max(similar[k], 1e-3) ** KNN.sharpness for k in best]
        assert row["s"] == pytest.approx(sum(w * fitted.labels[k] for w, k in zip(weights, best)) / sum(weights), abs=1e-3)
        assert 0 <= row["s"] <= 1


def test_trigrams_are_counted_within_texts(spark):
    piece = next(pieces(pa.array(["abcabc", "ab", None, "xyz"])))
    counts = quality_classifier.trigram_counts(piece, 10)
    assert counts.sum(axis=1).tolist() == [8, 0, 0, 2]
    assert counts[0].max() == 4  # all four trigrams have one shape


def test_counts_of_long_texts_are_whole(spark):
    texts = ["ab " * 60_000, "abc" * 50_000, "one two three", "four five", "xyz " * 30]
    counts = np.concatenate([quality_classifier.trigram_counts(p, KNN.bits) for p in pieces(pa.array(texts))])
    assert counts[1].max() == 149_998 and counts[0].sum() == 2 * 179_998
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, y int")
    fitted = quality_classifier.fit(documents, label_sample(labels, "doc_id", "y", 100), settings=KNN)
    want = quality_classifier.fit_arrays(counts, np.array([0, 1, 0, 1, 0]), KNN)
    assert np.allclose(fitted.vectors @ fitted.vectors.T, want.vectors @ want.vectors.T, atol=1e-4)
    assert np.array_equal(fitted.rarity, want.rarity) and np.array_equal(fitted.labels, want.labels)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_without_labels_or_documents(spark, awkward, nothing, module):
    none = spark.createDataFrame([], "doc_id long, y int")
    fitted = module.fit(awkward, label_sample(none, "doc_id", "y", 10))
    want = 0.5 if module is quality_classifier else 0.0
    assert {r["score"] for r in module.score(awkward, fitted, ["doc_id"]).collect()} == {want}
    assert module.score(nothing, fitted, ["doc_id"]).collect() == []


def test_samples_are_bounded_and_depend_on_ids_alone(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    first = {r[0] for r in label_sample(labels, "doc_id", "y", 500).collect()}
    again = {r[0] for r in label_sample(labels.repartition(7), "doc_id", "y", 500).collect()}
    assert first == again and 350 <= len(first) <= 500


def test_pairs_count_for_more_than_their_parts():
    """Insult and group are harmless alone: no weights of single terms can tell."""
    draw = random.Random(2)
    texts, labels = [], []
    for _ in range(3000):
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        words = [f"w{draw.randrange(200)}" for _ in range(12)] + ["rotten"] * insult + ["people"] * group
        draw.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(insult and group))
    settings = toxicity.FmSettings(epochs=60)
    rows, places = zip(*[(r + p.row, t) for p in pieces(pa.array(texts[:2000])) for r, t in [toxicity.terms(p, settings.bits)]])
    model = toxicity.fit_arrays(np.array(labels[:2000]), np.concatenate(rows), np.concatenate(places), settings)
    found = np.concatenate([toxicity.scores(p, model, settings.bits) for p in pieces(pa.array(texts[2000:]))])
    held = np.array(labels[2000:])
    assert ((found >= 0.5) == held).mean() > 0.97
    alone = np.concatenate([toxicity.scores(p, model, settings.bits) for p in pieces(pa.array(["rotten", "people", "rotten people"]))])
    assert alone[2] > 0.5 > max(alone[0], alone[1])


def fitted_and_held(texts, labels, settings, share=2 / 3):
    cut = int(len(texts) * share)
    rows, places = zip(*[(r + p.row, t) for p in pieces(pa.array(texts[:cut])) for r, t in [toxicity.terms(p, settings.bits)]])
    model = toxicity.fit_arrays(np.array(labels[:cut]), np.concatenate(rows), np.concatenate(places), settings)
    return model, np.concatenate([toxicity.scores(p, model, settings.bits) for p in pieces(pa.array(texts[cut:]))])


def test_words_that_tell_nothing_alone_tell_together():
    """Label 1 where both of two words or neither are there: each is as frequent in either."""
    draw = random.Random(2)
    texts, labels = [], []
    for _ in range(6000):
        one, other = draw.random() < 0.5, draw.random() < 0.5
        words = [f"w{draw.randrange(300)}" for _ in range(12)] + ["rotten"] * one + ["people"] * other
        draw.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(one == other))
    settings = toxicity.FmSettings()
    _, found = fitted_and_held(texts, labels, settings)
    assert ((found >= 0.5) == np.array(labels[4000:])).mean() > 0.95


def test_scores_are_the_sum_over_all_pairs(spark):
    draw = random.Random(4)
    random_model = np.random.Generator(np.random.PCG64(5))
    bits = toxicity.FmSettings().bits
    texts = [" ".join(f"w{draw.randrange(60)}" for _ in range(draw.randrange(40))) for _ in range(50)] + ["", None]
    place_of = {}
    for text in {w for t in texts if t for w in t.split()}:
        place_of[text] = int(toxicity.terms(next(pieces(pa.array([text]))), bits)[1][0])
    places = np.array(sorted(place_of.values())[::2])
    model = toxicity.Model(places, 0.3, random_model.normal(0, 1, len(places)), random_model.normal(0, 0.4, (len(places), 8)))
    found = np.concatenate([toxicity.scores(p, model, bits) for p in pieces(pa.array(texts, pa.string()))])
    at = {p: k for k, p in enumerate(places.tolist())}
    for text, score in zip(texts, found):
        own = sorted({at[place_of[w]] for w in (text or "").split() if place_of[w] in at})
        logit = model.bias + sum(model.weights[k] for k in own)
        logit += sum(float(model.vectors[i] @ model.vectors[j]) for i in own for j in own if i < j)
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


def test_of_rows_with_one_id_the_least_text_counts(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (2, None), (2, None), (3, "z")]
    documents = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5)
    sample = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "key long, label int")
    assert sorted(map(tuple, labelled_texts(documents, sample, "doc_id", "text").collect())) == [(1, 1, "a"), (2, 0, None)]


def test_terms_of_the_sample_are_bounded(spark):
    documents = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(200)], "doc_id long, text string")
    sample = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label"))
    seen = []
    whole = toxicity.fit_arrays
    toxicity.fit_arrays = lambda labels, row, place, settings: seen.append(len(place)) or whole(labels, row, place, settings)
    try:
        toxicity.fit(documents, sample, settings=toxicity.FmSettings(max_terms=3000))
        toxicity.fit(documents, sample)
    finally:
        toxicity.fit_arrays = whole
    assert 0 < seen[0] < 4500 and seen[1] > 9900


def test_awkward_documents_get_a_score(spark, awkward, sample):
    model = toxicity.fit(awkward, label_sample(sample, "doc_id", "y", 100))
    rows = toxicity.score(awkward, model, ["doc_id", "score"]).toDF("doc_id", "clash", "score").collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}) == 1


@pytest.mark.parametrize(("query", "column", "least"), [(op3_quality_classifier, "quality", 0.97), (op6_toxicity, "toxic", 0.92)])
def test_held_out_accuracy(spark, query, column, least):
    directory = os.path.join(TESTDATA, "sf0.01")
    if not os.path.isdir(directory):
        pytest.skip("test tables not present")
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    held = query(spark, directory).where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    assert len(held) > 80
    assert np.mean([r[0] == r[1] for r in held]) >= least
    crc = spark.createDataFrame([(123,), (None,)], "i long").select(crc_of_id(F.col("i"))).collect()
    assert [r[0] for r in crc] == [2286445522, 0]


def test_only_texts_of_repeated_ids_are_shuffled(spark):
    rows = [(1, "b"), (1, "a"), (2, None), (2, None), (3, "c"), (4, None), (None, "x"), (5, "unlabelled")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "key long, label int")
    found = labelled_texts_in_place(documents, sample, "doc_id", "text")
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a"), (2, 0, None), (3, 1, "c"), (4, 0, None)]
    once = labelled_texts_in_place(documents.where("doc_id > 2"), sample, "doc_id", "text")
    assert sorted(map(tuple, once.collect())) == [(3, 1, "c"), (4, 0, None)]
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan


def test_toxicity_is_fitted_without_sorting_texts(spark, monkeypatch):
    documents = spark.createDataFrame([(k, f"good w{k % 5}" if k % 2 else f"bad w{k % 5}") for k in range(40)], "doc_id long, text string")
    sample = label_sample(spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, y int"), "doc_id", "y", 100)
    plans = []

    def noted(frame, *columns):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame, *columns)

    written = toxicity.written
    monkeypatch.setattr(toxicity, "written", noted)
    model = toxicity.fit(documents, sample)
    assert len(model.places) and not any("SortAggregate" in plan for plan in plans)
