import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cropscan.llm import quality, toxicity
from cropscan.llm.common import held_out, table
from cropscan.llm.sampling import training_labels
from helpers import EDGES, by_id, make

MIDDLE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query,label,least", [
    (quality.quality_query, "quality", 0.97), (toxicity.toxicity_query, "toxic", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    found = query(spark, MIDDLE).where("held_out").join(table(spark, MIDDLE, "labels"), "doc_id")
    rows = found.select("score", "predicted", F.col(label).alias("y")).collect()
    assert len(rows) > 500
    assert sum(r["predicted"] == r["y"] for r in rows) / len(rows) > least
    assert all(0 <= r["score"] <= 1 for r in rows)
    by_label = [np.mean([r["score"] for r in rows if r["y"] == y]) for y in (0, 1)]
    assert by_label[1] > by_label[0] + 0.5


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_training_rows_are_bounded_and_not_held_out(spark):
    rows = labels(spark, [(i, i % 2, None) for i in range(4_000)] + [(None, 1, 1), (1, 0, 0), (1, 1, 1)])
    some = training_labels(rows, "quality", 500)
    assert 380 < some.count() < 620 and some.where(held_out(5, 0)).count() == 0
    assert training_labels(rows, "toxic").count() <= 1


def test_quality_edges(spark):
    docs = make(spark, EDGES)
    vectors = quality.word_vectors(docs)
    assert vectors.shape == (quality.VECTORS, quality.DIMENSIONS) and np.isfinite(vectors).all()
    network = quality.fit(docs, labels(spark, [(6, 1, 0), (8, 0, 0), (11, 0, 1)]), vectors)
    found = by_id(quality.score(docs, vectors, network), "score")
    assert all(0 <= s <= 1 for s, in found.values()) and found[1] == found[2] == found[3]
    untrained = quality.fit(make(spark, []), labels(spark, []), vectors)
    assert by_id(quality.score(docs, vectors, untrained), "score")[6] == (0.5,)
    assert quality.score(make(spark, []), vectors, network).collect() == []
    assert not quality.word_vectors(make(spark, [])).any()


def test_context_vectors_equal_a_plain_count(spark):
    docs = make(spark, [(1, "a b c a"), (2, "b a")])
    place, sign = quality.index_vectors()
    dense = np.zeros((quality.VECTORS, quality.DIMENSIONS))
    for k in range(quality.NONZEROS):
        np.add.at(dense, (np.arange(quality.VECTORS), place[:, k]), sign[:, k])
    total = np.zeros_like(dense)
    for text in ("a b c a", "b a"):
        ids = quality.token_numbers(pa.array([text]))[0]
        for i in range(len(ids)):
            for j in range(len(ids)):
                if 0 < abs(i - j) <= quality.WINDOW:
                    total[ids[i]] += dense[ids[j]]
    size = np.linalg.norm(total, axis=1, keepdims=True)
    assert np.allclose(quality.word_vectors(docs), total / np.where(size > 0, size, 1), atol=1e-6)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3_000, 5))
    y = (rng.random(3_000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    apart = np.arange(3_000) % 5 == 0
    network = quality.train(x, y, apart)
    raw = network.logits(x[apart])
    assert quality.log_loss(raw / network.temperature, y[apart]) <= quality.log_loss(raw, y[apart]) + 1e-9
    assert quality.log_loss(raw / network.temperature, y[apart]) < 0.55


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.3
    right = lambda p: np.where(rng.random(20_000) < p, y, ~y) * 2 - 1
    good, fair, poor = right(0.9), right(0.8), right(0.6)
    votes = np.stack([good, fair, fair, right(0.75), poor], axis=1)
    shown = np.where(rng.random(20_000) < 0.2, y, np.nan)
    patterns, counts = np.unique(np.column_stack([votes, np.where(np.isnan(shown), 9, shown)]), axis=0, return_counts=True)
    truth = np.where(patterns[:, -1] == 9, np.nan, patterns[:, -1])
    model = toxicity.fit_label_model(patterns[:, :-1].astype(np.int8), counts, truth)
    assert model.accuracy[0] > model.accuracy[3] > model.accuracy[4]
    assert model.correlation[1, 2] > 0.9 > model.correlation[0, 3]
    assert model.power[1] < 0.7 < model.power[0]
    told = model.posterior(votes.astype(np.int8)) > 0.5
    assert (told == y).mean() > 0.88


def test_toxicity_edges(spark):
    docs = make(spark, [*EDGES, (30, "you are a worthless idiot"), (31, "a kind word"), (32, "pathetic idiot trash")])
    voters, model, linear = toxicity.fit(docs, labels(spark, [(30, 1, 1), (31, 1, 0), (32, 0, 1)]))
    found = by_id(toxicity.score(docs, linear), "score")
    assert all(0 <= s <= 1 for s, in found.values()) and found[1] == found[2] == found[3]
    votes = voters.votes(pa.array(["you are a worthless idiot", "a kind word", ""]))
    place = toxicity.VOTERS.index
    assert votes[0, place("persons")] == votes[0, place("worth")] == votes[0, place("direct")] == 1
    assert votes[1, place("nothing")] == votes[2, place("nothing")] == -1
    assert model.posterior(votes)[0] > model.posterior(votes)[1]
    _, _, empty = toxicity.fit(make(spark, []), labels(spark, []))
    assert toxicity.score(make(spark, []), empty).collect() == []
