"""The label model and the classifier against plain versions, and what the lists say of words that no training row holds."""

import math

import numpy as np
import pyarrow as pa
import pytest

from cropscan.llm import toxicity as tx
from helpers import EDGES, make


def plain_model(rows, truth, rounds):
    """Expectation maximisation row by row, for voters that err apart."""
    m, n = len(rows[0]), len(rows)
    q = [t if t is not None else (0.9 if sum(v) > 0 else 0.05) for v, t in zip(rows, truth)]
    for _ in range(rounds):
        prior = (sum(q) + 1) / (n + 2)
        given = {
            (j, label, vote): math.log((sum(w for w, v in zip(share, rows) if v[j] == vote) + 0.1) / (sum(share) + 0.3))
            for label, share in ((1, q), (0, [1 - x for x in q])) for j in range(m) for vote in (-1, 0, 1)}
        logit = [math.log(prior / (1 - prior)) + sum(given[j, 1, v[j]] - given[j, 0, v[j]] for j in range(m)) for v in rows]
        q = [t if t is not None else 1 / (1 + math.exp(-x)) for x, t in zip(logit, truth)]
    return q


def test_label_model_equals_a_plain_one(monkeypatch):
    monkeypatch.setattr(tx, "LOOSE", 2.0)  # no correlation counts
    dice = np.random.default_rng(3)
    label = dice.random(400) < 0.3
    votes = np.where(dice.random((400, 5)) < 0.4, 0, np.where((dice.random((400, 5)) < 0.85) == label[:, None], 1, -1)).astype(np.int8)
    truth = [float(y) if i % 10 == 0 else None for i, y in enumerate(label)]
    expected = plain_model(votes.tolist(), truth, 5)
    patterns, back = np.unique(np.column_stack([votes, [9 if t is None else int(t) for t in truth]]), axis=0, return_inverse=True)
    known = np.where(patterns[:, -1] == 9, np.nan, patterns[:, -1].astype(float))
    model = tx.fit_label_model(patterns[:, :-1].astype(np.int8), np.bincount(back), known, rounds=5)
    found = np.where(np.isnan(known), model.posterior(patterns[:, :-1]), known)[back]
    assert np.abs(found - expected).max() < 1e-6
    assert ((found > 0.5) == label).mean() > 0.85 and (model.accuracy > 0.7).all()


def test_voters_that_agree_lose_power():
    dice = np.random.default_rng(4)
    label = dice.random(3_000) < 0.3
    vote = lambda right: np.where((dice.random(3_000) < right) == label, 1, -1)
    one = vote(0.8)
    votes = np.column_stack([one, one, one, vote(0.8), vote(0.8)]).astype(np.int8)
    patterns, back = np.unique(np.column_stack([votes, label]), axis=0, return_inverse=True)
    model = tx.fit_label_model(patterns[:, :5].astype(np.int8), np.bincount(back), patterns[:, 5].astype(float))
    assert max(model.power[:3]) < 0.7 < min(model.power[3:]) and model.correlation[0, 1] > 0.95


def test_votes_and_scores_equal_plain_ones():
    voters = tx.Voters([("badword", 3.0), ("otherbad", 2.9), ("stemm-", 2.8)])
    texts = ["You are a moron, you idiot", "a Badword here", "stemming otherbad", "quiet text", "", "HEY YOU!! idiot", "f**k it", "LOUD NOISE!!"]
    got = [dict(zip(tx.VOTERS, row)) for row in voters.votes(pa.array(texts)).tolist()]
    assert got[0]["persons"] == got[0]["direct"] == got[0]["several"] == 1 and got[0]["nothing"] == 0
    assert got[1]["words_a"] == 1 and got[1]["several"] == 0 and got[2]["stems"] == got[2]["words_b"] == 1
    assert got[3]["nothing"] == got[4]["nothing"] == -1 and got[5]["shout"] == 1 and got[6]["masked"] == 1 and got[7]["shout"] == -1
    linear = tx.Linear({"badword": 2.0, "badwo-": 0.5, "quiet": -1.0}, -1.5)
    plain = []
    for text in texts:
        held = {n for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() for n in (w, *tx.stems(w))}
        plain.append(1 / (1 + math.exp(-(linear.constant + sum(linear.weights.get(n, 0) for n in held)))))
    assert linear.score(pa.array(texts)).tolist() == pytest.approx(plain)


def test_linear_fit_separates_soft_labels():
    dice = np.random.default_rng(5)
    rows = [([0, 2] if i % 4 == 0 else [1, 2] if i % 2 else [2], 0.95 if i % 4 == 0 else 0.03) for i in range(400)]
    dice.shuffle(rows)
    linear = tx.fit_linear([(list(map(int, h)), float(y)) for h, y in rows], ["bad", "good", "both"])
    logit = lambda held: linear.constant + sum(linear.weights[n] for n in held)
    assert logit(["bad", "both"]) == pytest.approx(math.log(0.95 / 0.05), abs=0.5) and logit(["both"]) < -2.5


def corpus(spark, rows):
    return make(spark, [(i, t) for i, (t, _) in enumerate(rows)]), spark.createDataFrame(
        [(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")


def test_listed_words_that_training_lacks_still_count(spark):
    """Only one insult is ever seen; the others of the lists raise the score, and plain words do not."""
    rows = [(f"some calm text number n{i} about weather and gardens", 0) for i in range(300)]
    rows += [(f"what a moron you are, you moron n{i} worthless idiot", 1) for i in range(40)]
    docs, labels = corpus(spark, rows)
    _, model, linear = tx.fit(docs, labels)
    scores = linear.score(pa.array([
        "calm words of another kind", "i will kill and strangle you, bitch", "retardado de mierda asshole", "you are a moron and an idiot", "weather and gardens"]))
    assert scores[0] < 0.1 and scores[4] < 0.1 and min(scores[1:4]) > 0.5
    assert all(linear.weights[w] > 0 for held in tx.LEXICON_SETS.values() for w in held)


def test_awkward_tables(spark):
    docs, labels = make(spark, EDGES), spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    _, _, linear = tx.fit(docs, labels)
    found = tx.score(docs, linear).collect()
    assert len(found) == len(EDGES) and all(0 <= r["score"] <= 1 for r in found)
    _, _, empty = tx.fit(docs.limit(0), labels.limit(0))
    assert tx.score(docs.limit(0), empty).isEmpty() and len(tx.score(docs, empty).collect()) == len(EDGES)
