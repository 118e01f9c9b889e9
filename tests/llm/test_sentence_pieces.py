import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cropscan.llm import sentence_pieces as sp
from helpers import EDGES, LONG, make

PIECES = sp.load(sp.default_model())


def vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    order = {int(i): w for i, w in zip(PIECES.ids, PIECES.weights, strict=True)}
    return {model.id_to_piece(i).replace(sp.SPACE, " "): (i, w) for i, w in order.items()}


VOCABULARY = vocabulary()


def segmentations(text):
    """(ids, log weight) of every way to cut ``text``."""
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in VOCABULARY:
            i, w = VOCABULARY[text[:n]]
            out += [((i, *rest), w + v) for rest, v in segmentations(text[n:])]
    return out


def draw_many(text, n):
    column = pa.array([text] * n)
    ids, bounds = sp.sample(column, sp.row_keys(pa.array(range(n), pa.int64()), 0), PIECES)
    return Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


@pytest.mark.parametrize("text", ["cat", " the", "other", "a  b"])
def test_draws_follow_the_lattice(text):
    ways = segmentations(text)
    total = math.fsum(math.exp(w) for _, w in ways)
    exact = {ids: math.exp(w) / total for ids, w in ways}
    n = 20_000
    seen = draw_many(text, n)
    assert set(seen) <= set(exact)
    for ids, p in exact.items():
        assert abs(seen[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


@pytest.mark.parametrize("word", ["cat", " other", "zebras", "ab" * 6])
def test_forward_weights_sum_all_segmentations(word):
    lattice = sp.Lattice([word, "x", word + "s"], PIECES)
    state = int(lattice.state(np.array([0]))[0])
    assert lattice.forward[state] == pytest.approx(math.log(math.fsum(math.exp(w) for _, w in segmentations(word))))


def test_every_text_comes_back():
    texts = ["", " ", "   ", "a", " a", "a ", "a  b   c", "▁ is no space", "日本語 😀 ​\x00\x01", "\n\t\r", LONG, "x" * 30_000, "é́ ﷽"]
    column = pa.array(texts)
    for seed in range(3):
        ids, bounds = sp.sample(column, sp.row_keys(pa.array(range(len(texts)), pa.int64()), seed), PIECES)
        assert sp.spell(ids, bounds, PIECES).cast(pa.string()).to_pylist() == texts


def test_pieces_depend_on_the_row_alone(spark):
    rows = [(i, f"the same words in document {i % 3}, again and again") for i in range(50)] + [(6, LONG)]
    one = {(r["doc_id"], r["text_sha256"]): bytes(r["ids"]) for r in sp.encode(make(spark, rows, 1)).collect()}
    many = {(r["doc_id"], r["text_sha256"]): bytes(r["ids"]) for r in sp.encode(make(spark, rows[::-1], 7)).collect()}
    assert one == many
    assert len({v for (d, _), v in one.items() if d != 6}) > 12
    other = {(r["doc_id"], r["text_sha256"]): bytes(r["ids"]) for r in sp.encode(make(spark, rows), seed=1).collect()}
    assert sum(other[k] != one[k] for k in one) > 25


def test_edges(spark):
    rows = sp.encode_and_decode(make(spark, EDGES)).collect()
    assert len(rows) == len(EDGES) and all(r["lossless"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert len({(r["doc_id"], r["ids_crc32"]) for r in rows if r["doc_id"] == 7}) == 1
    assert sp.encode_and_decode(make(spark, [])).collect() == []


def test_digests_are_those_of_encode_and_decode(spark):
    docs = make(spark, EDGES)
    chained = sp.decode(sp.encode(docs)).selectExpr(
        "doc_id", "cast(length(ids) / 4 AS long) AS n_pieces", "crc32(ids) AS ids_crc32", "text_sha256",
        "sha2(text, 256) = text_sha256 AS lossless")
    once = sp.encode_and_decode(docs).select(*chained.columns)
    assert sorted(map(str, chained.collect())) == sorted(map(str, once.collect()))


def test_long_words_are_cut_as_short_ones(monkeypatch):
    """One state at a time or all words at once: the same pieces, wherever the word stands in the row."""
    dice = random.Random(12)
    for n in range(60):
        text = "".join(dice.choices(["the", "ing", " ", "a", "日", "😀", "xx", "qz", " word", "   "], k=60))
        rows, keys = pa.array([text, text[:30], "", text[::-1]]), sp.row_keys(pa.array([n, n, 7, None]), 3)
        whole = sp.sample(rows, keys, PIECES)
        with monkeypatch.context() as patch:
            patch.setattr(sp, "LONG_WORD", 3)
            apart = sp.sample(rows, keys, PIECES)
        assert whole[0].tolist() == apart[0].tolist() and whole[1].tolist() == apart[1].tolist()


@pytest.mark.parametrize("sign", ["x", "日本語", "aB3/", "="])
def test_texts_without_spaces_take_linear_time(sign):
    dice = random.Random(13)
    text = "".join(dice.choices(sign, k=200_000))
    began = time.perf_counter()
    ids, bounds = sp.sample(pa.array([text]), sp.row_keys(pa.array([1]), 0), PIECES)
    assert time.perf_counter() - began < 6
    assert sp.spell(ids, bounds, PIECES).to_pylist()[0].decode() == text
