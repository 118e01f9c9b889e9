import random

import pyarrow as pa
import pytest
import regex
import zstandard
from pyspark.sql import Row
from pyspark.sql import functions as F

from cropscan.llm import language_id as li
from cropscan.llm.common import held_out, table
from helpers import EDGES, by_id, make

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = table(spark, MIDDLE, "documents").where("lang is not null and length(text) > 200")
    found = li.language_query(spark, MIDDLE).where("held_out").join(truth, "doc_id")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right / n > 0.95


def test_training_rows_are_not_held_out(spark):
    docs = table(spark, MIDDLE, "documents")
    assert li.train_rows(docs).where(held_out(4, 2)).count() == 0
    assert set(li.learn(li.train_rows(docs))) == {"de", "en", "es", "fr"}


def test_edges(spark):
    learned = {"aa": b"one two three four five six word and other words follow", "bb": b"xyz qrs tuv"}
    found = by_id(li.classify(make(spark, EDGES), learned), "lang_pred", "score", "rejected")
    for doc in (1, 2, 3, 9):
        assert found[doc] == (li.UNKNOWN, 0.0, True)
    assert found[6][0] == "aa" and found[6][1] > 0.99 and not found[6][2]
    assert all(0 <= s <= 1 for _, s, _ in found.values())
    nothing = by_id(li.classify(make(spark, EDGES), {}), "lang_pred", "rejected")
    assert set(nothing.values()) == {(li.UNKNOWN, True)}
    assert li.learn(make(spark, [])) == {}
    assert li.classify(make(spark, []), learned).collect() == []


def test_a_tie_is_rejected_and_named_first(spark):
    same = {"bb": b"some words of text", "aa": b"some words of text"}
    assert by_id(li.classify(make(spark, [(1, "some words of text here")]), same), "lang_pred", "margin", "rejected") == {1: ("aa", 0, True)}


def test_filter_keeps_rows_as_they_were(spark):
    learned = {"aa": b"one two three four five six word and other words follow each", "bb": b"xyz qrs tuv"}
    docs = make(spark, EDGES)
    kept = li.without_rejected(docs, learned)
    told = li.classify(docs, learned).where("not rejected")
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in told.collect())
    assert {r["n_chars"] for r in kept.collect()} == {r["n_chars"] for r in docs.collect()}


def rejected_part(coder, texts):
    return sum(li.judged(pa.array(texts), coder)["rejected"]) / len(texts)


def test_texts_of_no_learned_language_are_rejected_at_any_length(spark):
    docs = table(spark, MIDDLE, "documents")
    learned = li.learn(li.train_rows(docs))
    coder = li.Compressors(learned, li.least_margins(learned))
    random.seed(17)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = "ka ta li nen ssa sta ko mi tu va pu hyv jo ki en ra ää yö uo ie ne ve ja me te si su ru po pe".split()

    def made(parts, low, high, words):
        return " ".join("".join(random.choices(parts, k=random.randint(low, high))) for _ in range(words))

    for words in (50, 300, 3_000):
        assert rejected_part(coder, [made(letters, 2, 9, words) for _ in range(20)]) == 1
        assert rejected_part(coder, [made(syllables, 1, 5, words) for _ in range(20)]) == 1

    clean = docs.where(held_out(4, 2)).where("length(text) > 200").select("lang", "text").orderBy("doc_id").collect()
    assert rejected_part(coder, [r["text"] for r in clean]) < 0.02
    sentences = {}
    for r in clean:
        sentences.setdefault(r["lang"], []).extend(x for x in r["text"].split(".") if len(x) > 20 and "|" not in x)
    for chars, least in ((1_000, 0.6), (8_000, 0.7)):
        texts = []
        for _ in range(40):
            pair, halves = random.sample(sorted(sentences), 2), ([], [])
            while sum(map(len, halves[0] + halves[1])) < chars:
                side = sum(map(len, halves[0])) > sum(map(len, halves[1]))
                halves[side].append(random.choice(sentences[pair[side]]))
            texts.append(". ".join(halves[0] + halves[1]))
        assert rejected_part(coder, texts) >= least, chars


def plain_sizes(text, dictionaries):
    """Every block of every language by a fresh compressor, without what the operator prepares and shares."""
    sizes = []
    for name in sorted(dictionaries):
        def coded(piece):
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)  # noqa: B023
            coder = zstandard.ZstdCompressor(
                level=li.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
            return len(coder.compress(piece.encode()))
        blocks = sum(coded(text[i:i + li.BLOCK_CHARS]) for i in range(0, len(text), li.BLOCK_CHARS))
        words = text.split(" ")
        sizes.append((blocks, sum(coded(" ".join(words[i:i + li.PIECE_WORDS])) for i in range(0, len(words), li.PIECE_WORDS))))
    low = sorted(b for b, _ in sizes)[:2]
    narrow = low[-1] - low[0] < li.NARROW and len(sizes) > 1
    return [b + p if narrow else b for b, p in sizes]


def test_predictions_equal_plain_compression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dictionaries = li.learn(li.train_rows(docs), passages=20)
    names = sorted(dictionaries)
    rows = docs.select("doc_id", "text").limit(40).collect() + [Row(doc_id=-1, text=None), Row(doc_id=-2, text="12 !"), Row(doc_id=-3, text="ab")]
    found = {r["doc_id"]: r for r in li.classify(spark.createDataFrame(rows, "doc_id long, text string"), dictionaries).collect()}
    for row in rows:
        text = " ".join(regex.findall(r"[\p{L}\p{M}]+", (row["text"] or "").lower()))
        got = found[row["doc_id"]]
        if not text:
            assert (got["lang_pred"], got["score"], got["rejected"]) == ("und", 0.0, True)
            continue
        sizes = plain_sizes(text, dictionaries)
        order = sorted(range(len(names)), key=lambda i: (sizes[i], i))
        assert got["lang_pred"] == names[order[0]] and got["margin"] == sizes[order[1]] - sizes[order[0]]
        assert got["score"] == pytest.approx(1 / sum(2.0 ** max(-60, sizes[order[0]] - s) for s in sizes))
