import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cropscan.llm import packing as pk
from cropscan.llm.common import table
from helpers import EDGES, LONG, make


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(pk.default_tokenizer())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def checked(pieces, capacity=2048):
    """Pieces by row: gapless sequences within capacity; returns fill by sequence."""
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fill = {}
    for name, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        fill[name] = at
    return fill


def padding(fill, capacity=2048):
    return sum(capacity - n for n in fill.values() if n & (n - 1))


def test_every_id_is_in_one_piece(spark, sf_dir, tokenizer):
    docs = table(spark, sf_dir, "documents")
    ids = {r["doc_id"]: np.array(whole(tokenizer, r["text"]), "<u4") for r in docs.collect()}
    pieces = pk.packing_query(docs).collect()
    at = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {d: len(own) for d, own in ids.items()}
    fill = checked(pieces)
    assert padding(fill) < 0.002 * sum(fill.values())


def test_sequences_are_put_together(spark, sf_dir, tokenizer, tmp_path):
    docs = table(spark, sf_dir, "documents").limit(40)
    pieces = pk.packed(docs)
    pieces.write.parquet(str(tmp_path / "pieces"))
    pieces = spark.read.parquet(str(tmp_path / "pieces"))
    rows = {r["sequence_id"]: r for r in pk.sequences(pieces).collect()}
    for r in pieces.collect():
        own = np.frombuffer(rows[r["sequence_id"]]["ids"], "<u4")
        assert own[r["offset"]:r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
    for r in rows.values():
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * n and r["padding"] == (0 if n & (n - 1) == 0 else 2048 - n)


def test_classes_hold_a_fixed_number_of_pieces():
    worker = pk._Worker(3, 2048)
    lengths = np.array([40] * 120 + [64] * 40 + [2048] * 2)  # 51 to a sequence, 32, 1
    info = [np.arange(len(lengths)), np.zeros(len(lengths), bool), np.zeros_like(lengths), lengths, lengths]
    out = worker.add(info, np.arange(lengths.sum(), dtype=np.uint32)).to_pylist()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert sorted(by.values(), key=len) == [[2048], [2048], [64] * 32, [40] * 51, [40] * 51]
    left = worker.end().to_pylist()
    assert sum(r["length"] for r in left) == 18 * 40 + 8 * 64
    fill = checked(out + left)
    assert all(n & (n - 1) == 0 or n >= 2040 for n in fill.values()) and all(s >> 32 == 3 for s in fill)


@pytest.mark.parametrize("capacity, least", [(2048, 64), (16, 4), (8, 1), (2048, 1)])
def test_cuts_of_any_length(capacity, least):
    lengths = np.arange(1, 3 * capacity + 2)
    row, start, size = pk.cut(lengths, capacity, least)
    for i, n in enumerate(lengths):
        mine = row == i
        assert size[mine].sum() == n and (start[mine] == np.cumsum(size[mine]) - size[mine]).all()
        tail = [s for s in size[mine] if s & (s - 1)]
        assert len(tail) <= 1 and all(s < least for s in tail)


def test_awkward_rows(spark, tokenizer):
    rows = [*EDGES, (20, "<|endoftext|> in the text<|endoftext|>"), (21, " private sign "), (22, "a.b. c,d , e .\n\nf"), (23, "don't we'll  double   spaces  x \x85 y\x1cz"), (24, "é. è, ñ\n")]
    pieces = pk.packed(make(spark, rows)).collect()
    found = {}
    for r in pieces:
        found.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    expected = {(d, len(whole(tokenizer, t))) for d, t in rows}
    assert set(found) == expected
    for d, t in rows:
        if d not in (None, 7):
            own = whole(tokenizer, t)
            assert b"".join(p for _, p in sorted(found[d, len(own)])) == np.array(own, "<u4").tobytes()
    checked(pieces)
    assert pk.packed(make(spark, rows).limit(0)).isEmpty()
    with pytest.raises(ValueError, match="powers of two"):
        pk.packed(make(spark, rows), capacity=100)


def test_runs_apart_are_texts_whole(tokenizer):
    """Random texts of awkward signs: encoding runs apart gives the tokenizer's own ids."""
    dice = random.Random(8)
    signs = ["a", "Word", "the", "é", "ß", "日本", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", "!", "<|endoftext|>", " ", " ", "\r\n", "😀", "ͅ", "ǅ", "-", "_", "²"]
    texts = ["".join(dice.choices(signs, k=dice.randint(0, 40))) for _ in range(4_000)]
    ids, bounds = pk.encode_column(pa.array(texts), pk.default_tokenizer())
    for text, low, high in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[low:high].tolist() == whole(tokenizer, text), repr(text)


def test_a_rerun_worker_gives_the_same(spark):
    docs = make(spark, [(i, LONG[:i * 37]) for i in range(300)], partitions=3)
    key = [F.col(c) for c in ("doc_id", "start", "length", "sequence_id", "offset")]
    first, again = (sorted(map(tuple, pk.packed(docs).select(*key).collect())) for _ in range(2))
    assert first == again
