import hashlib
import random

import pyarrow as pa
import pytest

from cropscan.llm import exact_dedup as ed
from cropscan.llm.cuckoo import CuckooFilter, LiveDigests, Overflow
from helpers import EDGES, by_id, make


def sha(x):
    return hashlib.sha256(str(x).encode()).digest()


def test_filter_holds_and_forgets():
    keys = [sha(i) for i in range(5_000)]
    made = CuckooFilter.of(keys)
    assert all(k in made for k in keys)
    assert sum(sha(-i) in made for i in range(1, 5_000)) < 50
    for k in keys[:2_500]:
        assert made.delete(k)
    assert all(k in made for k in keys[2_500:])
    assert sum(k in made for k in keys[:2_500]) < 50
    back = CuckooFilter(made.buckets, made.to_bytes())
    assert all(k in back for k in keys[2_500:])


def test_overflow_is_told_and_resizing_mends_it():
    small = CuckooFilter(2)
    with pytest.raises(Overflow):
        for i in range(100):
            small.insert(sha(i))
    live = LiveDigests()
    for i in range(3_000):
        assert not live.add(sha(i), i)
    assert live.resizes > 0
    assert all(sha(i) in live.filter for i in range(3_000))
    assert live.add(sha(5), 9_000) and live.entries[sha(5)] == [9_000, 2]
    assert live.remove(sha(5)) and not live.remove(sha(5)) and not live.remove(sha("new"))


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(
        ((d, best[t or ""], len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
         for d, t in rows), key=str)


def test_equals_brute_force(spark):
    random.seed(5)
    rows = [(i, f"text {random.randint(0, 40)}" if i % 3 else "hot") for i in range(600)] + EDGES
    found = ed.exact_duplicates(make(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert ed.exact_duplicates(make(spark, [])).collect() == []


def test_what_stays(spark):
    docs = make(spark, EDGES)
    left = ed.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0 for r in left.collect())) == [0, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    repeated = ed.without_copies(make(spark, [(7, "t"), (7, "t"), (7, "u"), (6, "u")]))
    assert sorted((r["doc_id"], r["text"]) for r in repeated.collect()) == [(7, "t"), (7, "u")]


def test_index_takes_rows_in_and_out(spark):
    buckets = 4
    first = ed.digests(make(spark, [(1, "a"), (2, "b"), (3, "a")]))
    index = ed.build_index(first, buckets)
    index = ed.insert_rows(index, ed.digests(make(spark, [(9, "b"), (4, "c"), (0, "a")])), buckets)
    live = {bytes(r["digest"]): (r["keep_id"], r["n_rows"]) for r in index.where("digest is not null").collect()}
    key = lambda t: hashlib.sha256(t.encode()).digest()
    assert live == {key("a"): (3, 3), key("b"): (9, 2), key("c"): (4, 1)}
    gone = ed.digests(make(spark, [(0, "b"), (0, "never there")]))
    after = ed.delete_digests(index, gone, buckets)
    rows = after.collect()
    assert {bytes(r["digest"]) for r in rows if r["digest"] is not None} == {key("a"), key("c")}
    for r in (r for r in rows if r["cuckoo"] is not None):
        held = [bytes(x["digest"]) for x in rows if x["bucket"] == r["bucket"] and x["digest"] is not None]
        stored_filter = CuckooFilter(len(r["cuckoo"]) // 8, bytes(r["cuckoo"]))
        assert all(d in stored_filter for d in held)


def test_the_stored_filter_is_opened_and_resized_on_overflow(monkeypatch):
    """Inserting into and deleting from a stored bucket uses its filter; only an overflow makes one anew."""
    empty = ed._bucket_rows(0, LiveDigests())
    rows = lambda keys: pa.table({"bucket": pa.array([0] * len(keys), pa.int32()), "digest": pa.array(keys, pa.binary()),
                                  "doc_id": pa.array(range(len(keys)), pa.int64()), "n_rows": pa.array([1] * len(keys), pa.int64())})
    keys = [sha(i) for i in range(900)]
    made = ed._insert(empty, rows(keys[:600]))
    of, calls = CuckooFilter.of.__func__, []
    monkeypatch.setattr(CuckooFilter, "of", classmethod(lambda cls, digests, buckets=64: calls.append(len(digests)) or of(cls, digests, buckets)))
    after = ed._delete(made, rows(keys[100:200]))
    after = ed._insert(after, rows(keys[150:160]))
    assert not calls
    live = ed._loaded(after)
    assert set(live.entries) == set(keys[:100] + keys[150:160] + keys[200:600]) and all(k in live.filter for k in live.entries)
    grown = ed._loaded(ed._insert(after, rows([sha(i) for i in range(900, 6_000)])))
    assert calls and len(grown.entries) == 510 + 5_100 and all(k in grown.filter for k in grown.entries)
