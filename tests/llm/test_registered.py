"""The registered text queries against their SQL, and the pipeline against its stages done plainly."""

import hashlib
import re
from collections import Counter
from math import log

import pytest

import corpus_pipeline
from compare import connect, duck_rows, spark_rows
from cropscan.llm.common import table
from cropscan.llm.language_id import classify, learn, train_rows
from cropscan.llm.oracle import ORACLE
from cropscan.llm.queries import QUERIES
from test_ngram_jaccard import brute


def test_all_are_registered():
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.items() <= entry.oracle_sql().items()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert (columns, rows) == duck_rows(connect(sf_dir), ORACLE[name])


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def holds_item(text, items, weight, n_items):
    doc = words(text)
    for item in items:
        k = min(5, len(item))
        cut = lambda w: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
        whole = cut(item)
        starts = {i - j for i in range(len(doc) - k + 1) for j in range(len(item) - k + 1) if doc[i:i + k] == item[j:j + k]}
        for start in starts:
            window = cut(doc[max(0, start):start + len(item)])
            total = lambda s: sum(log(1 + n_items / max(1, weight[x])) for x in s)
            if total(whole & window) >= 0.8 * total(whole | window):
                return True
    return False


def test_pipeline_equals_its_stages_done_plainly(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    told = {r["doc_id"] for r in classify(docs, learn(train_rows(docs))).where("not rejected").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in told}
    last = {}
    for doc in sorted(rows):
        last[rows[doc] or ""] = doc
    rows = {d: rows[d] for d in last.values()}
    rows = {d: t for d, t in rows.items() if brute_of(rows)[d] == d}
    items = [w for w in {tuple(words(r["text"])) for r in table(spark, sf_dir, "benchmark").collect()} if w]
    weight = Counter(x for w in items for x in {w[i:i + min(5, len(w))] for i in range(len(w) - min(5, len(w)) + 1)})
    firsts = {w[i:i + 5] for w in items for i in range(len(w) - 4)}

    def hit(text):
        doc = words(text)
        near = any(tuple(doc[i:i + 5]) in firsts for i in range(len(doc) - 4))
        return near and holds_item(text, [list(w) for w in items], weight, len(items))

    expected = {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in rows.items() if not hit(t)}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["text_sha256"] for r in found} == expected and len(found) == len(expected)
    assert all(r["lossless"] for r in found)


_components = {}


def brute_of(rows):
    key = tuple(sorted(rows))
    if key not in _components:
        _components[key] = {d: c for d, (_, c) in brute(list(rows.items())).items()}
    return _components[key]


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
