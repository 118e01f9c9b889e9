"""Every stage of the pipeline on awkward tables: repeated and null ids, clashing names, nothing known, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cropscan.llm import common, decontamination, exact_dedup, ngram_jaccard
from cropscan.llm.decontamination import contaminated, without_benchmark
from cropscan.llm.exact_dedup import exact_duplicates, without_copies
from cropscan.llm.language_id import learn, train_rows, without_rejected
from cropscan.llm.ngram_jaccard import jaccard_components, one_of_each
from helpers import EDGES, make

A = " ".join(f"alpha{i} beta{i % 7} gamma{i % 11}" for i in range(60))
B = " ".join(f"delta{i} epsilon{i % 5} zeta{i % 13}" for i in range(60))
ITEM = "who painted the large blue horse on the northern wall of the old town hall in winter"
ITEMS = "item_id long, text string"


def kept(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_near_copies_go_by_text_not_by_id(spark):
    """Doc 5 is a near copy of 3 in one row and the first of its own kind in another."""
    rows = [(3, A), (5, A + " more"), (5, B), (8, B + " end"), (None, A), (9, "")]
    stays = kept(one_of_each(make(spark, rows)))
    assert stays == sorted([(3, A), (5, B), (None, A), (9, "")], key=str)


def test_rows_of_one_id_are_as_if_linked(spark):
    rows = [(3, A), (5, A + " more"), (5, B), (8, B + " end"), (12, "nothing like it at all"), (None, B)]
    found = {(r["doc_id"], r["component_id"]) for r in jaccard_components(make(spark, rows)).collect()}
    assert found == {(3, 3), (5, 3), (8, 3), (12, 12), (None, None)}
    two_classes = make(spark, [(3, A), (3, B), (7, A + " more"), (4, B + " end")])
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_components(two_classes).collect()} == {(3, 3), (7, 3), (4, 3)}


def test_a_repeated_id_is_verified_by_its_own_text(spark):
    """The other row of id 5 must not speak for the one that is compared."""
    rows = [(5, A), (5, "short and different words only here"), (6, A + " more"), (7, "short and different words only there")]
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_components(make(spark, rows)).collect()}
    assert found[(5, 178)] == found[(5, 4)] == 5 and found[(7, 4)] == 7 and found[(6, 179)] == 5


def test_benchmark_goes_by_text_not_by_id(spark):
    clean = "a text of its own that has nothing to do with any question whatever it may be"
    items = spark.createDataFrame([(1, ITEM)], ITEMS)
    rows = [(7, f"before {ITEM} after"), (7, clean), (None, ITEM), (None, clean), (8, None), (9, "")]
    assert kept(without_benchmark(make(spark, rows), items)) == sorted([(7, clean), (None, clean), (8, None), (9, "")], key=str)
    assert without_benchmark(make(spark, rows), items.limit(0)).count() == len(rows)
    assert without_benchmark(make(spark, rows).limit(0), items).isEmpty()


def test_no_known_language_keeps_the_corpus(spark):
    docs = make(spark, [(1, A), (2, B), (3, None)])
    assert learn(train_rows(docs)) == {}
    assert corpus_pipeline.language(spark, docs, None).count() == 3
    assert without_rejected(docs.limit(0), {"en": b"some words of it"}).isEmpty()


def test_columns_of_the_user_stay_as_they_are(spark):
    docs = make(spark, EDGES).withColumns({
        c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("_doc", "_OWN", "_digest", "_mark", "_id")})
    items = spark.createDataFrame([(1, ITEM)], ITEMS)
    for stage in (without_copies, one_of_each, lambda d: without_benchmark(d, items)):
        out = stage(docs)
        assert out.schema.simpleString() == docs.schema.simpleString()
        for row in out.collect():
            assert row["_doc"] == f"_doc of {row['doc_id'] or 'none'}".replace("None", "none")
            assert row["_OWN"].startswith("_OWN of ") and row["_digest"].startswith("_digest of ")


def test_empty_tables(spark):
    docs = make(spark, EDGES).limit(0)
    items = spark.createDataFrame([(1, ITEM)], ITEMS)
    for stage in (without_copies, one_of_each, lambda d: without_benchmark(d, items)):
        out = stage(docs)
        assert out.isEmpty() and out.columns == docs.columns


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


@pytest.mark.parametrize("operator", ["op4", "op5", "op9", "copies", "near", "benchmark"])
def test_without_any_broadcast(spark, sf_dir, monkeypatch, operator):
    """Beyond the bound the same rows come out of joins by shuffling."""
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    run = {
        "op4": lambda: contaminated(docs, items), "op5": lambda: exact_duplicates(docs), "op9": lambda: jaccard_components(docs),
        "copies": lambda: without_copies(docs), "near": lambda: one_of_each(docs), "benchmark": lambda: without_benchmark(docs, items),
    }[operator]
    expected = run().collect()
    shuffled = lambda narrow, rows=0: narrow.hint("merge")
    for module in (common, decontamination, exact_dedup, ngram_jaccard):
        monkeypatch.setattr(module, "bounded", shuffled)
    assert sorted(map(str, run().collect())) == sorted(map(str, expected))
