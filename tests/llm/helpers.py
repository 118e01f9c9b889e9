"""Small document tables with awkward rows, shared by the tests of the text operators."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, key long, label long, "
    "words int, size int, hash long, ids string, start long, y double, score double, members string, _gone long"
)
LONG = "word and other words follow each other here. " * 6_000


def make(spark, rows, partitions=3):
    """(doc_id, text) or (doc_id, text, lang) rows, with columns whose names operators use themselves."""
    full = [(*r, *(None,) * (3 - len(r)), "s", None, "x", 1, 2, 3, 4, 5, 6, "i", 7, 0.5, 0.25, "m", 8) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, "Same text twice."),
    (7, "Same text twice."), (8, "Same text twice."), (9, "123 456 !!! ***"), (None, "a text without an id at all"),
    (10, "日本語のテキスト 😀 ​﻿ ▁ ́x"), (11, "x" * 50_000),
]


def by_id(frame, *columns):
    """{doc_id: row of columns}; every column in order where none are named."""
    columns = columns or [c for c in frame.columns if c != "doc_id"]
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}
