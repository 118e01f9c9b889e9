"""A corpus pipeline: language, exact copies, near copies, benchmark passages, pieces.

Each stage reads what the one before it wrote; all but the last return the columns of
``documents``. The last returns the sampled pieces of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cropscan.llm.common import table
from cropscan.llm.decontamination import without_benchmark
from cropscan.llm.exact_dedup import without_copies
from cropscan.llm.language_id import learn, train_rows, without_rejected
from cropscan.llm.ngram_jaccard import one_of_each
from cropscan.llm.sentence_pieces import encode_and_decode
from cropscan.session import fresh_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; ``lang`` itself stays as it was."""
    return without_rejected(docs, learn(train_rows(docs)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the smallest doc_id."""
    return one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document, and whether it spells the text again."""
    return encode_and_decode(docs)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("pieces", pieces),
]

#: The language stage compresses and the last one draws from hashes: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
