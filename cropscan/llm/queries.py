"""The registered queries of the text operators."""

from __future__ import annotations

import corpus_pipeline

from .centroids import cluster_query
from .collocations import collocations
from .common import table
from .decontamination import contaminated
from .exact_dedup import exact_duplicates
from .language_id import language_query
from .ngram_jaccard import jaccard_components
from .packing import packing_query
from .pii import find_personal_data
from .quality import quality_query
from .secrets import find_secrets
from .sentence_pieces import encode_and_decode
from .token_binary import round_trip
from .toxicity import toxicity_query


def _over_documents(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def benchmark_query(spark, sf_dir):
    """The fingerprints' distance is left out: SQL has no such hash to compare it with."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr(
        "doc_id", "item_id", "cast(n_words AS long) AS n_words", "cast(start_word AS long) AS start_word", "similarity")


def centroid_query(spark, sf_dir):
    """How often a vector was scanned is left out: SQL scans all of them every time."""
    return cluster_query(table(spark, sf_dir, "embeddings")).drop("scans")


QUERIES = {
    "op1_pii": _over_documents(find_personal_data),
    "op10_toxicity": toxicity_query,
    "op11_collocations": _over_documents(collocations),
    "op12_centroids": centroid_query,
    "op13_packing": _over_documents(packing_query),
    "op2_sentencepiece": _over_documents(encode_and_decode),
    "op3_token_binary": _over_documents(round_trip),
    "op4_decontamination": benchmark_query,
    "op5_exact_dedup": _over_documents(exact_duplicates),
    "op6_quality": quality_query,
    "op7_language_id": language_query,
    "op8_secrets": _over_documents(find_secrets),
    "op9_ngram_jaccard": _over_documents(jaccard_components),
    "pipeline": corpus_pipeline.run,
}
