"""Benchmark passages in documents: SimHash of item-sized windows, multi-index blocks, exact check.

DataFrame functions only. A window has as many words as some item. Windows are cut where a document
has a shingle of an item of that size, at the place that lines the two up: a window that
shares no shingle with any item has similarity 0 with all of them. Windows and items meet on
blocks of their SimHash; the blocks guarantee every pair of fingerprints within RADIUS. What
meets is decided by the exact weighted similarity of the shingle sets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropscan.session import stored

from .common import bounded, free_names, prepare, text_digest, texts

SHINGLE = 5
SIMILARITY = 0.8

BITS, BLOCKS = 64, 8
WIDTH = BITS // BLOCKS
#: Blocks may differ in this many bits, so fingerprints may differ in BLOCKS * (REACH + 1) - 1.
REACH = 2
RADIUS = BLOCKS * (REACH + 1) - 1
#: All ways to change up to REACH bits of a block.
CHANGES = [sum(1 << b for b in bits) for n in range(REACH + 1) for bits in combinations(range(WIDTH), n)]

def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles in order; none if there are fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(
        F.size(words) >= k, F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    ).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """Each bit is what more than half of the hashes have there."""
    def bit(place: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, place).bitwiseAND(1).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def block_values(fingerprint: Column) -> Column:
    return F.array(*(
        F.struct(F.lit(i).alias("block"),
                 F.shiftrightunsigned(fingerprint, i * WIDTH).bitwiseAND((1 << WIDTH) - 1).cast("int").alias("value"))
        for i in range(BLOCKS)))


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, n_words, k, hashes): items without a word are left out; k is smaller in shorter items.

    Rows that repeat an item with the same text count once.
    """
    words = benchmark.select("item_id", word_list(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).distinct()
    sized = words.withColumn("n_words", F.size("words")).where("n_words > 0").withColumn("k", F.least("n_words", F.lit(shingle)))
    hashes = F.coalesce(*(F.when(F.col("k") == k, shingle_hashes(F.col("words"), k)) for k in range(1, shingle + 1)))
    return sized.select("item_id", "n_words", "k", hashes.alias("hashes"))


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, n_words, start_word, hamming, similarity.

    The similarity of window and item is the weight of their common shingles over that of all their
    shingles; a shingle of n of N items weighs ln(1 + N / max(n, 1)). Of several windows the most
    similar is told, the first of equals. Null and empty texts, on either side, and empty tables
    give no rows. Rows that share a doc_id are told together; a null doc_id cannot be told.
    """
    return _matches(texts(docs), benchmark, shingle, similarity)


def _matches(source: DataFrame, benchmark: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``contaminated`` for (doc_id, text) rows, with a doc_id of any type."""
    items = stored(benchmark_items(benchmark, shingle), "items")
    n_items = items.count()
    if not n_items:
        return source.limit(0).select("doc_id", *(F.lit(None).cast(kind).alias(name) for name, kind in _RESULT.items()))
    item_shingles = stored(
        items.select("item_id", "n_words", "k", F.posexplode("hashes").alias("item_pos", "hash")), "item-shingles")
    known = item_shingles.groupBy("k", "hash").agg(F.countDistinct("item_id").alias("n"))
    weights = bounded(stored(known.select("k", "hash", F.log1p(n_items / F.col("n")).alias("weight")), "item-weights"))
    unseen = F.log1p(F.lit(float(n_items)))

    # Where documents carry a shingle of an item, and the windows that line up with it.
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most ``shingle`` numbers
    anchors = bounded(stored(
        item_shingles.groupBy("k", "hash", "n_words").agg(F.collect_set("item_pos").alias("places")), "anchors"))
    seen = None
    for k in sorted(sizes):
        hashed = source.select("doc_id", word_list(F.col("text")).alias("words")).select(
            "doc_id", F.size("words").alias("doc_words"), F.posexplode(shingle_hashes(F.col("words"), k)).alias("pos", "hash"))
        one = hashed.join(anchors.where(F.col("k") == k), "hash").select(
            "doc_id", "n_words", "k", F.explode("places").alias("place"), "pos", "doc_words").select(
            "doc_id", "n_words", "k", (F.col("pos") - F.col("place")).alias("start"))
        seen = one if seen is None else seen.union(one)
    windows = stored(seen.distinct(), "windows")
    holders = bounded(stored(windows.select("doc_id").distinct(), "holders"))

    cut = None
    for k in sorted(sizes):
        hashed = source.join(holders, "doc_id", "left_semi").select("doc_id", word_list(F.col("text")).alias("words")).select(
            "doc_id", shingle_hashes(F.col("words"), k).alias("all"))
        first = F.greatest(F.col("start"), F.lit(0))
        last = F.least(F.col("start") + F.col("n_words") - k, F.size("all") - 1)
        one = windows.where(F.col("k") == k).join(hashed, "doc_id").select(
            "doc_id", "n_words", "k", "start", F.slice("all", first + 1, F.greatest(last - first + 1, F.lit(0))).alias("hashes")
        ).where(F.size("hashes") > 0)
        cut = one if cut is None else cut.union(one)
    # Rows that share a doc_id may have different texts; ``own`` keeps their windows apart and equal ones together.
    cut = cut.withColumn("own", F.xxhash64("hashes")).dropDuplicates(["doc_id", "n_words", "k", "start", "own"])
    windows = stored(cut.withColumn("mark", simhash(F.col("hashes"))), "window-marks")

    # Every pair of fingerprints within RADIUS, by blocks.
    item_marks = items.select("item_id", "n_words", simhash(F.col("hashes")).alias("item_mark"))
    item_blocks = item_marks.select("*", F.explode(block_values(F.col("item_mark"))).alias("b")).select(
        "item_id", "n_words", "item_mark", "b.block", F.explode(F.array(*map(F.lit, CHANGES))).alias("change"), "b.value")
    item_blocks = bounded(stored(item_blocks.select(
        "item_id", "n_words", "item_mark", "block", F.col("value").bitwiseXOR(F.col("change")).alias("value")), "item-blocks"))
    window_blocks = windows.select("doc_id", "n_words", "start", "own", "mark", F.explode(block_values(F.col("mark"))).alias("b")).select(
        "doc_id", "n_words", "start", "own", "mark", "b.block", "b.value")
    hamming = F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark")))
    near = window_blocks.join(item_blocks, ["n_words", "block", "value"]).withColumn("hamming", hamming).where(
        F.col("hamming") <= RADIUS).select("doc_id", "n_words", "start", "own", "item_id", "hamming").distinct()

    # The exact similarity of what met.
    pairs = near.join(windows.select("doc_id", "n_words", "k", "start", "own", "hashes"), ["doc_id", "n_words", "start", "own"])
    shared = bounded(stored(item_shingles.select("item_id", "k", "hash").distinct().withColumn("common", F.lit(True)), "item-sets"))
    item_weight = bounded(stored(
        shared.join(weights, ["k", "hash"]).groupBy("item_id").agg(F.sum("weight").alias("item_weight")), "item-totals"))
    each = pairs.select("doc_id", "n_words", "k", "start", "own", "item_id", "hamming", F.explode(F.array_distinct("hashes")).alias("hash"))
    scored = (
        each.join(weights, ["k", "hash"], "left").join(shared, ["item_id", "k", "hash"], "left")
        .withColumn("weight", F.coalesce("weight", unseen))
        .groupBy("doc_id", "item_id", "n_words", "start", "own", "hamming")
        .agg(F.sum("weight").alias("window_weight"),
             F.sum(F.when(F.col("common"), F.col("weight")).otherwise(0.0)).alias("both"))
        .join(item_weight, "item_id")
        .withColumn("similarity", F.round(F.col("both") / (F.col("item_weight") + F.col("window_weight") - F.col("both")), 6))
        .where(F.col("similarity") >= similarity)
    )
    return scored.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words", "hamming")).alias("best")
    ).select(
        "doc_id", "item_id", "best.n_words", F.greatest(-F.col("best.before"), F.lit(0)).alias("start_word"),
        "best.hamming", "best.similarity")


_RESULT = {"item_id": "long", "n_words": "int", "start_word": "int", "hamming": "int", "similarity": "double"}


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Texts are told by their digest: of rows that share a doc_id only those with an item go, and a null
    doc_id is no shelter. Null and empty texts stay; without items all rows do. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    (digest,) = free_names(docs, "_digest")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(text_digest().alias("doc_id"), text.alias("text"))
    found = _matches(source, benchmark, SHINGLE, SIMILARITY).select(F.col("doc_id").alias("_bad")).distinct()
    bad = stored(found, "contaminated")
    keyed = docs.withColumn(digest, text_digest())
    return keyed.join(bounded(bad), keyed[digest] == bad["_bad"], "left_anti").select(*docs.columns)
