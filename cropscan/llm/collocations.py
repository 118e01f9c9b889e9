"""Phrase collocations from a weighted de Bruijn graph of word runs.

Nodes are runs of three words, edges the runs of four that join two overlapping nodes. Only edges are
counted over the corpus, together with the last one, two and three words of every run of text (the
corrections for what no edge leaves). All shorter counts follow from them: a run of words occurs as often as
the edges out of it say, plus its corrections.

A place in a text gives one row: the longest run of up to four words from there on that may matter, which
is an edge, or the correction for a run that nothing extends: at a piece's end, or because the run with the next
word occurs fewer than ``LEAST`` times. A saturating counter per hash of a run tells these apart. It can only be too
high, so every occurrence of a phrase that counts begins a row at least as long. The counters have a fixed
size; a corpus that fills them gets more and longer rows, up to one edge per word, with the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropscan.session import fresh_path, materialise, stored

from .common import GOLDEN, coded, mixed, per_slice, prepare, word_hashes, words
from .token_binary import removed

#: A phrase must occur this often.
LEAST = 30
#: A candidate goes where a longer one occurs in this share of its places.
COVERED = 80
#: Phrases reported for each language.
REPORTED = 2_000
#: Words of an edge.
LONGEST = 4
#: Runs are told apart by this many bits of a hash: 2 ** 28 bits (32 MB) say which are frequent.
HASH_BITS = 28
_LOW = 16
_BUCKETS = 1 << (HASH_BITS - _LOW)
#: Parts in which the rows of a language are ordered first.
SALTS = 64
#: Phrases of more than a HOT-th of all words are looked up by broadcast: HOT of each size at most.
HOT = 5_000

_STOPS = r"[.,;:!?\x0a-\x0d]+"
COUNTED = "lang string, size int, phrase string, n long"


def _input(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


class _Words:
    """The words of a slice as numbers, and for each place how many words from there on are in one piece."""

    def __init__(self, piece: pa.RecordBatch):
        flat, bounds = words(pc.replace_substring_regex(piece["text"], _STOPS, " . "), lower=True)
        self.index, self.different = coded(flat)
        langs, self.langs = coded(piece["lang"])
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.lang = langs[row]
        stop = self.different.index(".") if "." in self.different else -1
        word = self.index != stop
        #: Places where a run of 1, 2, ... words begins.
        self.begins = [word]
        for size in range(2, LONGEST + 1):
            longer = np.zeros(len(word), bool)
            longer[:-1] = word[:-1] & self.begins[-1][1:] & (row[:-1] == row[1:])
            self.begins.append(longer)

    def keys(self, size: int, at: np.ndarray) -> np.ndarray:
        """Hash of the runs of ``size`` words that begin at ``at``, in HASH_BITS bits."""
        of_word = word_hashes(self.different)
        with np.errstate(over="ignore"):
            code = word_hashes(self.langs)[self.lang[at]] + np.uint64(size)
            for k in range(size):
                code = mixed((code ^ of_word[self.index[at + k]]) * GOLDEN)
        return (code >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def longest(self, bits: np.ndarray) -> list[np.ndarray]:
        """Places by the size of the longest run from there on of which all parts may be frequent."""
        kept = []
        for size, begins in enumerate(self.begins, start=1):
            at = begins if size == 1 else begins & kept[-1] & np.append(kept[-1][1:], False)
            at = np.flatnonzero(at)
            held = np.zeros(len(begins), bool)
            held[at] = _holds(bits, self.keys(size, at))
            kept.append(held)
        return [np.flatnonzero(one & ~more) for one, more in zip(kept, [*kept[1:], np.zeros_like(kept[0])], strict=True)]

    def runs(self, at: np.ndarray, size: int) -> dict:
        """The different runs of ``size`` words that begin at ``at``, and how often each does."""
        code, columns = self.lang[at].astype(np.uint64), []
        many = np.uint64(max(1, len(self.different)))
        for k in range(size):
            columns.append(self.index[at + k])
            code = code * many + columns[-1].astype(np.uint64)
            if k % 2:  # two words at a time fit 64 bits
                code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        dictionary = pa.array(self.different, pa.string())
        parts = [dictionary.take(pa.array(c[first])) for c in columns]
        return {
            "lang": pa.array(self.langs, pa.string()).take(pa.array(self.lang[at][first])),
            "size": np.full(len(first), size, np.int32),
            "phrase": parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " "),
            "n": n.astype(np.int64),
        }

    def totals(self) -> dict:
        """Words of each language, as runs of no word."""
        n = np.bincount(self.lang[self.begins[0]], minlength=len(self.langs))
        return {
            "lang": pa.array(self.langs, pa.string()), "size": np.zeros(len(n), np.int32),
            "phrase": pa.array([""] * len(n), pa.string()), "n": n.astype(np.int64),
        }


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bits[keys >> 3] >> (keys & 7).astype(np.uint8) & 1).astype(bool)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def frequent_bits(docs: DataFrame, least: int = LEAST) -> np.ndarray:
    """Bits of the hashes that at least ``least`` runs of one to four words have, packed; 2 ** HASH_BITS of them.

    Each slice counts its own; the counters of a bucket of hashes are added up in one task, a byte
    each that stops at 255, so that memory and what comes to the driver have a fixed bound.
    """
    if not 1 <= least <= 255:
        raise ValueError("the counters tell numbers up to 255")
    spark = docs.sparkSession

    def count(piece):
        found = _Words(piece)
        keys = [found.keys(size, np.flatnonzero(begins)) for size, begins in enumerate(found.begins, start=1)]
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        buckets = np.unique(key >> _LOW)
        bounds = np.concatenate([np.searchsorted(key >> _LOW, buckets), [len(key)]]).astype(np.int64)
        return {
            "bucket": buckets.astype(np.int32),
            "keys": _binary((key & ((1 << _LOW) - 1)).astype("<u2"), bounds),
            "counts": _binary(np.minimum(n, 255).astype(np.uint8), bounds),
        }

    def total(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, keys, counts in zip(
                    batch["bucket"].to_pylist(), batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                if bucket not in held:
                    held[bucket] = np.zeros(1 << _LOW, np.uint8)
                at = np.frombuffer(keys, "<u2")
                sums = held[bucket][at].astype(np.uint16) + np.frombuffer(counts, np.uint8)
                held[bucket][at] = np.minimum(sums, 255)
        for bucket, sums in held.items():
            bits = np.packbits(sums >= least, bitorder="little")
            if bits.any():
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    counted = per_slice(_input(docs), count, "bucket int, keys binary, counts binary")
    parts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = np.zeros((_BUCKETS, 1 << (_LOW - 3)), np.uint8)
    for row in counted.repartition(parts, "bucket").mapInArrow(total, "bucket int, bits binary").collect():
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def edges_and_ends(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(lang, size, phrase, n): edges, corrections of one to three words, and the words of each language as size 0.

    From a place where not even the word is frequent there is no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(piece):
        found = _Words(piece)
        parts = [found.totals(), *(found.runs(at, size) for size, at in enumerate(found.longest(shared.value), start=1))]
        return {
            "size": np.concatenate([p["size"] for p in parts]), "n": np.concatenate([p["n"] for p in parts]),
            **{c: pa.concat_arrays([p[c] for p in parts]) for c in ("lang", "phrase")},
        }

    return per_slice(_input(docs), work, COUNTED).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _without_last(phrase: Column, size: int) -> Column:
    return F.substring_index(phrase, " ", size - 1)


def flows(table: DataFrame, name: str = "runs") -> list[DataFrame]:
    """Occurrences of runs of one, two, three and four words, each from the runs one longer and the corrections.

    Those of ``LEAST`` occurrences are counted whole, others at most as often as they occur.
    """
    found = [table.where("size = 4")]
    for size in range(LONGEST - 1, 0, -1):
        left = found[0].select(
            "lang", F.lit(size).alias("size"), _without_last(F.col("phrase"), size + 1).alias("phrase"), "n")
        both = left.unionByName(table.where(F.col("size") == size))
        found.insert(0, stored(both.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")), f"{name}-{size}"))
    return found


def unary_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(lang, phrase): nodes with one way in and one way out that every occurrence takes.

    Such a node is inner to a path, on which all counts are equal; the path stands for it.
    """
    return (
        edges.select("lang", _without_last(F.col("phrase"), 4).alias("phrase"), F.lit(1).alias("out"), "n")
        .union(edges.select("lang", F.substring_index("phrase", " ", -3), F.lit(0), "n"))
        .groupBy("lang", "phrase")
        .agg(F.max(F.when(F.col("out") == 1, F.col("n"))).alias("next"), F.max(F.when(F.col("out") == 0, F.col("n"))).alias("before"))
        .join(nodes.select("lang", "phrase", "n"), ["lang", "phrase"])
        .where("next = n AND before = n")
        .select("lang", "phrase")
    )


def paths(nodes: DataFrame, edges: DataFrame, name: str = "paths") -> DataFrame:
    """(lang, path, place, phrase, n): edges along their maximal unary path, which its first edge names.

    Each round follows twice as many edges back, so a passage of n words takes about log n rounds. A ring
    of unary nodes can't be: text that enters one must end in it or leave it.
    """
    spark = edges.sparkSession
    inner = unary_nodes(nodes, edges)
    ends = edges.select("lang", F.substring_index("phrase", " ", -3).alias("node"), F.col("phrase").alias("back"))
    ends = ends.join(inner.withColumnRenamed("phrase", "node"), ["lang", "node"])
    begins = edges.select("lang", "phrase", "n", _without_last(F.col("phrase"), 4).alias("node"))
    at = fresh_path(spark, name)
    begins.join(ends, ["lang", "node"], "left").select(
        "lang", "phrase", "n", "back", F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("place"),
    ).withColumn("done", F.col("back").isNull()).withColumn("back", F.coalesce("back", "phrase")).write.parquet(at)
    state = spark.read.parquet(at)
    while state.where("NOT done").limit(1).count():
        far = state.select(
            "lang", F.col("phrase").alias("back"), F.col("back").alias("far"), F.col("place").alias("more"), F.col("done").alias("end"))
        step = state.join(far, ["lang", "back"]).select(
            "lang", "phrase", "n", F.col("far").alias("back"),
            F.when(F.col("done"), F.col("place")).otherwise(F.col("place") + F.col("more")).alias("place"),
            (F.col("done") | F.col("end")).alias("done"))
        last, at = at, fresh_path(spark, name)
        step.write.parquet(at)
        state = spark.read.parquet(at)
        removed(spark, last)
    return state.select("lang", F.col("back").alias("path"), "place", "phrase", "n")


def _looked_up(rows: DataFrame, counts: DataFrame, on: str, hot: int) -> DataFrame:
    """``rows`` with the count of the phrase in column ``on``.

    A phrase that occurs n times begins or ends n / LEAST candidates at most. Those of more than
    ``hot`` occurrences, which are few, are broadcast; rows of all others are joined by phrase.
    """
    counts = counts.select("lang", F.col("phrase").alias(on), F.col("n").alias(f"n_{on}"))
    often = F.col(f"n_{on}") > hot
    key = ["lang", on]
    return rows.join(F.broadcast(counts.where(often)), key).unionByName(rows.join(counts.where(~often), key))


def _at_least(longer: Column, shorter: Column, percent: int) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    return wide(longer) * 100 >= wide(shorter) * percent


def scored(candidates: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the lowest-scoring cut of each candidate, of equal ones the first."""
    cuts = candidates.select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "size")
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    cuts = _looked_up(_looked_up(cuts, counts, "left", hot), counts, "right", hot)
    score = F.expr(
        "cast(a AS decimal(20,0)) * cast(2000000 AS decimal(7,0)) div (cast(n_left AS decimal(20,0)) + cast(n_right AS decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "k", F.col("n_left").alias("l"), F.col("n_right").alias("r"))).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, inner: DataFrame) -> DataFrame:
    """Candidates that no longer candidate covers. ``inner`` nodes are covered by the path they lie on."""
    runs = candidates.where("size > 2").select(
        "lang", "n", F.expr("split(phrase, ' ')").alias("w"), "size",
        F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> struct(i, m))))")).alias("at"))
    most = runs.groupBy("lang", F.expr("array_join(slice(w, at.i, at.m), ' ')").alias("phrase")).agg(F.max("n").alias("longer"))
    return (
        candidates.join(inner, ["lang", "phrase"], "left_anti")
        .join(most, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | ~_at_least(F.col("longer"), F.col("n"), COVERED))
        .select("lang", "phrase", "n", "size")
    )


def first_of_each(rows: DataFrame, reported: int) -> DataFrame:
    """The first rows of each language, numbered; a language is ordered in SALTS parts before."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= reported)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return rows.where(F.col("rank") <= reported)


def collocations(docs: DataFrame, least: int = LEAST, reported: int = REPORTED) -> DataFrame:
    """The first collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Null text is empty and null lang ``und``. Repeated rows and repeated doc_ids count as often as they
    occur; a text of any length is read whole. Equal scores go by count, then by phrase. An empty table, or one
    without a phrase of ``least`` occurrences, gives no rows. Other columns are not read.
    """
    counts, n = phrase_counts(docs, least)
    candidates = counts.where("size > 1")
    left = uncovered(candidates, unary_nodes(counts.where("size = 3"), counts.where("size = 4")))
    hot = n.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] // HOT
    return first_of_each(scored(left, counts, hot), reported).join(n, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of one to four words with ``least`` occurrences, and (lang, words)."""
    spark = docs.sparkSession
    at = fresh_path(spark, "edges")
    table = stored(edges_and_ends(docs, frequent_bits(docs, least)), "edges", at)
    runs = flows(table)
    counts = runs[0]
    for longer in runs[1:]:
        counts = counts.unionByName(longer)
    counts = stored(counts.where(F.col("n") >= least), "phrases")
    n = materialise(table.where("size = 0").select("lang", F.col("n").alias("words")))
    removed(spark, at)
    return counts, n


def passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, path, place, phrase, n): word runs that always occur together at least ``least`` times.

    Edges of one ``path`` in order of ``place`` spell a passage of place + 4 words.
    """
    counts, _ = phrase_counts(docs, least)
    return paths(counts.where("size = 3"), counts.where("size = 4"))
