"""Exact Jaccard join of word n-gram sets by parity sketches.

A parity sketch sends each member of a set to one bit and keeps the parity of each bit, so the Hamming
distance of two sketches is at most the size of the symmetric difference of the sets. Two sets
that are similar enough differ in few members for their size, d say. The sketches of one size band
are cut into more than d blocks; a pair then agrees in whole blocks (pigeonhole), and is found by an
equi-join on (band, block, bits). Blocks are wide and nearly empty, so they are kept as the
XOR of one random word for each of their set bits, which is equal where the bits are. A second,
short sketch of every set bounds the difference of proposed pairs. What is left, the sets decide.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropscan.session import stored

from .common import bounded, coded, free_names, mixed, per_slice, text_digest, texts, trimmed, word_hashes, words
from .components import components

#: Bits of one block.
BLOCK_BITS = 1 << 16
#: Blocks with so few bits set say little and are proposed only where a pair may have no others.
LIGHT = 2
#: 64-bit words of the short sketch.
SHORT = 32
#: Counters of token frequency used to order tokens; collisions cost time, never results.
COUNTERS = 1 << 20


@dataclass(frozen=True)
class Similarity:
    """Sets link when ``of * |A and B| >= at_least * |A or B|``; sets are of ``words``-word shingles."""

    words: int = 3
    at_least: int = 90
    of: int = 100
    ratio: float = 1.2

    def difference(self, smaller: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set has this size."""
        return smaller * (self.of - self.at_least) // self.at_least

    def largest(self, size: int) -> int:
        """The largest set that can link with one of this size."""
        return size * self.of // self.at_least

    @cached_property
    def _starts(self) -> list[int]:
        """Where size bands start; a linked pair is in one band or in neighbours."""
        step = max(self.ratio, self.of / self.at_least)
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(np.ceil(out[-1] * step))))
        return out

    def bands(self, size: int) -> list[int]:
        own = int(np.searchsorted(self._starts, size, side="right")) - 1
        return [own, own + 1] if self.largest(size) >= self._starts[own + 1] else [own]

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks of a band's sketches, and how many more than pigeonhole needs; (0, 0): only equal sets link."""
        most = self.difference(self._starts[band + 1] - 1)
        spare = 2 + most // 12
        return (most + 1 + spare, spare) if most else (0, 0)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each row's different k-word shingles.

    A-Z is lower-cased, words lie between ASCII white space. Fewer than k words: the whole
    sequence is the one shingle. No word: the empty set.
    """
    flat, bounds = words(column, lower=True)
    index, different = coded(flat)
    hashed = word_hashes(different)[index] if different else np.zeros(0, np.uint64)
    n = len(hashed)
    rolled = mixed(hashed)
    with np.errstate(over="ignore"):
        for i in range(1, k):
            rolled = mixed(rolled[:max(n - i, 0)] + hashed[i:])
        out = []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end - start >= k:
                out.append(np.unique(rolled[start:end - k + 1]))
            elif end > start:
                whole = mixed(hashed[start:start + 1])
                for i in range(start + 1, end):
                    whole = mixed(whole + hashed[i:i + 1])
                out.append(mixed(whole ^ np.uint64(end - start)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def short_sketch(members: np.ndarray) -> np.ndarray:
    """SHORT words of parity bits."""
    bit = (members % np.uint64(SHORT * 64)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SHORT * 64) & 1).astype(np.uint8), bitorder="little").view("<i8")


def block_sketches(members: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each block, the XOR of the words of its odd bits, and how many bits are odd. ``members`` ascend."""
    block = ((members >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits, times = np.unique(block << np.uint64(16) | members & np.uint64(BLOCK_BITS - 1), return_counts=True)
    bits = bits[times % 2 == 1]
    block = (bits >> np.uint64(16)).astype(np.int64)
    value, odd = np.zeros(blocks, np.uint64), np.bincount(block, minlength=blocks)
    if len(bits):
        first = np.flatnonzero(np.diff(block, prepend=-1))
        value[block[first]] = np.bitwise_xor.reduceat(mixed(bits + np.uint64(1)), first)
    return value, odd


def block_keys(members: np.ndarray, rule: Similarity) -> np.ndarray:
    """Keys that every linked pair of different sets shares at least one of.

    A linked pair agrees in more than ``spare`` blocks. Where a set has at most ``spare`` light
    blocks, one of those is not light, so the light ones can be left out; else all are kept.
    """
    out = []
    for band in rule.bands(len(members)) if len(members) else ():
        blocks, spare = rule.blocks(band)
        if not blocks:
            continue
        sketch, odd = block_sketches(members, blocks)
        place = np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40)
        heavy = odd > LIGHT
        if blocks - int(heavy.sum()) <= spare:
            sketch, place = sketch[heavy], place[heavy]
        with np.errstate(over="ignore"):
            out.append(mixed(sketch + mixed(place + np.uint64(1))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signature(members: np.ndarray) -> bytes:
    """128 bits that depend on the set alone, after its size."""
    with np.errstate(over="ignore"):
        first, second = members.sum(dtype=np.uint64), mixed(members ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
    return struct.pack("<QQQ", len(members), int(first), int(second))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketched(docs: DataFrame, rule: Similarity) -> DataFrame:
    """(doc_id, n_shingles, signature, keys, short) of every row."""

    def work(piece):
        sets = shingle_sets(piece["text"], rule.words)
        short = np.concatenate([short_sketch(s) for s in sets])
        return {
            "doc_id": piece["doc_id"], "n_shingles": np.array([len(s) for s in sets], np.int64),
            "signature": [signature(s) for s in sets], "keys": _lists([block_keys(s, rule) for s in sets]),
            "short": pa.FixedSizeListArray.from_arrays(pa.array(short), SHORT).cast(pa.list_(pa.int64())),
        }

    return per_slice(
        texts(docs), work, "doc_id long, n_shingles long, signature binary, keys array<long>, short array<long>")


def stored_sets(docs: DataFrame, wanted: DataFrame, rule: Similarity) -> DataFrame:
    """(node, members) for the documents whose id is in the stored ``wanted``."""

    def work(piece):
        return {"node": piece["doc_id"],
                "members": [s.astype("<u8").tobytes() for s in shingle_sets(piece["text"], rule.words)]}

    ids = wanted.select(F.col("node").alias("doc_id"))
    chosen = texts(docs).join(bounded(ids), "doc_id", "left_semi")
    return stored(per_slice(chosen, work, "node long, members binary"), "shingle-sets")


def near(pairs: DataFrame, sketches: DataFrame, rule: Similarity) -> DataFrame:
    """Those (a, b) whose sizes and short sketches let them link."""
    of = lambda side: sketches.select(
        F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("short").alias(f"short_{side}"))
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    hamming = F.aggregate(
        F.zip_with("short_a", "short_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = F.floor(small * (rule.of - rule.at_least) / rule.at_least)
    return pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where(
        (large * rule.at_least <= small * rule.of) & (hamming <= most)).select("a", "b")


def linked(pairs: DataFrame, docs: DataFrame, rule: Similarity) -> DataFrame:
    """Those of the stored (a, b) whose sets meet the rule."""

    def verify(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch["of_a"], batch["of_b"], strict=True):
                a, b = (np.frombuffer(x.as_buffer(), "<u8") for x in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(rule.of * common >= rule.at_least * (len(a) + len(b) - common))
            trimmed()
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored_sets(docs, stored(ends, "pair-ends"), rule)
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")).hint("merge"), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")).hint("merge"), "b")
        .select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")
    )


def _shared(keys: DataFrame) -> DataFrame:
    """(key, node, degree) of the (key, node) rows whose key has two nodes.

    ``degree`` is how many rows a node's buckets hold: of copies of one text, those that differ least have most.
    """
    ends = keys.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    shared = stored(keys.join(ends.select("key", "n"), "key"), "shared-keys")
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    return shared.select("key", "node").join(degrees.hint("merge"), "node").select("key", "node", "degree")


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the component known so far, of buckets that hold two components."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    with_label = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ends = with_label.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return with_label.join(ends.select("key"), "key")


def _star(open_buckets: DataFrame, tried: DataFrame | None) -> DataFrame:
    """One pair a node: with the bucket centre that it shares most buckets with and was not tried with.

    The centre of a bucket is its node of largest degree, so that copies of one text meet their original.
    """
    centre = F.max(F.struct("degree", (-F.col("node")).alias("minus"), "label"))
    centres = open_buckets.groupBy("key").agg(centre.alias("c")).select(
        "key", (-F.col("c.minus")).alias("centre"), F.col("c.degree").alias("centre_degree"), F.col("c.label").alias("centre_label"))
    offers = open_buckets.join(centres, "key").where(F.col("label") != F.col("centre_label")).groupBy(
        "node", "centre").agg(F.count("*").alias("n"), F.max("centre_degree").alias("of"))
    offers = offers.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), "node", "n", "of")
    if tried is not None:
        offers = offers.join(tried, ["a", "b"], "left_anti")
    best = F.max(F.struct("n", "of", (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))
    return offers.groupBy("node").agg(best.alias("best")).select(
        (-F.col("best.a")).alias("a"), (-F.col("best.b")).alias("b")).distinct()


def _rare_first(sets: DataFrame, rule: Similarity) -> DataFrame:
    """(key, node, size, place) for the rarest members of each set, as many as a linked pair cannot all miss."""
    spark = sets.sparkSession

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for row in batch["members"]:
                total += np.bincount((np.frombuffer(row.as_buffer(), "<u8") % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["slot", "n"])

    counted = sets.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int64)
    table[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(table)  # COUNTERS numbers, whatever the input

    def prefix(batches):
        for batch in batches:
            keys, nodes, sizes, places = [], [], [], []
            for node, row in zip(batch["node"].to_pylist(), batch["members"], strict=True):
                members = np.frombuffer(row.as_buffer(), "<u8")
                n = len(members)
                order = np.lexsort((members, shared.value[(members % np.uint64(COUNTERS)).astype(np.int64)]))
                least = -(-n * rule.at_least // rule.of)
                chosen = members[order[:n - least + 1]]
                keys.append(chosen)
                nodes += [node] * len(chosen)
                sizes += [n] * len(chosen)
                places += range(len(chosen))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(places, pa.int64())],
                names=["key", "node", "size", "place"])

    return sets.mapInArrow(prefix, "key long, node long, size long, place long")


def _rest(open_buckets: DataFrame, docs: DataFrame, labels: DataFrame, rule: Similarity) -> DataFrame:
    """All pairs that may still link: of different components, both in open buckets, sharing a rare member.

    The rarest member that two sets share leaves room for the common ones after it only, on either
    side; that must reach what a link needs. In a bucket, the nodes of its most frequent
    component are paired with the others only, so that a large group of copies that is one
    component already makes no pairs of its own.
    """
    sets = stored_sets(docs, stored(open_buckets.select("node").distinct(), "open-nodes"), rule)
    rare = stored(_rare_first(sets, rule), "rare-members")
    known = rare.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = known.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(
        F.max(F.struct("n", "label")).getField("label").alias("main"), F.count("*").alias("labels")
    ).where("labels > 1").select("key", "main")
    open_rare = stored(known.join(main, "key"), "open-rare-members")
    others = open_rare.where("label <> main").select(
        "key", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("place").alias("other_place"), F.col("label").alias("other_label"))
    both = F.col("size") + F.col("other_size")
    needed = F.ceil(both * rule.at_least / (rule.of + rule.at_least))
    room = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place")) >= needed
    once = (F.col("label") == F.col("main")) | (F.col("node") < F.col("other"))
    return open_rare.join(others, "key").where((F.col("label") != F.col("other_label")) & room & once).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _numbered(docs: DataFrame) -> DataFrame | None:
    """(own, doc_id, text, digest) where some doc_id has several rows, each with a number of its own; else None."""
    rows = texts(docs)
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    return stored(rows.select(F.monotonically_increasing_id().alias("own"), "doc_id", "text", text_digest().alias("digest")), "numbered")


def _by_row(numbered: DataFrame, rule: Similarity, rounds: int) -> DataFrame:
    """(own, doc_id, digest, n_shingles, component) of the rows as documents of their own; null ids link nothing."""
    known = _components(numbered.where("doc_id is not null").select(F.col("own").alias("doc_id"), "text"), rule, rounds)
    lone = sketched(numbered.where("doc_id is null").select(F.col("own").alias("doc_id"), "text"), rule)
    every = known.unionByName(lone.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    named = numbered.select("own", F.col("doc_id").alias("id"), "digest")
    return named.join(every.withColumnRenamed("doc_id", "own"), "own").select(
        "own", F.col("id").alias("doc_id"), "digest", "n_shingles", F.col("component_id").alias("component"))


def jaccard_components(docs: DataFrame, rule: Similarity = Similarity(), rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, itself included. Rows of equal
    sets are one node, so copies make no pairs. ``rounds`` times each node is compared with one
    partner; then every pair that may still join two components is. A pair inside
    one component is never needed. Null and empty texts link with nothing. A null doc_id gets
    a null component and links nothing; rows that share a doc_id are one document, as
    if linked, each with the size of its own set. An empty table gives no rows.
    """
    numbered = _numbered(docs)
    if numbered is None:
        return _components(docs, rule, rounds)
    rows = stored(_by_row(numbered, rule, rounds), "row-components")
    ids = rows.where("component is not null").select("doc_id", "component").distinct()
    first = ids.groupBy("doc_id").agg(F.min("component").alias("a"))
    edges = ids.join(first, "doc_id").where("component <> a").select("a", F.col("component").alias("b")).distinct()
    joined = rows.join(components(edges).withColumnRenamed("node", "component"), "component", "left").withColumn(
        "component", F.coalesce("label", "component"))
    names = joined.groupBy("component").agg(F.min("doc_id").alias("component_id")).where("component is not null")
    return joined.join(names, "component", "left").select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, rule: Similarity, rounds: int) -> DataFrame:
    """``jaccard_components`` of rows whose doc_ids differ or are null."""
    rows = stored(sketched(docs, rule), "parity-sketches")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = stored(named.groupBy("signature").agg(F.min("doc_id").alias("node")), "shingle-classes")
    nodes = named.join(classes.select(F.col("node").alias("doc_id"), "signature").hint("merge"), ["doc_id", "signature"], "left_semi")
    members = nodes.where(F.size("keys") > 0).select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    members = stored(_shared(members), "shared-blocks")
    labels, edges, tried = None, None, None
    if not members.isEmpty():
        inside = members.select("node").distinct()
        sketches = stored(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "short").join(
            inside, "node", "left_semi"), "short-sketches")
        for step in range(rounds + 1):
            open_buckets = _open(members, labels)
            if labels is not None:
                open_buckets = stored(open_buckets, "open-blocks")
                if open_buckets.isEmpty():
                    break
            if step < rounds:
                pairs = stored(_star(open_buckets, tried), "star-pairs")
                tried = pairs if tried is None else tried.union(pairs)
            else:
                pairs = _rest(open_buckets, docs, labels, rule)
            pairs = stored(near(pairs, sketches, rule), "near-pairs")
            found = stored(linked(pairs, docs, rule), "links")
            edges = found if edges is None else edges.union(found)
            labels = components(edges)
    own = rows.select("doc_id", "n_shingles", "signature").join(
        classes.hint("merge"), "signature", "left")
    if labels is not None:
        own = own.join(labels, "node", "left")
        own = own.withColumn("node", F.coalesce("label", "node"))
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Similarity = Similarity(), rounds: int = 2) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id, with all its columns; a null doc_id stays.

    Here rows that share a doc_id are documents of their own, told apart by their text: a text goes only
    where one that it is linked with stays. Of equal smallest doc_ids any one stays; a row repeated in full is one
    document and stays as often as it occurs. Texts without a word stay. An empty table gives no rows.
    """
    numbered = _numbered(docs)
    if numbered is None:
        found = _components(docs, rule, rounds)
        gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
        return docs.join(bounded(gone), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    rows = stored(_by_row(numbered, rule, rounds).where("component is not null"), "row-components")
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("best"))
    lost = rows.join(best, "component").where((F.col("doc_id") != F.col("best.doc_id")) | (F.col("digest") != F.col("best.digest")))
    # A row can be in one component only, and so can all rows of its text.
    gone = stored(lost.select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_text")).distinct(), "near-copies")
    (digest,) = free_names(docs, "_digest")
    keyed = docs.withColumn(digest, text_digest())
    same = (keyed["doc_id"].cast("long") == gone["_gone"]) & (keyed[digest] == gone["_text"])
    return keyed.join(bounded(gone), same, "left_anti").select(*docs.columns)
