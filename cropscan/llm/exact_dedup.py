"""Exact deduplication through a cuckoo-filter index of live digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropscan.session import stored

from .common import bounded, free_names, text_digest, texts
from .cuckoo import LiveDigests

#: Live digests that one index bucket is meant to hold.
BUCKET_KEYS = 16_384
#: Digests a map task combines before it hands them on.
COMBINE_KEYS = 100_000
LEAST_BUCKETS = 256

INDEX = "bucket int, digest binary, keep_id long, n_rows long, cuckoo binary"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row: SHA-256 of the whole text in UTF-8, null read as empty."""
    return texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


def bucket_count(rows: int) -> int:
    return 1 << max(LEAST_BUCKETS.bit_length() - 1, (rows // BUCKET_KEYS).bit_length())


def _bucket(buckets: int):
    """The last bytes of a digest; the filter inside a bucket uses the first ones."""
    return F.conv(F.hex(F.substring("digest", 29, 4)), 16, 10).cast("long").bitwiseAND(buckets - 1).cast("int")


def _combine(batches):
    """Within a map task, the rows of equal digests become one, again by a cuckoo index."""
    live = LiveDigests()

    def out():
        return pa.RecordBatch.from_pydict({
            "digest": pa.array(list(live.entries), pa.binary()),
            "doc_id": pa.array([e[0] for e in live.entries.values()], pa.int64()),
            "n_rows": pa.array([e[1] for e in live.entries.values()], pa.int64()),
        })

    for batch in batches:
        for digest, doc_id in zip(batch["digest"].to_pylist(), batch["doc_id"].to_pylist(), strict=True):
            live.add(digest, doc_id)
        if len(live.entries) >= COMBINE_KEYS:
            yield out()
            live = LiveDigests()
    yield out()


def _bucket_rows(bucket: int, live: LiveDigests) -> pa.Table:
    """The bucket's live digests, and one row with the filter."""
    keys = list(live.entries)
    size = len(keys) + 1
    return pa.table({
        "bucket": pa.array([bucket] * size, pa.int32()),
        "digest": pa.array([*keys, None], pa.binary()),
        "keep_id": pa.array([*(live.entries[k][0] for k in keys), None], pa.int64()),
        "n_rows": pa.array([*(live.entries[k][1] for k in keys), None], pa.int64()),
        "cuckoo": pa.array([None] * (size - 1) + [live.filter.to_bytes()], pa.binary()),
    })


def _insert(old: pa.Table, new: pa.Table) -> pa.Table:
    live = _loaded(old)
    for digest, doc_id, rows in zip(
        new["digest"].to_pylist(), new["doc_id"].to_pylist(), new["n_rows"].to_pylist(), strict=True
    ):
        live.add(digest, doc_id, rows)
    return _bucket_rows((new if new.num_rows else old)["bucket"][0].as_py(), live)


def _delete(old: pa.Table, gone: pa.Table) -> pa.Table:
    live = _loaded(old)
    for digest in gone["digest"].to_pylist():
        live.remove(digest)
    return _bucket_rows((gone if gone.num_rows else old)["bucket"][0].as_py(), live)


def _loaded(old: pa.Table) -> LiveDigests:
    """A bucket's digests behind the filter that is stored with them."""
    rows = zip(old["digest"].to_pylist(), old["keep_id"].to_pylist(), old["n_rows"].to_pylist(), strict=True)
    cells = [c for c in old["cuckoo"].to_pylist() if c is not None] if "cuckoo" in old.column_names else []
    return LiveDigests({d: [k, n] for d, k, n in rows if d is not None}, cells[0] if cells else None)


def _combined(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.select("digest", "doc_id").mapInArrow(
        _combine, "digest binary, doc_id long, n_rows long"
    ).withColumn("bucket", _bucket(buckets))


def build_index(rows: DataFrame, buckets: int) -> DataFrame:
    """A new index of (doc_id, digest) rows; bucket by bucket, however often a digest occurs."""
    empty = pa.table({"digest": pa.array([], pa.binary()), "keep_id": pa.array([], pa.int64()),
                      "n_rows": pa.array([], pa.int64())})
    return _combined(rows, buckets).groupBy("bucket").applyInArrow(lambda new: _insert(empty, new), INDEX)


def insert_rows(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """The index after further rows; an equal text with a larger doc_id takes over the live digest."""
    return index.groupBy("bucket").cogroup(_combined(rows, buckets).groupBy("bucket")).applyInArrow(_insert, INDEX)


def delete_digests(index: DataFrame, gone: DataFrame, buckets: int) -> DataFrame:
    """The index without the given digests; those that are not live change nothing."""
    marked = gone.select("digest").distinct().withColumn("bucket", _bucket(buckets))
    return index.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(_delete, INDEX)


def _live(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = stored(digests(docs), "digests")
    index = stored(build_index(rows, bucket_count(rows.count())), "cuckoo-index")
    return rows, index.where(F.col("digest").isNotNull()).select("digest", "keep_id", "n_rows")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest doc_id stays. Null text equals the empty text. Rows that repeat
    a doc_id with the same text all count and all carry ``kept`` of that doc_id; a null doc_id
    stays only where no other row has the text. An empty table gives no rows.
    """
    rows, live = _live(docs)
    return rows.join(live.hint("merge"), "digest").select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; a row repeated in full stays once.

    Null ids and null texts are as in ``exact_duplicates``; an empty table gives no rows. The columns may have any names.
    """
    rows, live = _live(docs)
    judged = rows.join(live.hint("merge"), "digest").withColumn("_mark", F.xxhash64("digest"))
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = stored(judged.where(~is_kept).select(F.col("doc_id").alias("_id"), "_mark").distinct(), "copies")
    # Columns beside the user's own, under names that are not among them.
    doc, own = free_names(docs, "_doc", "_own")
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(own, F.xxhash64(text_digest()))
    same = keyed[doc].eqNullSafe(gone["_id"]) & (keyed[own] == gone["_mark"])
    kept = keyed.join(bounded(gone), same, "left_anti")
    # Rows that repeat doc_id and text are rare; only where there are any, they are merged.
    twice = stored(judged.where(is_kept).groupBy("_mark").count().where("count > 1").select("_mark"), "repeated-rows")
    if not twice.isEmpty():
        again = keyed[own] == twice["_mark"]
        once = kept.join(bounded(twice), again, "left_anti")
        kept = once.unionByName(kept.join(bounded(twice), again, "left_semi").dropDuplicates([own]))
    return kept.select(*docs.columns)
