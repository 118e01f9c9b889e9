"""Helpers shared by the text operators: clean input columns, bounded Arrow slices, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points handled at once inside a task; a longer document is a slice of its own.
SLICE_CHARS = 4_000_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of an Arrow batch between the JVM and a Python worker, whatever the length of its texts.
BATCH_BYTES = 8 << 20

_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, and give executors this package where their Python path lacks it.

    The bound is a session setting that is only ever lowered. Spark hands the archive out itself;
    it is what ``--py-files`` does for a submitted job.
    """
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_cropscan_sent", False):
        return
    archive = os.path.join(tempfile.mkdtemp(), "cropscan.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in (root / "cropscan").rglob("*.py"):
            out.write(source, source.relative_to(root))
    context.addPyFile(archive)
    context._cropscan_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null read as empty; all other columns are left out."""
    prepare(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until it is no column of ``docs``, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def text_digest():
    """SHA-256 of the whole text, null read as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


#: Rows up to which a stored table of narrow rows is broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 2_000_000


def bounded(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, with a broadcast hint where its counted size allows one."""
    return F.broadcast(narrow) if narrow.count() <= rows else narrow


def slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the ``text`` of a piece holds about ``chars`` code points at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(False).astype(np.int64))
        start = done = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + chars, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def trimmed() -> None:
    """Hand freed memory back to the system, where the C library can; a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def per_slice(
    docs: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, chars: int = SLICE_CHARS
) -> DataFrame:
    """``work`` on every slice of (doc_id, text); it returns the columns of ``schema`` by name."""
    arrow = docs.sparkSession.createDataFrame([], schema).schema
    names = arrow.fieldNames()

    def run(batches):
        for piece in slices(batches, chars):
            out = work(piece)
            trimmed()
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (out[n] for n in names)],
                names=names,
            )

    return docs.mapInArrow(run, arrow)


def words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space as one flat array, and where each row's words begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(False))])
    full = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(False))]).astype(np.int64)
    return flat.filter(full), kept[bounds.astype(np.int64)]


def coded(flat: pa.Array) -> tuple[np.ndarray, list]:
    """Number of each word in the list of different words, and that list."""
    found = flat.dictionary_encode()
    return found.indices.to_numpy(False).astype(np.int64), found.dictionary.to_pylist()


def word_hashes(different: list) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in different), np.uint64, len(different))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around on purpose."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length - 1 of every run, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def held_out(divisor: int, remainder: int):
    """Whether the CRC-32 of doc_id written as text leaves ``remainder``; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(True))
