"""Token ids as byte-aligned variable-length codes of frequency ranks, with separate control bytes.

File format: a folder with two Parquet tables. ``ranks`` lists the token ids by falling count;
the rank is what is coded. ``blocks`` holds, per range partition and in ascending doc_id order,
blocks of documents: two control bits per id say how many bytes (1 to 4) its rank takes in the
data bytes, four ids to a control byte. Parquet is only the container: it is written and
committed by Spark, so that a lost task leaves nothing half written, and read from any store.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cropscan.session import fresh_path

from .common import coded, gathered, per_slice, texts, words

END_ID = 1
#: Ids that a block holds before it is closed; a longer document makes a longer block.
BLOCK_IDS = 1_000_000
#: Words whose ids a worker remembers between slices; those met first are the frequent ones.
REMEMBERED = 900_000

BLOCKS = (
    "part int, seq int, before long, n_docs int, n_ids long, first_doc long, doc_ids binary, null_docs binary, counts binary, "
    "control binary, data binary"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The rules of the tokenizer that words are encoded apart for.
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

_loaded: dict[str, tuple[Tokenizer, dict[str, bytes], bool]] = {}


def _tokenizer(path: str) -> tuple[Tokenizer, dict[str, bytes], bool]:
    """The tokenizer, the ids met so far, and whether its rules are those that let words be encoded apart."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        rules = json.loads(tokenizer.to_str())
        apart = (
            (rules["normalizer"] or {}).get("normalizers") == _NORMALISER
            and (rules["pre_tokenizer"] or {}).get("pretokenizers") == _SPLITTER
            and all(t["content"].startswith("<|") and t["content"].endswith("|>") and not (t["lstrip"] or t["rstrip"] or t["normalized"])
                    and not any(c in t["content"] for c in " .,") for t in rules["added_tokens"])
        )
        _loaded[path] = tokenizer, {}, apart
    return _loaded[path]


def _fresh(missing: list[str], tokenizer: Tokenizer, apart: bool) -> dict[str, bytes]:
    """Ids of words, or of whole texts. Words of a-z alone pass the normaliser and splitter unchanged, so they go to the model at once."""
    model, found, rest = tokenizer.model, {}, []
    for word in missing:
        if apart and word.isascii() and word.isalpha() and word.islower():
            found[word] = array("I", [t.id for t in model.tokenize(word)]).tobytes()
        else:
            rest.append(word)
    for start in range(0, len(rest), 50_000):
        part = rest[start:start + 50_000]
        for word, one in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            found[word] = array("I", one.ids).tobytes()
    return found


def _words_apart(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    column = pc.replace_substring_regex(column, r"([A-Za-z0-9])([.,]+)(\s|$)", r"\1 \2\3")
    lower = not pc.any(pc.match_substring(column, "<|")).as_py()  # the sign of special tokens, which are told by case
    return words(column, lower)


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, each row closed by END_ID, and the rows' bounds.

    The default tokenizer drops white space and no rule of it reaches over any, so the ids of a text are those
    of its words, and different words are encoded once. It also lower-cases, and ends a word
    before a full stop or comma; doing both here first leaves fewer different words. With a tokenizer
    of other rules texts are encoded whole.
    """
    tokenizer, known, apart = _tokenizer(path)
    flat, bounds = _words_apart(column) if apart else (column, np.arange(len(column) + 1))
    index, different = coded(flat)
    fresh = _fresh([w for w in different if w not in known], tokenizer, apart)
    if apart and len(known) + len(fresh) <= REMEMBERED:
        known.update(fresh)
        fresh = known
    end = array("I", [END_ID]).tobytes()
    pieces = [known[w] if w in known else fresh[w] for w in different] + [end]
    ids = np.frombuffer(b"".join(pieces), np.uint32)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    starts = np.cumsum(lengths) - lengths
    # Each row's words, then the end: the last entry of ``pieces``.
    rows = len(bounds) - 1
    closed = np.full(len(index) + rows, len(different), np.int64)
    closed[np.arange(len(index)) + np.repeat(np.arange(rows), np.diff(bounds))] = index
    run = lengths[closed]
    total = np.concatenate([[0], np.cumsum(run)])[bounds + np.arange(rows + 1)]
    return ids[gathered(starts[closed], run)], total


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian integers of ``width`` bytes, 2 or 4."""
    path = path or default_tokenizer()
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4

    def work(piece):
        ids, bounds = encode_column(piece["text"], path)
        return {"doc_id": piece["doc_id"], "ids": _binary(ids.astype(f"<u{width}"), bounds), "width": np.full(len(bounds) - 1, width, np.int32)}

    return per_slice(texts(docs), work, "doc_id long, ids binary, width int")


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int64)
    large = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    )
    return large.cast(pa.binary())


def _ids(row: bytes, width: int) -> np.ndarray:
    return np.frombuffer(row, f"<u{width}")


def ranked(found: DataFrame) -> DataFrame:
    """(token, n, rank) over all ids, most frequent first, equal counts by id; bounded by the vocabulary."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row, width in zip(batch["ids"], batch["width"].to_pylist(), strict=True):
                one = np.bincount(_ids(row.as_buffer(), width))
                if len(one) > len(total):
                    total = np.concatenate([total, np.zeros(len(one) - len(total), np.int64)])
                total[:len(one)] += one
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    counts = found.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect(), key=lambda r: (-r["n"], r["token"]))
    return found.sparkSession.createDataFrame(
        [(r["token"], r["n"], i) for i, r in enumerate(rows)], "token long, n long, rank long"
    )


# --- the code ----------------------------------------------------------------------------------

#: For each control byte, the lengths of its four codes.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = sizes - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < sizes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks, by table lookup of the control bytes."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write(found: DataFrame, folder: str) -> None:
    """Write stored ``tokens`` to ``folder``, in ascending doc_id order, null first."""
    spark = found.sparkSession
    ranks = ranked(found)
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    order = np.array([r["token"] for r in ranks.orderBy("rank").collect()], np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # one entry per id of the vocabulary

    def pack(batches):
        seq, before, docs, rows, held = 0, 0, [], [], 0

        def block():
            ids = np.concatenate(rows)
            control, data = encode(shared.value[ids])
            known = [0 if d is None else d for d in docs]
            return pa.RecordBatch.from_pydict({
                "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()), "n_docs": pa.array([len(docs)], pa.int32()),
                "n_ids": pa.array([len(ids)], pa.int64()), "first_doc": pa.array([docs[0]], pa.int64()),
                "doc_ids": pa.array([np.array(known, "<i8").tobytes()], pa.binary()),
                "null_docs": pa.array([bytes(d is None for d in docs)], pa.binary()),
                "counts": pa.array([np.array([len(r) for r in rows], "<u4").tobytes()], pa.binary()),
                "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
            })

        for batch in batches:
            for doc, row, width in zip(batch["doc_id"].to_pylist(), batch["ids"], batch["width"].to_pylist(), strict=True):
                docs.append(doc)
                rows.append(_ids(row.as_py(), width))
                held += len(rows[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    seq, before, docs, rows, held = seq + 1, before + held, [], [], 0
        if docs:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "ids")
    schema = BLOCKS.removeprefix("part int, ")
    ordered.mapInArrow(pack, schema).select(F.spark_partition_id().alias("part"), "*").write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (binary, 4 bytes each)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    tokens_by_rank = np.array(
        [r["token"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.uint32)
    shared = spark.sparkContext.broadcast(tokens_by_rank)
    # One total per part: as many rows as the writer had shuffle partitions, whatever they hold.
    before, starts = 0, []
    for row in sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        starts.append((row["part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(starts, "part int, part_start long")
    placed = blocks.drop("first_doc").join(F.broadcast(offsets), "part")

    def unpack(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                counts = np.frombuffer(one["counts"], "<u4").astype(np.int64)
                ids = shared.value[decode(one["control"], one["data"], one["n_ids"])].astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(one["doc_ids"], "<i8"), mask=np.frombuffer(one["null_docs"], bool)),
                    pa.array(one["part_start"] + one["before"] + bounds[:-1]), pa.array(counts), _binary(ids, bounds),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 of every document.

    Null and empty texts hold the end id alone. Equal doc_ids follow one another by their ids; null
    doc_ids come first. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    found = tokens(docs, path)
    at = fresh_path(spark, "tokens")
    found.write.option("compression", "zstd").parquet(at)
    found = spark.read.schema(found.schema).parquet(at)
    folder = fresh_path(spark, "token-files")
    write(found, folder)
    removed(spark, at)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
