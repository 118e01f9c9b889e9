"""Harmonic packing of token sequences.

A document's ids are cut into whole sequences, then into pieces whose lengths are powers of two, and a tail
shorter than ``LEAST_CUT``. A piece longer than capacity / (k + 1) and no longer than capacity / k is of
class k, and a sequence takes exactly k pieces of one class: powers of two fill it to the end, tails all but
a few ids. Every worker fills its own sequences and shares none, so nothing is shuffled and a lost worker's
pieces come out again as they were. What is left of its classes at a worker's end, fewer than k pieces of
each, is put end to end, and the last of these sequences is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import coded, gathered, slices, texts, trimmed

CAPACITY = 2048
#: No piece shorter than this is cut off; only tails are shorter. A power of two.
LEAST_CUT = 64
END_ID = 1
#: Runs of text whose ids a worker remembers between slices.
REMEMBERED = 600_000

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: Set between runs that are encoded apart; texts that hold it are encoded whole.
_CUT = "\ue000"
_PLAIN_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> list[str]:
    """The sign for each byte in a byte-level vocabulary: itself where it prints, else the next one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


_SIGNS = dict(enumerate(_byte_signs()))
#: A run that the splitter leaves in one part: letters, and the space before them.
_ONE_PART = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")


_loaded: dict[str, tuple[Tokenizer, bool, dict[str, bytes]]] = {}


def _tokenizer(path: str) -> tuple[Tokenizer, bool, dict[str, bytes]]:
    """The tokenizer, whether texts may be cut before white space, and the ids met so far."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        rules = json.loads(tokenizer.to_str())
        splitter = rules["pre_tokenizer"] or {}
        apart = (
            rules["normalizer"] is None
            and all(splitter.get(k) == v for k, v in _PLAIN_SPLITTER.items())
            and not any(
                set(t["content"]) & set(" \n.,") or _ONE_PART.fullmatch(t["content"]) or t["lstrip"] or t["rstrip"]
                for t in rules["added_tokens"])
        )
        _loaded[path] = tokenizer, apart, {}
    return _loaded[path]


def _ids_of(runs: list[str], tokenizer: Tokenizer, apart: bool) -> dict[str, bytes]:
    """Ids of runs; those that are one part already go to the model at once."""
    found, rest, model = {}, [], tokenizer.model
    for run in runs:
        if apart and _ONE_PART.fullmatch(run):
            found[run] = array("I", [t.id for t in model.tokenize(run.encode().decode("latin-1").translate(_SIGNS))]).tobytes()
        else:
            rest.append(run)
    for start in range(0, len(rest), 50_000):
        part = rest[start:start + 50_000]
        for run, one in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            found[run] = array("I", one.ids).tobytes()
    return found


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, each row closed by END_ID, and the rows' bounds.

    A byte-level splitter never joins a letter or sign to white space after it, or a letter to a full
    stop or comma. So runs that begin there are encoded apart, each different one once.
    """
    tokenizer, apart, known = _tokenizer(path)
    if apart and not pc.any(pc.match_substring(column, _CUT)).as_py():
        column = pc.replace_substring_regex(column, "([A-Za-zÀ-ÖØ-öø-ɏ])([.,])([ \n])", f"\\1{_CUT}\\2{_CUT}\\3")
        lists = pc.split_pattern(pc.replace_substring_regex(column, "([!-~À-ɏ])([ \n])", f"\\1{_CUT}\\2"), _CUT)
        flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(False))])
    else:
        flat, bounds = column, np.arange(len(column) + 1)
    index, different = coded(flat)
    fresh = _ids_of([r for r in different if r not in known], tokenizer, apart)
    if apart and len(known) + len(fresh) <= REMEMBERED:
        known.update(fresh)
        fresh = known
    parts = [known[r] if r in known else fresh[r] for r in different] + [array("I", [END_ID]).tobytes()]
    ids = np.frombuffer(b"".join(parts), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts = np.cumsum(lengths) - lengths
    rows = len(bounds) - 1
    bounds = bounds.astype(np.int64)
    closed = np.full(len(index) + rows, len(different), np.int64)
    closed[np.arange(len(index)) + np.repeat(np.arange(rows), np.diff(bounds))] = index
    run = lengths[closed]
    total = np.concatenate([[0], np.cumsum(run)])[bounds + np.arange(rows + 1)]
    return ids[gathered(starts[closed], run)], total


def cut(lengths: np.ndarray, capacity: int = CAPACITY, least: int = LEAST_CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the pieces of rows with that many ids, in order."""
    row, whole, rest = np.arange(len(lengths)), lengths // capacity, lengths % capacity
    rows, starts, sizes = [np.repeat(row, whole)], [gathered(np.zeros_like(whole), whole) * capacity], [np.full(whole.sum(), capacity)]
    size = capacity // 2
    while size >= least:
        has = np.flatnonzero(rest & size)
        rows.append(has)
        starts.append(whole[has] * capacity + rest[has] // (2 * size) * (2 * size))
        sizes.append(np.full(len(has), size))
        size //= 2
    has = np.flatnonzero(rest % least)
    rows.append(has)
    starts.append(whole[has] * capacity + rest[has] // least * least)
    sizes.append(rest[has] % least)
    rows, starts, sizes = map(np.concatenate, (rows, starts, sizes))
    order = np.lexsort((starts, rows))
    return rows[order], starts[order], sizes[order]


class _Worker:
    """Pieces that wait for their class's sequence to fill, and the sequences given out so far."""

    def __init__(self, number: int, capacity: int):
        self.base, self.given, self.capacity = number << 32, 0, capacity
        #: doc_id, is null, start, length, ids in the document
        self.wait = [np.zeros(0, np.int64), np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3))]
        self.ids = np.zeros(0, np.uint32)

    def _rows(self, info: list, ids: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        doc, null, start, length, doc_tokens = info
        offsets = np.concatenate([[0], np.cumsum(length)]) * 4
        data = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, mask=null), *map(pa.array, (start, length, doc_tokens, self.base + sequence, offset)), data.cast(pa.binary())],
            names=[c.split()[0] for c in PIECES.split(", ")])

    def add(self, info: list, ids: np.ndarray) -> pa.RecordBatch:
        """Take pieces, and give out those of the sequences that are full now."""
        info = [np.concatenate(x) for x in zip(self.wait, info, strict=True)]
        ids = np.concatenate([self.ids, ids])
        length = info[3]
        begin = np.cumsum(length) - length
        kind = self.capacity // length
        order = np.argsort(kind, kind="stable")
        kinds, first, many = np.unique(kind[order], return_index=True, return_counts=True)
        place = np.arange(len(order)) - np.repeat(first, many)
        bins = many // kinds
        full = place < np.repeat(bins * kinds, many)
        sequence = np.repeat(np.cumsum(bins) - bins, many) + place // kind[order]
        out, rest = order[full], np.sort(order[~full])
        sequence = sequence[full]
        ends = np.cumsum(length[out])
        opens = np.flatnonzero(np.diff(sequence, prepend=-1))
        offset = ends - length[out] - np.repeat((ends - length[out])[opens], np.diff(np.append(opens, len(out))))
        done = self._rows([x[out] for x in info], ids[gathered(begin[out], length[out])], self.given + sequence, offset)
        self.given += int(bins.sum())
        self.wait, self.ids = [x[rest] for x in info], ids[gathered(begin[rest], length[rest])]
        return done

    def end(self) -> pa.RecordBatch:
        """Give out what waits, end to end: full sequences, then ones of a power of two each."""
        doc, null, start, length, doc_tokens = self.wait
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        marks = list(range(self.capacity, total + 1, self.capacity))
        left, at = total % self.capacity, total - total % self.capacity
        while left:
            most = 1 << (left.bit_length() - 1)
            at, left = at + most, left - most
            marks.append(at)
        marks = np.array(marks, np.int64)
        stops = np.unique(np.concatenate([ends, marks]))
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(stops) else stops
        piece, sequence = np.searchsorted(ends, starts, side="right"), np.searchsorted(marks, starts, side="right")
        opened = np.concatenate([[0], marks])[sequence]
        info = [doc[piece], null[piece], start[piece] + starts - (ends - length)[piece], stops - starts, doc_tokens[piece]]
        return self._rows(info, self.ids, self.given + sequence, starts - opened)


def packed(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, least: int = LEAST_CUT
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (4 bytes each, little-endian).

    Null text is empty text: a document of the end id alone. Each row is a document of its own, also where
    doc_ids repeat or are null. Long texts are cut like others. An empty table gives no rows. Other columns
    are not read. A sequence_id holds the worker's number and a count.
    """
    for size in (capacity, least):
        if size < 1 or size & (size - 1):
            raise ValueError("capacity and shortest cut must be powers of two")
    path = path or default_tokenizer()

    def run(batches):
        worker = _Worker(TaskContext.get().partitionId(), capacity)
        for piece in slices(batches):
            ids, bounds = encode_column(piece["text"], path)
            lengths = np.diff(bounds)
            row, start, length = cut(lengths, capacity, least)
            doc = pc.fill_null(piece["doc_id"], 0).to_numpy(False)
            null = pc.is_null(piece["doc_id"]).to_numpy(False)
            yield worker.add([doc[row], null[row], start, length, lengths[row]], ids)
            trimmed()
        yield worker.end()

    return texts(docs).mapInArrow(run, PIECES)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, n_tokens, padding, ids): sequences put together from stored pieces of ``packed``.

    One of a power of two ids is not padded; another is short of ``padding`` ids. A sequence holds
    ``capacity`` ids at most, which bounds its row.
    """
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, one: F.concat(all_, one["ids"]))
    even = F.bit_count("n_tokens") == 1
    return whole.select("sequence_id", "n_tokens", F.when(even, 0).otherwise(capacity - F.col("n_tokens")).alias("padding"), joined.alias("ids"))


def packing_query(docs: DataFrame) -> DataFrame:
    return packed(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
