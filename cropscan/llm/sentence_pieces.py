"""SentencePiece segmentations drawn from the piece lattice, and lossless decoding.

Forward filtering sums, for every prefix of a piece of text, the weights of all its segmentations; backward
sampling then draws pieces from the end. The draws depend on the row key and the
place in the text only, so a row is always segmented the same way, whatever the partitioning.

No piece of the model reaches over the start of a run of spaces, so the lattice of a text falls apart
into those of its space-led words, and equal words share theirs; only the draws are per place.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import GOLDEN, coded, gathered, mixed, per_slice, texts

SPACE = "▁"
#: The power of the piece weights: 0 draws evenly among segmentations, large values near the likeliest.
SHARPNESS = 1.0
SEED = 0
#: Code points whose different words have their lattices in memory at once.
LATTICE_CHARS = 600_000
_WORDS = re.compile(r" *[^ ]+| +")
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """The model's pieces with spaces for its space signs; a space sign in a text is no space and is spelled in bytes."""

    ids: np.ndarray        # piece ids by number
    lengths: np.ndarray    # code points of each numbered piece
    hashes: np.ndarray     # rolling hash of each
    weights: np.ndarray    # log weight of each
    first: np.ndarray      # number by hash slot, -1: none
    second: np.ndarray     # another number of the same slot
    bits: int              # of a slot number
    likely: np.ndarray     # for a short slot number, whether any piece has it
    byte_ids: np.ndarray   # ids of the 256 byte pieces
    byte_weight: float
    starts: np.ndarray     # where the bytes of each id begin in ``raw``
    sizes: np.ndarray
    raw: np.ndarray

    @property
    def longest(self) -> int:
        return int(self.lengths.max())


def rolling(codes: np.ndarray) -> int:
    value = 0
    for c in codes:
        value = (value * _MULTIPLIER + int(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return value


#: Bits of the short slot number; its table stays in the processor's cache.
_LIKELY = 19


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A table of two numbers a slot, as small as that allows."""
    bits = 20
    while np.bincount(_slot(hashes, bits).astype(np.int64)).max() > 2:
        bits += 1
    first, second = np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int32)
    for number, slot in enumerate(_slot(hashes, bits).tolist()):
        (first if first[slot] < 0 else second)[slot] = number
    return first, second, bits


def load(path: str, sharpness: float = SHARPNESS) -> Pieces:
    """Weights follow the pieces' rank by score, as 1 / (rank + 2) to the power of ``sharpness``."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids, usable, spelled = np.full(256, -1, np.int64), [], [b""] * n
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value], spelled[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            shown = piece.replace(SPACE, " ")
            if " " in shown.lstrip(" "):
                raise ValueError(f"a piece goes over a space: {piece!r}")
            spelled[i] = shown.encode()
            usable.append((-model.get_score(i), i, shown))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so not every text can be spelled")
    usable.sort()
    hashes = np.array([rolling(map(ord, p)) for _, _, p in usable], np.uint64)
    if len(np.unique(hashes)) != len(hashes):
        raise ValueError("two pieces have one hash")
    first, second, bits = _slots(hashes)
    likely = np.zeros(1 << _LIKELY, bool)
    likely[_slot(hashes, _LIKELY)] = True
    sizes = np.array(list(map(len, spelled)), np.int64)
    return Pieces(
        np.array([i for _, i, _ in usable], np.int32), np.array([len(p) for _, _, p in usable]), hashes,
        -sharpness * np.log(np.arange(len(usable)) + 2.0), first, second, bits, likely, byte_ids,
        -sharpness * float(np.log(len(usable) + 2.0)),
        np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(spelled), np.uint8),
    )


_loaded: dict[tuple[str, float], Pieces] = {}


def pieces_of(path: str, sharpness: float) -> Pieces:
    if (path, sharpness) not in _loaded:
        _loaded[path, sharpness] = load(path, sharpness)
    return _loaded[path, sharpness]


class Lattice:
    """Forward weights of different words, all at once.

    States are (prefix length, word) in that order, words from long to short, so that the states of one
    length lie together and every word's states are found by its rank.
    """

    def __init__(self, different: list[str], pieces: Pieces, weighed: bool = True):
        lengths = np.fromiter(map(len, different), np.int64, len(different))
        self.order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(different), np.int64)
        self.rank[self.order] = np.arange(len(different))
        self.lengths = lengths
        by_rank = lengths[self.order]
        longest = int(by_rank[0]) if len(by_rank) else 0
        # States of length p belong to the words of rank below ``alive[p]``.
        self.alive = np.searchsorted(-by_rank, -np.arange(longest + 2), side="right")
        self.base = np.concatenate([[0], np.cumsum(self.alive)])
        codes = np.frombuffer("".join(different[i] for i in self.order).encode("utf-32-le", "surrogatepass"), np.uint32)
        word_start = np.cumsum(by_rank) - by_rank
        rank_of = np.repeat(np.arange(len(by_rank)), by_rank)
        place = np.arange(len(codes)) - word_start[rank_of]
        left = by_rank[rank_of] - place
        self._edges(codes.astype(np.uint64) + np.uint64(1), rank_of, place, left, pieces)
        if weighed:
            self._filter(longest)

    def _edges(self, codes, rank_of, place, left, pieces: Pieces) -> None:
        found, spelled = [], np.ones(len(codes), bool)
        rolled = np.zeros(len(codes), np.uint64)
        at = np.arange(len(codes), dtype=np.int32)
        with np.errstate(over="ignore"):
            for size in range(1, pieces.longest + 1):
                fits = left[at] >= size
                at, rolled = at[fits], rolled[fits]
                if not len(at):
                    break
                rolled = rolled * np.uint64(_MULTIPLIER) + codes[at + size - 1]
                hit = np.flatnonzero(pieces.likely[_slot(rolled, _LIKELY)])
                want = rolled[hit]
                slots = _slot(want, pieces.bits)
                number = pieces.first[slots]
                other = np.flatnonzero(pieces.hashes[number] != want)
                number[other] = pieces.second[slots[other]]
                good = pieces.hashes[number] == want
                good &= number >= 0
                hit, number = at[hit[good]], number[good]
                if size == 1:
                    spelled[hit] = False
                found.append((size, hit, pieces.weights[number], pieces.ids[number]))
        alone = np.flatnonzero(spelled)
        points = (codes[alone] - np.uint64(1)).astype(np.int64)
        n_bytes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        found.append((1, alone, pieces.byte_weight * n_bytes, -1 - points))

        ends = [self.base[place[hit] + size] + rank_of[hit] for size, hit, _, _ in found]
        degree = np.zeros(int(self.base[-1]) + 1, np.int64)
        for end in ends:
            degree[end] += 1
        self.offset = np.concatenate([[0], np.cumsum(degree)])
        total = int(self.offset[-1])
        self.source, self.weight = np.empty(total, np.int32), np.empty(total, np.float32)
        self.piece, self.size = np.empty(total, np.int32), np.empty(total, np.int8)
        filled = self.offset[:-1].copy()
        for (size, hit, weight, piece), end in zip(found, ends, strict=True):
            slot = filled[end]
            filled[end] += 1
            self.source[slot] = self.base[place[hit]] + rank_of[hit]
            self.weight[slot], self.piece[slot], self.size[slot] = weight, piece, size

    def _filter(self, longest: int) -> None:
        """Log weights of all states, and for each edge the share of its state's edges up to it."""
        self.forward = np.zeros(int(self.base[-1]) + 1)
        self.share = np.empty(len(self.weight), np.float32)
        for p in range(1, longest + 1):
            a, b = int(self.base[p]), int(self.base[p + 1])
            e, f = int(self.offset[a]), int(self.offset[b])
            values = self.forward[self.source[e:f]] + self.weight[e:f]
            starts = self.offset[a:b] - e
            counts = self.offset[a + 1:b + 1] - self.offset[a:b]
            top = np.maximum.reduceat(values, starts)
            grown = np.exp(values - np.repeat(top, counts))
            sums = np.add.reduceat(grown, starts)
            self.forward[a:b] = top + np.log(sums)
            running = np.cumsum(grown)
            before = running[starts] - grown[starts]
            self.share[e:f] = (running - np.repeat(before, counts)) / np.repeat(sums, counts)
        del self.weight

    def state(self, word: np.ndarray) -> np.ndarray:
        return self.base[self.lengths[word]] + self.rank[word]


def draws(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the row's key and the place alone."""
    with np.errstate(over="ignore"):
        return (mixed(key + (place.astype(np.uint64) + np.uint64(1)) * GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def row_keys(doc_ids: pa.Array, seed: int) -> np.ndarray:
    """One key a row; null doc_ids share one."""
    ids = pc.fill_null(doc_ids, -1).to_numpy(False).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(mixed(ids + np.uint64(seed) * GOLDEN) + pc.is_null(doc_ids).to_numpy(False).astype(np.uint64))


def _space_led(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of spaces with the word after them, flat, and the rows' bounds."""
    if pc.any(pc.match_substring(column, "  ")).as_py():
        rows = [_WORDS.findall(t) for t in column.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return pa.array([w for r in rows for w in r], pa.string()), bounds
    lists = pc.split_pattern(column, " ")
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(False))]).astype(np.int64)
    leads = np.ones(len(flat), bool)
    leads[bounds[:-1][np.diff(bounds) > 0]] = False
    led = pc.if_else(pa.array(leads), pc.binary_join_element_wise(pa.scalar(" "), flat, ""), flat)
    full = pc.not_equal(pc.binary_length(led), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(False))]).astype(np.int64)
    return led.filter(full), kept[bounds]


#: Words of more code points, as texts without spaces, are gone through one state at a time, each by itself.
LONG_WORD = 4_096


class LongWord:
    """The lattice of one long word; its states are the prefix lengths."""

    def __init__(self, text: str, pieces: Pieces):
        lattice = Lattice([text], pieces, weighed=False)
        self.length = len(text)
        self.offset, self.source, self.piece = (x.tolist() for x in (lattice.offset, lattice.source, lattice.piece))
        weight = lattice.weight.tolist()
        forward, self.share = [0.0] * (self.length + 1), [0.0] * len(weight)
        for p in range(1, self.length + 1):
            e, f = self.offset[p], self.offset[p + 1]
            values = [forward[s] + w for s, w in zip(self.source[e:f], weight[e:f], strict=True)]
            top, total = max(values), 0.0
            for i, value in enumerate(values, e):
                total += math.exp(value - top)
                self.share[i] = total
            for i in range(e, f):
                self.share[i] /= total
            forward[p] = top + math.log(total)

    def drawn(self, key: np.uint64, end: int) -> list[int]:
        """Pieces of the occurrence that ends at place ``end`` of the row with this key."""
        u = draws(np.full(self.length + 1, key), np.arange(end - self.length, end + 1)).tolist()
        out, at, offset, share = [], self.length, self.offset, self.share
        while at:
            edge, last = offset[at], offset[at + 1] - 1
            while edge < last and share[edge] <= u[at]:
                edge += 1
            out.append(self.piece[edge])
            at = self.source[edge]
        return out[::-1]


def sample(column: pa.Array, keys: np.ndarray, pieces: Pieces, step: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows end to end, and the rows' bounds."""
    flat, bounds = _space_led(column)
    word, different = coded(flat)
    lengths = np.fromiter(map(len, different), np.int64, len(different))
    lattice = Lattice([w if len(w) <= LONG_WORD else "" for w in different], pieces)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    length = lengths[word]
    ends = np.cumsum(length)
    row_start = np.concatenate([[0], ends])[bounds[:-1]]
    place = ends - row_start[row]
    long, by_long = {}, np.flatnonzero(length > LONG_WORD)
    for number in np.unique(word[by_long]).tolist():
        own = LongWord(different[number], pieces)
        for i in by_long[word[by_long] == number].tolist():
            long[i] = own.drawn(keys[row[i]], int(place[i]))
    parts, counts = [], np.zeros(len(word), np.int64)
    for low in range(0, len(word), step):
        high = min(low + step, len(word))
        active = low + np.flatnonzero(length[low:high] <= LONG_WORD)
        state, at, drawn = lattice.state(word[active]), place[active], []
        key = keys[row[active]]
        inside = [i for i in long if low <= i < high]
        for i in inside:
            counts[i] = len(long[i])
        while len(active):
            edge = lattice.offset[state]
            u = draws(key, at)
            last = lattice.offset[state + 1] - 1
            ahead = np.flatnonzero((lattice.share[edge] <= u) & (edge < last))
            while len(ahead):
                edge[ahead] += 1
                ahead = ahead[(lattice.share[edge[ahead]] <= u[ahead]) & (edge[ahead] < last[ahead])]
            drawn.append((active, lattice.piece[edge]))
            counts[active] += 1
            state = lattice.source[edge]
            at = at - lattice.size[edge]
            more = state >= lattice.base[1]
            active, state, at, key = active[more], state[more], at[more], key[more]
        own = counts[low:high]
        start = np.cumsum(own) - own
        out = np.empty(int(own.sum()), np.int32)
        for n, (which, piece) in enumerate(drawn):
            out[start[which - low] + own[which - low] - 1 - n] = piece
        for i in inside:
            out[start[i - low]:start[i - low] + own[i - low]] = long[i]
        parts.append(out)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    totals = np.concatenate([[0], np.cumsum(counts)])
    return _spelled(ids, totals[bounds], pieces)


def _spelled(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Characters that no piece has become the byte pieces of their UTF-8 form."""
    foreign = np.flatnonzero(ids < 0)
    if not len(foreign):
        return ids, bounds
    raw = [chr(-1 - p).encode("utf-8", "surrogatepass") for p in ids[foreign].tolist()]
    width = np.ones(len(ids), np.int64)
    width[foreign] = list(map(len, raw))
    starts = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(ids, width)
    out[gathered(starts[foreign], width[foreign])] = pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, starts[bounds]


def spell(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> pa.Array:
    """The texts of rows of piece ids, by table lookup."""
    sizes = pieces.sizes[ids]
    raw = pieces.raw[gathered(pieces.starts[ids], sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes)])[bounds].astype(np.int64)
    rows = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
    return rows.cast(pa.binary())


def encode(docs: DataFrame, path: str | None = None, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, text_sha256): one sampled segmentation of every whole text.

    ``ids`` are little-endian unsigned 32-bit integers; ``text_sha256`` is of the source. Null
    and empty texts have no pieces. Equal (doc_id, text) rows get equal pieces; null doc_ids share a key.
    """
    path = path or default_model()

    def work(piece):
        held = pieces_of(path, sharpness)
        ids, bounds = sample(piece["text"], row_keys(piece["doc_id"], seed), held)
        offsets = (bounds * 4).astype(np.int64)
        rows = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1,
            [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
        return {"doc_id": piece["doc_id"], "ids": rows.cast(pa.binary()), "text_sha256": piece["text_sha256"]}

    source = texts(docs).withColumn("text_sha256", F.sha2("text", 256))
    return per_slice(source, work, "doc_id long, ids binary, text_sha256 string", LATTICE_CHARS)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the ``text`` that its ids spell; ids of no text spell the empty one."""
    path = path or default_model()
    schema = StructType([*encoded.schema.fields, StructField("text", StringType())])

    def run(batches):
        held = pieces_of(path, SHARPNESS)
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                rows = [r.as_buffer() for r in part["ids"]]
                ids = np.frombuffer(b"".join(rows), "<u4")
                bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, spell(ids, bounds, held).cast(pa.string())], names=[*part.schema.names, "text"])

    return encoded.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, text_sha256 of the source, and whether the decoded text has the same.

    The digests of ``encode`` and ``decode``, in one pass: chained, each task would hold two workers.
    """
    path = path or default_model()

    def work(piece):
        held = pieces_of(path, SHARPNESS)
        ids, bounds = sample(piece["text"], row_keys(piece["doc_id"], SEED), held)
        raw = memoryview(ids.astype("<u4")).cast("B")
        decoded = spell(ids, bounds, held)
        ends = (bounds * 4).tolist()
        return {
            "doc_id": piece["doc_id"], "n_pieces": np.diff(bounds), "text_sha256": piece["text_sha256"],
            "ids_crc32": [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)],
            "lossless": [hashlib.sha256(d.as_buffer()).hexdigest() == s
                         for d, s in zip(decoded, piece["text_sha256"].to_pylist(), strict=True)],
        }

    source = texts(docs).withColumn("text_sha256", F.sha2("text", 256))
    return per_slice(
        source, work, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string, lossless boolean", LATTICE_CHARS)
