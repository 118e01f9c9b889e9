"""Language by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, per_slice, prepare, slices, table, texts

#: Training passages taken for each language, about; the dictionaries are all that is learned.
PASSAGES = 200
PASSAGE_CHARS = 500
#: Text is coded in blocks of this many code points, each with a fresh copy of the dictionary.
BLOCK_CHARS = 1_500
LEVEL = 9
#: Where fewer bytes than this part the two smallest, the text is coded again in pieces of so many
#: words, which adds to the sizes; a text that then still has less than MARGIN is rejected.
NARROW, PIECE_WORDS = 4, 3
MARGIN = 1
#: So is one whose margin is a smaller part of its size than LEAST times what clean passages of the
#: language have in the middle; LEAST_UNKNOWN is the part where fewer than LEAST_PASSAGES can tell.
LEAST, LEAST_PASSAGES, LEAST_UNKNOWN = 0.3, 8, 0.05

UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_SPACE = r"[\s\p{P}\p{S}\p{N}]+"


def letters_only(column: pa.Array) -> pa.Array:
    """Lower case, with everything that is neither letter nor mark read as one space."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(column), r"[^\pL\pM]+", " "), " ")


def learn(labelled: DataFrame, passages: int = PASSAGES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from (doc_id, text, lang) rows.

    Of each language, about ``passages`` documents chosen by a hash of doc_id give one passage each; the
    passage begins at a place that another hash chooses. Null lang is no language. Repeated rows are drawn
    alike; without a labelled row with text, as in an empty table, there is no dictionary.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*(
        F.when(F.col("lang") == name, F.lit(min(1.0, passages / n))) for name, n in counts.items()))
    draw = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30))
    size = F.length("text")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(size - PASSAGE_CHARS, F.lit(1))).cast("int") + 1
    chosen = rows.where(draw < share).select(
        "lang", F.xxhash64("doc_id", "text").alias("key"), F.substring("text", start, F.lit(PASSAGE_CHARS)).alias("text"))
    found: dict[str, list] = {}
    for row in chosen.collect():  # about ``passages`` rows of PASSAGE_CHARS for each language
        found.setdefault(row["lang"], []).append((row["key"], row["text"]))
    return {
        name: " ".join(letters_only(pa.array([t for _, t in sorted(rows)], pa.string())).to_pylist()).encode()
        for name, rows in sorted(found.items())
    }


class Compressors:
    """One zstd compressor for each language; sizes are of frames without header fields."""

    def __init__(self, dictionaries: dict[str, bytes], least: dict[str, float] | None = None, level: int = LEVEL):
        self.names = sorted(dictionaries)
        self.least = [(least or {}).get(name, LEAST_UNKNOWN) for name in self.names]
        self.compress = []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(
                level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        sizes = self._coded([text[i:i + BLOCK_CHARS] for i in range(0, len(text), BLOCK_CHARS)])
        low = sorted(sizes)[:2]
        if low[-1] - low[0] < NARROW and len(sizes) > 1:
            parts = text.split(" ")
            pieces = [" ".join(parts[i:i + PIECE_WORDS]) for i in range(0, len(parts), PIECE_WORDS)]
            sizes = [a + b for a, b in zip(sizes, self._coded(pieces), strict=True)]
        return sizes

    def _coded(self, pieces: list[str]) -> list[int]:
        raw = [p.encode() for p in pieces]
        return [sum(len(f(b)) for b in raw) for f in self.compress]


def least_margins(dictionaries: dict[str, bytes]) -> dict[str, float]:
    """By language, the least margin of a told text as a part of its size.

    One half of each dictionary codes passages of the other half, which are clean and not in it.
    """
    halves, passages = {}, {}
    for name, learned in dictionaries.items():
        parts = learned.decode().split(" ")
        rest = " ".join(parts[len(parts) // 2:])
        halves[name] = " ".join(parts[:len(parts) // 2]).encode()
        passages[name] = [rest[i:i + PASSAGE_CHARS] for i in range(0, len(rest) - PASSAGE_CHARS + 1, PASSAGE_CHARS)]
    coder, least = Compressors(halves), {}
    for place, name in enumerate(coder.names if len(coder.names) > 1 else []):
        if len(passages[name]) >= LEAST_PASSAGES:
            found = (coder.sizes(text) for text in passages[name])
            parts = [(min(sizes[:place] + sizes[place + 1:]) - sizes[place]) / sizes[place] for sizes in found]
            least[name] = LEAST * max(0.0, float(np.median(parts)))
    return least


def judged(column: pa.Array, coder: Compressors) -> dict[str, list]:
    """lang_pred, score, margin and rejected of every text."""
    out = {k: [] for k in ("lang_pred", "score", "margin", "rejected")}
    for text in letters_only(column).to_pylist():
        sizes = coder.sizes(text) if coder.names and _LETTER.search(text) else []
        if not sizes:
            name, score, margin, least = UNKNOWN, 0.0, 0, MARGIN
        else:
            best = int(np.argmin(sizes))
            rest = sorted(sizes[:best] + sizes[best + 1:])
            margin = rest[0] - sizes[best] if rest else sizes[best]
            score = 1.0 / (1.0 + sum(2.0 ** max(-60, sizes[best] - r) for r in rest))
            name = coder.names[best]
            least = max(MARGIN, coder.least[best] * sizes[best])
        out["lang_pred"].append(name)
        out["score"].append(score)
        out["margin"].append(margin)
        out["rejected"].append(name == UNKNOWN or margin < least)
    return out


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected), one row per row.

    ``margin``: bytes that the second smallest takes more than the smallest; ``score``: the share of
    the smallest when each language weighs 2 to the minus bytes saved. Equal sizes: first name. Null text,
    text without a letter, and no learned language: ``und``, score 0, rejected. Rejected as well: margins that
    are too small a part of the size, whatever the length, as of texts in a language that was not learned.
    """
    learned = dictionaries, least_margins(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # PASSAGES x PASSAGE_CHARS each
    made: list[Compressors] = []

    def work(piece):
        if not made:
            made.append(Compressors(*shared.value))
        return {"doc_id": piece["doc_id"], **judged(piece["text"], made[0])}

    return per_slice(texts(docs), work, "doc_id long, lang_pred string, score double, margin long, rejected boolean")


def without_rejected(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows whose language is told with a margin, with all their columns as they were.

    Null text and text without a letter are rejected; ids, repeated rows and other columns have no part in it.
    An empty table gives no rows. Without any dictionary no language can be told or rejected, and
    all rows stay.
    """
    if not dictionaries:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((dictionaries, least_margins(dictionaries)))

    def keep(batches):
        coder = Compressors(*shared.value)
        for piece in slices(batches):
            rejected = judged(pc.fill_null(piece["text"].cast(pa.string()), ""), coder)["rejected"]
            yield piece.filter(pc.invert(pa.array(rejected, pa.bool_())))

    prepare(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang")).where(~held_out(4, 2))


def language_query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, learn(train_rows(docs)))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
