"""Document quality: random-indexing word vectors, pooled, and a small calibrated network.

Every word has a sparse random index vector, made from its hash. The vector of a word is the sum of the
index vectors of the words next to it over the whole corpus. A document is the pool of its words'
vectors. A two-layer network in numpy maps the pool to a probability, with one temperature
fitted on rows that the network was not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, held_out, mixed, per_slice, slices, table, texts, word_hashes, words
from .sampling import TRAIN_ROWS, training_labels

#: Words share this many vectors by hash; with DIMENSIONS it bounds the model, whatever the corpus.
VECTORS = 8192
DIMENSIONS = 64
NONZEROS = 4
WINDOW = 2
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.3
SEED = 7


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each vector's nonzero entries."""
    number = np.arange(VECTORS * NONZEROS, dtype=np.uint64).reshape(VECTORS, NONZEROS)
    drawn = mixed(number + np.uint64(1))
    return (drawn % np.uint64(DIMENSIONS)).astype(np.int64), 1 - 2 * (drawn >> np.uint64(63)).astype(np.int64)


def token_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vector numbers of all tokens, and the rows' bounds. Runs of signs are tokens, and case counts."""
    parted = pc.replace_substring_regex(column, r"([^\pL\pN\s]+)", r" \1 ")
    flat, bounds = words(parted)
    index, different = coded(flat)
    numbers = (word_hashes(different) % np.uint64(VECTORS)).astype(np.int64)
    return (numbers[index] if different else np.zeros(0, np.int64)), bounds


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all numbers, from the contexts in every document."""
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def count(batches):
        place, sign = index_vectors()
        total = np.zeros(VECTORS * DIMENSIONS, np.int64)
        for piece in slices(batches):
            numbers, bounds = token_numbers(piece["text"])
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for step in range(1, WINDOW + 1):
                together = row[step:] == row[:-step]
                left, right = numbers[:-step][together], numbers[step:][together]
                for word, near in ((left, right), (right, left)):
                    for k in range(NONZEROS):
                        total += np.bincount(
                            word * DIMENSIONS + place[near, k], weights=sign[near, k], minlength=len(total)).astype(np.int64)
        vectors = total.reshape(VECTORS, DIMENSIONS)
        used = np.flatnonzero(vectors.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(vectors[used, i]) for i in range(DIMENSIONS))], names=["word", *names])

    schema = ", ".join(["word long", *(f"{n} long" for n in names)])
    sums = texts(docs).mapInArrow(count, schema).groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((VECTORS, DIMENSIONS), np.float32)
    if sums.num_rows:
        out[sums["word"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], axis=1)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Rows of features: mean vector of the tokens, of the different tokens, share of different ones, log of the count.

    A text without a token is a row of zeros.
    """
    numbers, bounds = token_numbers(column)
    out = np.zeros((len(bounds) - 1, 2 * DIMENSIONS + 2), np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if a < b:
            counts = np.bincount(numbers[a:b], minlength=VECTORS)
            used = np.flatnonzero(counts)
            held = vectors[used]
            out[i, :DIMENSIONS] = counts[used] @ held / (b - a)
            out[i, DIMENSIONS:-2] = held.mean(axis=0)
            out[i, -2:] = len(used) / min(b - a, VECTORS), np.log(b - a) / 10
    return out


@dataclass
class Network:
    """Scaled input, tanh layer, logit; the logit is divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Rounded, so that equal rows score alike whatever other rows are multiplied with them."""
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40))), 9)


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits)) if len(y) else 0.0


def train(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Network:
    """Adam on the rows not ``apart``; the temperature is fitted on those that are. No row: always one half."""
    rng = np.random.default_rng(SEED)
    n_in = x.shape[1]
    if len(y) == 0:
        return Network(np.zeros(n_in), np.ones(n_in), np.zeros((n_in, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    fit = ~apart if (~apart).any() else np.ones(len(y), bool)
    centre, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    rate = float(np.clip(y[fit].mean(), 0.01, 0.99))
    params = [rng.normal(0, n_in ** -0.5, (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN),
              np.array(np.log(rate / (1 - rate)))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z, target, step = ((x - centre) / scale)[fit].astype(float), y[fit], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            step += 1
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40))) - target[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden ** 2)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ error + 1e-4 * params[2], error.sum()]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - 0.005 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    made = Network(centre, scale, params[0], params[1], params[2], float(params[3]))
    if apart.any():
        logits = made.logits(x[apart])
        made.temperature = min(np.geomspace(0.5, 8, 41), key=lambda t: log_loss(logits / t, y[apart]))
    return made


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """The network from about ``rows`` labelled rows; a fifth of them only sets the temperature."""
    chosen = training_labels(labels, label, rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # VECTORS x DIMENSIONS
    some = texts(docs).join(F.broadcast(chosen), "doc_id")  # the bound of ``rows``
    schema = "doc_id long, y double, x array<float>"

    def work(piece):
        x = pooled(piece["text"], shared.value)
        return {"doc_id": piece["doc_id"], "y": piece["y"], "x": pa.FixedSizeListArray.from_arrays(
            pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))}

    rows_ = per_slice(some, work, schema).toArrow().to_pydict()
    order = np.lexsort((rows_["y"], rows_["doc_id"]))
    x = np.array(rows_["x"], np.float64).reshape(len(order), 2 * DIMENSIONS + 2)[order]
    ids, y = np.array(rows_["doc_id"], np.int64)[order], np.array(rows_["y"], float)[order]
    return train(x, y, mixed(ids.view(np.uint64)) % np.uint64(5) == 0)


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts are scored as a row of zeros."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def work(piece):
        held, net = shared.value
        return {"doc_id": piece["doc_id"], "score": net.probability(pooled(piece["text"], held).astype(float))}

    return per_slice(texts(docs), work, "doc_id long, score double")


def quality_query(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows of equal text get equal scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = word_vectors(docs)
    scored = score(docs, vectors, fit(docs, labels, vectors))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
