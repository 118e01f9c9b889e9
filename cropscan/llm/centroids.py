"""Exact k-means over whole-number vectors, with bounds that geometry tightens.

A vector keeps its cluster without a scan where its distance to its own centroid is below a lower bound of
its distances to all others. When centroids move, that bound must fall. Instead of by the greatest drift
it falls, per cluster, by what can happen inside the cluster's sphere (its old centroid, and the distance of
its farthest vector): of a centroid that moves by t past the sphere, a vector can come nearer by at most
t * cos(angle), where the angle is measured in the plane of the sphere's centre and the two positions, at the
middle of the move, between the move and the tangent to the sphere that is closest to it. Vectors whose bounds
do not decide are compared with all centroids in whole numbers, so ties fall as in a plain scan.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropscan.session import fresh_path

from .common import prepare
from .token_binary import removed

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Components of this size and more are refused: a distance of them may not fit a long.
LARGEST = 1 << 27
#: Up to this size products and their sums are exact in floating point.
_EXACT = 1 << 22
#: Share by which every bound is moved to the safe side of rounding.
_SLACK = 1e-9

STATE = "vec_id long, v array<int>, cluster int, distance long, lower double, scans int"


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of that many finite components, as floor(scale * x)."""
    prepare(embeddings.sparkSession)
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return x.where((F.size("x") == dimensions) & finite).select(
        "vec_id", F.transform("x", lambda e: F.floor(scale * e)).alias("v"))


def seeds(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ``1:<vec_id>`` has the smallest hashes; equal ids by their components. Null ids are no seeds."""
    first = vectors.where(F.col("vec_id").isNotNull()).orderBy(
        F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256), "v").limit(clusters)
    return np.array([r["v"] for r in first.collect()], np.int64)


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres."""
    if max(np.abs(v).max(initial=0), np.abs(centres).max(initial=0)) < _EXACT:
        a, c = v.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centres], 1)


def loosening(centres: np.ndarray, moved: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer any other centroid can have come to a vector in its sphere.

    With m the middle of a move from c to c' and u its direction, d(x,c) - d(x,c') =
    2t u(x-m) / (d(x,c) + d(x,c')) <= t cos(x-m, u), since the two distances together are 2|x-m| or more.
    The largest cosine in a sphere is that of the tangent next to u, or 1 where the sphere holds m or meets the axis.
    """
    old, new = centres.astype(np.float64), moved.astype(np.float64)
    drift = np.sqrt(((new - old) ** 2).sum(1))
    away = old[:, None, :] - ((old + new) / 2)[None, :, :]  # sphere centre seen from the middle of the move
    far = np.sqrt((away ** 2).sum(2))
    with np.errstate(invalid="ignore", divide="ignore"):
        along = np.einsum("ijd,jd->ij", away, new - old) / (far * drift)
        angle = np.arccos(np.clip(along, -1, 1)) - np.arcsin(np.clip(radius[:, None] * (1 + _SLACK) / far, 0, 1))
    cosine = np.where(np.isnan(angle) | (radius[:, None] >= far) | (angle <= 0), 1.0, np.cos(np.maximum(angle, 0)))
    loss = drift[None, :] * np.clip(cosine + 1e-12, 0, 1)
    np.fill_diagonal(loss, 0)
    return loss.max(1)


def _assign(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre (the first of equal ones), its squared distance, and a bound of the distance to the others."""
    d = _distances(v, centres)
    rows, cluster = np.arange(len(v)), d.argmin(1)
    nearest = d[rows, cluster]
    d[rows, cluster] = np.iinfo(np.int64).max
    return cluster, nearest, np.sqrt(d.min(1).astype(np.float64)) * (1 - _SLACK)


def _numbers(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch["v"].flatten().to_numpy(False).astype(np.int64).reshape(-1, dimensions)


def _state(batch: pa.RecordBatch, v: np.ndarray, cluster, distance, lower, scans) -> pa.RecordBatch:
    offsets = np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)
    return pa.RecordBatch.from_arrays([
        batch["vec_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel().astype(np.int32))),
        pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(lower), pa.array(scans.astype(np.int32)),
    ], names=["vec_id", "v", "cluster", "distance", "lower", "scans"])


def _first(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    dimensions = centres.shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _numbers(batch, dimensions)
                if np.abs(v).max() >= LARGEST:
                    raise ValueError(f"a component reaches {LARGEST}: its distances may not fit a long")
                yield _state(batch, v, *_assign(v, centres), np.ones(len(v)))

    return vectors.mapInArrow(run, STATE)


def _next(state: DataFrame, centres: np.ndarray, moved: np.ndarray, radius: np.ndarray) -> DataFrame:
    loss = loosening(centres, moved, radius)
    apart = np.sqrt(_distances(moved, moved).astype(np.float64))
    np.fill_diagonal(apart, np.inf)
    half = apart.min(1) / 2 * (1 - _SLACK)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _numbers(batch, moved.shape[1])
            cluster = batch["cluster"].to_numpy().astype(np.int64)
            distance = ((v - moved[cluster]) ** 2).sum(1)
            lower = batch["lower"].to_numpy() - loss[cluster]
            open_ = np.flatnonzero(np.sqrt(distance.astype(np.float64)) * (1 + _SLACK) >= np.maximum(lower, half[cluster]))
            scans = batch["scans"].to_numpy().copy()
            if len(open_):
                cluster[open_], distance[open_], lower[open_] = _assign(v[open_], moved)
                scans[open_] += 1
            yield _state(batch, v, cluster, distance, lower, scans)

    return state.mapInArrow(run, STATE)


def _facts(state: DataFrame, clusters: int, dimensions: int) -> list:
    """Per cluster: its vectors' sums by component, their number, greatest and total distance; one row a cluster."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dimensions)]
    return state.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max("distance").alias("far"), F.sum("distance").alias("inertia"), *sums).collect()


def centroid_hash(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def clustered(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, name: str = "clusters"
) -> tuple[DataFrame, np.ndarray, list]:
    """State of every vector after the last assignment, the final centroids, and one row of facts per cluster.

    The vectors travel with their bounds from round to round in a table of the shared folder, so nothing
    is shuffled but one row of sums per cluster and task. ``scans`` is how often a vector was compared with all centroids.
    """
    spark: SparkSession = vectors.sparkSession
    at = fresh_path(spark, f"{name}-vectors")
    vectors.write.parquet(at)
    last, vectors = at, spark.read.parquet(at)
    centres = seeds(vectors, clusters)
    if not len(centres):
        return spark.createDataFrame([], STATE), centres, []
    plan = _first(vectors, centres)
    for step in range(rounds + 1):
        at = fresh_path(spark, name)
        plan.write.parquet(at)
        removed(spark, last)
        last, state = at, spark.read.schema(STATE).parquet(at)
        facts = _facts(state, clusters, centres.shape[1])
        if step == rounds:
            return state, centres, facts
        moved, radius = centres.copy(), np.zeros(len(centres))
        for row in facts:
            moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centres.shape[1])]
            radius[row["cluster"]] = np.sqrt(float(row["far"]))
        plan, centres = _next(state, centres, moved, radius), moved
    raise AssertionError


def cluster_query(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans of every vector that is kept.

    Vectors that are null, of another length, or hold a null, NaN or infinite component are left out;
    components too large for exact distances raise an error. Of equal distances the smaller number counts.
    Repeated and null vec_ids stay as rows; fewer vectors than clusters give as many clusters as there are with
    an id. An empty table gives no rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    state, centres, facts = clustered(whole_vectors(embeddings))
    inertia = sum(row["inertia"] for row in facts)
    by_cluster = spark.createDataFrame(
        [(row["cluster"], row["inertia"], inertia, centroid_hash(centres[row["cluster"]])) for row in facts],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster, CLUSTERS of them.
    return state.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
