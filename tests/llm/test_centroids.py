import hashlib
import math
import random

import numpy as np
import pytest

from cropscan.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, v string"


def brute(rows, clusters=16, rounds=3):
    """The contract in whole Python numbers."""
    kept = [
        (i, tuple(math.floor(64 * float(np.float32(x))) for x in e)) for i, e in rows
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:clusters]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((gap(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centres = [tuple(sum(x) // len(members[k]) for x in zip(*members[k])) if k in members else c for k, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {k: sum(d for _, c, d in found if c == k) for k in range(len(centres))}
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), named[k]) for i, k, d in found), key=str)


def result(frame):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[c] for c in names) for r in ce.cluster_query(frame).collect()), key=str)


def frame_of(spark, rows, partitions=4):
    return spark.createDataFrame([(i, e, 0, "c", "d", "v") for i, e in rows], SCHEMA).repartition(partitions)


def vectors(seed, many, spread=0.1, groups=5):
    dice = np.random.default_rng(seed)
    middles = dice.normal(0, 1, (groups, 64))
    return [(i, [float(x) for x in (middles[i % groups] + dice.normal(0, spread, 64)).astype(np.float32)]) for i in range(many)]


@pytest.mark.parametrize("seed, spread", [(1, 0.05), (2, 0.5), (3, 3.0)])
def test_clusters_equal_brute_force(spark, seed, spread):
    rows = vectors(seed, 250, spread)
    assert result(frame_of(spark, rows)) == brute(rows)


def test_bounds_spare_scans_and_lose_nothing(spark):
    """Where clusters are apart most vectors are scanned fewer times than there are assignments."""
    rows = vectors(4, 600, 0.02, groups=16)
    found = ce.cluster_query(frame_of(spark, rows)).collect()
    assert np.mean([r["scans"] for r in found]) < 3 and result(frame_of(spark, rows)) == brute(rows)


def test_loosening_covers_every_vector_and_less_than_the_drift():
    dice = np.random.default_rng(6)
    tighter = 0
    for _ in range(300):
        centres = dice.normal(0, 40, (5, 6))
        moved = centres + dice.normal(0, dice.choice([0.5, 5, 30]), (5, 6))
        radius = np.abs(dice.normal(0, 10, 5))
        loss = ce.loosening(centres, moved, radius)
        drift = np.sqrt(((moved - centres) ** 2).sum(1))
        for i in range(5):
            others = [j for j in range(5) if j != i]
            way = dice.normal(0, 1, (200, 6))
            x = centres[i] + way / np.sqrt((way ** 2).sum(1))[:, None] * radius[i] * dice.uniform(0, 1, (200, 1))
            far = lambda c: np.sqrt(((x[:, None] - c[others]) ** 2).sum(2))
            assert (far(centres) - far(moved)).max() <= loss[i] + 1e-9
            assert loss[i] <= drift[others].max() + 1e-9
            tighter += loss[i] < 0.9 * drift[others].max()
    assert tighter > 100


def test_awkward_vectors(spark):
    good = [0.5] * 64
    rows = [
        (1, good), (2, good), (2, [-0.26] * 64), (None, good), (None, [9.0] * 64), (3, None), (4, []), (5, good[:63]), (6, good + [1.0]),
        (7, [None] + good[1:]), (8, [float("nan")] + good[1:]), (9, [float("inf")] + good[1:]), (10, [float("-inf")] + good[1:]),
        (11, [-1e-9] * 64), (12, [70_000.0] * 64), (12, [70_000.0] * 64)]
    assert result(frame_of(spark, rows)) == brute(rows)


def test_ties_and_fewer_vectors_than_clusters(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(40)]
    assert result(frame_of(spark, rows)) == brute(rows)
    assert result(frame_of(spark, rows[:4])) == brute(rows[:4])


def test_nothing_and_too_much(spark):
    assert result(frame_of(spark, []).limit(0)) == [] and result(frame_of(spark, [(1, None), (2, [1.0])])) == []
    with pytest.raises(Exception, match="may not fit"):
        result(frame_of(spark, [(1, [3e7] * 64)]))
