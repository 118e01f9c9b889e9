"""Several k-means fits side by side: every pass over the rows serves all of them.

The features are stored once, without anything else. Seeding takes one pass per cluster and Lloyd's
iteration one pass per step, however many restarts there are. A pass is one aggregation: a task turns its rows into a few
numbers per restart and cluster, which is all that is shuffled. Nothing is cached, so no memory grows with the rows or with the
number of restarts.

Most of Lloyd's steps move centres through the bulk of the rows. They are taken over a summary first, the count and mean of
the rows in each cell of a grid, which every row is in and which is bounded. A step over the rows then starts where those
settled, and corrects them; fits settle when a step over the rows no longer moves their centres, and few are needed.

The centres stand beside the rows as one literal table. The generated code is then the same at every step, where centres as
literals of their own would have it compiled anew for each, on every executor; and no row leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropscan.session import bound_methods, stored_for_a_while

Centres = Sequence[Sequence[float]]

ROW = "_row"

#: Cells of the grid that rows are summarised in, about, at most. The driver holds their counts and means: 3 MB of five features.
CELLS = 1 << 16


@dataclass(frozen=True)
class Restart:
    """One of several fits: its seed, centres, cost, and the steps it took to settle."""

    seed: int
    centres: list[list[float]]
    cost: float
    steps: int
    settled: bool


def _distances(columns: Sequence[np.ndarray], centres: Centres | np.ndarray) -> np.ndarray:
    """Squared distances, one line per centre. Term by term, as the expression on columns does: ties fall alike."""
    near, gap = np.zeros((len(centres), len(columns[0]))), np.empty(len(columns[0]))
    for distance, centre in zip(near, centres):
        for column, value in zip(columns, centre):
            np.subtract(column, value, out=gap)
            np.multiply(gap, gap, out=gap)
            distance += gap
    return near


def _members(near: np.ndarray) -> np.ndarray:
    """Per centre 1.0 for the rows it is nearest to, the first of equally near ones."""
    mine, nearest, free = np.empty_like(near), near.min(0), np.ones(near.shape[1], bool)
    for c, distance in enumerate(near):
        here = distance == nearest
        here &= free
        free ^= here
        mine[c] = here
    return mine


def _beside(
    table: DataFrame, features: Sequence[str], groups: Sequence[Centres], salts: Sequence[int] | None = None
) -> DataFrame:
    """Every row that lacks no feature once per group: ``_group``, the features as ``_f0`` and so on, and, where there are
    centres, ``_near``, the squared distance to the group's nearest one, and ``_c``, the first that is as near.

    Groups of fewer centres than others repeat their first, which no row is nearest to again. With ``salts``, one number per group, the row
    number and ``_salt`` come along.
    """
    bound_methods(table.sparkSession)
    most = max(len(group) for group in groups)
    fields = [f"_f{k}" for k in range(len(features))]

    def line(g: int, group: Centres) -> str:
        values = [f"{g} AS _group", *([] if salts is None else [f"{salts[g]}L AS _salt"])]
        for c in range(most):
            values += [f"double('{float(v)!r}') AS _m{c}_{k}" for k, v in enumerate(group[c if c < len(group) else 0])]
        return f"struct({', '.join(values)})"

    def distance(c: int) -> Column:
        total = F.lit(0.0)
        for k, field in enumerate(fields):
            gap = F.col(field) - F.col(f"_m{c}_{k}")
            total = total + gap * gap
        return total

    kept = [] if salts is None else [ROW]
    rows = table.select(*kept, *(F.col(f).cast("double").alias(name) for f, name in zip(features, fields, strict=True)))
    lines = ", ".join(line(g, group) for g, group in enumerate(groups))
    each = rows.dropna(subset=fields).select("*", F.expr(f"inline(array({lines}))"))
    kept += ["_group", *fields] if salts is None else ["_group", "_salt", *fields]
    if not most:
        return each.select(*kept)
    apart = [F.col(f"_d{c}") for c in range(most)]
    found = each.select(*kept, *(distance(c).alias(f"_d{c}") for c in range(most))).withColumn(
        "_near", F.least(*apart) if most > 1 else apart[0])
    nearest = F.coalesce(*(F.when(d == F.col("_near"), F.lit(c)) for c, d in enumerate(apart)))
    return found.select(*kept, "_near", nearest.alias("_c"))


def seeded_starts(
    table: DataFrame, features: Sequence[str], clusters: int, seeds: Sequence[int]
) -> list[list[list[float]]]:
    """Starting centres for every seed by distance-weighted draws (k-means++).

    ``table`` is stored and has a row number in ``_row``. A first centre is drawn evenly, each further one
    with a chance in proportion to the squared distance to those drawn before. A draw is the row whose
    -log(u) / weight is smallest, with u from a hash of row number, seed and turn; a minimum is
    found in every task apart, so one pass draws for all seeds, and a rerun task draws the same. The drawn rows are then looked
    up by number. With fewer different rows than clusters the last centre is repeated.
    """
    names = list(features)
    starts: list[list[list[float]]] = [[] for _ in seeds]
    for turn in range(clusters):
        salts = [(seed * 1_000_003 + turn * 7_919 + 1) % (1 << 63) for seed in seeds]
        each = _beside(table, names, starts, salts)
        even = F.shiftrightunsigned(F.xxhash64(ROW, "_salt"), 11).cast("double")
        chance = -F.log((even + 0.5) / float(1 << 53))
        if turn:
            each = each.filter(F.col("_near") > 0)
            chance = chance / F.col("_near")
        drawn = {r["_group"]: r["row"] for r in each.groupBy("_group").agg(F.min_by(ROW, chance).alias("row")).collect()}
        if turn == 0 and len(drawn) < len(seeds):
            raise ValueError("no row has all features")
        rows = {}
        if drawn:
            wanted = table.filter(F.col(ROW).isin(sorted(set(drawn.values()))))
            rows = {r[0]: list(r[1:]) for r in wanted.select(ROW, *(F.col(f).cast("double") for f in names)).collect()}
        for i, start in enumerate(starts):
            start.append(list(rows[drawn[i]] if i in drawn else start[-1]))
    return starts


def _sums(table: DataFrame, features: Sequence[str], groups: Sequence[Centres]) -> list:
    """Per group and cluster that has rows: rows, sum of squared distances, and sums of the features in their order."""
    sums = [F.sum(f"_f{k}") for k in range(len(features))]
    return _beside(table, features, groups).groupBy("_group", "_c").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_near").alias("cost"), F.array(*sums).alias("sums")).collect()


def lloyd_steps_together(
    table: DataFrame, features: Sequence[str], groups: Sequence[Centres]
) -> list[list[list[float]]]:
    """The centres of every group after one Lloyd step, from one pass; an empty cluster keeps its centre.

    A row counts for its nearest centre in each group, the first of equally near ones.
    """
    moved = [[list(map(float, c)) for c in group] for group in groups]
    for row in _sums(table, features, groups):
        moved[row["_group"]][row["_c"]] = [total / row["n"] for total in row["sums"]]
    return moved


def costs_together(table: DataFrame, features: Sequence[str], groups: Sequence[Centres]) -> list[float]:
    """Sum of squared distances to the nearest centre for every group, from one pass."""
    costs = [0.0] * len(groups)
    for row in sorted(_sums(table, features, groups), key=lambda r: r["_c"]):
        costs[row["_group"]] += row["cost"]
    return costs


def feature_rows(pixels: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features alone, as numbers, of rows that lack none of them, with a row number."""
    narrow = pixels.select(*(F.col(f).cast("double").alias(f) for f in features)).dropna()
    return narrow.withColumn(ROW, F.monotonically_increasing_id())


def _settled(before: Centres, after: Centres, tol: float) -> bool:
    return all(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) <= tol * tol for x, y in zip(before, after, strict=True))


def fit_from_starts(
    table: DataFrame, features: Sequence[str], starts: Sequence[Centres], max_iter: int = 300, tol: float = 1e-4
) -> list[tuple[list[list[float]], int, bool]]:
    """(centres, steps, settled) for every start. One whose centres all move by ``tol`` at most is left out of later passes."""
    current = [[list(map(float, c)) for c in start] for start in starts]
    steps, done = [0] * len(current), [False] * len(current)
    for _ in range(max_iter):
        open_ = [i for i, d in enumerate(done) if not d]
        if not open_:
            break
        moved = lloyd_steps_together(table, features, [current[i] for i in open_])
        for i, centres in zip(open_, moved, strict=True):
            done[i] = _settled(current[i], centres, tol)
            current[i], steps[i] = centres, steps[i] + 1
    return list(zip(current, steps, done, strict=True))


def summarised(table: DataFrame, features: Sequence[str], cells: int = CELLS) -> np.ndarray | None:
    """Count and feature means of the rows in every cell of a grid over all of them, one line per cell that has any.

    There are about ``cells`` lines at most, however many rows. None where some feature has no finite extremes.
    """
    names = list(features)
    ends = table.agg(*(F.min(f).cast("double") for f in names), *(F.max(f).cast("double") for f in names)).first()
    low, high = ends[:len(names)], ends[len(names):]
    if not all(v is not None and math.isfinite(v) for v in ends) or not all(math.isfinite(b - a) for a, b in zip(low, high)):
        return None
    spread = [(f, a, b) for f, a, b in zip(names, low, high) if b > a]

    # Features that go together leave most of a grid empty: the finest of these whose cells with rows are few enough.
    coarsest, halvings = max(1, int(cells ** (1 / max(1, len(spread))) + 1e-9)), 4
    finest = coarsest << halvings
    placed = table.select(*names, *(
        F.least(F.floor((F.col(f) - F.lit(a)) / F.lit(b - a) * finest), F.lit(finest - 1)).cast("int").alias(f"_{f}")
        for f, a, b in spread))

    def cell(up: int) -> list[Column]:
        return [F.shiftright(f"_{f}", up).alias(f"_{f}") for f, _, _ in spread]

    up = halvings
    if spread:
        counts = placed.agg(*(F.approx_count_distinct(F.xxhash64(*cell(k))).alias(f"up{k}") for k in range(halvings))).first()
        up = next((k for k in range(halvings) if counts[f"up{k}"] <= cells), halvings)
    rows = placed.groupBy(*cell(up)).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.avg(f).alias(f) for f in names))
    found = rows.select("n", *names).toArrow()
    return np.stack([found[c].to_numpy() for c in ("n", *names)], 1)


def _summary_step(summary: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """The centres after one Lloyd step over weighted points, and the weight of each; an empty cluster keeps its centre."""
    weight, points = summary[:, 0], summary[:, 1:]
    mine = _members(_distances(points.T, centres))
    rows = mine @ weight
    moved = np.array(centres, np.float64)
    moved[rows > 0] = (mine @ (points * weight[:, None]))[rows > 0] / rows[rows > 0, None]
    return moved, rows


def fit_summary(
    summary: np.ndarray, centres: Centres, max_iter: int, tol: float, offset: np.ndarray | float = 0.0
) -> list[list[float]]:
    """Where Lloyd's steps over weighted points lead, each corrected by ``offset``."""
    found = np.array(centres, np.float64)
    for _ in range(max_iter):
        moved, rows = _summary_step(summary, found)
        moved = np.where(rows[:, None] > 0, moved + offset, found)
        settled = _settled(found, moved, tol)
        found = moved
        if settled:
            break
    return found.tolist()


def fit_with_summary(
    table: DataFrame, features: Sequence[str], starts: Sequence[Centres], max_iter: int = 300, tol: float = 1e-4
) -> list[tuple[list[list[float]], int, bool]]:
    """``fit_from_starts`` with the way between two passes over the rows taken over their summary.

    What a step over the rows adds to one over the summary corrects the summary's steps from there. Centres settle by the same
    rule, a step over all rows. Where a pass does not halve the last one's move, plain steps over the rows go on.
    """
    summary = summarised(table, features)
    if summary is None:
        return fit_from_starts(table, features, starts, max_iter, tol)
    current = [fit_summary(summary, start, max_iter, tol / 10) for start in starts]
    steps, done, plain, last = [0] * len(current), [False] * len(current), [False] * len(current), [math.inf] * len(current)
    for _ in range(max_iter):
        open_ = [i for i, d in enumerate(done) if not d]
        if not open_:
            break
        moved = lloyd_steps_together(table, features, [current[i] for i in open_])
        for i, centres in zip(open_, moved, strict=True):
            steps[i] += 1
            done[i] = _settled(current[i], centres, tol)
            gap = float(np.abs(np.subtract(centres, current[i])).max())
            plain[i] = plain[i] or gap > last[i] / 2
            last[i] = gap
            if not (done[i] or plain[i] or steps[i] == max_iter):
                offset = np.subtract(centres, _summary_step(summary, current[i])[0])
                centres = fit_summary(summary, centres, max_iter, tol / 10, offset)
            current[i] = centres
    return list(zip(current, steps, done, strict=True))


def fit_rows(
    table: DataFrame, features: Sequence[str], clusters: int, seeds: Iterable[int] = range(10),
    max_iter: int = 300, tol: float = 1e-4,
) -> list[Restart]:
    """One fit per seed over stored ``feature_rows``, best (lowest cost, then lowest seed) first.

    The starts are drawn among the rows. At most ``max_iter`` steps go over the rows, which are those that ``steps`` and
    ``settled`` tell of, and as many over their summary before each.
    """
    seeds = list(seeds)
    starts = seeded_starts(table, features, clusters, seeds)
    fits = fit_with_summary(table, features, starts, max_iter, tol)
    costs = costs_together(table, features, [centres for centres, _, _ in fits])
    found = [Restart(seed, fit[0], cost, *fit[1:]) for seed, fit, cost in zip(seeds, fits, costs, strict=True)]
    return sorted(found, key=lambda r: (r.cost, r.seed))


def fit_together(pixels: DataFrame, features: Sequence[str], clusters: int, **options) -> list[Restart]:
    """One fit per seed, best first, over features that are stored for the time of the fits.

    Rows with a null feature take no part. Without any row there is nothing to fit, which is an error.
    """
    with stored_for_a_while(feature_rows(pixels, features), "features") as table:
        return fit_rows(table, features, clusters, **options)
