import math
import random

import pytest
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.functions.indices import with_indices
from cropscan.functions.quality import clear_pixels
from cropscan.operators import clustering as cl
from cropscan.operators import restarts as rt


@pytest.fixture(scope="module")
def ready(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("restarts") / "features")
    with_indices(clear_pixels(fx.pixel_obs(spark, sf_dir)), cl.INDEX_FEATURES).select(*cl.INDEX_FEATURES).write.parquet(path)
    return spark.read.parquet(path)


def one_step(points, centres):
    """The same step in plain Python."""
    members = [[] for _ in centres]
    for p in points:
        members[min(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centres[c])), c))].append(p)
    return [[sum(v) / len(m) for v in zip(*m)] if m else list(map(float, c)) for m, c in zip(members, centres)]


def test_steps_together_are_steps_apart(spark):
    dice = random.Random(5)
    points = [(dice.randint(0, 9), dice.randint(0, 9)) for _ in range(200)]
    frame = spark.createDataFrame(points, "a INT, b INT")
    groups = [[(0, 0), (9, 9)], [(5, 5)], [(1, 1), (1, 1), (8, 2), (99, 99)], [(0, 9), (9, 0), (4, 4)]]
    assert rt.lloyd_steps_together(frame, ["a", "b"], groups) == [
        [pytest.approx(c) for c in one_step(points, g)] for g in groups]
    costs = rt.costs_together(frame, ["a", "b"], groups)
    for group, cost in zip(groups, costs):
        assert cost == sum(min(sum((x - y) ** 2 for x, y in zip(p, c)) for c in group) for p in points)


def test_fits_equal_fits_from_the_same_starts_alone(ready):
    starts = [[(-3000.0, 0.0, -3000.0), (0.0, 0.0, 0.0), (3000.0, 0.0, 3000.0)], [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (5.0, 0.0, 9.0)]]
    both = rt.fit_from_starts(ready, cl.INDEX_FEATURES, starts, max_iter=4, tol=0.0)
    for start, (centres, steps, settled) in zip(starts, both):
        alone = cl.lloyd_fit(ready, start, cl.INDEX_FEATURES, steps=4)
        assert [pytest.approx(c) for c in alone] == centres
        assert steps == 4 and not settled


def test_costs_are_as_low_as_those_of_separate_fits(ready):
    together = rt.fit_together(ready, cl.INDEX_FEATURES, clusters=4, seeds=range(10), max_iter=100)
    costs = [r.cost for r in together]
    assert costs == sorted(costs) and sorted(r.seed for r in together) == list(range(10))
    separate = cl.fit_restarts(ready, cl.INDEX_FEATURES, clusters=4, seeds=range(10), max_iter=100)
    assert costs[0] <= separate[0][1].summary.trainingCost * (1 + 1e-3)
    again = rt.fit_together(ready, cl.INDEX_FEATURES, clusters=4, seeds=[together[0].seed], max_iter=100)[0]
    assert again.cost == pytest.approx(costs[0], rel=1e-9)


def test_draws_follow_the_squared_distance(spark):
    """Three values at distances 1, 2 and 3 from the first centre, each held by as many rows."""
    rows = [(float(v),) for v in (0, 1, 2, 3) for _ in range(4 if v else 400)]
    table = spark.createDataFrame(rows, "v DOUBLE").coalesce(1).withColumn("_row", F.monotonically_increasing_id())
    starts = []
    for begin in range(0, 600, 100):
        starts += rt.seeded_starts(table, ["v"], 2, range(begin, begin + 100))
    second = [s[1][0] for s in starts if s[0] == [0.0]]
    assert len(second) > 500 and 0.0 not in second
    for value in (1, 2, 3):
        expected = value ** 2 / 14 * len(second)
        assert abs(second.count(float(value)) - expected) < 4 * math.sqrt(expected)


def test_few_rows_nulls_and_no_rows(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (None, 3.0)], "a DOUBLE, b DOUBLE")
    best = rt.fit_together(frame, ["a", "b"], clusters=3, seeds=[7])[0]
    assert best.centres == [[1.0, 1.0]] * 3 and best.cost == 0.0 and best.settled
    with pytest.raises(ValueError, match="no row"):
        rt.fit_together(frame.limit(0), ["a", "b"], clusters=2)


def test_one_pass_serves_all_restarts(ready, monkeypatch):
    """A step reads the features once and shuffles one row per centre and task, whatever the number of restarts."""
    plans = []
    collect = type(ready).collect

    def kept(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return collect(frame)

    monkeypatch.setattr(type(ready), "collect", kept)
    for many in (1, 10):
        groups = [[(float(i), 0.0, 0.0), (1000.0, 0.0, float(i))] for i in range(many)]
        rt.lloyd_steps_together(ready, cl.INDEX_FEATURES, groups)
    assert len(plans) == 2 and all(p.count("FileScan") == 1 and p.count("Exchange") == 1 for p in plans)


def test_far_from_zero(spark):
    """Products of large figures would drown the gaps between close centres."""
    rows = [(1e9 + v,) for v in (0.0, 1.0, 4.0, 5.0)]
    frame = spark.createDataFrame(rows, "v DOUBLE")
    assert rt.lloyd_steps_together(frame, ["v"], [[(1e9,), (1e9 + 5,)]]) == [[[1e9 + 0.5], [1e9 + 4.5]]]


def test_few_steps_go_over_the_rows(spark, monkeypatch):
    """Overlapping groups settle slowly: plain steps take dozens of passes, the summary leaves a handful, to the same end."""
    dice = random.Random(3)
    points = [(dice.gauss(m, 0.9), dice.gauss(-m, 0.9), dice.random()) for m in (0, 1, 2) for _ in range(2000)]
    table = rt.feature_rows(spark.createDataFrame(points, "a DOUBLE, b DOUBLE, d DOUBLE"), ["a", "b", "d"]).cache()
    names, starts = ["a", "b", "d"], rt.seeded_starts(table, ["a", "b", "d"], 3, range(4))
    plain = rt.fit_from_starts(table, names, starts, tol=1e-4)
    step, passes = rt.lloyd_steps_together, []
    monkeypatch.setattr(rt, "lloyd_steps_together", lambda *a: passes.append(1) or step(*a))
    fits = rt.fit_with_summary(table, names, starts, tol=1e-4)
    assert len(passes) <= 8 < max(steps for _, steps, _ in plain)
    assert all(settled for _, _, settled in fits)
    for (centres, _, _), cost, before in zip(fits, rt.costs_together(table, names, [f[0] for f in fits]), rt.costs_together(table, names, [f[0] for f in plain])):
        assert rt._settled(centres, step(table, names, [centres])[0], 1e-4)
        assert cost == pytest.approx(before, rel=1e-3)
    table.unpersist()


def test_the_summary_holds_every_row(spark):
    frame = spark.range(5000).selectExpr("cast(id % 97 AS DOUBLE) AS a", "7.0D AS b", "cast(id AS DOUBLE) AS c")
    whole = rt.summarised(frame, ["a", "b", "c"], cells=64)
    assert len(whole) <= 70 and whole[:, 0].sum() == 5000
    assert [(whole[:, 0] * whole[:, k]).sum() for k in (1, 2, 3)] == [
        pytest.approx(v) for v in frame.selectExpr("sum(a)", "sum(b)", "sum(c)").first()]
    endless = spark.createDataFrame([(1.0,), (math.inf,)], "a DOUBLE")
    assert rt.summarised(endless, ["a"]) is None and rt.summarised(endless.limit(0), ["a"]) is None


def test_passes_stay_in_the_jvm_and_compile_once(spark, ready):
    """No row goes through Arrow, and centres are no part of the generated code, which would be compiled anew at each step."""
    mode, code = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"), []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for first in (0.5, 0.125, -7.5):
            sums = rt._beside(ready, cl.INDEX_FEATURES, [[(first, 1.0, 2.0), (3.0, first, 4.0)]] * 3).groupBy("_group", "_c").agg(F.sum("_near"))
            assert "InArrow" not in sums._jdf.queryExecution().executedPlan().toString()
            text = sums._jdf.queryExecution().explainString(mode)
            code.append([row for row in text.splitlines() if row.startswith("/* ")])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert code[0] and code[0] == code[1] == code[2]


def test_feature_names_do_not_clash_with_the_sums(spark):
    frame = spark.createDataFrame([(0.0, 1.0), (4.0, 1.0)], "c DOUBLE, n DOUBLE")
    assert rt.lloyd_steps_together(frame, ["c", "n"], [[(1.0, 1.0), (3.0, 1.0)]]) == [[[0.0, 1.0], [4.0, 1.0]]]


def test_seeds_of_any_size(spark):
    table = rt.feature_rows(spark.createDataFrame([(float(i),) for i in range(9)], "v DOUBLE").coalesce(1), ["v"])
    starts = rt.seeded_starts(table, ["v"], 3, [-5, 0, 1 << 62, 1 << 70])
    assert all(len({tuple(c) for c in start}) == 3 for start in starts)
