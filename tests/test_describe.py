import math
import random

import numpy as np
import pandas as pd
import pytest

from cropscan.operators import describe as ds


def result(frame):
    return {(r[0], r["column"]): r.asDict() for r in frame.collect()}


def check(frame, rows, columns):
    """Against pandas, group by group."""
    table = pd.DataFrame(rows, columns=["k", *columns])
    assert set(frame) == {(k, c) for k in table.k.unique() for c in columns}
    for (k, c), got in frame.items():
        own = pd.to_numeric(table[table.k == k][c]).describe()
        assert got["count"] == own["count"]
        for name, of in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert (got[name] is None and math.isnan(own[of])) or got[name] == pytest.approx(own[of], rel=1e-9, abs=1e-9), (k, c, name)


def rows_of(seed, many):
    dice = random.Random(seed)
    return [(dice.choice("aaab"), dice.gauss(0, 9), float(dice.randint(0, 3)), None if dice.random() < 0.3 else dice.random()) for _ in range(many)]


@pytest.mark.parametrize("many", [40, 3_000])
def test_all_columns_equal_pandas(spark, many):
    rows = rows_of(many, many) + [("c", 1.0, 2.0, None)]
    frame = spark.createDataFrame(rows, "k STRING, x DOUBLE, y DOUBLE, z DOUBLE").repartition(5)
    check(result(ds.describe_all(frame, "k")), rows, ["x", "y", "z"])


def test_wrong_brackets_are_opened(spark, monkeypatch):
    """A sketch that is far off costs a pass, never a result."""
    monkeypatch.setattr(ds, "ACCURACY", 2)
    monkeypatch.setattr(ds, "REACH", 0.0)
    rows = rows_of(7, 2_000)
    frame = spark.createDataFrame(rows, "k STRING, x DOUBLE, y DOUBLE, z DOUBLE")
    check(result(ds.describe_all(frame, "k")), rows, ["x", "y", "z"])


def test_only_bracketed_values_are_shuffled(spark):
    rows = spark.range(200_000).selectExpr("'a' AS k", "rand(1) AS x", "rand(2) AS y")
    numbers = ds._numbers(rows, "k", ["x", "y"])
    basics = ds._first_pass(numbers, ["x", "y"], [0.25, 0.5, 0.75])
    counts = ds._bracketed(numbers, basics.select("g", "ends0", "ends1"), 2, 3)
    assert counts.count() < 2 * 3 * 200_000 * 3 * ds.REACH
    got = result(ds.describe_all(rows, "k"))
    for c in "xy":
        own = np.array([r[c] for r in rows.collect()])
        for name, share in ds.QUARTILES.items():
            assert got["a", c][name] == pytest.approx(np.quantile(own, share), rel=1e-12)


def test_nan_null_groups_whole_numbers_and_nothing(spark):
    frame = spark.createDataFrame(
        [("a", 1, float("nan")), ("a", 3, None), (None, 5, 1.0), ("b", None, float("inf"))], "k STRING, n INT, x DOUBLE")
    got = result(ds.describe_all(frame, "k"))
    assert set(got) == {("a", "n"), ("a", "x"), ("b", "n"), ("b", "x")}
    assert (got["a", "n"]["count"], got["a", "n"]["p25"], got["a", "n"]["p50"]) == (2, 1.5, 2.0)
    assert got["a", "x"]["count"] == got["b", "n"]["count"] == 0 and got["a", "x"]["p50"] is None
    assert got["b", "x"]["max"] == math.inf
    assert ds.describe_all(frame.limit(0), "k").isEmpty()
