import datetime as dt

import pytest
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.functions.indices import with_indices
from cropscan.operators import joins
from cropscan.operators.scaling import (
    SCALED_SOURCES, SCENE, extremes, minmax_scaled, minmax_sql, standard_scaled,
)

DAY = dt.date(2017, 1, 1)
SCHEMA = "tile_x INT, tile_y INT, date DATE, x INT, y INT, B08 INT"


def pixels(spark, scenes):
    rows = [
        (tile, 0, DAY, i, 0, value) for tile, values in scenes.items() for i, value in enumerate(values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def scaled_values(frame):
    out = {}
    for r in frame.orderBy("tile_x", "x").collect():
        out.setdefault(r["tile_x"], []).append(r["Scaled_NIR"])
    return out


def test_scene_scope(spark):
    frame = minmax_scaled(pixels(spark, {1: [10, 20, 30], 2: [5, 5], 3: [7, None, 9]}), ["NIR"])
    assert scaled_values(frame) == {1: [0.0, 0.5, 1.0], 2: [0.0, 0.0], 3: [0.0, None, 1.0]}
    assert set(frame.columns) == {"tile_x", "tile_y", "date", "x", "y", "B08", "Scaled_NIR"}


def test_global_scope(spark):
    frame = minmax_scaled(pixels(spark, {1: [0, 50], 2: [100]}), ["NIR"], scope="global")
    assert scaled_values(frame) == {1: [0.0, 0.5], 2: [1.0]}
    with pytest.raises(ValueError):
        minmax_scaled(frame, ["NIR"], scope="tile")


def test_extremes_of_other_rows(spark):
    every = pixels(spark, {1: [0, 5, 10], 2: [3, 4]})
    chosen = every.filter((F.col("tile_x") == 1) & (F.col("B08") > 0))
    assert scaled_values(minmax_scaled(every, ["NIR"], fitted_on=chosen)) == {
        1: [-1.0, 0.0, 1.0], 2: [None, None],
    }


def test_minmax_sql_constant_column_is_null(spark):
    row = {c: [1, 3] for c in SCALED_SOURCES.values()} | {"LAI": [4, 4]}
    frame = spark.createDataFrame(
        [(0, 0, DAY, i, 0, *(v[i] for v in row.values())) for i in range(2)],
        "tile_x INT, tile_y INT, date DATE, x INT, y INT, " + ", ".join(f"{c} INT" for c in row),
    )
    got = minmax_sql(frame).orderBy("x").collect()
    assert [r["NDVI_scaled"] for r in got] == [0.0, 1.0]
    assert [r["LAI_scaled"] for r in got] == [None, None]


def test_standard_scale_uses_population_deviation(spark):
    frame = standard_scaled(pixels(spark, {1: [2, 4, 4, 4, 5, 5, 7, 9]}), ["B08"])
    got = [r["Standard_B08"] for r in frame.orderBy("x").collect()]
    assert got == pytest.approx([-1.5, -0.5, -0.5, -0.5, 0, 0, 1, 2])
    constant = standard_scaled(pixels(spark, {1: [3, 3]}), ["B08"]).collect()
    assert [r["Standard_B08"] for r in constant] == [0.0, 0.0]


def test_scaled_values_lie_in_unit_range(spark, sf_dir):
    ready = minmax_scaled(with_indices(fx.pixel_obs(spark, sf_dir)))
    names = [f"Scaled_{n}" for n in SCALED_SOURCES]
    low, high = ready.agg(
        F.min(F.least(*names)).alias("low"), F.max(F.greatest(*names)).alias("high")
    ).first()
    assert (low, high) == (0.0, 1.0)


def test_large_table_is_salted_not_broadcast(spark, sf_dir):
    """Beyond the size bound the same rows come out of a join that splits a hot scene."""
    everything = fx.pixel_obs(spark, sf_dir)
    hot = everything.withColumns({
        c: F.when(F.col("x") < 32, F.lit(v)).otherwise(F.col(c))
        for c, v in (("tile_x", 1), ("tile_y", 1))
    })
    bounds = extremes(with_indices(hot), ["NIR", "NDVI"], SCENE)
    small = joins.lookup_join(hot, bounds, SCENE, spread=("x", "y"), how="left")
    large = joins.lookup_join(hot, bounds, SCENE, spread=("x", "y"), how="left", max_bytes=0)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_salt" in plan and "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    columns = small.columns
    assert large.columns == columns
    assert large.count() == hot.count()
    assert large.exceptAll(small.select(*columns)).isEmpty()


def test_salted_semi_join(spark):
    facts = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    wanted = spark.createDataFrame([(0,), (2,), (9,)], "k BIGINT")
    small = joins.lookup_join(facts, wanted, ["k"], spread=("id",), how="left_semi")
    large = joins.lookup_join(facts, wanted, ["k"], spread=("id",), how="left_semi", max_bytes=0)
    assert small.count() == large.count() == 667


def test_table_bytes(spark):
    frame = spark.createDataFrame(
        [(1, "abc", [1.0, 2.0]), (2, None, None)], "a INT, b STRING, c ARRAY<DOUBLE>"
    )
    assert joins.table_bytes(frame) == 2 * 8 * 5 + 3 + 16
    assert joins.table_bytes(frame.limit(0)) == 0
    with pytest.raises(TypeError):
        joins.table_bytes(frame.select(F.struct("a").alias("s")))
