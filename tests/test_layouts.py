"""Plans over tables that are laid out for them."""

import uuid

import pytest
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.operators import raster as rs
from cropscan.operators import scenes as sn
from cropscan.operators.scaling import SCENE
from cropscan.plans import scored
from cropscan.sources import read_pixels, save_clustered, scenes_of, write_pixels


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    a, b = a.select(*b.columns), b
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


@pytest.fixture
def clustered(spark, tmp_path):
    made = []

    def make(rows, keys):
        name = f"layout_{uuid.uuid4().hex}"
        made.append(name)
        return save_clustered(rows, name, str(tmp_path / name), buckets=4, keys=keys)

    yield make
    for name in made:
        spark.sql(f"DROP TABLE {name}")


def test_painting_from_aligned_tables_exchanges_nothing(spark, sf_dir, clustered):
    pixels = fx.pixel_obs(spark, sf_dir)
    predictions = scored(pixels, fx.CENTRES).select(*rs.PIXEL, "prediction")
    expected = rs.overlay(pixels, predictions)
    shown = rs.overlay(clustered(pixels, rs.PIXEL), clustered(predictions, rs.PIXEL), clustered=True)
    plan = plan_of(shown)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert same(shown, expected)


def test_slices_of_buckets_exchange_no_pixel(spark, sf_dir, clustered):
    pixels = fx.pixel_obs(spark, sf_dir)
    table = clustered(pixels, SCENE)
    part = sn.scene_slice(table, 1, 3, clustered=True)
    plan = plan_of(part)
    # What is exchanged is the list of scenes, once it holds nothing else: by tile, then to the buckets.
    pixel_side = plan[plan.index("SortMergeJoin"):].split("FileScan")[0]
    assert "Exchange" not in pixel_side
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanged) == 2 and all("hashpartitioning(tile_x" in line for line in exchanged)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    expected = sn.scene_slice(pixels, 1, 3)
    assert same(part, expected) and part.select("date").distinct().count() == 2


def test_slices_open_only_their_dates(spark, sf_dir, tmp_path):
    path = str(tmp_path / "pixels")
    write_pixels(fx.pixel_obs(spark, sf_dir), path)
    pixels = read_pixels(spark, path)
    scenes_of(pixels).write.parquet(str(tmp_path / "scenes"))
    part = sn.sliced_dates(pixels, 1, 3, spark.read.parquet(str(tmp_path / "scenes")))
    plan = plan_of(part)
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan
    assert same(part, sn.scene_slice(pixels, 1, 3))
    named = pixels.withColumn("f", F.col("_metadata.file_path"))
    files = sn.sliced_dates(named, 1, 3, scenes_of(pixels)).select("f").distinct().collect()
    assert {r["f"].split("date=")[1][:10] for r in files} == {"2017-01-01", "2017-01-11"}


def test_slices_by_a_kept_list(spark, sf_dir):
    """Positions count the scenes of the list, also those without a pixel."""
    pixels = fx.pixel_obs(spark, sf_dir)
    early = pixels.select("tile_x", "tile_y", F.lit("2016-01-01").cast("date").alias("date")).distinct()
    scenes = scenes_of(pixels).unionByName(early)
    assert same(sn.scene_slice(pixels, 2, 4, scenes=scenes).drop("day_no"), sn.scene_slice(pixels, 1, 3).drop("day_no"))
