import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.operators.masks import (
    BLOCK_HEIGHT, BLOCK_WIDTH, inside_mask, mask_bitmaps, mask_sizes, merged_masks, pixels_in_mask, with_mask, write_mask,
)
from cropscan.plans import harvest_report
from cropscan.sources import save_clustered

CELLS = "tile_x INT, tile_y INT, x INT, y INT"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bits_are_those_of_the_cells(spark):
    """Cells at the edges of blocks, far away, below zero, repeated, and without a coordinate."""
    edges = [0, 1, 7, 8, 63, 64, 127, 128, 255, 256, 511, 100_000, -1, -64, -129]
    cells = [(t, 5, x, y) for t in (1, 2) for x in edges for y in edges if (x * 7 + y * 3 + t) % 4]
    mask = spark.createDataFrame([*cells, cells[0], (1, 5, None, 3), (None, 5, 1, 1)], CELLS)
    every = [(t, 5, x, y) for t in (1, 2, 3) for x in edges for y in edges] + [(1, 5, None, 3), (None, 5, 1, 1)]
    pixels = spark.createDataFrame(every, CELLS)
    assert sorted(map(tuple, inside_mask(pixels, mask).collect())) == sorted(set(cells))
    marked = with_mask(pixels.withColumn("mask", F.lit(9)), mask).collect()
    assert len(marked) == len(every) and {r["mask"] for r in marked} == {0, 1}
    assert sum(r["mask"] == 0 for r in marked) == len(set(cells))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 2), st.just(0), st.integers(-300, 600), st.integers(-200, 300)), max_size=40))
def test_random_masks(spark, cells):
    mask = spark.createDataFrame(sorted(cells), CELLS)
    near = sorted({(t, u, x + d, y) for t, u, x, y in cells for d in (-1, 0, 1)})
    found = inside_mask(spark.createDataFrame(near, CELLS), mask)
    assert sorted(map(tuple, found.collect())) == sorted(cells)


def test_pixels_are_not_shuffled_at_any_mask_size(spark, sf_dir, tmp_path):
    pixels = fx.pixel_obs(spark, sf_dir)
    pixels.write.parquet(str(tmp_path / "pixels"))
    pixels = spark.read.parquet(str(tmp_path / "pixels"))
    mask = pixels_in_mask(fx.mask_image(spark, sf_dir))
    expected = pixels.filter("mask = 0")
    for max_bytes in (1 << 29, 10_000):
        found = inside_mask(pixels, mask, max_bytes)
        plan = plan_of(found)
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        assert plan.count("BroadcastHashJoin") == (1 if max_bytes > 10_000 else plan.count("FileScan parquet"))
        assert found.count() == expected.count() and found.exceptAll(expected).isEmpty()
    assert plan.count("BroadcastHashJoin") > 2 and "GreaterThanOrEqual(tile_x" in plan


def test_ranges_keep_pixels_without_a_tile(spark):
    mask = spark.createDataFrame([(t, u, 0, 0) for t in (-3, 0, 4) for u in (-7, 0, 9)], CELLS)
    pixels = spark.createDataFrame(
        [(t, u, x, 0) for t in (-4, -3, 0, 4, 5) for u in (-8, -7, 0, 9, 10) for x in (0, 1)] + [(None, 1, 0, 0), (1, None, 0, 0)], CELLS)
    few, many = with_mask(pixels, mask), with_mask(pixels, mask, max_bytes=1)
    assert many.count() == pixels.count() and many.exceptAll(few).isEmpty()
    assert many.filter("mask = 0").count() == 9


def test_masks_are_merged_counted_and_stored(spark, tmp_path):
    first = mask_bitmaps(spark.createDataFrame([(1, 1, 0, 0), (1, 1, 1, 0)], CELLS))
    second = mask_bitmaps(spark.createDataFrame([(1, 1, 1, 0), (1, 1, BLOCK_WIDTH, BLOCK_HEIGHT), (2, 1, 0, 0)], CELLS))
    both = merged_masks(first.unionByName(second))
    assert {(r["tile_x"], r["cells"]) for r in mask_sizes(both).collect()} == {(1, 3), (2, 1)}
    write_mask(both, str(tmp_path / "mask"))
    pixels = spark.createDataFrame([(1, 1, x, 0) for x in range(4)], CELLS)
    assert inside_mask(pixels, spark.read.parquet(str(tmp_path / "mask"))).count() == 2


def test_empty_mask_and_empty_pixels(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0)], CELLS)
    nothing = cells.limit(0)
    assert inside_mask(cells, nothing).isEmpty() and inside_mask(nothing, cells).isEmpty()
    assert with_mask(cells, nothing).first()["mask"] == 1


@pytest.mark.parametrize("clustered", [False, True])
def test_report_with_a_mask_table(spark, sf_dir, tmp_path, clustered):
    """The mask table stands for the mask column, which is wrong here, and keeps the buckets."""
    pixels = fx.pixel_obs(spark, sf_dir)
    expected = harvest_report(pixels, fx.CENTRES)
    mask = pixels_in_mask(fx.mask_image(spark, sf_dir))
    table = pixels.withColumn("mask", F.lit(7))
    if clustered:
        name = f"masked_{dt.datetime.now():%H%M%S%f}"
        table = save_clustered(table, name, str(tmp_path / name), buckets=4)
    report = harvest_report(table, fx.CENTRES, mask=mask, clustered=clustered)
    if clustered:
        assert "Exchange hashpartitioning" not in plan_of(report)
    assert report.count() == expected.count() and report.exceptAll(expected).isEmpty()
