"""What keeps a task's share, or a stage's code, from growing with the table."""

import datetime as dt
import os

import numpy as np

from cropscan import fixtures as fx
from cropscan.operators import clustering as cl
from cropscan.plans import report_from_files, scene_files, scored_in_place
from cropscan.sources import bucket_count, image_blocks, image_manifest, named_files, write_named_files

SETTING = "spark.sql.codegen.hugeMethodLimit"


def test_sessions_made_elsewhere_compile_their_methods(spark, sf_dir):
    """Whole-stage code above 8,000 bytecodes runs interpreted, so the plans lower Spark's 65,535."""
    before = spark.conf.get(SETTING)
    try:
        spark.conf.set(SETTING, "65535")
        scored_in_place(fx.pixel_obs(spark, sf_dir), fx.CENTRES)
        assert spark.conf.get(SETTING) == "8000"
        spark.conf.set(SETTING, "4000")
        scored_in_place(fx.pixel_obs(spark, sf_dir), fx.CENTRES)
        assert spark.conf.get(SETTING) == "4000"
    finally:
        spark.conf.set(SETTING, before)


def test_buckets_follow_the_rows(spark):
    assert bucket_count(spark.range(100), bucket_rows=10) == 10
    assert bucket_count(spark.range(101), bucket_rows=10) == 11
    assert bucket_count(spark.range(0)) == 8


def test_images_exchange_cells_not_pixels(spark, tmp_path):
    lines = [(i, i % 7 + 1, i % 5, i % 3, float(i % 50)) for i in range(3000)]
    spark.createDataFrame(
        lines, "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    images = fx.colour_images(spark, str(tmp_path))
    assert sum("hashpartitioning" in line for line in images._jdf.queryExecution().executedPlan().toString().splitlines()) == 2
    cells = {(r["tile_x"], r["tile_y"], r["date"], i): tuple(v) for r in images.collect() for i, v in enumerate(r["pixels"]) if v}
    plain = {
        (r["tile_x"], r["tile_y"], r["date"], 64 * r["y"] + r["x"]): (r["mask"], r["red"], r["green"], r["blue"])
        for r in fx.pixel_obs(spark, str(tmp_path)).collect()}
    assert cells == plain and len({k[2] for k in plain}) == 4 and min(k[2] for k in plain) == dt.date(2016, 12, 22)


def test_many_files_are_written_and_listed_by_tasks(spark, tmp_path):
    """No folder a file, and no list of files on the driver."""
    names = [f"{i}-{2 * i}-B01-2017-01-01.png" for i in range(40)]
    rows = spark.createDataFrame([(n, n) for n in names], "key STRING, text STRING").repartition(3)
    folder = str(tmp_path / "images")
    write_named_files(rows, folder, subfolders=4)
    write_named_files(rows, folder, subfolders=4)
    assert sorted(p.name for p in (tmp_path / "images").iterdir()) == ["000000", "000001", "000002", "000003"]
    listed = named_files(spark, folder).collect()
    assert sorted(r["key"] for r in listed) == sorted(names)
    assert all(r["bytes"] == len(r["key"]) + 1 and r["path"].endswith(r["key"]) for r in listed)
    (tmp_path / "none").mkdir()
    assert named_files(spark, str(tmp_path / "none")).count() == 0


def test_tasks_of_a_fit_hold_few_rows_however_well_they_compress(spark):
    """One value throughout: a compressed table of it would be read by one task or two."""
    rows = spark.range(2_000_000, numPartitions=2).selectExpr("0.5 AS a", "0.25 AS b", "0.0 AS c")
    with cl._feature_table(rows, ["a", "b", "c"]) as table:
        files = table.inputFiles()
        assert len(files) == 8 and table.rdd.getNumPartitions() >= 4
        assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) > 2_000_000 * 24
        assert table.count() == 2_000_000


def test_reports_read_files_once_and_in_many_tasks(spark, tmp_path):
    """One listing and one reading behind the stored pixels; the ranges are not left to one task."""
    for band, width in (("TCI", 4), ("B01", 1)):
        for tile in range(20):
            np.full(16 * width, 100, "<u2").tofile(tmp_path / f"{tile}-1-{band}-2017-01-01.raw")
    manifest = image_manifest(spark, str(tmp_path), kind="raw")
    blocks = image_blocks(scene_files(manifest), 4)
    assert blocks.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    report = report_from_files(manifest, 4, fx.CENTRES)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "binaryFile" not in plan
    assert report.count() == 20
