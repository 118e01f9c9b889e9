import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.operators.raster import align_blocks
from cropscan.plans import harvest_report, ingested, report_from_files, scene_files
from cropscan.sources import image_blocks, image_manifest, write_band_files

DAY = "2017-01-01"


def raw(folder, name, values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(np.array(values, "<u2").tobytes())


def test_files_are_read_in_ranges(spark, tmp_path):
    """Images of 3 x 5 in blocks of 4 cells; one band is missing, one cell has no observation."""
    colour = [[0, i, 2 * i, 3 * i] for i in range(15)]
    colour[7] = [0xFFFF] * 4
    raw(tmp_path / "f", f"1-2-TCI-{DAY}.raw", colour)
    raw(tmp_path / "f", f"1-2-B01-{DAY}.raw", range(100, 115))
    manifest = image_manifest(spark, str(tmp_path / "f"), kind="raw")
    assert {(r["key"], r["bytes"]) for r in manifest.collect()} == {(f"1-2-TCI-{DAY}.raw", 120), (f"1-2-B01-{DAY}.raw", 30)}
    blocks = image_blocks(scene_files(manifest), 3, block_cells=4)
    assert {r["n"] for r in blocks.select(F.size("part").alias("n")).collect()} == {4, 3} and blocks.count() == 5 * 4
    rows = {(r["x"], r["y"]): r for r in ingested(manifest, 3, ["B01", "B02"], block_cells=4).collect()}
    assert len(rows) == 14 and (1, 2) not in rows
    for (x, y), r in rows.items():
        i = 3 * y + x
        assert (r["mask"], r["red"], r["green"], r["blue"], r["B01"], r["B02"]) == (0, i, 2 * i, 3 * i, 100 + i, None)
        assert r["date"] == dt.date(2017, 1, 1) and (r["tile_x"], r["tile_y"]) == (1, 2)


def test_newest_files_of_whole_scenes(spark, tmp_path):
    folder = tmp_path / "f"
    raw(folder, f"1-2-B01-{DAY}.raw", range(4))  # no colour image
    raw(folder, f"5-2-TCI-{DAY}.raw", [[0, 1, 1, 1]] * 4)
    raw(folder, "notes-on-it.raw", [1])
    files = scene_files(image_manifest(spark, str(folder), kind="raw")).collect()
    assert [(r["tile_x"], r["band"]) for r in files] == [(5, "TCI")]
    old = spark.createDataFrame([("file:/a/k", "1-2-TCI-2017-01-01.raw", 8, 1), ("file:/b/k", "1-2-TCI-2017-01-01.raw", 16, 2)],
                                "path STRING, key STRING, bytes BIGINT, modified INT")
    assert [(r["path"], r["bytes"]) for r in scene_files(old).collect()] == [("file:/b/k", 16)]


def test_cut_files_stop_the_query(spark, tmp_path):
    raw(tmp_path / "f", f"1-2-TCI-{DAY}.raw", [[0, 1, 1, 1]] * 4)
    manifest = image_manifest(spark, str(tmp_path / "f"), kind="raw")
    with pytest.raises(Exception, match="whole number of rows"):
        ingested(manifest, 3).collect()
    listed = manifest.withColumn("bytes", F.col("bytes") * 2)
    with pytest.raises(Exception):
        ingested(listed, 2).collect()


def test_written_files_give_the_report(spark, sf_dir, tmp_path):
    pixels = fx.pixel_obs(spark, sf_dir).filter("tile_x < 8704").cache()
    folder = str(tmp_path / "bands")
    few = F.col("tile_x") < 8704
    write_band_files(fx.colour_images(spark, sf_dir).filter(few).withColumn("band", F.lit("TCI")), folder)
    write_band_files(fx.band_images(spark, sf_dir).filter(few), folder)
    manifest = image_manifest(spark, folder, kind="raw")
    back = ingested(manifest, fx.SIDE)
    expected = pixels.select(*back.columns).withColumn("B07", F.when(F.expr("tile_x DIV 512 % 3 <> 0"), F.col("B07")))
    assert back.count() == pixels.count() and back.exceptAll(expected).isEmpty()
    report = report_from_files(manifest, fx.SIDE, fx.CENTRES)
    assert report.exceptAll(harvest_report(pixels, fx.CENTRES)).isEmpty()
    assert align_blocks(image_blocks(scene_files(manifest), fx.SIDE, block_cells=1000), ["B01"], 1000).count() >= pixels.count()


def test_many_files_lie_in_subfolders_that_tasks_list(spark, sf_dir, tmp_path):
    """The driver holds no list of files; what is listed, and the report, are those of a plain folder."""
    few = F.col("tile_x") < 8192
    colour = fx.colour_images(spark, sf_dir).filter(few).withColumn("band", F.lit("TCI"))
    bands = fx.band_images(spark, sf_dir).filter(few)
    plain, deep = str(tmp_path / "plain"), str(tmp_path / "deep")
    for images in (colour, bands):
        write_band_files(images, plain)
        write_band_files(images, deep, subfolders=3)
    assert sorted(p.name for p in (tmp_path / "deep").iterdir()) == ["000000", "000001", "000002"]
    assert all(p.is_file() and not p.name.endswith(".part") for d in (tmp_path / "deep").iterdir() for p in d.iterdir())
    listed = image_manifest(spark, deep, kind="raw", subfolders=True)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "binaryFile" not in plan
    flat = image_manifest(spark, plain, kind="raw")
    assert listed.dtypes == flat.dtypes
    sizes = sorted(map(tuple, flat.select("key", "bytes").collect()))
    assert sorted(map(tuple, listed.select("key", "bytes").collect())) == sizes and len(sizes) > 20
    newest = listed.agg(F.max("modified")).first()[0]
    assert abs(newest.timestamp() - max(p.stat().st_mtime for p in (tmp_path / "deep").rglob("*.raw"))) < 1e-3
    some = image_manifest(spark, deep, 7680, band="TCI", kind="raw", subfolders=True)
    assert sorted(r["key"] for r in some.collect()) == [k for k, _ in sizes if k.startswith("7680-") and "-TCI" in k]
    report = report_from_files(listed, fx.SIDE, fx.CENTRES)
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, report_from_files(flat, fx.SIDE, fx.CENTRES).collect()))


def test_the_query_leaves_its_list_to_tasks(spark, sf_dir, monkeypatch):
    from cropscan import queries

    def refused(*args, **options):
        assert options.get("subfolders"), "a plain folder is listed by the driver"
        return image_manifest(*args, **options)

    monkeypatch.setattr(queries, "image_manifest", refused)
    assert queries.QUERIES["report_from_files"](spark, sf_dir).count() == 12
