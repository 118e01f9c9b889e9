import datetime as dt
import json
import os
import pathlib
import subprocess
import sys

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.operators import lots as lt
from cropscan.operators import scenes as sn
from cropscan.operators.scaling import SCENE
from cropscan.plans import harvest_report
from cropscan.session import settings
from cropscan.sources import (
    PIXEL_SCHEMA, json_field, list_images, read_csv, read_geojson, read_geojson_parts, read_metadata, read_pixels,
    read_predictions, rows_to_table, save_clustered, scan_table, write_collections, write_features,
    write_pixels, write_predictions,
)
from cropscan.sources.files import ADDRESS_SCHEMA, HARVEST_SERIES_SCHEMA, LOT_FACTS_SCHEMA, YIELD_SERIES_SCHEMA


def test_csv_with_bom_and_missing_values(spark, tmp_path):
    path = tmp_path / "addresses.csv"
    path.write_bytes(b"\xef\xbb\xbfSEGPAR,ADDRESS\n11,1 First Lane\n22,#N/A\n")
    rows = read_csv(spark, str(path), ADDRESS_SCHEMA).orderBy("SEGPAR").collect()
    assert [tuple(r) for r in rows] == [(11, "1 First Lane"), (22, None)]


def test_csv_unnamed_index_and_dates(spark, tmp_path):
    path = tmp_path / "series.csv"
    path.write_text(
        ",Date,X Tile,Y Tile,Pixels Harvested,Percentage\n0,2020-02-29,1,2,345.0,0.75\n"
    )
    frame = read_csv(spark, str(path), HARVEST_SERIES_SCHEMA)
    assert tuple(frame.first()) == (dt.date(2020, 2, 29), 1, 2, 345.0, 0.75)


def test_lot_facts_csv_and_year_fill(spark, tmp_path):
    path = tmp_path / "facts.csv"
    path.write_text(
        ",year,SEGPAR,sale_price_count,sale_price_mean,sale_price_median,sf_mean,price_sf_mean,"
        "min_income\n1,2017,10,5,1000,900,70,20,400\n2,2018,10,6,1100,950,71,21,500\n"
    )
    facts = read_csv(spark, str(path), LOT_FACTS_SCHEMA)
    lots = spark.createDataFrame([(10, "A"), (11, "B"), (None, "C")], "SEGPAR BIGINT, PLAN STRING")
    fill = {"sale_price_count": 0, "min_income": 0, "not_a_column": 5}
    rows = {r["PLAN"]: r for r in lt.with_year_facts(lots, facts, 2018, fill).collect()}
    assert rows["A"]["sale_price_count"] == 6 and rows["A"]["year"] == 2018
    assert rows["B"]["sale_price_count"] == 0 and rows["B"]["year"] == 2018
    assert rows["B"]["sf_mean"] is None
    assert rows["C"]["min_income"] == 0


# How a failed read reaches Python depends on where the reader stops.
STOPPED = (PySparkException, Py4JJavaError)

COLLECTION = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"SEGPAR": 1, "PLAN": "P1"},
         "geometry": {"type": "Polygon", "coordinates": [[[148.7, -20.8], [148.8, -20.8], [148.7, -20.8]]]}},
        {"type": "Feature", "properties": {}, "geometry": None},
    ],
}


def test_pretty_printed_geojson(spark, tmp_path):
    (tmp_path / "map.geojson").write_text(json.dumps(COLLECTION, indent=2))
    rows = read_geojson(spark, str(tmp_path), "SEGPAR: BIGINT, PLAN: STRING").collect()
    assert len(rows) == 2
    first = next(r for r in rows if r["geometry"] is not None)
    assert first["properties"]["SEGPAR"] == 1
    assert first["geometry"]["coordinates"][0][1] == [148.8, -20.8]


def test_feature_text_keeps_nulls(spark, tmp_path):
    lots = spark.createDataFrame([(3, None)], "SEGPAR BIGINT, ADDRESS STRING")
    text = lots.select(lt.feature(F.struct("SEGPAR", "ADDRESS"), fx.lot_geometry()))
    path = str(tmp_path / "out")
    write_features(text, path)
    feature = json.loads(spark.read.text(path).first()[0])
    assert feature["properties"] == {"SEGPAR": 3, "ADDRESS": None}
    assert feature["geometry"]["coordinates"][0][2] == [4.0, 1.0]


def test_metadata_files(spark, tmp_path):
    (tmp_path / "2016-12-22.json").write_text('{\n "cloud-cover": 12.5,\n "x": {"y": 1}\n}')
    (tmp_path / "2017-01-01.json").write_text('{"x": "no cover"}')
    frame = read_metadata(spark, str(tmp_path)).select(
        F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1).alias("date"),
        json_field(F.col("text"), "cloud-cover").alias("cover"),
    )
    assert {tuple(r) for r in frame.collect()} == {("2016-12-22", 12.5), ("2017-01-01", None)}


def test_image_listing(spark, tmp_path):
    names = ["7680-10240-TCI-2016-12-22.png", "7680-10240-TCI-2017-01-01.png",
             "7680-10240-B01-2016-12-22.png", "8192-10240-TCI-2016-12-22.png", "notes.txt"]
    for name in names:
        (tmp_path / name).write_bytes(b"x")
    found = list_images(spark, str(tmp_path), 7680, 10240, "TCI")
    assert {r["key"] for r in found.collect()} == set(names[:2])
    everything = sn.parse_image_keys(list_images(spark, str(tmp_path)))
    assert everything.count() == 4
    assert [r["key"] for r in sn.images_of(everything, 7680, 10240, "TCI").collect()] == names[:2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_pixel_table_layout(spark, sf_dir, tmp_path):
    path = str(tmp_path / "pixels")
    pixels = fx.pixel_obs(spark, sf_dir)
    write_pixels(pixels, path)
    assert sorted(p.name for p in (tmp_path / "pixels").iterdir() if p.is_dir()) == [
        "date=2016-12-22", "date=2017-01-01", "date=2017-01-11", "date=2017-01-21"]
    back = read_pixels(spark, path)
    assert back.select(pixels.columns).schema.simpleString() == pixels.schema.simpleString()
    assert back.select(pixels.columns).exceptAll(pixels).isEmpty()
    one = back.filter((F.col("tile_x") == 7680) & (F.col("date") == F.lit("2017-01-01").cast("date")))
    plan = one.select("x", "B08")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "EqualTo(tile_x,7680)" in plan
    assert "ReadSchema: struct<tile_x:int,x:int,B08:int>" in plan
    by_scene = str(tmp_path / "scenes")
    write_pixels(pixels, by_scene, SCENE)
    assert read_pixels(spark, by_scene).select(pixels.columns).exceptAll(pixels).isEmpty()


def test_layout_takes_partitions_by_bytes(spark, sf_dir, tmp_path):
    few = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
           "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    pixels = fx.pixel_obs(spark, sf_dir)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(initial, None)
    with settings(spark, few):
        write_pixels(pixels, str(tmp_path / "pixels"))
    assert spark.conf.get(initial, None) == before
    back = read_pixels(spark, str(tmp_path / "pixels"))
    files = back.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(files) > 8 and max(r["n"] for r in files) < pixels.count() / 4
    assert back.select(pixels.columns).exceptAll(pixels).isEmpty() and back.count() == pixels.count()


def test_predictions_come_back(spark, tmp_path):
    day = dt.date(2017, 1, 1)
    rows = spark.createDataFrame(
        [(1, 2, day, 3, 4, 0, "x"), (1, 2, day, 3, 5, None, "x")],
        "tile_x INT, tile_y INT, date DATE, x INT, y INT, prediction INT, other STRING")
    write_predictions(rows, str(tmp_path / "p"))
    back = read_predictions(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.select("x", "y", "prediction", "date").collect()), key=str) == [(3, 4, 0, day), (3, 5, None, day)]


def test_clustered_report_exchanges_nothing(spark, sf_dir, tmp_path):
    pixels = fx.pixel_obs(spark, sf_dir)
    table = save_clustered(pixels, "clustered_pixels", str(tmp_path / "clustered"), buckets=4)
    report = harvest_report(table, fx.CENTRES, clustered=True)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    expected = harvest_report(pixels, fx.CENTRES)
    assert report.exceptAll(expected).isEmpty() and report.count() == expected.count()
    spark.sql("DROP TABLE clustered_pixels")


def test_csv_stops_at_wrong_headers_and_rows(spark, tmp_path):
    (tmp_path / "turned.csv").write_text("ADDRESS,SEGPAR\nhere,1\n")
    (tmp_path / "bad.csv").write_text("SEGPAR,ADDRESS\nx,here\n2,there\n")
    with pytest.raises(STOPPED):
        read_csv(spark, str(tmp_path / "turned.csv"), ADDRESS_SCHEMA).collect()
    with pytest.raises(STOPPED):
        read_csv(spark, str(tmp_path / "bad.csv"), ADDRESS_SCHEMA).collect()
    kept = read_csv(spark, str(tmp_path / "bad.csv"), ADDRESS_SCHEMA, corrupt="_bad").collect()
    assert [tuple(r) for r in kept] == [(None, "here", "x,here"), (2, "there", None)]


def test_geojson_stops_at_broken_records(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(COLLECTION))
    (tmp_path / "cut.json").write_text(json.dumps(COLLECTION)[:60])
    fields = "SEGPAR: BIGINT, PLAN: STRING"
    with pytest.raises(STOPPED):
        read_geojson(spark, str(tmp_path), fields).collect()
    rows = read_geojson(spark, str(tmp_path), fields, corrupt=True).collect()
    assert len(rows) == 3 and sum(r["_corrupt"] is not None for r in rows) == 1
    (tmp_path / "cut.json").write_text('{"type": "Topology"}')
    with pytest.raises(STOPPED, match="neither"):
        read_geojson(spark, str(tmp_path), fields).collect()


def test_geojson_keeps_other_geometries_and_bare_features(spark, tmp_path):
    many = {"type": "Feature", "properties": {"SEGPAR": 5},
            "geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 4], [1, 2]]], [[[5, 6], [7, 8], [5, 6]]]]}}
    (tmp_path / "lines.json").write_text(json.dumps(many) + "\n" + json.dumps(COLLECTION) + "\n")
    rows = read_geojson(spark, str(tmp_path), "SEGPAR: BIGINT, PLAN: STRING", one_per_line=True).collect()
    assert len(rows) == 3
    found = next(r["geometry"] for r in rows if r["properties"]["SEGPAR"] == 5)
    assert found["coordinates"] is None and json.loads(found["text"]) == many["geometry"]["coordinates"]


def test_exported_collections_come_back(spark, tmp_path):
    lots = spark.createDataFrame([(i, f"P{i}") for i in range(25)], "SEGPAR BIGINT, PLAN STRING")
    features = lots.select(lt.feature_struct(F.struct("SEGPAR", "PLAN"), fx.lot_geometry()).alias("feature"))
    path = str(tmp_path / "out")
    write_collections(features, path, size=4)
    sizes = [len(json.loads(r[0])["features"]) for r in spark.read.text(path).collect()]
    assert sum(sizes) == 25 and max(sizes) <= 4
    back = read_geojson(spark, path, "SEGPAR: BIGINT, PLAN: STRING", one_per_line=True)
    assert back.select("properties.*").exceptAll(lots).isEmpty() and back.count() == 25


def test_cloud_cover_joins_its_scene(spark):
    day = dt.date(2017, 1, 1)
    scenes = spark.createDataFrame([(1, 2, day), (1, 3, day)], "tile_x INT, tile_y INT, date DATE")
    texts = spark.createDataFrame([(1, 2, day, '{"cloud-cover": 7.5}')], "tile_x INT, tile_y INT, date DATE, text STRING")
    assert {r["tile_y"]: r["cloud_cover"] for r in sn.with_cloud_cover(scenes, texts).collect()} == {2: 7.5, 3: None}


def test_odd_names_stay_as_rows(spark):
    names = spark.createDataFrame([("old-copy-B01.png",), ("1-2-B01-2017-01-01.png",), ("1-2-B01-2017-99-99.png",)], "key STRING")
    rows = {r["key"]: (r["tile_x"], r["tile_y"], r["date"]) for r in sn.parse_image_keys(names).collect()}
    assert rows == {"old-copy-B01.png": (None, None, None), "1-2-B01-2017-01-01.png": (1, 2, dt.date(2017, 1, 1)),
                    "1-2-B01-2017-99-99.png": (1, 2, None)}


def test_pixel_schema_names():
    # Leading columns of the stored pixel tables.
    names = [part.split()[0] for part in PIXEL_SCHEMA.split(", ")]
    assert names[:9] == ["tile_x", "tile_y", "x", "y", "date", "mask", "red", "green", "blue"]
    assert names[9:] == [f"B{k:02d}" for k in range(1, 13)]


def test_small_tables_and_sql_scan(spark):
    table = rows_to_table(spark, [(1, "a"), (2, None)], "id INT, name STRING")
    assert scan_table(spark, table).orderBy("id").collect() == table.orderBy("id").collect()


def test_object_keys(spark):
    handles = [
        "s3.ObjectSummary(bucket_name='raw', key='img512/')",
        "s3.ObjectSummary(bucket_name='raw', key='img512/image_values_7680_10240_2016-12-22.snappy.parquet')",
        "s3.ObjectSummary(bucket_name='raw', key='img32/image_values_7680_10240_2016-12-22.snappy.parquet')",
    ]
    frame = spark.createDataFrame([(h,) for h in handles], "key STRING")
    got = [r["key"] for r in sn.clean_object_keys(frame, "img512").collect()]
    assert got == ["image_values_7680_10240_2016-12-22.snappy.parquet"]


@pytest.mark.parametrize("missing", ["B05", "B12"])
def test_incomplete_and_paired_scenes(spark, missing):
    bands = ["TCI", *(f"B{k:02d}" for k in range(1, 13))]
    names = [
        (f"1-2-{b}-{d}.png",) for b in bands for d in ("2017-01-01", "2017-01-11")
        if not (b == missing and d == "2017-01-11")
    ]
    catalogue = sn.parse_image_keys(spark.createDataFrame(names, "key STRING"))
    gaps = sn.incomplete_bands(catalogue).collect()
    assert [(r["band"], r["colour_dates"], r["band_dates"]) for r in gaps] == [(missing, 2, 1)]
    paired = {str(r["date"]): r for r in sn.paired_images(catalogue).collect()}
    assert paired["2017-01-11"][missing] is None
    assert paired["2017-01-01"][missing] == f"1-2-{missing}-2017-01-01.png"
    assert sn.latest_images(catalogue).filter(F.col("band") == missing).first()["key"] == (
        f"1-2-{missing}-2017-01-01.png"
    )


def test_csv_headers_are_checked_beside_corrupt_rows(spark, tmp_path):
    (tmp_path / "turned.csv").write_text("ADDRESS,SEGPAR\nhere,1\n")
    with pytest.raises(STOPPED):
        read_csv(spark, str(tmp_path / "turned.csv"), ADDRESS_SCHEMA, corrupt="_bad").collect()
    (tmp_path / "indexed.csv").write_text(",date,SugarCane Harvested,Estimated Sugar,Value of Sugar Produced\n0,2017-01-01,1.5,x,2\n")
    row = read_csv(spark, str(tmp_path / "indexed.csv"), YIELD_SERIES_SCHEMA, corrupt="_bad").first()
    assert row["SugarCane Harvested"] == 1.5 and row["Estimated Sugar"] is None and row["_bad"].startswith("0,2017")


def test_several_documents_of_a_scene(spark):
    day = dt.date(2017, 1, 1)
    scenes = spark.createDataFrame([(1, 2, day)], "tile_x INT, tile_y INT, date DATE")
    texts = spark.createDataFrame(
        [(1, 2, day, t) for t in ('{"cloud-cover": 7.5}', '{"cloud-cover": 9}', "{}")], "tile_x INT, tile_y INT, date DATE, text STRING")
    assert [tuple(r) for r in sn.with_cloud_cover(scenes, texts).select("tile_y", "cloud_cover").collect()] == [(2, 9.0)]


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"SEGPAR": i, "PLAN": None if i % 5 else f"{{\"type\": [{i}] é"},
         "geometry": None if i % 7 == 0 else {"type": "Polygon", "coordinates": [[[i, 0.5], [i, 1], [i, 0.5]]]}} for i in range(3_000)]
    whole = {"type": "FeatureCollection", "name": "lots", "features": features, "crs": {"type": "name"}}
    fields, old = "SEGPAR: BIGINT, PLAN: STRING", spark.conf.get("spark.sql.files.maxPartitionBytes")
    for indent in (2, None):
        path = tmp_path / f"large{indent}.geojson"
        path.write_text("﻿" * (indent == 2) + json.dumps(whole, indent=indent, ensure_ascii=False), encoding="utf-8")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 9))
        try:
            parts = read_geojson_parts(spark, str(path), fields)
            tasks = parts.select(F.spark_partition_id().alias("t")).distinct().count()
            rows = {r["properties"]["SEGPAR"]: r for r in parts.collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert tasks >= 8 and len(rows) == 3_000
        for i, f in enumerate(features):
            assert rows[i]["properties"]["PLAN"] == f["properties"]["PLAN"]
            assert (rows[i]["geometry"] and rows[i]["geometry"]["coordinates"]) == (f["geometry"] and f["geometry"]["coordinates"])


@pytest.mark.parametrize("feature", [
    '{"properties": {"SEGPAR": 1}, "type": "Feature", "geometry": null}', '{"properties": {"SEGPAR": 1}, "geometry": null, "type": "Feature"}',
    '{"type": "Feature", "properties": {"SEGPAR": 1, "PLAN": "Feature"}, "geometry": null}',
])
def test_files_that_have_no_parts_stop_the_query(spark, tmp_path, feature):
    (tmp_path / "odd.json").write_text(f'{{"type": "FeatureCollection", "features": [{feature}, {feature}]}}')
    assert read_geojson(spark, str(tmp_path), "SEGPAR: BIGINT, PLAN: STRING").count() == 2
    with pytest.raises(STOPPED):
        read_geojson_parts(spark, str(tmp_path), "SEGPAR: BIGINT, PLAN: STRING").collect()


RETRY = """
import json, sys
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import SparkSession
from cropscan.sources import files

settings = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
spark = SparkSession.builder.master("local[4,3]").config(map=settings).getOrCreate()
write = files.write_features

def failing(lines, path):
    '''Every second task breaks off midway, once.'''
    def run(batches):
        task = TaskContext.get()
        for i, batch in enumerate(batches):
            if task.attemptNumber() == 0 and task.partitionId() % 2:
                yield batch.slice(0, 1)
                raise RuntimeError("lost")
            yield batch
    write(lines.mapInArrow(run, lines.schema), path)

files.write_features = failing
rows = spark.range(0, 3_000, 1, 6).select(F.struct(F.lit("Feature").alias("type"), F.struct("id").alias("properties")).alias("feature"), F.expr("uuid()").alias("u"))
files.write_collections(rows.sortWithinPartitions("u"), sys.argv[1], size=7)
"""


def test_a_task_that_fails_midway_loses_and_doubles_nothing(spark, tmp_path):
    """The order of the input differs from one evaluation to the next, and tasks fail while they write."""
    script = tmp_path / "retry.py"
    script.write_text(RETRY)
    out = tmp_path / "out"
    root = str(pathlib.Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, str(script), str(out)], capture_output=True, text=True, timeout=300,
                          env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "lost" in done.stderr
    ids = [f["properties"]["id"] for r in spark.read.text(str(out)).collect() for f in json.loads(r[0])["features"]]
    assert sorted(ids) == list(range(3_000))


def test_predictions_are_scored_once(spark, tmp_path):
    """A sample for the ranges must not score every pixel a second time."""
    scored_rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scored_rows.add(batch.num_rows)
            yield batch

    rows = spark.range(400, numPartitions=2).selectExpr(
        "int(id % 3) AS tile_x", "1 AS tile_y", "DATE '2019-01-01' AS date", "int(id) AS x", "2 AS y",
        "int(nullif(id % 4, 3)) AS prediction")
    write_predictions(rows.mapInArrow(counted, rows.schema), str(tmp_path / "predictions"))
    assert scored_rows.value == 400
    back = read_predictions(spark, str(tmp_path / "predictions")).select(*rows.columns)
    assert back.count() == 400 and back.exceptAll(rows).isEmpty()
