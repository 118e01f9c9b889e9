import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cropscan.functions.colours import CLUSTER_PALETTE
from cropscan.operators import raster as rs
from cropscan.operators.harvest import harvest_stats, with_yield
from cropscan.operators.lots import DISPLAY_FIELDS, display_fields, with_addresses, with_display
from cropscan.operators.masks import pixels_in_mask
from cropscan.operators.scenes import append_scenes, scene_slice

DAY = dt.date(2017, 1, 1)


def images(spark, rows, kind="INT"):
    schema = (
        "tile_x INT, tile_y INT, date DATE, band STRING, width INT, height INT, "
        f"pixels ARRAY<{kind}>"
    )
    return spark.createDataFrame([(1, 2, DAY, *row) for row in rows], schema)


def test_explode_scalar_image_is_row_major(spark):
    frame = rs.explode_image(images(spark, [("B01", 3, 2, [10, 11, 12, 20, 21, 22])]))
    got = {(r["x"], r["y"]): r["value"] for r in frame.collect()}
    assert got == {(0, 0): 10, (1, 0): 11, (2, 0): 12, (0, 1): 20, (1, 1): 21, (2, 1): 22}


def test_explode_tuple_image_flattens(spark):
    kind = "STRUCT<red: INT, green: INT, blue: INT>"
    frame = rs.explode_image(images(spark, [("TCI", 1, 2, [(1, 2, 3), (4, 5, 6)])], kind))
    assert {(r["y"], r["red"], r["green"], r["blue"]) for r in frame.collect()} == {
        (0, 1, 2, 3), (1, 4, 5, 6),
    }


def test_align_bands(spark):
    frame = images(spark, [("B01", 2, 2, [1, 2, 3, 4]), ("B02", 2, 2, [5, 6, 7, 8]),
                           ("B03", 2, 2, [0, 0, 0, 0])])
    got = {(r["x"], r["y"], r["B01"], r["B02"]) for r in rs.align_bands(frame, ["B01", "B02"]).collect()}
    assert got == {(0, 0, 1, 5), (1, 0, 2, 6), (0, 1, 3, 7), (1, 1, 4, 8)}


def test_a_missing_band_keeps_the_scene(spark):
    got = rs.align_bands(images(spark, [("B01", 2, 1, [1, 2]), ("B03", 2, 1, [7, 8]), ("B02", 2, 1, None)]), ["B01", "B02", "B03"])
    assert {tuple(r)[3:] for r in got.collect()} == {(0, 0, 1, None, 7), (1, 0, 2, None, 8)}
    colour = images(spark, [], "STRUCT<mask: INT, red: INT, green: INT, blue: INT>").drop("band")
    table = rs.pixel_table(colour, images(spark, [("B01", 2, 1, [7, 8])]), bands=["B01"])
    assert {(r["x"], r["mask"], r["red"], r["B01"]) for r in table.collect()} == {(0, None, None, 7), (1, None, None, 8)}


def test_rows_are_bounded_by_blocks(spark):
    wide = images(spark, [(f"B{k:02d}", 50, 41, list(range(2050))) for k in range(1, 4)])
    bands = ["B01", "B02", "B03"]
    blocks = rs._blocks(wide, 128)
    assert blocks.agg(F.max(F.size("part"))).first()[0] == 128
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] == 3
    got = rs.align_bands(wide, bands, block_cells=128)
    assert got.count() == 2050
    assert got.filter("B01 <> y * 50 + x OR B02 <> B01 OR B03 <> B01").isEmpty()


@pytest.mark.parametrize("odd", [("B02", 1, 4, [5, 6, 7, 8]), ("B02", 2, 1, [5, 6])])
def test_unequal_sizes_stop_the_query(spark, odd):
    frame = images(spark, [("B01", 2, 2, [1, 2, 3, 4]), odd])
    assert rs.image_sizes(frame).first()["same_size"] is False
    with pytest.raises(PySparkException, match="differ in size"):
        rs.align_bands(frame, ["B01", "B02"]).collect()


def test_pixel_table_joins_both_kinds(spark):
    colour = images(
        spark, [("TCI", 2, 1, [(0, 1, 2, 3), (3, 4, 5, 6)])],
        "STRUCT<mask: INT, red: INT, green: INT, blue: INT>",
    ).drop("band")
    frame = rs.pixel_table(colour, images(spark, [("B01", 2, 1, [7, 8])]), bands=["B01"])
    assert frame.columns[3:] == ["x", "y", "mask", "red", "green", "blue", "B01"]
    assert {tuple(r)[3:] for r in frame.collect()} == {(0, 0, 0, 1, 2, 3, 7), (1, 0, 3, 4, 5, 6, 8)}


def pixel_rows(spark, rows):
    return spark.createDataFrame(
        [(1, 2, x, y, DAY, *rgb) for x, y, rgb in rows],
        "tile_x INT, tile_y INT, x INT, y INT, date DATE, red INT, green INT, blue INT",
    )


def test_crop_is_half_open(spark):
    frame = pixel_rows(spark, [(x, 0, (0, 0, 0)) for x in range(5)])
    assert sorted(r["x"] for r in rs.crop(frame, 1, 0, 4, 1).collect()) == [0, 1, 2]


def test_overlay_and_hstack(spark):
    image = pixel_rows(spark, [(0, 0, (9, 9, 9)), (1, 0, (8, 8, 8))])
    predictions = image.filter("x = 1").withColumn("prediction", F.lit(3))
    painted = rs.overlay(image, predictions)
    got = {r["x"]: (r["red"], r["green"], r["blue"]) for r in painted.collect()}
    assert got == {0: (9, 9, 9), 1: CLUSTER_PALETTE[3]}
    both = rs.beside_itself(image, [F.lit(5).alias(c) for c in rs.RGB], 2).collect()
    assert {r["x"]: r["red"] for r in both} == {0: 5, 1: 5, 2: 9, 3: 8}
    wide = {r["x"]: r["red"] for r in rs.hstack(painted, image.select(painted.columns), 2).collect()}
    assert wide == {0: 9, 1: 255, 2: 9, 3: 8}


def test_mask_needs_opaque_black(spark):
    frame = spark.createDataFrame(
        [(1, 2, 0, 0, 0, 0, 0, 255), (1, 2, 1, 0, 0, 0, 0, 254), (1, 2, 2, 0, 0, 0, 1, 255)],
        "tile_x INT, tile_y INT, x INT, y INT, r INT, g INT, b INT, a INT",
    )
    assert [tuple(r) for r in pixels_in_mask(frame).collect()] == [(1, 2, 0, 0)]


def test_slice_and_append(spark):
    days = [dt.date(2017, 1, d) for d in (1, 11, 21)]
    frame = spark.createDataFrame(
        [(t, 0, 0, 0, d) for t in (1, 2) for d in days if (t, d.day) != (2, 1)],
        "tile_x INT, tile_y INT, x INT, y INT, date DATE",
    )
    got = {(r["tile_x"], r["date"].day) for r in scene_slice(frame, 0, 1).collect()}
    assert got == {(1, 1), (2, 11)}
    whole = append_scenes(*(scene_slice(frame, n, n + 1) for n in range(3)))
    assert whole.count() == frame.count()


# Date, cane, sugar, value of the published yield series.
YIELD_SERIES = [
    ("2016-12-22", 14166.5, 2284.9193548387125, 959.6661290322588),
    ("2017-02-20", 1563.2, 252.12903225806443, 105.89419354838714),
    ("2017-05-01", 0.0, 0.0, 0.0),
    ("2017-10-08", 32241.0, 5200.161290322592, 2184.0677419354706),
    ("2018-08-14", 97993.1, 15805.338709677273, 6638.242258064583),
    ("2019-08-09", 22861.8, 3687.387096774216, 1548.7025806451536),
]


def test_published_yield(spark):
    rows = [(d, round(cane / 97.7), cane, sugar, value) for d, cane, sugar, value in YIELD_SERIES]
    frame = spark.createDataFrame(
        rows, "date STRING, harvested_pixels INT, c DOUBLE, s DOUBLE, v DOUBLE"
    )
    for r in with_yield(frame).collect():
        assert r["cane"] == pytest.approx(r["c"], abs=1e-8)
        assert r["sugar"] == pytest.approx(r["s"], abs=1e-8)
        assert r["value"] == pytest.approx(r["v"], abs=1e-8)


# Harvested pixels and share of the published harvest series.
HARVEST_SERIES = [
    (52301, 0.30012509755313777), (21342, 0.12259880514705883), (2029, 0.9424059451927543),
    (100134, 0.5808910546467108), (35004, 0.3878774447337803),
]


def test_published_share(spark):
    for harvested, share in HARVEST_SERIES:
        clear = round(harvested / share)
        frame = spark.range(clear).select(
            F.lit(1).alias("tile_x"), F.lit(2).alias("tile_y"), F.lit(DAY).alias("date"),
            (F.col("id") < harvested).alias("cut"),
        )
        row = harvest_stats(frame, F.col("cut")).first()
        assert (row["clear_pixels"], row["harvested_pixels"]) == (clear, harvested)
        assert row["percentage"] == pytest.approx(share, abs=1e-15)


def test_display_dimension_and_addresses(spark):
    frame = spark.createDataFrame(
        [("sf_mean", 1443), ("min_income", 90734), ("unknown", 1)], "field STRING, value INT"
    )
    shown = {r["field"]: r["shown"] for r in with_display(frame, display_fields(spark)).collect()}
    assert shown == {"sf_mean": "1,443", "min_income": "$90,734", "unknown": None}
    labels = spark.createDataFrame([("Minimum Income Required", 7), ("Number of Sales", 7)],
                                   "verbage STRING, value INT")
    by_label = with_display(labels, display_fields(spark), on="verbage").collect()
    assert {r["verbage"]: (r["field"], r["shown"]) for r in by_label} == {
        "Minimum Income Required": ("min_income", "$7"), "Number of Sales": (None, None),
    }
    assert len(DISPLAY_FIELDS) == display_fields(spark).count()
    lots = spark.createDataFrame([(1,), (2,), (None,)], "SEGPAR INT")
    addresses = spark.createDataFrame([(1, "here"), (None, "nowhere")], "SEGPAR INT, ADDRESS STRING")
    got = {r["SEGPAR"]: r["ADDRESS"] for r in with_addresses(lots, addresses).collect()}
    assert got == {1: "here", 2: None, None: None}
