import pytest
from pyspark.sql import functions as F

from cropscan.functions import indices as ix
from cropscan.functions.colours import (
    CLUSTER_PALETTE, colour_class, palette_colour, spread_palette,
)
from cropscan.functions.keys import (
    band_name, composite_key, image_key, key_part, last_date, pixel_table_key, strip_ends,
)
from cropscan.functions.numbers import display_number, round_half_even
from cropscan.functions.quality import is_clear, with_quality_flags


def bands(spark, **values):
    row = {f"B{k:02d}": 1000 + k for k in range(1, 13)} | values
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} INT" for c in row))


def one(frame):
    return frame.first().asDict()


def test_indices_by_hand(spark):
    row = one(ix.with_indices(bands(
        spark, B02=700, B03=800, B04=600, B05=900, B08=2400, B11=1500
    )))
    assert row["NDVI"] == 6000
    assert row["GNDVI"] == 5000
    assert row["RDVI"] == int(20000 * 1800 / 3000**0.5)
    assert row["RBNDVI"] == int(10000 * (4800 - 600 - 700) / (4800 + 600 + 700))
    assert row["LCI"] == int(100 * 1500 / 3300)
    assert row["LAI"] == 2000
    assert row["SCI"] == int(10000 * -900 / 3900)
    assert row["NDMI"] == -row["SCI"]
    assert row["GLI"] == row["LAI"]


def test_index_truncates_towards_zero(spark):
    # -10000 / 10001 is about -0.9999, and 100 * -1 / 2001 about -0.05.
    assert one(ix.with_indices(bands(spark, B08=5000, B04=5001)))["NDVI"] == 0
    assert one(ix.with_indices(bands(spark, B08=1000, B05=1001)))["LCI"] == 0
    assert one(ix.with_indices(bands(spark, B08=4000, B04=5001)))["NDVI"] == -1112


def test_zero_denominator_gives_null(spark):
    row = one(ix.with_indices(bands(spark, B02=0, B03=0, B04=0, B05=0, B08=0, B11=0)))
    assert all(row[name] is None for name in ix.INDICES)


def test_registering_an_index(spark):
    ix.register_index("NDRE", lambda: ix.normalised_difference("B08", "B06"))
    try:
        assert one(ix.with_indices(bands(spark, B08=3000, B06=1000), ["NDRE"]))["NDRE"] == 5000
        with pytest.raises(ValueError):
            ix.register_index("NDRE", lambda: F.lit(0))
    finally:
        del ix.INDICES["NDRE"]


def test_quality_rules(spark):
    rows = spark.createDataFrame(
        [(224, 224, 224), (225, 0, 0), (0, 225, 0), (0, 0, 225), (10, 9, 9), (9, 10, 9)],
        "red INT, green INT, blue INT",
    )
    flagged = with_quality_flags(rows).withColumn("clear", is_clear()).collect()
    assert [r["clear"] for r in flagged] == [True, False, False, False, True, True]
    assert [r["clouds"] for r in flagged] == [True, False, False, False, False, False]
    assert [r["havested"] for r in flagged] == [False, True, False, False, True, False]


def test_keys_round_trip(spark):
    row = one(spark.range(1).select(
        image_key(F.lit(7680), F.lit(10240), band_name(F.lit(3)), F.lit("2017-06-20")).alias("image"),
        pixel_table_key(F.lit(7680), F.lit(10240), F.lit("2017-06-20")).alias("table"),
        composite_key(F.lit(7680), F.lit(10240)).alias("tile"),
    ))
    assert row["image"] == "7680-10240-B03-2017-06-20.png"
    assert row["table"] == "image_values_7680_10240_2017-06-20.snappy.parquet"
    assert row["tile"] == "7680 10240"


@pytest.mark.parametrize("text, expected", [
    ("7680-10240-TCI-2016-12-22.png", "2016-12-22"),
    ("image_values_7680_10240_2019-08-09.snappy.parquet", "2019-08-09"),
    ("2017-01-01/7680-10240-B01-2017-01-11.png", "2017-01-11"),
    ("no date in 7680-10240 here", None),
    ("", None),
])
def test_last_date(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "key STRING")
    assert frame.select(last_date(F.col("key"))).first()[0] == expected


def test_key_part_and_strip(spark):
    frame = spark.createDataFrame([("a.b-c",), ("x",)], "key STRING")
    rows = frame.select(key_part(F.col("key"), 1).alias("dash"),
                        key_part(F.col("key"), 1, ".").alias("dot"),
                        strip_ends(F.col("key"), 1, 2).alias("inner")).collect()
    assert [tuple(r) for r in rows] == [("c", "b-c", ".b"), (None, None, "")]


def test_round_half_even_is_the_binary_one(spark):
    frame = spark.createDataFrame([(0.575,), (0.125,), (0.375,), (0.5849,)], "v DOUBLE")
    got = [r[0] for r in frame.select(round_half_even(F.col("v"), 2)).collect()]
    assert got == [0.57, 0.12, 0.38, 0.58]


def test_display_number(spark):
    frame = spark.createDataFrame(
        [(1234567, "0,0"), (1234567, "$0,0"), (5, "0,0"), (5, None)], "v BIGINT, f STRING"
    )
    got = [r[0] for r in frame.select(display_number(F.col("v"), F.col("f"))).collect()]
    assert got == ["1,234,567", "$1,234,567", "5", None]


def test_palettes(spark):
    # Five clusters of the spread palette, cut to whole numbers.
    assert spread_palette(5) == (
        (0, 0, 255), (102, 51, 204), (204, 102, 153), (204, 153, 102), (102, 204, 51),
    )
    frame = spark.createDataFrame([(0,), (3,), (9,), (None,)], "p INT")
    got = [r[0] for r in frame.select(palette_colour(F.col("p"), CLUSTER_PALETTE)).collect()]
    assert tuple(got[0]) == (16, 173, 0) and tuple(got[1]) == (255, 198, 0)
    assert got[2] is None and got[3] is None


def test_colour_class_edges(spark):
    frame = spark.createDataFrame(
        [(-5.0,), (0.0,), (12.4,), (12.5,), (99.0,), (100.0,), (1e9,), (None,)], "v DOUBLE"
    )
    got = [r[0] for r in frame.select(colour_class(F.col("v"), F.lit(0), F.lit(100))).collect()]
    assert got == [0, 0, 0, 1, 7, 7, 7, None]
