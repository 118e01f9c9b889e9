"""Land lots: addresses, yearly facts, map classes and GeoJSON features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropscan.functions.colours import MAP_PALETTE, class_colour, colour_class
from cropscan.functions.numbers import display_number

# Field, low and high end of its colour scale, number pattern, label.
DISPLAY_FIELDS = (
    ("harverst_count", 0, 100, "0,0", "Number of Harverst"),
    ("sale_price_mean", 500000, 4000000, "$0,0", "Average Sales Price"),
    ("sale_price_median", 500000, 4000000, "$0,0", "Median Sales Price"),
    ("sf_mean", 500, 5000, "0,0", "Average Square Footage"),
    ("price_sf_mean", 0, 2000, "$0,0", "Average Price Per Square Foot"),
    ("min_income", 50000, 600000, "$0,0", "Minimum Income Required"),
)
DISPLAY_SCHEMA = "field STRING, min_range INT, max_range INT, format STRING, verbage STRING"


def display_fields(spark: SparkSession) -> DataFrame:
    """The six-row display dimension."""
    return spark.createDataFrame(DISPLAY_FIELDS, DISPLAY_SCHEMA)


def renamed_lots(lots: DataFrame) -> DataFrame:
    return lots.withColumnsRenamed({"PLAN": "neighborhood_name", "nid": "subdist_no"})


def with_addresses(lots: DataFrame, addresses: DataFrame, key: str = "SEGPAR") -> DataFrame:
    """Every lot with its address, null where there is none."""
    return lots.join(addresses, key, "left")


def with_year_facts(
    lots: DataFrame,
    facts: DataFrame,
    year: int,
    fill: Mapping[str, int | float],
    key: str = "SEGPAR",
) -> DataFrame:
    """Every lot with one year's facts; missing values take ``fill``, a missing year ``year``.

    Names in ``fill`` that are not columns are ignored.
    """
    of_year = facts.filter(F.col("year") == year)
    merged = lots.join(of_year, key, "left")
    known = {name: v for name, v in {**fill, "year": year}.items() if name in merged.columns}
    return merged.na.fill(known)


def with_display(measures: DataFrame, fields: DataFrame, on: str = "field") -> DataFrame:
    """Look up how a value is shown, by ``field`` name or by its label ``verbage``.

    Unknown names give nulls. ``fields`` has a handful of rows; the planner measures
    it before it broadcasts.
    """
    return measures.join(fields, on, "left").withColumn(
        "shown", display_number(F.col("value"), F.col("format"))
    )


def with_colour_class(
    rows: DataFrame, value: str, low: float, high: float, classes: int = 8
) -> DataFrame:
    return rows.withColumn(
        "colour_class", colour_class(F.col(value), F.lit(low), F.lit(high), classes)
    )


def with_field_class(rows: DataFrame, fields: DataFrame, classes: int = 8) -> DataFrame:
    """Class of ``value`` on the colour scale of its ``field``; null for a field without a scale."""
    scales = fields.select("field", "min_range", "max_range")
    return rows.join(scales, "field", "left").withColumn(
        "colour_class", colour_class(F.col("value"), F.col("min_range"), F.col("max_range"), classes)
    ).drop("min_range", "max_range")


def with_field_colour(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """``with_field_class``, and the ``fill_color`` that the class has on the map; lots without one are gray."""
    classed = with_field_class(rows, fields, len(MAP_PALETTE))
    return classed.withColumn("fill_color", class_colour(F.col("colour_class")))


def feature_struct(properties: Column, geometry: Column) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")
    )


def feature(properties: Column, geometry: Column) -> Column:
    """One GeoJSON feature as text, nulls kept."""
    return F.to_json(feature_struct(properties, geometry), {"ignoreNullFields": "false"})
