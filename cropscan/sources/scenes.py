"""A table of scenes that grows and is corrected scene by scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropscan.operators.joins import lookup_join
from cropscan.operators.scaling import SCENE
from cropscan.session import stored_for_a_while

#: Tiles of this many units a side share a folder of a date: 8 x 8 tiles of 512 pixels.
AREA_SIDE = 8 * 512

#: A folder holds the scenes of one date and area.
FOLDER = ("date", "area")


def area(side: int = AREA_SIDE) -> Column:
    """The square of tiles that a tile lies in; a row without a whole scene key stops the query."""
    whole = F.col("tile_x").isNotNull() & F.col("tile_y").isNotNull() & F.col("date").isNotNull()
    place = F.concat_ws("_", F.floor(F.col("tile_x") / side), F.floor(F.col("tile_y") / side))
    return F.when(whole, place).otherwise(F.raise_error(F.lit("a row without tile or date is of no scene")).cast("string"))


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_scenes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows at ``path`` with the columns of ``schema``; none where no run has written yet."""
    empty = spark.createDataFrame([], schema)
    if not path_exists(spark, path):
        return empty
    found = spark.read.schema(f"{schema}, area STRING, present BOOLEAN").parquet(path)
    return found.filter("present").select(*empty.columns)


def scenes_of(rows: DataFrame) -> DataFrame:
    """The different scenes of ``rows``, from three columns."""
    return rows.select(*SCENE).distinct()


def replace_scenes(rows: DataFrame, scenes: DataFrame, path: str, side: int = AREA_SIDE) -> None:
    """Store ``rows`` as all there is of ``scenes``; every other stored scene stays as it is.

    Only folders that one of ``scenes`` falls in are written: what other scenes have there is read, and
    written again beside the new rows. Spark swaps whole folders when all tasks are done, so a lost executor
    changes nothing and a second run leaves the same table. Each written folder gets one row that is not
    ``present``: without it a folder that loses its last rows would not be swapped. Rows of scenes that are
    not among ``scenes`` are refused.
    """
    spark, names = rows.sparkSession, rows.columns
    order = [*FOLDER, "tile_x", "tile_y", *(c for c in ("y", "x") if c in names)]
    spread = [c for c in ("x", "y") if c in names] or ["tile_y"]
    with stored_for_a_while(scenes_of(scenes).withColumn("area", area(side)), "scenes") as replaced:
        # One row per folder that is touched.
        folders = replaced.select(*FOLDER).distinct()
        named = lookup_join(rows, replaced.withColumn("_named", F.lit(True)), SCENE, spread, "left")
        foreign = F.raise_error(F.lit("a row is of none of the scenes to replace")).cast("boolean")
        placed = named.select(*names, "area", F.when(F.col("_named"), True).otherwise(foreign).alias("present"))
        placed = placed.unionByName(
            folders.withColumn("present", F.lit(False)), allowMissingColumns=True).select(*names, "area", "present")
        if path_exists(spark, path):
            old = spark.read.schema(placed.schema).parquet(path).join(F.broadcast(folders), list(FOLDER), "left_semi")
            kept = lookup_join(old.filter("present"), replaced.select(*SCENE), SCENE, spread, "left_anti")
            placed = placed.unionByName(kept.select(*placed.columns))
        (
            placed.repartitionByRange(*order).sortWithinPartitions(*order)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy").partitionBy(*FOLDER).parquet(path)
        )
