"""Scoring that adds to what is stored: new scenes, and scenes that are asked for again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropscan.operators.clustering import Centres
from cropscan.operators.harvest import harvest_stats, with_yield
from cropscan.operators.joins import lookup_join
from cropscan.operators.scaling import SCENE
from cropscan.session import stored
from cropscan.sources.pixels import PREDICTION_SCHEMA
from cropscan.sources.scenes import read_scenes, replace_scenes, scenes_of

from .scoring import scored

REPORT_SCHEMA = (
    "tile_x INT, tile_y INT, date DATE, clear_pixels BIGINT, harvested_pixels BIGINT, percentage DOUBLE, "
    "cane DOUBLE, sugar DOUBLE, value DOUBLE"
)


def stored_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions that ``score_into`` has stored under ``path``."""
    return read_scenes(spark, f"{path}/predictions", PREDICTION_SCHEMA)


def stored_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per scene that ``score_into`` has stored under ``path``."""
    return read_scenes(spark, f"{path}/report", REPORT_SCHEMA)


def score_into(
    pixels: DataFrame, centres: Centres, path: str, harvested: int = 0, again: DataFrame | None = None,
    scenes: DataFrame | None = None, **options,
) -> DataFrame:
    """Score the scenes that ``path`` does not hold yet, store predictions and report, and return their report.

    ``again`` names scenes that are scored even if they are stored; their rows are replaced. ``scenes`` is
    the list of the pixels' scenes where one is kept; it is read from the pixels otherwise. Pixels
    of other scenes are not scored, and nothing at all is written when there is nothing new.

    Predictions come first and the report second, and a scene counts as stored when it is in the report. So
    a run that breaks off is made good by running it again. Scenes without a clear field pixel are in the report.
    """
    spark = pixels.sparkSession
    every = scenes_of(pixels if scenes is None else scenes).dropna()
    have = stored_report(spark, path).select(*SCENE)
    if again is not None:
        have = have.join(scenes_of(again), list(SCENE), "left_anti")
    todo = stored(every.join(have, list(SCENE), "left_anti"), "scenes-to-score")
    if todo.isEmpty():
        return spark.createDataFrame([], REPORT_SCHEMA)
    chosen = lookup_join(pixels, todo, SCENE, spread=("x", "y"), how="left_semi")
    found = scored(chosen, centres, **options).select(*SCENE, "x", "y", "prediction")
    replace_scenes(found, todo, f"{path}/predictions")
    written = lookup_join(stored_predictions(spark, path), todo, SCENE, spread=("x", "y"), how="left_semi")
    stats = harvest_stats(written, F.col("prediction") == harvested)
    report = todo.join(stats, list(SCENE), "left").na.fill(0, ["clear_pixels", "harvested_pixels"])
    replace_scenes(with_yield(report), todo, f"{path}/report")
    return lookup_join(stored_report(spark, path), todo, SCENE, spread=("tile_y",), how="left_semi")


def damaged_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenes whose stored predictions are not as many as their report says: scenes to score ``again``.

    A driver that dies while folders are being swapped can leave a folder without its rows.
    """
    counts = stored_predictions(spark, path).groupBy(*SCENE).agg(F.count(F.lit(1)).alias("rows"))
    both = stored_report(spark, path).select(*SCENE, "clear_pixels").join(counts, list(SCENE), "full")
    return both.filter(
        F.coalesce("rows", F.lit(0)) != F.coalesce("clear_pixels", F.lit(-1))
    ).select(*SCENE)
