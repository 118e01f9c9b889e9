"""The scene scoring and training plans, over all tiles and dates at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cropscan.functions.indices import with_indices
from cropscan.functions.quality import clear_pixels, is_clear, is_inside
from cropscan.operators.clustering import (
    SCALED_FEATURES, Centres, assign_clusters, centres_table, cluster_profile, fit_kmeans,
    model_centres, nearest_centre,
)
from cropscan.operators.harvest import harvest_stats, with_yield
from cropscan.operators.masks import inside_mask, with_mask
from cropscan.operators.restarts import Restart, fit_together
from cropscan.operators.scaling import SCENE, Moments, minmax_scaled, moments, standard_scaled
from cropscan.sources.pixels import rows_to_table


def prepared(
    pixels: DataFrame, features: Sequence[str] = SCALED_FEATURES, scope: str = "scene",
    clustered: bool = False,
) -> DataFrame:
    """Clear pixels with the indices and scaled columns that ``features`` need."""
    names = [feature.removeprefix("Scaled_") for feature in features]
    return minmax_scaled(with_indices(clear_pixels(pixels)), names, scope, clustered=clustered)


def scored(
    pixels: DataFrame,
    centres: Centres,
    features: Sequence[str] = SCALED_FEATURES,
    scope: str = "scene",
    mask: DataFrame | None = None,
    clustered: bool = False,
) -> DataFrame:
    """Clear field pixels with their cluster.

    Scaling sees the clear pixels outside the mask too; the mask is applied after it.
    Without a ``mask`` table the pixel table's own mask column is used.
    """
    ready = prepared(pixels, features, scope, clustered)
    fields = ready.filter(is_inside()) if mask is None else inside_mask(ready, mask)
    return assign_clusters(fields, centres, features)


def scored_in_place(
    pixels: DataFrame,
    centres: Centres,
    features: Sequence[str] = SCALED_FEATURES,
    scope: str = "scene",
    clustered: bool = False,
) -> DataFrame:
    """Every pixel, with the cluster that ``scored`` gives it or null where it gives none.

    Painting an image from this needs no join of predictions back onto pixels.
    """
    names = [feature.removeprefix("Scaled_") for feature in features]
    indexed = with_indices(pixels)
    ready = minmax_scaled(indexed, names, scope, fitted_on=clear_pixels(indexed), clustered=clustered)
    counted = is_clear() & is_inside()
    return ready.withColumn(
        "prediction", F.when(counted, nearest_centre(centres, features))
    )


def observed_scores(
    pixels: DataFrame, centres: Centres, harvested: int = 0, name: str = "scores", **options
) -> tuple[DataFrame, Observation]:
    """``scored_in_place``, and the counts at each filter, filled in by the first action on the rows.

    The counts are those of ``filter_audit`` over all scenes, and the pixels with a cluster and the harvested
    ones. They come with the run that uses the rows: nothing is read for them. Write the rows as they come: a sort or
    a partitioning by range runs them once more for its sample, and would count them twice.
    """
    cells = scored_in_place(pixels, centres, **options)
    counts = Observation(name)
    clear, inside, label = is_clear(), is_inside(), F.col("prediction")
    conditions = {
        "clear_pixels": clear, "mask_pixels": inside, "clear_mask_pixels": clear & inside,
        "scored_pixels": label.isNotNull(), "harvested_pixels": label == harvested,
    }
    seen = cells.observe(
        counts, F.count(F.lit(1)).alias("all_pixels"), *(F.count_if(c).alias(n) for n, c in conditions.items()))
    return seen, counts


def harvest_report(
    pixels: DataFrame,
    centres: Centres,
    harvested: int = 0,
    mask: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Clear and harvested field pixels, share, cane, sugar and value per scene.

    Every scene is reported; one without a clear field pixel has 0 pixels and a null share. For pixels
    bucketed by scene pass ``clustered=True``: nothing is exchanged then. A ``mask`` table, of cells or of
    bitmaps, takes the place of the pixels' own mask column; it shuffles no pixel and keeps their buckets.
    """
    if mask is not None:
        pixels = with_mask(pixels, mask)
    taken = F.col("prediction") == harvested
    cells = scored_in_place(pixels, centres, **options)
    return with_yield(harvest_stats(cells, taken, is_clear() & is_inside()))


def train_scaled(
    pixels: DataFrame, clusters: int = 3, features: Sequence[str] = SCALED_FEATURES, **options
) -> Restart:
    """The best of several k-means fits on globally scaled clear pixels."""
    return fit_together(prepared(pixels, features, "global"), features, clusters, **options)[0]


def trained_report(pixels: DataFrame, clusters: int = 3, **options) -> DataFrame:
    """Train, take the cluster of lowest mean NDVI as harvested, and report.

    Training and scoring use the extremes of the whole table, so that clusters mean the same in
    every scene.
    """
    centres = model_centres(train_scaled(pixels, clusters, **options))
    profile = cluster_profile(scored(pixels, centres, scope="global"))
    row = profile.filter("harvested").first()
    return harvest_report(pixels, centres, row["prediction"] if row else 0, scope="global")


@dataclass(frozen=True)
class StandardModel:
    """Cluster centres with the scaler that they were fitted behind."""

    columns: tuple[str, ...]
    moments: Moments
    centres: list[list[float]]

    @property
    def features(self) -> list[str]:
        return [f"Standard_{c}" for c in self.columns]

    def predict(self, pixels: DataFrame) -> DataFrame:
        """Clusters by the stored scaler, whatever else is in ``pixels``."""
        ready = standard_scaled(pixels, self.columns, self.moments)
        return assign_clusters(ready, self.centres, self.features)

    def save(self, spark: SparkSession, path: str) -> None:
        scaler = [(c, *self.moments[c]) for c in self.columns]
        rows_to_table(spark, scaler, "name STRING, mean DOUBLE, deviation DOUBLE").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/scaler")
        centres_table(spark, self.centres, self.features).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @staticmethod
    def load(spark: SparkSession, path: str) -> StandardModel:
        scaler = spark.read.parquet(f"{path}/scaler").collect()
        columns = tuple(r["name"] for r in scaler)
        rows = spark.read.parquet(f"{path}/centres").orderBy("prediction").collect()
        centres = [[r[f"Standard_{c}"] for c in columns] for r in rows]
        return StandardModel(columns, {r["name"]: (r["mean"], r["deviation"]) for r in scaler}, centres)


def train_standardised(
    pixels: DataFrame, columns: Sequence[str], clusters: int = 4, seed: int = 0
) -> StandardModel:
    """Standard scaling followed by k-means, kept together."""
    clear = clear_pixels(pixels)
    fitted = moments(clear, columns)
    features = [f"Standard_{c}" for c in columns]
    model = fit_kmeans(standard_scaled(clear, columns, fitted), features, clusters, seed)
    return StandardModel(tuple(columns), fitted, model_centres(model))
