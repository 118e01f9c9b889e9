"""K-means on pixel features: fitting, stored centres, assignment and evaluation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropscan.session import bound_methods, stored_for_a_while

from .restarts import Centres, Restart, fit_together

INDEX_FEATURES = ("NDVI", "GNDVI", "LAI")
SCALED_FEATURES = ("Scaled_NDVI", "Scaled_LCI", "Scaled_LAI", "Scaled_GNDVI", "Scaled_SCI")
WIDE_SCALED_FEATURES = (
    "Scaled_NIR", "Scaled_RED", "Scaled_GRN", "Scaled_NDVI",
    "Scaled_LCI", "Scaled_LAI", "Scaled_GNDVI", "Scaled_SCI",
)


def with_features(pixels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the ``features`` vector; pixels with a null feature are left out, as they get no cluster."""
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="skip"
    )
    return assembler.transform(pixels)


#: Scans are cut by bytes, and a vector in memory takes some seven times its three numbers. Plain numbers in short files
#: keep a task's rows the same however well the features would compress: about three million.
PLAIN = {"maxRecordsPerFile": 250_000, "compression": "none", "parquet.enable.dictionary": False}


@contextmanager
def _feature_table(rows: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """The columns alone, numbers as doubles, stored for the time of a fit that reads them many times over."""
    kinds = {f.name: f.dataType for f in rows.select(*columns).schema.fields}
    narrow = rows.select(*(F.col(c).cast("double").alias(c) if isinstance(k, T.NumericType) else F.col(c) for c, k in kinds.items()))
    with stored_for_a_while(narrow, "features", **PLAIN) as table:
        yield table


@dataclass(frozen=True)
class FitSummary:
    """What a fit tells of itself."""

    k: int
    numIter: int
    trainingCost: float


class FittedKMeansModel(KMeansModel):
    """Spark ML's model of centres that were found elsewhere, with the figures of that fit. Loaded again it is a plain ``KMeansModel``."""

    figures: FitSummary | None = None

    @property
    def hasSummary(self) -> bool:
        return self.figures is not None

    @property
    def summary(self) -> FitSummary:
        return self.figures


class _OfCentres(KMeans):
    """Without a step, and with its starts drawn among rows that are the centres, a fit has them all."""

    def _create_model(self, java_model) -> FittedKMeansModel:
        return FittedKMeansModel(java_model)


def _model_of(spark: SparkSession, features: Sequence[str], fit: Restart) -> FittedKMeansModel:
    """The fit as a Spark ML model. Equal centres become one, as in Spark ML's own fits."""
    rows = centres_table(spark, fit.centres, features).coalesce(1)
    estimator = _OfCentres(k=max(2, len(fit.centres)), initMode="random", maxIter=0, seed=fit.seed)
    model = estimator.fit(with_features(rows, features).select("features"))
    model.figures = FitSummary(len(model.clusterCenters()), fit.steps, fit.cost)
    return model


def fit_kmeans(
    pixels: DataFrame, features: Sequence[str], clusters: int, seed: int = 1, max_iter: int = 20
) -> KMeansModel:
    return fit_restarts(pixels, features, clusters, [seed], max_iter)[0][1]


def fit_restarts(
    pixels: DataFrame,
    features: Sequence[str],
    clusters: int,
    seeds: Iterable[int] = range(10),
    max_iter: int = 300,
) -> list[tuple[int, KMeansModel]]:
    """One fit per seed over the same stored features, best (lowest cost) first.

    The fits are those of ``restarts.fit_together``: they share their passes and cache nothing, where Spark ML's own
    keeps each row's norm, costs and block in the executors. Equal costs are ordered by seed.
    """
    fits = fit_together(pixels, features, clusters, seeds=seeds, max_iter=max_iter)
    return [(fit.seed, _model_of(pixels.sparkSession, features, fit)) for fit in fits]


def fit_best_of(pixels: DataFrame, features: Sequence[str], clusters: int, **options) -> KMeansModel:
    return fit_restarts(pixels, features, clusters, **options)[0][1]


def save_model(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def model_centres(model) -> list[list[float]]:
    """Centres of a KMeansModel, or of a fit that holds them as ``centres``."""
    if hasattr(model, "centres"):
        return [list(centre) for centre in model.centres]
    return [[float(v) for v in centre] for centre in model.clusterCenters()]


def centres_table(spark: SparkSession, centres: Centres, features: Sequence[str]) -> DataFrame:
    """One row per cluster: prediction and one column per feature."""
    schema = "prediction INT, " + ", ".join(f"`{f}` DOUBLE" for f in features)
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], schema)


def squared_distance(centre: Sequence[float], features: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for name, value in zip(features, centre, strict=True):
        gap = F.col(name).cast("double") - F.lit(float(value))
        total = total + gap * gap
    return total


def nearest_centre(centres: Centres, features: Sequence[str]) -> Column:
    """Id of the nearest centre, the lowest id on ties; null if a feature is null."""
    ranked = [
        F.struct(squared_distance(centre, features).alias("distance"), F.lit(i).alias("id"))
        for i, centre in enumerate(centres)
    ]
    nearest = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    complete = F.lit(True)
    for name in features:
        complete = complete & F.col(name).isNotNull()
    return F.when(complete, nearest["id"])


def assign_clusters(pixels: DataFrame, centres: Centres, features: Sequence[str]) -> DataFrame:
    bound_methods(pixels.sparkSession)
    return pixels.withColumn("prediction", nearest_centre(centres, features))


def predict(pixels: DataFrame, model: KMeansModel, features: Sequence[str]) -> DataFrame:
    """Assignment by a fitted model, with its centres as literals in generated code."""
    return assign_clusters(pixels, model_centres(model), features)


def lloyd_step(pixels: DataFrame, centres: Centres, features: Sequence[str]) -> DataFrame:
    """Means of the features and size per cluster after assignment to ``centres``."""
    return (
        assign_clusters(pixels, centres, features)
        .groupBy("prediction")
        .agg(F.count(F.lit(1)).alias("pixels"), *(F.avg(f).alias(f) for f in features))
    )


def lloyd_fit(
    pixels: DataFrame, centres: Centres, features: Sequence[str], steps: int
) -> list[list[float]]:
    """Centres after a fixed number of Lloyd steps from given ones; an empty cluster keeps its centre."""
    found = [list(map(float, c)) for c in centres]
    for _ in range(steps):
        for row in lloyd_step(pixels, found, features).filter("prediction IS NOT NULL").collect():
            found[row["prediction"]] = [row[f] for f in features]
    return found


def fit_audit(assigned: DataFrame, centres: Centres, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group: rows, rows without a cluster, and rows that are not with their nearest centre.

    A row with a null feature has no cluster, here as in the fit, and is no misfit.
    """
    nearest = nearest_centre(centres, features)
    return assigned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(F.col("prediction").isNull()).alias("unlabelled"),
        F.count_if(F.col("prediction") != nearest).alias("misplaced"),
    )


def one_cluster_cost(pixels: DataFrame, features: Sequence[str]) -> float:
    """Sum of squared distances to the mean of all rows without a null feature."""
    total = sum((F.var_pop(F.col(f).cast("double")) for f in features), F.lit(0.0))
    row = pixels.dropna(subset=list(features)).agg(total.alias("spread"), F.count(F.lit(1)).alias("n")).first()
    return (row["spread"] or 0.0) * row["n"]


def cluster_profile(assigned: DataFrame) -> DataFrame:
    """Size and mean NDVI per cluster, and which one counts as harvested.

    That is the cluster of lowest mean NDVI, the lowest id on ties. The window
    sees one row per cluster, so that the pixels are gone over once.
    """
    profile = assigned.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("NDVI").alias("mean_ndvi")
    )
    lowest = F.min(F.struct("mean_ndvi", "prediction")).over(Window.partitionBy(F.lit(0)))["prediction"]
    return profile.withColumn("harvested", F.col("prediction") == lowest)


def silhouette(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean squared-Euclidean silhouette of the assignment, as one row.

    The evaluator passes over its rows more than once, so they are stored without anything else.
    """
    narrow = assigned.select(*features, "prediction").dropna()
    with stored_for_a_while(narrow, "assigned") as table:
        vectors = with_features(table, features).select("features", "prediction")
        value = ClusteringEvaluator().evaluate(vectors)
    return assigned.sparkSession.createDataFrame([(value,)], "silhouette DOUBLE")
