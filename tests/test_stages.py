import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.functions.indices import with_indices
from cropscan.functions.quality import clear_pixels
from cropscan.operators.clustering import SCALED_FEATURES
from cropscan.operators.masks import mask_bitmaps, pixels_in_mask, write_mask
from cropscan.operators.raster import PIXEL
from cropscan.operators.scaling import minmax_scaled
from cropscan.plans.stages import (
    ClearPixels, FieldMask, MinMaxScaler, MinMaxScalerModel, StoredKMeans, VegetationIndices,
)

NAMES = [f.removeprefix("Scaled_") for f in SCALED_FEATURES]


@pytest.fixture(scope="module")
def pixels(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages") / "pixels")
    fx.pixel_obs(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    a = a.select(*b.columns)
    return a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("scope", ["global", "scene"])
def test_a_saved_pipeline_predicts_alike_on_other_scenes(spark, sf_dir, pixels, tmp_path, scope):
    mask = str(tmp_path / "mask")
    write_mask(mask_bitmaps(pixels_in_mask(fx.mask_image(spark, sf_dir))), mask)
    stages = [
        ClearPixels(limit=220), VegetationIndices(names=["NDVI", "LCI", "LAI", "GNDVI", "SCI"]), MinMaxScaler(names=NAMES, scope=scope),
        FieldMask(path=mask), VectorAssembler(inputCols=list(SCALED_FEATURES), outputCol="features", handleInvalid="skip"), KMeans(k=3, seed=5)]
    first = F.col("date") < F.lit("2017-01-11").cast("date")
    model = Pipeline(stages=stages).fit(pixels.filter(first))
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    other = pixels.filter(~first)
    assert same(loaded.transform(other).select(*PIXEL, "prediction"), model.transform(other).select(*PIXEL, "prediction"))
    assert loaded.stages[0].getOrDefault("limit") == 220 and loaded.stages[3].getOrDefault("path") == mask
    unfitted = Pipeline(stages=stages)
    unfitted.write().overwrite().save(str(tmp_path / "plan"))
    again = Pipeline.load(str(tmp_path / "plan")).fit(pixels.filter(first))
    assert same(again.transform(other).select(*PIXEL, "prediction"), model.transform(other).select(*PIXEL, "prediction"))


def test_the_scaler_keeps_what_it_was_fitted_with(pixels):
    ready = with_indices(clear_pixels(pixels))
    few = ready.filter("tile_x = 7680")
    fitted = MinMaxScaler(names=NAMES).fit(ready)
    whole = minmax_scaled(ready, NAMES, "global").filter("tile_x = 7680")
    assert same(fitted.transform(few).select(*PIXEL, *SCALED_FEATURES), whole.select(*PIXEL, *SCALED_FEATURES))
    by_scene = MinMaxScaler(names=NAMES, scope="scene").fit(few).transform(few)
    assert same(by_scene.select(*PIXEL, *SCALED_FEATURES), minmax_scaled(few, NAMES).select(*PIXEL, *SCALED_FEATURES))
    with pytest.raises(ValueError, match="scope"):
        MinMaxScaler(scope="tile").fit(few)
    with pytest.raises(ValueError, match="nothing"):
        MinMaxScaler(names=NAMES).fit(few.limit(0))
    assert isinstance(fitted, MinMaxScalerModel) and fitted.copy().getOrDefault("scope") == "global"


def test_a_fit_runs_the_stages_before_it_once(spark):
    """Every row that is read counts; plain KMeans reads them anew for each pass of its seeding."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    points = spark.range(300, numPartitions=2).selectExpr("double(id % 3 * 10) AS a", "double(id % 7) / 10 AS b")
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(points.mapInArrow(counted, points.schema))
    model = StoredKMeans(k=3, seed=1, solver="block").fit(vectors)
    assert read.value == 300
    assert sorted(round(float(c[0])) for c in model.clusterCenters()) == [0, 10, 20]
    assert model.summary.trainingCost > 0 and type(model).__name__ == "KMeansModel"
