import datetime
import math

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.functions.indices import with_indices
from cropscan.functions.quality import clear_pixels
from cropscan.operators import clustering as cl
from cropscan.operators.harvest import harvest_stats
from cropscan.operators.masks import pixels_in_mask
from cropscan.operators.scaling import standard_scaled
from cropscan.plans import (
    StandardModel, harvest_report, scored, scored_in_place, train_scaled, train_standardised, trained_report,
)
from cropscan.session import fresh_path


@pytest.fixture(scope="module")
def ready(spark, sf_dir):
    frame = with_indices(clear_pixels(fx.pixel_obs(spark, sf_dir)), cl.INDEX_FEATURES).cache()
    yield frame
    frame.unpersist()


@pytest.fixture(scope="module")
def model(ready):
    return cl.fit_kmeans(ready, cl.INDEX_FEATURES, clusters=4, seed=1)


def cost(frame, centres, features):
    distances = [cl.squared_distance(c, features) for c in centres]
    nearest = F.least(*distances) if len(distances) > 1 else distances[0]
    return frame.agg(F.sum(nearest)).first()[0]


def test_fit_beats_one_cluster(ready, model):
    centres = cl.model_centres(model)
    mean = ready.agg(*(F.avg(c) for c in cl.INDEX_FEATURES)).first()
    assert cost(ready, centres, cl.INDEX_FEATURES) < cost(ready, [mean], cl.INDEX_FEATURES)
    assert cost(ready, centres, cl.INDEX_FEATURES) == pytest.approx(
        model.summary.trainingCost, rel=1e-4  # the summary is one step behind
    )


def test_literal_centres_equal_the_model(ready, model):
    ours = cl.predict(ready, model, cl.INDEX_FEATURES).withColumnRenamed("prediction", "ours")
    theirs = model.transform(cl.with_features(ours, cl.INDEX_FEATURES))
    assert theirs.filter(F.col("ours") != F.col("prediction")).isEmpty()
    assert theirs.count() == ready.count()


def test_save_and_load(spark, ready, model):
    path = fresh_path(spark, "model")
    cl.save_model(model, path)
    assert cl.model_centres(cl.load_model(path)) == cl.model_centres(model)


def test_best_of_has_the_lowest_cost(ready):
    fits = cl.fit_restarts(ready, cl.INDEX_FEATURES, clusters=3, seeds=range(4), max_iter=30)
    costs = [fit.summary.trainingCost for _, fit in fits]
    assert sorted(seed for seed, _ in fits) == [0, 1, 2, 3]
    assert costs == sorted(costs)
    single = cl.fit_kmeans(ready, cl.INDEX_FEATURES, clusters=3, seed=fits[0][0], max_iter=30)
    assert single.summary.trainingCost == pytest.approx(costs[0], rel=1e-9)


def test_training_plans(spark, sf_dir):
    pixels = fx.pixel_obs(spark, sf_dir)
    best = train_scaled(pixels, clusters=2, seeds=range(2), max_iter=20)
    assert len(cl.model_centres(best)) == 2
    assert all(0 <= v <= 1 for centre in cl.model_centres(best) for v in centre)


def test_the_scaler_is_kept_with_the_model(spark, sf_dir, tmp_path):
    pixels = clear_pixels(fx.pixel_obs(spark, sf_dir))
    model = train_standardised(pixels, ["B08", "B04", "B03"])
    assert len(model.centres) == 4
    model.save(spark, str(tmp_path / "m"))
    loaded = StandardModel.load(spark, str(tmp_path / "m"))
    assert loaded == model
    few = pixels.limit(50)
    assert loaded.predict(few).exceptAll(model.predict(few)).isEmpty()
    other_scaler = standard_scaled(few, model.columns)
    assert not loaded.predict(few).select("Standard_B08").exceptAll(other_scaler.select("Standard_B08")).isEmpty()


def test_fit_from_given_centres(spark):
    frame = spark.createDataFrame([(0.0,), (1.0,), (9.0,), (11.0,), (None,)], "v DOUBLE")
    assert cl.lloyd_fit(frame, [(1.0,), (2.0,), (100.0,)], ["v"], steps=3) == [[0.5], [10.0], [100.0]]


def test_pixels_without_a_cluster_count_but_are_not_harvested(spark):
    frame = spark.createDataFrame(
        [(1, 2, None, 0.0), (1, 2, None, None)], "tile_x INT, tile_y INT, date DATE, v DOUBLE")
    assigned = cl.assign_clusters(frame, [(0.0,), (5.0,)], ["v"])
    row = harvest_stats(assigned, F.col("prediction") == 0).first()
    assert (row["clear_pixels"], row["harvested_pixels"]) == (2, 1)
    audit = cl.fit_audit(assigned, [(0.0,), (5.0,)], ["v"], ["tile_x"]).first()
    assert (audit["pixels"], audit["unlabelled"], audit["misplaced"]) == (2, 1, 0)


def test_report_has_every_scene(spark, sf_dir):
    pixels = fx.pixel_obs(spark, sf_dir)
    report = harvest_report(pixels, fx.CENTRES)
    scenes = pixels.select("tile_x", "tile_y", "date").distinct().count()
    empty = report.filter("clear_pixels = 0").collect()
    assert report.count() == scenes and len(empty) == 1
    assert (empty[0]["harvested_pixels"], empty[0]["percentage"], empty[0]["cane"]) == (0, None, 0.0)
    mask = pixels_in_mask(fx.mask_image(spark, sf_dir))
    by_table = harvest_report(pixels, fx.CENTRES, mask=mask)
    assert by_table.select(report.columns).exceptAll(report).isEmpty() and by_table.count() == scenes


def test_ties_and_nulls(spark):
    frame = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (None, 0.0), (0.9, 0.0)], "a DOUBLE, b DOUBLE")
    got = cl.assign_clusters(frame, [(2.0, 0.0), (0.0, 0.0), (2.0, 0.0)], ["a", "b"]).collect()
    assert [r["prediction"] for r in got] == [1, 0, None, 1]


def test_lloyd_steps_do_not_raise_the_cost(ready):
    centres = [(-3000.0, 0.0, -3000.0), (0.0, 0.0, 0.0), (3000.0, 0.0, 3000.0)]
    last = math.inf
    for _ in range(3):
        now = cost(ready, centres, cl.INDEX_FEATURES)
        assert now <= last
        last = now
        step = cl.lloyd_step(ready, centres, cl.INDEX_FEATURES).orderBy("prediction").collect()
        assert sum(r["pixels"] for r in step) == ready.count()
        centres = [tuple(r[f] for f in cl.INDEX_FEATURES) for r in step]


def test_harvested_cluster_is_the_lowest_ndvi(spark):
    frame = spark.createDataFrame([(0, 10), (1, -5), (1, 5), (2, 0), (3, 7)], "prediction INT, NDVI INT")
    rows = {r["prediction"]: r for r in cl.cluster_profile(frame).collect()}
    assert [p for p in sorted(rows) if rows[p]["harvested"]] == [1]
    assert rows[1]["mean_ndvi"] == 0.0 and rows[1]["pixels"] == 2


def test_mask_table_equals_mask_column(spark, sf_dir):
    pixels = fx.pixel_obs(spark, sf_dir)
    keys = ["tile_x", "tile_y", "x", "y", "date", "prediction"]
    by_column = scored(pixels, fx.CENTRES).select(keys)
    mask = pixels_in_mask(fx.mask_image(spark, sf_dir))
    by_table = scored(pixels, fx.CENTRES, mask=mask).select(keys)
    in_place = scored_in_place(pixels, fx.CENTRES).filter("prediction IS NOT NULL").select(keys)
    assert by_column.count() == by_table.count() == in_place.count() == 6714
    assert by_column.exceptAll(by_table).isEmpty()
    assert by_column.exceptAll(in_place).isEmpty()


def test_empty_mask_and_cloudy_scene(spark, sf_dir):
    pixels = fx.pixel_obs(spark, sf_dir)
    empty = pixels_in_mask(fx.mask_image(spark, sf_dir)).limit(0)
    assert scored(pixels, fx.CENTRES, mask=empty).isEmpty()
    cloudy = pixels.withColumns({c: F.lit(255) for c in ("red", "green", "blue")})
    assert scored(cloudy, fx.CENTRES).isEmpty()
    in_place = scored_in_place(cloudy, fx.CENTRES)
    assert in_place.filter("prediction IS NOT NULL").isEmpty()
    assert in_place.count() == pixels.count()


def test_trained_report_takes_the_lowest_ndvi_of_separated_clusters(spark):
    # A known number of bare pixels a scene; near-infrared alone sets the groups apart.
    names = ["tile_x", "tile_y", "x", "y", "date", "mask", "red", "green", "blue", *fx.BANDS]
    rows, bare = [], {1: 20, 2: 45}
    for tile, n in bare.items():
        for i in range(90):
            nir = (300 if i < n else 1500 if i % 2 else 3800) + i % 7
            bands = [nir if b == "B08" else 1000 + i % 5 for b in fx.BANDS]
            rows.append((tile, 2, i, tile, datetime.date(2019, 1, 1), 0, 50, 90, 40, *bands))
    report = trained_report(spark.createDataFrame(rows, names), clusters=3, seeds=(0, 1), max_iter=20).collect()
    assert {r["tile_x"]: (r["clear_pixels"], r["harvested_pixels"]) for r in report} == {1: (90, 20), 2: (90, 45)}
    for r in report:
        n = bare[r["tile_x"]]
        assert r["percentage"] == n / 90
        assert [r["cane"], r["sugar"], r["value"]] == pytest.approx([n * 97.7, n * 97.7 / 6.2, n * 97.7 / 6.2 * 0.42])


def test_a_fit_caches_nothing(spark, ready):
    """Spark ML's own fit keeps norms, costs and blocks of all rows in the executors while it runs."""
    jsc, most = spark.sparkContext._jsc, []
    seen, kept = type(ready).collect, set(jsc.getPersistentRDDs())

    def watched(frame):
        most.append(len(set(jsc.getPersistentRDDs()) - kept))
        return seen(frame)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(ready), "collect", watched)
        fitted = cl.fit_kmeans(ready, cl.INDEX_FEATURES, clusters=4, seed=1)
    assert most and max(most) == 0
    assert len(fitted.clusterCenters()) == 4 and fitted.hasSummary


def test_fits_are_as_good_as_those_of_spark_ml(ready, model):
    vectors = cl.with_features(ready, cl.INDEX_FEATURES).select("features")
    theirs = [KMeans(k=4, seed=seed).fit(vectors).summary.trainingCost for seed in (1, 2, 3)]
    ours = [fit.summary.trainingCost for _, fit in cl.fit_restarts(ready, cl.INDEX_FEATURES, clusters=4, seeds=(1, 2, 3), max_iter=20)]
    assert min(ours) <= min(theirs) * 1.01


def test_equal_rows_give_fewer_centres(spark):
    frame = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "v DOUBLE")
    fitted = cl.fit_kmeans(frame, ["v"], clusters=4)
    assert sorted(cl.model_centres(fitted)) == [[1.0], [2.0]] and fitted.summary.trainingCost == 0.0


def test_a_profile_goes_over_the_pixels_once(spark, tmp_path):
    spark.createDataFrame([(0, 10), (1, -5)], "prediction INT, NDVI INT").write.parquet(str(tmp_path / "p"))
    profile = cl.cluster_profile(spark.read.parquet(str(tmp_path / "p")))
    assert profile._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["prediction"]: r["harvested"] for r in profile.collect()} == {0: False, 1: True}
