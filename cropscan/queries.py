"""Registered queries: name -> function of (spark, folder of test tables).

Dates leave a query as 'YYYY-MM-DD' text, the form the stored pixel tables use.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cropscan import fixtures as fx
from cropscan.functions.colours import spread_palette
from cropscan.functions.indices import INDICES, index, with_indices
from cropscan.functions.keys import composite_key, image_key, last_date, pixel_table_key
from cropscan.functions.quality import clear_pixels, is_clear, is_inside, with_quality_flags
from cropscan.operators import clustering as cl
from cropscan.operators import describe as ds
from cropscan.operators import harvest as hv
from cropscan.operators import lots as lt
from cropscan.operators import ragged as rg
from cropscan.operators import raster as rs
from cropscan.operators import restarts as rt
from cropscan.operators import scaling as sc
from cropscan.operators import scenes as sn
from cropscan.operators import timeseries as ts
from cropscan.operators.masks import inside_mask, pixels_in_mask
from cropscan.plans import (
    StandardModel, harvest_report, observed_scores, prepared, score_into, scored, scored_in_place,
    stored_predictions, train_scaled, train_standardised,
)
from cropscan.plans import report_from_files as plan_report_from_files
from cropscan.plans import stages as st
from cropscan.plans import trained_report as plan_trained_report
from cropscan.session import fresh_path, stored
from cropscan.sources import (
    SUBFOLDERS, bucket_count, image_manifest, json_field, named_files, read_csv, read_geojson, read_geojson_parts, read_pixels, read_predictions,
    save_clustered, scan_table, scenes_of, write_band_files, write_collections, write_csv, write_named_files,
    write_pixels, write_predictions,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PIXEL = rs.PIXEL
REPORT_YEAR = 1998
# The other labels of the events table come under "Other".
LABELS = ("click", "purchase", "view")
YEAR_FILL = {
    "sale_price_count": 0, "sale_price_mean": 0, "sale_price_median": 0, "sf_mean": 0,
    "price_sf_mean": 0, "min_income": 0, "harverst_count": 0,
}


def query(run: Query, name: str | None = None) -> Query:
    """Register a query under its function name."""

    def with_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = run(spark, sf_dir)
        return result.withColumns(
            {c: F.col(c).cast("string") for c, kind in result.dtypes if kind == "date"}
        )

    QUERIES[name or run.__name__] = with_text_dates
    return run


def named(name: str) -> Callable[[Query], Query]:
    return lambda run: query(run, name)


def _rounded(rows: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, places) for c in columns})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(fx.pixel_obs(spark, sf_dir), fx.CENTRES)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.parse_image_keys(fx.scene_keys(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.with_date(fx.table(spark, sf_dir, "events"), "ts")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with some values that are no numbers."""
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _events(spark, sf_dir).withColumn("value", value)


# Flagship: scenes to harvest, share and yield per tile and date.


@named("harvest_report")
def harvest_report_query(spark, sf_dir):
    return harvest_report(fx.pixel_obs(spark, sf_dir), fx.CENTRES)


@query
def harvest_report_clustered(spark, sf_dir):
    """The same over a table bucketed by scene."""
    table = _clustered(fx.pixel_obs(spark, sf_dir), "pixels", sc.SCENE)
    return harvest_report(table, fx.CENTRES, clustered=True)


@query
def trained_report(spark, sf_dir):
    """Per scene the clear field pixels, and two facts about the rest of the report, worked out without the plan.

    Harvested are the pixels of the cluster of lowest mean NDVI, and the value is theirs.
    """
    pixels, options = _stored_pixels(spark, sf_dir), {"clusters": 3, "seeds": (0, 1), "max_iter": 20}
    report = plan_trained_report(pixels, **options)
    assigned = scored(pixels, cl.model_centres(train_scaled(pixels, **options)), scope="global")
    # The pixels are gone over once, for a few numbers per scene and cluster.
    sums = assigned.groupBy(*sc.SCENE, "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.count("NDVI").alias("known"), F.sum("NDVI").alias("ndvi"))
    sums = stored(sums, "sums")
    mean = F.try_divide(F.sum("ndvi").cast("double"), F.sum("known").cast("double"))
    means = {r["prediction"]: r["m"] for r in sums.groupBy("prediction").agg(mean.alias("m")).collect()}
    lowest = min(means, key=lambda c: (means[c], c))
    theirs = F.when(F.col("prediction") == lowest, F.col("n")).otherwise(0)
    counted = sums.groupBy(*sc.SCENE).agg(F.sum(theirs).alias("expected"))
    both = report.join(counted, list(sc.SCENE), "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    worth = F.col("expected") * hv.CANE_PER_PIXEL / hv.CANE_PER_SUGAR * hv.SUGAR_PRICE
    return both.select(
        *sc.SCENE, "clear_pixels", (F.col("harvested_pixels") == F.col("expected")).alias("harvested_is_lowest"),
        (F.abs(F.col("value") - worth) < 1e-6).alias("value_is_theirs"))


def _stored_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "pixels")
    write_pixels(fx.pixel_obs(spark, sf_dir), path)
    return read_pixels(spark, path)


@query
def score_increment(spark, sf_dir):
    """Predictions after three runs: the first dates, then all, then one date again with centres in other order."""
    pixels, path = _stored_pixels(spark, sf_dir), fresh_path(spark, "scored")
    score_into(pixels.filter("date < DATE '2017-01-21'"), fx.CENTRES, path)
    score_into(pixels, fx.CENTRES, path)
    again = pixels.filter("date = DATE '2017-01-01'")
    score_into(again, fx.CENTRES[::-1], path, again=again)
    return stored_predictions(spark, path).select(*PIXEL, "prediction")


@query
def score_second_run(spark, sf_dir):
    """What each of three runs has scored: the first dates, the last one, nothing."""
    pixels, path = _stored_pixels(spark, sf_dir), fresh_path(spark, "scored")
    runs = [pixels.filter("date < DATE '2017-01-21'"), pixels, pixels]
    reports = [score_into(part, fx.CENTRES, path).withColumn("run", F.lit(i)) for i, part in enumerate(runs)]
    done = reports[0].unionByName(reports[1]).unionByName(reports[2])
    return done.groupBy("run").agg(
        F.count(F.lit(1)).alias("scenes"), F.sum("clear_pixels").alias("clear_pixels"),
        F.sum("harvested_pixels").alias("harvested_pixels"))


# Sources and sinks.


@query
def scene_list(spark, sf_dir):
    return sn.image_series(_images(spark, sf_dir))


@query
def object_keys_clean(spark, sf_dir):
    return sn.clean_object_keys(fx.object_handles(spark, sf_dir), "img512")


@query
def pixel_scan(spark, sf_dir):
    return fx.pixel_obs(spark, sf_dir)


@query
def csv_roundtrip(spark, sf_dir):
    priority = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    rows = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_custkey").alias("SEGPAR"),
        F.col("o_totalprice").alias("price"),
        priority.alias("priority"),
    )
    path = fresh_path(spark, "csv")
    write_csv(rows, path)
    return read_csv(
        spark, path, "row BIGINT, date DATE, SEGPAR BIGINT, price DOUBLE, priority STRING"
    ).drop("row")


def _written_features(spark: SparkSession, lots: DataFrame, geometry: Column, path: str) -> None:
    properties = F.struct("SEGPAR", "PLAN")
    write_collections(lots.select(lt.feature_struct(properties, geometry).alias("feature")), path, size=7)


@query
def geojson_features(spark, sf_dir):
    """Collections of several features, some of them of many polygons."""
    lots = fx.lots(spark, sf_dir)
    square = fx.lot_geometry()
    many = F.struct(F.lit("MultiPolygon").alias("type"), F.array(square["coordinates"]).alias("coordinates"))
    path = fresh_path(spark, "geojson")
    _written_features(spark, lots.filter("SEGPAR % 7 <> 0"), square, f"{path}/single")
    _written_features(spark, lots.filter("SEGPAR % 7 = 0"), many, f"{path}/many")
    features = read_geojson(spark, f"{path}/*", "SEGPAR: BIGINT, PLAN: STRING", one_per_line=True)
    ring = F.coalesce(
        F.col("geometry.coordinates"), F.from_json("geometry.text", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")[0]
    )[0]

    def edge(pick: Callable[[Column], Column], axis: int) -> Column:
        return pick(F.transform(ring, lambda corner: corner[axis]))

    return features.select(
        "properties.SEGPAR", "properties.PLAN", F.col("geometry.type").alias("shape"),
        F.size(ring).alias("corners"),
        edge(F.array_min, 0).alias("west"), edge(F.array_min, 1).alias("south"),
        edge(F.array_max, 0).alias("east"), edge(F.array_max, 1).alias("north"),
    )


@query
def geojson_parts(spark, sf_dir):
    """Collections printed over many lines, read feature by feature from parts of the files."""
    path = fresh_path(spark, "geojson")
    feature = lt.feature_struct(F.struct("SEGPAR", "PLAN"), fx.lot_geometry())
    write_collections(fx.lots(spark, sf_dir).select(feature.alias("feature")), path, pretty=True)
    features = read_geojson_parts(spark, path, "SEGPAR: BIGINT, PLAN: STRING")
    return features.select("type", "properties.*", F.col("geometry.coordinates")[0][2][0].alias("east"), F.size("geometry.coordinates").alias("rings"))


def _year_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = lt.with_addresses(fx.lots(spark, sf_dir), fx.lot_addresses(spark, sf_dir))
    return lt.with_year_facts(lots, fx.lot_facts(spark, sf_dir), REPORT_YEAR, YEAR_FILL)


@query
def geojson_export(spark, sf_dir):
    """Feature collections with every merged column, read back feature by feature."""
    merged = _year_lots(spark, sf_dir)
    path = fresh_path(spark, "features")
    exported = lt.feature_struct(F.struct(*merged.columns), fx.lot_geometry())
    write_collections(merged.select(exported.alias("feature")), path)
    fields = ", ".join(f"{name}: {kind}" for name, kind in merged.dtypes)
    back = read_geojson(spark, path, fields, one_per_line=True)
    shape = F.struct("geometry.type", "geometry.coordinates")
    return back.select(lt.feature(F.col("properties"), shape).alias("feature"))


@query
def choropleth_export(spark, sf_dir):
    """Year facts, class on the field's own scale, map features, and those read back."""
    merged = _year_lots(spark, sf_dir).withColumns({"field": F.lit("min_income"), "value": F.col("min_income")})
    classed = lt.with_field_class(merged, lt.display_fields(spark))
    path = fresh_path(spark, "choropleth")
    exported = lt.feature_struct(F.struct("SEGPAR", "PLAN", "year", "min_income", "colour_class"), fx.lot_geometry())
    write_collections(classed.select(exported.alias("feature")), path)
    fields = "SEGPAR: BIGINT, PLAN: STRING, year: INT, min_income: BIGINT, colour_class: INT"
    return read_geojson(spark, path, fields, one_per_line=True).select("properties.*")


@named("json_field")
def json_field_query(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return events.select("event_id", json_field(F.col("props"), "k", "int").alias("cloud_cover"))


@query
def scene_cloud_cover(spark, sf_dir):
    scenes = fx.pixel_obs(spark, sf_dir).select(*sc.SCENE).distinct()
    return sn.with_cloud_cover(scenes, fx.cover_documents(spark, sf_dir))


@query
def report_from_files(spark, sf_dir):
    """The report of a folder of band files: listed, paired, read in ranges, aligned and scored."""
    folder = fresh_path(spark, "bands")
    write_band_files(fx.colour_images(spark, sf_dir).withColumn("band", F.lit("TCI")), folder, SUBFOLDERS)
    write_band_files(fx.band_images(spark, sf_dir), folder, SUBFOLDERS)
    return plan_report_from_files(image_manifest(spark, folder, kind="raw", subfolders=True), fx.SIDE, fx.CENTRES)


@query
def image_folder(spark, sf_dir):
    """A folder of image files: names listed, and parsed back into scenes."""
    files = fx.scene_keys(spark, sf_dir)
    path = fresh_path(spark, "images")
    # Files that hold their own names stand for images.
    write_named_files(files.select("key", F.col("key").alias("text")), path)
    return sn.parse_image_keys(named_files(spark, path).select("key"))


@query
def raster_explode(spark, sf_dir):
    cells = rs.explode_image(fx.colour_images(spark, sf_dir))
    return cells.filter(F.col("mask").isNotNull())


@query
def parquet_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "pixels")
    write_pixels(fx.pixel_obs(spark, sf_dir), path)
    return read_pixels(spark, path)


@query
def sql_scan(spark, sf_dir):
    return scan_table(spark, fx.table(spark, sf_dir, "customer"))


@query
def model_roundtrip(spark, sf_dir):
    """Pixels per scene, and how many a saved and reloaded model puts in the same cluster."""
    ready = _indexed(spark, sf_dir)
    fitted = cl.fit_kmeans(ready, cl.INDEX_FEATURES, clusters=4)
    path = fresh_path(spark, "kmeans")
    cl.save_model(fitted, path)
    loaded = cl.load_model(path)
    before = cl.nearest_centre(cl.model_centres(fitted), cl.INDEX_FEATURES)
    return loaded.transform(cl.with_features(ready, cl.INDEX_FEATURES)).groupBy(*sc.SCENE).agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(F.col("prediction") == before).alias("same"),
    )


# Projections, filters and predicates.


@query
def project_subset(spark, sf_dir):
    return _scored(spark, sf_dir).select(*PIXEL, "prediction")


@query
def rename_cols(spark, sf_dir):
    return lt.renamed_lots(fx.lots(spark, sf_dir))


@named("composite_key")
def composite_key_query(spark, sf_dir):
    return fx.pixel_obs(spark, sf_dir).select(
        composite_key(F.col("tile_x"), F.col("tile_y")).alias("tile"),
        composite_key(F.col("x"), F.col("y")).alias("pixel"),
        "date",
    )


@query
def bright_filter(spark, sf_dir):
    return clear_pixels(fx.pixel_obs(spark, sf_dir)).select(*PIXEL, *rs.RGB)


@query
def quality_flags(spark, sf_dir):
    flagged = with_quality_flags(fx.pixel_obs(spark, sf_dir))
    return flagged.select(*PIXEL, "clouds", "havested")


@query
def tile_select(spark, sf_dir):
    chosen = sn.select_tiles(fx.pixel_obs(spark, sf_dir), [(7680, 10240), (8192, 10240)])
    return chosen.select(*PIXEL)


@query
def lot_year_fill(spark, sf_dir):
    return lt.with_year_facts(
        fx.lots(spark, sf_dir), fx.lot_facts(spark, sf_dir), REPORT_YEAR, YEAR_FILL
    )


@query
def cluster_filter(spark, sf_dir):
    return _scored(spark, sf_dir).filter(F.col("prediction") == 0).select(*PIXEL)


@query
def crop_window(spark, sf_dir):
    return rs.crop(fx.pixel_obs(spark, sf_dir), 16, 8, 48, 40).select(*PIXEL, *rs.RGB)


@query
def mask_pixels(spark, sf_dir):
    return pixels_in_mask(fx.mask_image(spark, sf_dir))


@query
def scene_slice(spark, sf_dir):
    return sn.scene_slice(fx.pixel_obs(spark, sf_dir), 1, 3).select(*PIXEL, "day_no")


def _clustered(rows: DataFrame, name: str, keys, buckets: int | None = None) -> DataFrame:
    name = f"{name}_{uuid.uuid4().hex}"
    return save_clustered(rows, name, fresh_path(rows.sparkSession, name), buckets or bucket_count(rows), keys=keys)


@query
def scene_slice_clustered(spark, sf_dir):
    """The same slice of a table bucketed by scene, with positions from the buckets themselves."""
    pixels = _clustered(fx.pixel_obs(spark, sf_dir), "pixels", sc.SCENE)
    return sn.scene_slice(pixels, 1, 3, clustered=True).select(*PIXEL, "day_no")


@query
def scene_slice_dates(spark, sf_dir):
    """The same slice of a table with a folder per date, with positions from a stored list of scenes."""
    pixels = _stored_pixels(spark, sf_dir)
    scenes = stored(scenes_of(pixels), "scenes")
    return sn.sliced_dates(pixels, 1, 3, scenes).select(*PIXEL, "day_no")


# Joins.


@query
def mask_semijoin(spark, sf_dir):
    mask = pixels_in_mask(fx.mask_image(spark, sf_dir))
    return inside_mask(fx.pixel_obs(spark, sf_dir), mask).select(*PIXEL)


@query
def lot_address_join(spark, sf_dir):
    return lt.with_addresses(fx.lots(spark, sf_dir), fx.lot_addresses(spark, sf_dir))


@query
def minmax_sql(spark, sf_dir):
    return sc.minmax_sql(with_indices(fx.pixel_obs(spark, sf_dir)))


@query
def band_pivot(spark, sf_dir):
    return rs.align_bands(fx.band_images(spark, sf_dir)).filter(F.col("B01").isNotNull())


@query
def image_ingest(spark, sf_dir):
    cells = rs.pixel_table(fx.colour_images(spark, sf_dir), fx.band_images(spark, sf_dir))
    return cells.filter(F.col("mask").isNotNull())


@query
def image_sizes(spark, sf_dir):
    bands = fx.band_images(spark, sf_dir).select(*sc.SCENE, "width", "height", "band")
    return rs.image_sizes(bands.unionByName(fx.thumbnails(spark, sf_dir)))


@query
def scene_pairing(spark, sf_dir):
    return sn.paired_images(_images(spark, sf_dir))


@query
def display_lookup(spark, sf_dir):
    measures = ["sale_price_count", "sale_price_mean", "min_income"]
    long = fx.lot_facts(spark, sf_dir).unpivot(["SEGPAR", "year"], measures, "field", "value")
    shown = lt.with_display(long, lt.display_fields(spark))
    return shown.select("SEGPAR", "year", "field", "value", "shown", "verbage")


@query
def display_by_label(spark, sf_dir):
    """The field behind a label, and how its value is shown."""
    labels = {"sale_price_mean": "Average Sales Price", "min_income": "Minimum Income Required"}
    long = fx.lot_facts(spark, sf_dir).unpivot(["SEGPAR", "year"], list(labels), "measure", "value")
    label = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[F.col("measure")]
    shown = lt.with_display(long.withColumn("verbage", label), lt.display_fields(spark), on="verbage")
    return shown.select("SEGPAR", "year", "verbage", "field", "value", "shown")


@query
def overlay(spark, sf_dir):
    cells = scored_in_place(fx.pixel_obs(spark, sf_dir), fx.CENTRES)
    return cells.select(*PIXEL, *rs.painted(F.col("prediction")))


@query
def predictions_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "predictions")
    write_predictions(_scored(spark, sf_dir), path)
    return read_predictions(spark, path)


@query
def overlay_join(spark, sf_dir):
    """Painted from predictions that were stored before."""
    path = fresh_path(spark, "predictions")
    write_predictions(_scored(spark, sf_dir), path)
    return rs.overlay(fx.pixel_obs(spark, sf_dir), read_predictions(spark, path))


@query
def overlay_clustered(spark, sf_dir):
    """The same from pixels and predictions in buckets by pixel."""
    rows = fx.pixel_obs(spark, sf_dir)
    buckets = bucket_count(rows)
    pixels = _clustered(rows, "pixels", PIXEL, buckets)
    predictions = _clustered(scored(pixels, fx.CENTRES).select(*PIXEL, "prediction"), "predictions", PIXEL, buckets)
    return rs.overlay(pixels, predictions, clustered=True)


# Aggregations.


@query
def cluster_counts(spark, sf_dir):
    return hv.cluster_counts(_scored(spark, sf_dir))


@query
def cluster_profile(spark, sf_dir):
    return _rounded(cl.cluster_profile(_scored(spark, sf_dir)), "mean_ndvi")


def _soil_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = with_quality_flags(fx.pixel_obs(spark, sf_dir))
    return hv.harvest_stats(pixels, F.col("havested"), is_clear() & is_inside())


@query
def harvest_pct(spark, sf_dir):
    return _soil_stats(spark, sf_dir)


@query
def yield_estimate(spark, sf_dir):
    return hv.with_yield(_soil_stats(spark, sf_dir)).select(*sc.SCENE, "cane", "sugar", "value")


@query
def distinct_dates(spark, sf_dir):
    return fx.pixel_obs(spark, sf_dir).select("date").distinct()


@query
def tile_count(spark, sf_dir):
    return sn.tile_count(_images(spark, sf_dir))


@query
def tile_dedup(spark, sf_dir):
    return sn.distinct_tiles(_images(spark, sf_dir))


@query
def filter_audit(spark, sf_dir):
    return hv.filter_audit(fx.pixel_obs(spark, sf_dir))


@query
def scored_audit(spark, sf_dir):
    """Counts at each filter, told by the run that writes the predictions."""
    cells, counts = observed_scores(fx.pixel_obs(spark, sf_dir), fx.CENTRES)
    stored(cells.filter("prediction IS NOT NULL").select(*PIXEL, "prediction"), "predictions")
    return spark.createDataFrame([Row(**counts.get)])


@query
def ts_describe(spark, sf_dir):
    described = ts.describe_by(_measured(spark, sf_dir), "date", "value")
    return _rounded(described, "mean", "std", "min", "p25", "p50", "p75", "max")


_STATISTICS = ("mean", "std", "min", "p25", "p50", "p75", "max")


@query
def ts_describe_all(spark, sf_dir):
    """All numeric columns of the events by date."""
    return _rounded(ds.describe_all(_measured(spark, sf_dir), "date"), *_STATISTICS, places=5)


@query
def describe_groups(spark, sf_dir):
    """Figures of the order lines by their flag: three groups, one of them with half of all rows."""
    lines = fx.table(spark, sf_dir, "lineitem")
    return _rounded(ds.describe_all(lines, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]), *_STATISTICS, places=5)


@query
def ts_group_sum(spark, sf_dir):
    return _rounded(ts.group_totals(_measured(spark, sf_dir), "date", "value"), "total", places=4)


@query
def label_precision(spark, sf_dir):
    table = ts.label_table(_events(spark, sf_dir), "date", "event_type", LABELS)
    return ts.with_precision(table, "view", LABELS)


@query
def label_table_found(spark, sf_dir):
    """The tally by date with a column for every label that occurs."""
    return rg.label_table_found(_events(spark, sf_dir), "date", "event_type")


@query
def tally_documents(spark, sf_dir):
    """Counts by date and label from one JSON text a date, with whatever labels it has."""
    counts = _events(spark, sf_dir).filter("user_id % 3 = 0").groupBy("date", "event_type").count()
    texts = counts.groupBy("date").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "count")))).alias("text"))
    return rg.tallies(texts, "date")


@query
def scene_metadata(spark, sf_dir):
    """Scenes with all fields that their metadata documents have."""
    scenes = fx.pixel_obs(spark, sf_dir).select(*sc.SCENE).distinct()
    return rg.with_metadata(scenes, fx.cover_documents(spark, sf_dir))


@query
def label_pivot(spark, sf_dir):
    return ts.label_table(_events(spark, sf_dir), "date", "event_type", LABELS)


@query
def scene_completeness(spark, sf_dir):
    return sn.incomplete_bands(_images(spark, sf_dir))


# Order and position.


@query
def latest_scene(spark, sf_dir):
    return sn.latest_images(_images(spark, sf_dir))


@query
def ts_sorted(spark, sf_dir):
    rows = _events(spark, sf_dir).select("date", "event_id", "value")
    return ts.sorted_series(rows, "date", "event_id")


@query
def ts_head(spark, sf_dir):
    return ts.head(_events(spark, sf_dir).select("date", "event_id", "value"), 5, "date", "event_id")


# Set operations.


@query
def scene_union(spark, sf_dir):
    """Scenes of two origins in one table; the second has some without a date."""
    pixels = fx.pixel_obs(spark, sf_dir).select(*PIXEL, *rs.RGB)
    odd = F.col("tile_y") % 1024 == 0
    undated = F.when(F.col("x") != 0, F.col("date"))
    return sn.append_scenes(pixels.filter(odd), pixels.filter(~odd).withColumn("date", undated))


@query
def hstack(spark, sf_dir):
    cells = scored_in_place(fx.pixel_obs(spark, sf_dir), fx.CENTRES)
    return rs.beside_itself(cells, rs.painted(F.col("prediction"), spread_palette(3)), fx.SIDE)


# Scalar functions.


@query
def veg_indices(spark, sf_dir):
    return with_indices(fx.pixel_obs(spark, sf_dir)).select(*PIXEL, *INDICES)


def _index_query(name: str) -> Query:
    return lambda spark, sf_dir: fx.pixel_obs(spark, sf_dir).select(*PIXEL, index(name))


for _name in list(INDICES):
    query(_index_query(_name), f"index_{_name.lower()}")


@query
def scene_parse(spark, sf_dir):
    """With a file among them whose name says nothing."""
    odd = spark.createDataFrame([("old-copy-B01.png",)], "key STRING")
    return sn.parse_image_keys(fx.scene_keys(spark, sf_dir).unionByName(odd))


@named("last_date")
def last_date_query(spark, sf_dir):
    keys = fx.object_handles(spark, sf_dir).unionByName(fx.scene_keys(spark, sf_dir))
    return keys.select("key", last_date(F.col("key")).alias("last_date"))


@query
def scene_keys_build(spark, sf_dir):
    x, y, band, date = (F.col(c) for c in ("tile_x", "tile_y", "band", "date"))
    return fx.scene_catalogue(spark, sf_dir).select(
        image_key(x, y, band, date).alias("image"), pixel_table_key(x, y, date).alias("table")
    )


# Scaling and clustering.


@query
def minmax_global(spark, sf_dir):
    return prepared(fx.pixel_obs(spark, sf_dir), cl.WIDE_SCALED_FEATURES, "global").select(
        *PIXEL, *cl.WIDE_SCALED_FEATURES
    )


@query
def minmax_scene(spark, sf_dir):
    return prepared(fx.pixel_obs(spark, sf_dir), cl.WIDE_SCALED_FEATURES).select(
        *PIXEL, *cl.WIDE_SCALED_FEATURES
    )


@query
def standard_scale(spark, sf_dir):
    columns = ("B08", "B04", "B03")
    names = [f"Standard_{c}" for c in columns]
    scaled = sc.standard_scaled(clear_pixels(fx.pixel_obs(spark, sf_dir)), columns)
    return _rounded(scaled.select(*PIXEL, *names), *names)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene and features of the clear pixels, worked out once for the fit and what follows it."""
    ready = with_indices(clear_pixels(fx.pixel_obs(spark, sf_dir)), cl.INDEX_FEATURES)
    return stored(ready.select(*sc.SCENE, *cl.INDEX_FEATURES), "indexed")


@query
def kmeans_fit(spark, sf_dir):
    """Per scene the clear pixels, those without a cluster, and those not with their nearest centre."""
    ready = _indexed(spark, sf_dir)
    model = cl.fit_kmeans(ready, cl.INDEX_FEATURES, clusters=4, seed=1)
    assigned = model.transform(cl.with_features(ready, cl.INDEX_FEATURES))
    return cl.fit_audit(assigned, cl.model_centres(model), cl.INDEX_FEATURES, sc.SCENE)


@query
def kmeans_best_of(spark, sf_dir):
    """Per restart: better than one cluster, and chosen exactly where the cost is lowest."""
    ready = prepared(fx.pixel_obs(spark, sf_dir), scope="global")
    table = stored(rt.feature_rows(ready, cl.SCALED_FEATURES), "features")
    fits = rt.fit_rows(table, cl.SCALED_FEATURES, clusters=3)
    single = cl.one_cluster_cost(table, cl.SCALED_FEATURES)
    costs = {fit.seed: fit.cost for fit in fits}
    chosen = fits[0].seed
    best = min(costs, key=lambda seed: (costs[seed], seed))
    rows = [(seed, cost <= single, (seed == chosen) == (seed == best)) for seed, cost in costs.items()]
    return spark.createDataFrame(rows, "seed INT, below_one_cluster BOOLEAN, chosen_by_cost BOOLEAN")


@query
def kmeans_standardised(spark, sf_dir):
    """The audit of ``kmeans_fit`` for a model that was saved with its scaler and read again."""
    pixels = fx.pixel_obs(spark, sf_dir)
    path = fresh_path(spark, "standard-model")
    train_standardised(pixels, ("B08", "B04", "B03")).save(spark, path)
    model = StandardModel.load(spark, path)
    return cl.fit_audit(model.predict(clear_pixels(pixels)), model.centres, model.features, sc.SCENE)


@query
def pipeline_roundtrip(spark, sf_dir):
    """A pipeline fitted on the first dates, saved and loaded: pixels of the last date, and how many of them the
    loaded one puts where the plan does with the same centres and extremes."""
    pixels, path = _stored_pixels(spark, sf_dir), fresh_path(spark, "pipeline")
    last = F.col("date") == F.lit("2017-01-21").cast("date")
    names = [f.removeprefix("Scaled_") for f in cl.SCALED_FEATURES]
    stages = [
        st.ClearPixels(), st.VegetationIndices(), st.MinMaxScaler(names=names), st.FieldMask(),
        VectorAssembler(inputCols=list(cl.SCALED_FEATURES), outputCol="features", handleInvalid="skip"), st.StoredKMeans(k=3, seed=1, solver="block")]
    Pipeline(stages=stages).fit(pixels.filter(~last)).write().overwrite().save(path)
    model = PipelineModel.load(path)
    found = model.transform(pixels.filter(last))
    centres = [[float(v) for v in c] for c in model.stages[-1].clusterCenters()]
    indexed = with_indices(pixels)
    ready = sc.minmax_scaled(indexed, names, "global", fitted_on=clear_pixels(indexed).filter(~last))
    expected = cl.assign_clusters(clear_pixels(ready).filter(last & is_inside()), centres, cl.SCALED_FEATURES)
    both = found.select(*PIXEL, "prediction").join(expected.select(*PIXEL, F.col("prediction").alias("expected")), list(PIXEL))
    return both.groupBy(*sc.SCENE).agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("prediction") == F.col("expected")).alias("same"))


@query
def kmeans_given_start(spark, sf_dir):
    """Centres after two Lloyd steps from given ones."""
    fields = _scored(spark, sf_dir).drop("prediction")
    centres = cl.lloyd_fit(fields, fx.CENTRES, cl.SCALED_FEATURES, steps=2)
    return _rounded(cl.centres_table(spark, centres, cl.SCALED_FEATURES), *cl.SCALED_FEATURES)


@query
def kmeans_given_starts(spark, sf_dir):
    """Centres and cost after two Lloyd steps from each of several starts, in one pass a step."""
    table = stored(rt.feature_rows(_scored(spark, sf_dir), cl.SCALED_FEATURES), "features")
    fits = rt.fit_from_starts(table, cl.SCALED_FEATURES, fx.STARTS, max_iter=2, tol=0.0)
    costs = rt.costs_together(table, cl.SCALED_FEATURES, [centres for centres, _, _ in fits])
    rows = [
        (i, c, *centre, cost) for i, ((centres, _, _), cost) in enumerate(zip(fits, costs, strict=True))
        for c, centre in enumerate(centres)]
    columns = ", ".join(f"{f} DOUBLE" for f in cl.SCALED_FEATURES)
    return _rounded(spark.createDataFrame(rows, f"start INT, prediction INT, {columns}, cost DOUBLE"), *cl.SCALED_FEATURES, "cost", places=5)


@query
def kmeans_assign(spark, sf_dir):
    return _scored(spark, sf_dir).select(*PIXEL, "NDVI", "prediction")


@query
def kmeans_lloyd_step(spark, sf_dir):
    fields = _scored(spark, sf_dir).drop("prediction")
    step = cl.lloyd_step(fields, fx.CENTRES, cl.SCALED_FEATURES)
    return _rounded(step, *cl.SCALED_FEATURES)


@query
def cluster_centers(spark, sf_dir):
    """Per fitted centre, whether it has members and is their mean to within a unit of the indices."""
    ready = _indexed(spark, sf_dir)
    centres = cl.model_centres(cl.fit_kmeans(ready, cl.INDEX_FEATURES, clusters=5, seed=1, max_iter=300))
    step = cl.lloyd_step(ready, centres, cl.INDEX_FEATURES)
    means = step.select("prediction", "pixels", *(F.col(f).alias(f"mean_{f}") for f in cl.INDEX_FEATURES))
    gap = F.greatest(*(F.abs(F.col(f) - F.col(f"mean_{f}")) for f in cl.INDEX_FEATURES))
    return cl.centres_table(spark, centres, cl.INDEX_FEATURES).join(means, "prediction", "left").select(
        "prediction", (F.coalesce("pixels", F.lit(0)) > 0).alias("has_members"), (gap < 1.0).alias("is_mean"))


@query
def silhouette(spark, sf_dir):
    return _rounded(cl.silhouette(_scored(spark, sf_dir), cl.SCALED_FEATURES), "silhouette")


# Map classes.


@query
def choropleth_bins(spark, sf_dir):
    """Classes on each field's own scale."""
    facts = fx.lot_facts(spark, sf_dir)
    long = facts.unpivot(["SEGPAR", "year"], ["sale_price_mean", "min_income"], "field", "value")
    return lt.with_field_class(long, lt.display_fields(spark))


@query
def choropleth_colours(spark, sf_dir):
    """Colour of every lot on the map of one year and field; lots without facts that year are gray."""
    lots = fx.lots(spark, sf_dir)
    year = fx.lot_facts(spark, sf_dir).filter(F.col("year") == REPORT_YEAR).select("SEGPAR", F.col("sale_price_mean").alias("value"))
    long = lots.select("SEGPAR", F.lit("sale_price_mean").alias("field")).join(year, "SEGPAR", "left")
    return lt.with_field_colour(long, lt.display_fields(spark))
