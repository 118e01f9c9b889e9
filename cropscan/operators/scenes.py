"""Scene catalogue: which images exist for which tile, band and date."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropscan.functions.indices import BANDS
from cropscan.functions.keys import composite_key, key_part, last_date, strip_ends

from cropscan.sources.files import json_field

from .joins import lookup_join
from .scaling import SCENE

COLOUR_IMAGE = "TCI"
TILE = ("tile_x", "tile_y")


def parse_image_keys(keys: DataFrame, key: str = "key") -> DataFrame:
    """tile_x, tile_y, band and date of '{x}-{y}-{band}-{date}.png' names.

    Names of another form stay as rows; what cannot be read from them is null.
    """
    name = F.col(key)
    return keys.select(
        F.col(key),
        key_part(name, 0).try_cast("int").alias("tile_x"),
        key_part(name, 1).try_cast("int").alias("tile_y"),
        key_part(name, 2).alias("band"),
        last_date(name).try_cast("date").alias("date"),
    )


def clean_object_keys(objects: DataFrame, folder: str, key: str = "key") -> DataFrame:
    """Bare file names out of printed object handles such as "...key='folder/name')".

    Keeps the handles of ``folder``, takes what follows the folder, drops the entry
    of the folder itself and strips the leading slash and the closing "')".
    """
    tail = F.get(F.split(F.col(key), rf"\Q{folder}\E"), F.lit(1))
    return (
        objects.filter(F.col(key).contains(folder))
        .select(tail.alias("tail"))
        .filter(F.col("tail") != "/')")
        .select(strip_ends(F.col("tail"), 1, 2).alias("key"))
    )


def image_series(catalogue: DataFrame) -> DataFrame:
    """Every image with its zero-based position in the date order of its tile and band."""
    order = Window.partitionBy(*TILE, "band").orderBy("date", "key")
    return catalogue.withColumn("position", F.row_number().over(order) - 1)


def images_of(catalogue: DataFrame, tile_x: int, tile_y: int, band: str) -> DataFrame:
    """The images of one tile and band in date order."""
    wanted = (F.col("tile_x") == tile_x) & (F.col("tile_y") == tile_y) & (F.col("band") == band)
    return catalogue.filter(wanted).orderBy("date", "key")


def select_tiles(rows: DataFrame, tiles: Iterable[tuple[int, int]]) -> DataFrame:
    """Rows of the listed tiles, as a predicate that reaches the scan."""
    wanted = F.lit(False)
    for tile_x, tile_y in tiles:
        wanted = wanted | ((F.col("tile_x") == tile_x) & (F.col("tile_y") == tile_y))
    return rows.filter(wanted)


def distinct_tiles(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(*TILE).dropDuplicates().withColumn(
        "tile", composite_key(F.col("tile_x"), F.col("tile_y"))
    )


def tile_count(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.countDistinct(*TILE).alias("tiles"))


def latest_images(catalogue: DataFrame) -> DataFrame:
    """The newest image of every tile and band."""
    return catalogue.groupBy(*TILE, "band").agg(
        F.max("date").alias("date"), F.max_by("key", F.struct("date", "key")).alias("key")
    )


def _dates_with(band: str) -> Column:
    return F.count_if(F.col("band") == band)


def incomplete_bands(catalogue: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """Bands whose number of dates differs from that of the colour image, per tile."""
    seen = catalogue.select(*TILE, "band", "date").distinct()
    counts = seen.groupBy(*TILE).agg(
        _dates_with(COLOUR_IMAGE).alias("colour_dates"), *(_dates_with(b).alias(b) for b in bands)
    )
    return counts.unpivot(
        [*TILE, "colour_dates"], list(bands), "band", "band_dates"
    ).filter(F.col("band_dates") != F.col("colour_dates"))


def paired_images(catalogue: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """One row per scene with the key of the colour image and of each band.

    Pairs on tile and date rather than on list position, in one shuffle; a missing
    band leaves a null.
    """
    def key_of(band: str) -> Column:
        return F.max(F.when(F.col("band") == band, F.col("key")))

    return (
        catalogue.groupBy(*SCENE)
        .agg(key_of(COLOUR_IMAGE).alias(COLOUR_IMAGE), *(key_of(b).alias(b) for b in bands))
        .filter(F.col(COLOUR_IMAGE).isNotNull())
    )


def scene_positions(rows: DataFrame) -> DataFrame:
    """Distinct scenes with their zero-based position in the date order of the tile."""
    order = Window.partitionBy(*TILE).orderBy("date")
    scenes = rows.select(*SCENE).distinct()
    return scenes.withColumn("day_no", F.dense_rank().over(order) - 1)


def scene_slice(
    pixels: DataFrame, start: int, stop: int, scenes: DataFrame | None = None, clustered: bool = False,
) -> DataFrame:
    """Pixels of the scenes at positions start..stop-1 of each tile.

    Positions are worked out on the scene list, so no window runs over pixels. ``scenes`` is that list where
    one is kept, such as a stored report; it is read from the pixels otherwise, which for a table bucketed by
    scene needs no exchange of them.

    The list is measured and broadcast, or joined by salted shuffle beyond the bound. With ``clustered``, for
    pixels bucketed by scene, it is dealt out to the buckets instead: no job runs ahead, no pixel is
    exchanged at any number of scenes. ``sliced_dates`` is for tables with one folder per date.
    """
    chosen = scene_positions(pixels if scenes is None else scenes).filter(F.col("day_no").between(start, stop - 1))
    if clustered:
        return pixels.join(chosen.hint("merge"), list(SCENE))
    return lookup_join(pixels, chosen, SCENE, spread=("x", "y"))


def sliced_dates(pixels: DataFrame, start: int, stop: int, scenes: DataFrame) -> DataFrame:
    """``scene_slice`` of a table with one folder per date: other dates are never opened.

    The scene list is broadcast as it stands, with its condition on the position, from which Spark takes the
    folders to read when the query runs. It has one row per scene: a kept list of millions fits.
    """
    chosen = scene_positions(scenes).filter(F.col("day_no").between(start, stop - 1))
    return pixels.join(F.broadcast(chosen), list(SCENE))


def with_cloud_cover(scenes: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """Scenes with the cloud cover of their metadata document, null where there is none.

    ``documents`` has the scene keys and the JSON text. Of several documents of a scene the cloudiest counts.
    """
    field = json_field(F.col(text), "cloud-cover")
    cover = documents.groupBy(*SCENE).agg(F.max(field).alias("cloud_cover"))
    return scenes.join(cover, list(SCENE), "left")


def append_scenes(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
