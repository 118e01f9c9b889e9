"""Rasters as rows: images hold one array of pixels, pixel tables one row per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropscan.functions.colours import CLUSTER_PALETTE, Colour, palette_colour
from cropscan.functions.indices import BANDS

from .masks import CELL
from .scaling import SCENE

RGB = ("red", "green", "blue")
PIXEL = (*CELL, "date")


def _cell(position: Column, width: Column) -> list[Column]:
    return [
        (position % width).cast("int").alias("x"),
        F.floor(position / width).cast("int").alias("y"),
    ]


def explode_image(images: DataFrame, pixels: str = "pixels") -> DataFrame:
    """One row per cell of row-major images; the fields of tuple pixels become columns.

    ``images`` has the scene keys, width, height and an array of numbers or structs.
    """
    cells = images.select(*SCENE, "width", F.posexplode(pixels).alias("position", "value"))
    element = images.schema[pixels].dataType.elementType
    values = "value.*" if hasattr(element, "fields") else "value"
    return cells.select(*SCENE, *_cell(F.col("position"), F.col("width")), values)


def image_sizes(images: DataFrame) -> DataFrame:
    """Per scene: number of images, and whether all have the same width and height."""
    return images.groupBy(*SCENE).agg(
        F.count(F.lit(1)).alias("images"),
        F.max("width").alias("width"),
        F.max("height").alias("height"),
        ((F.min("width") == F.max("width")) & (F.min("height") == F.max("height"))).alias(
            "same_size"
        ),
    )


#: Cells of one image that travel in one row while bands are brought together.
BLOCK_CELLS = 4096


def _blocks(images: DataFrame, cells: int) -> DataFrame:
    """The images cut into runs of at most ``cells`` pixels, numbered from 0; an empty image is one empty run."""
    count = F.size("pixels")
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(cells))
    parts = F.transform(starts, lambda at: F.slice("pixels", at + 1, cells))
    return images.select(
        *SCENE, "band", "width", count.alias("cells"), F.posexplode(parts).alias("block", "part")
    )


def align_bands(
    images: DataFrame, bands: Sequence[str] = BANDS, block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """Zip the band images of each scene cell by cell: one row per cell, one column per band.

    Images are cut into blocks before they are brought together, so a shuffled row holds at most
    one block of each band however large the image, and a scene is spread over many
    tasks. A band that a scene lacks gives nulls. Images of unequal size stop the query.
    """
    present = images.filter(F.col("band").isin(list(bands)) & F.col("pixels").isNotNull())
    return align_blocks(_blocks(present, block_cells), bands, block_cells)


def align_blocks(
    blocks: DataFrame, bands: Sequence[str] = BANDS, block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """The same for images that come in blocks: scene, band, width, cells of the image, block number, ``part``.

    Every block but the last has ``block_cells`` pixels, in ``part``.
    """
    kind = blocks.schema["part"].dataType
    gathered = blocks.groupBy(*SCENE, "block").agg(
        F.map_from_entries(F.collect_list(F.struct("band", "part"))).alias("by_band"),
        F.max("width").alias("width"),
        ((F.min("width") == F.max("width")) & (F.min("cells") == F.max("cells"))).alias("same_size"),
    )
    none = F.array().cast(kind)
    aligned = F.arrays_zip(*(
        F.coalesce(F.try_element_at("by_band", F.lit(band)), none).alias(band) for band in bands
    ))
    element = kind.elementType.simpleString()
    checked = F.when(F.col("same_size"), aligned).otherwise(
        F.raise_error(F.lit("band images of one scene differ in size")).cast(
            f"array<struct<{','.join(f'`{b}`:{element}' for b in bands)}>>"
        )
    )
    cells = gathered.select(*SCENE, "width", "block", F.posexplode(checked).alias("at", "value"))
    position = F.col("block").cast("long") * block_cells + F.col("at")
    return cells.select(*SCENE, *_cell(position, F.col("width")), "value.*")


def tuple_bands(images: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Split tuple images into one scalar image per field, named after it."""
    planes = F.array(*(
        F.struct(F.lit(f).alias("band"), F.col("pixels")[f].alias("pixels")) for f in fields
    ))
    return images.select(*SCENE, "width", "height", F.explode(planes).alias("plane")).select(
        *SCENE, "width", "height", "plane.*"
    )


def pixel_table(
    colour_images: DataFrame,
    band_images: DataFrame,
    fields: Sequence[str] = ("mask", *RGB),
    bands: Sequence[str] = BANDS,
) -> DataFrame:
    """The wide pixel table of scenes given as tuple images and scalar band images.

    The planes of both kinds are aligned together, so the arrays are shuffled once.
    """
    planes = tuple_bands(colour_images, fields).unionByName(
        band_images.select(*SCENE, "width", "height", "band", "pixels")
    )
    return align_bands(planes, [*fields, *bands])


def crop(pixels: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Pixels inside a half-open window, with coordinates counted from its corner."""
    x, y = F.col("x"), F.col("y")
    inside = (x >= left) & (x < right) & (y >= top) & (y < bottom)
    return pixels.filter(inside).withColumns({"x": x - left, "y": y - top})


def painted(prediction: Column, palette: Sequence[Colour] = CLUSTER_PALETTE) -> list[Column]:
    """red, green, blue: the cluster's colour where there is a prediction, else the image's."""
    colour = palette_colour(prediction, palette)
    return [F.coalesce(colour[name], F.col(name)).alias(name) for name in RGB]


def overlay(
    image: DataFrame, predictions: DataFrame, palette: Sequence[Colour] = CLUSTER_PALETTE,
    clustered: bool = False,
) -> DataFrame:
    """Paint stored predictions over the image; pixels without one keep their colour.

    Both sides are keyed by pixel, so the shuffle of the join has no hot key. ``clustered`` says that both
    are tables of as many buckets by pixel: they are then joined bucket by bucket, and nothing is shuffled.
    """
    keyed = predictions.select(*PIXEL, "prediction")
    if clustered:
        keyed = keyed.hint("merge")
    return image.join(keyed, list(PIXEL), "left").select(
        *PIXEL, *painted(F.col("prediction"), palette)
    )


def hstack(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Put two images side by side: the second moves right by the width of the first."""
    return left.unionByName(right.withColumn("x", F.col("x") + width))


def beside_itself(pixels: DataFrame, colours: Sequence[Column], width: int) -> DataFrame:
    """The image in ``colours`` with its own colours to the right, both from one scan."""
    shown = F.struct(F.col("x"), *colours)
    own = F.struct((F.col("x") + width).alias("x"), *RGB)
    sides = pixels.select(*PIXEL, F.explode(F.array(shown, own)).alias("side"))
    return sides.select(
        *(F.col("side.x") if c == "x" else F.col(c) for c in PIXEL),
        *(F.col(f"side.{c}") for c in RGB),
    )
