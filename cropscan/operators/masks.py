"""Crop masks as tables of pixel coordinates, and as bitmaps of blocks of a tile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropscan.functions.quality import is_opaque_black
from cropscan.session import materialise

from .joins import BROADCAST_BYTES, table_bytes

TILE = ("tile_x", "tile_y")
CELL = ("tile_x", "tile_y", "x", "y")

#: A block is as many cells as one bitmap has bits: 256 across and 128 down.
BLOCK_WIDTH, BLOCK_HEIGHT = 256, 128
BLOCK = (*TILE, "block_x", "block_y")
_BITS = BLOCK_WIDTH * BLOCK_HEIGHT


def pixels_in_mask(mask_image: DataFrame) -> DataFrame:
    """Coordinates of the opaque black pixels of the mask images (columns r, g, b, a)."""
    return mask_image.filter(is_opaque_black()).select(*CELL)


def _block() -> list[Column]:
    return [
        F.floor(F.col("x") / BLOCK_WIDTH).cast("int").alias("block_x"),
        F.floor(F.col("y") / BLOCK_HEIGHT).cast("int").alias("block_y"),
    ]


def _bit() -> Column:
    """Place of a cell in its block's bitmap, also for coordinates below zero."""
    return F.pmod(F.col("y"), F.lit(BLOCK_HEIGHT)) * BLOCK_WIDTH + F.pmod(F.col("x"), F.lit(BLOCK_WIDTH))


def mask_bitmaps(cells: DataFrame) -> DataFrame:
    """One row per block that holds a mask cell: tile, block and a bitmap of its cells, 4 KB each.

    Cells are set in the tasks that read them, so what is shuffled is a bitmap per block and
    task. Repeated cells are one bit; cells without coordinates are in no mask.
    """
    placed = cells.dropna(subset=list(CELL)).select(*TILE, *_block(), _bit().cast("long").alias("bit"))
    return placed.groupBy(*BLOCK).agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged_masks(bitmaps: DataFrame) -> DataFrame:
    """Blocks that occur more than once, as where masks are kept by field or crop, put together."""
    return bitmaps.groupBy(*BLOCK).agg(F.bitmap_or_agg("bits").alias("bits"))


def mask_sizes(bitmaps: DataFrame) -> DataFrame:
    """Cells in the mask of each tile."""
    return bitmaps.groupBy(*TILE).agg(F.sum(F.bitmap_count("bits")).alias("cells"))


def _words() -> Column:
    """The bitmap as numbers of 64 bits, for a test by index and shift."""
    def word(i: Column) -> Column:
        return F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(_BITS // 64 - 1)), word)


def _is_set() -> Column:
    """Whether the cell's bit is set. A word's first byte is its highest, as hex digits are read."""
    word = F.get("words", F.floor(_bit() / 64).cast("int"))
    within = F.pmod(F.col("x"), F.lit(64))
    return F.getbit(word, (7 - F.floor(within / 8)) * 8 + within % 8) == 1


def _tile_key() -> Column:
    return F.col("tile_x").cast("long") * F.lit(1 << 32) + F.col("tile_y")


def with_mask(pixels: DataFrame, mask: DataFrame, column: str = "mask", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every pixel with ``column``: 0 where it is in its own tile's mask, else 1.

    ``mask`` is a table of cells or of ``mask_bitmaps``. The bitmaps are computed once and measured.
    Within ``max_bytes`` (some four billion cells of area) they are broadcast; beyond, the tiles are dealt into ranges
    that each fit, and every range's pixels are read and matched apart. Pixels are never shuffled, and as
    a range is a condition on the tile, a table laid out by tile is read about once in all.
    """
    bitmaps = mask if "bits" in mask.columns else mask_bitmaps(mask)
    blocks = materialise(bitmaps.select(*BLOCK, _words().alias("words")))
    plain = pixels.drop(column)
    parts = math.ceil(table_bytes(blocks) / max(1, max_bytes))
    if parts <= 1:
        return _matched(plain, blocks, column)
    # The bounds are approximate, so ranges aim at half the size; one tile is the least a range holds.
    shares = [i / (2 * parts) for i in range(1, 2 * parts)]
    bounds = sorted(set(blocks.agg(F.percentile_approx(_tile_key(), shares, 100_000)).first()[0]))
    whole = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        here = _in_range(low, high)
        part = _matched(plain.filter(here), blocks.filter(here), column)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _in_range(low: int | None, high: int | None) -> Column:
    """Tiles above ``low`` up to ``high``; pixels without a tile are in the last range.

    The plain bounds on tile_x are what a scan can use.
    """
    key, x = _tile_key(), F.col("tile_x")
    above = F.lit(True) if low is None else (x >= low >> 32) & (key > low)
    if high is None:
        return above | x.isNull() | F.col("tile_y").isNull()
    return above & (x <= (high >> 32) + 1) & (key <= high)


def _matched(pixels: DataFrame, blocks: DataFrame, column: str) -> DataFrame:
    names = pixels.columns
    placed = pixels.withColumns(dict(zip(("block_x", "block_y"), _block(), strict=True)))
    joined = placed.join(F.broadcast(blocks), list(BLOCK), "left")
    inside = F.coalesce(_is_set(), F.lit(False))
    return joined.select(*names, F.when(inside, 0).otherwise(1).alias(column))


def inside_mask(pixels: DataFrame, mask: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Keep the pixels whose coordinates are in their own tile's mask.

    Where the pixel table carries the mask as a column, ``filter(is_inside())`` gives the same rows
    without a join.
    """
    marked = with_mask(pixels, mask, "_outside", max_bytes)
    return marked.filter(F.col("_outside") == 0).select(*pixels.columns)


def write_mask(bitmaps: DataFrame, path: str) -> None:
    """Bitmaps in tile order; a mask is built once and read by every run."""
    bitmaps.repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK).write.mode("overwrite").parquet(path)
