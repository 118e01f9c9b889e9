"""Per-pixel quality predicates on the red, green, blue and mask columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRIGHT_LIMIT = 225


def is_clear(limit: int = BRIGHT_LIMIT) -> Column:
    """True below the brightness limit in all three colours."""
    return (F.col("red") < limit) & (F.col("green") < limit) & (F.col("blue") < limit)


def is_cloud() -> Column:
    """Grey pixels: all three colours equal."""
    return (F.col("red") == F.col("green")) & (F.col("red") == F.col("blue"))


def is_bare_soil() -> Column:
    return F.col("red") > F.col("green")


def is_inside() -> Column:
    """Inside the crop mask, for pixel tables that carry the mask as a column."""
    return F.col("mask") == 0


def is_opaque_black() -> Column:
    """The colour that marks the inside of a field in an RGBA mask image."""
    return (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0) & (F.col("a") == 255)


def clear_pixels(pixels: DataFrame, limit: int = BRIGHT_LIMIT) -> DataFrame:
    return pixels.filter(is_clear(limit))


def with_quality_flags(pixels: DataFrame) -> DataFrame:
    """``clouds`` and ``havested`` (spelled as in the stored pixel tables)."""
    return pixels.withColumns({"clouds": is_cloud(), "havested": is_bare_soil()})
