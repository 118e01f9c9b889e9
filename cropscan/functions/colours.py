"""Cluster palettes and choropleth classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Colour = tuple[int, int, int]

# Cluster colours (red, green, blue) in cluster order.
CLUSTER_PALETTE: tuple[Colour, ...] = (
    (0x10, 0xAD, 0x00),
    (0x00, 0x26, 0xA4),
    (0xFF, 0x00, 0x00),
    (0xFF, 0xC6, 0x00),
    (0x00, 0x00, 0x00),
)


# The sequential blues of the map, from the lowest class to the highest.
MAP_PALETTE = ("#f7fbff", "#deebf7", "#c6dbef", "#9ecae1", "#6baed6", "#4292c6", "#2171b5", "#084594")


def spread_palette(clusters: int) -> tuple[Colour, ...]:
    """Colours spread over ``clusters`` steps, stored green-ramp first.

    For cluster c of n the three ramps are 255 - 255*|2c-n|/n, 255*c/n and 255 - 255*c/n,
    each cut to a whole number.
    """

    def colour(c: int) -> Colour:
        share, fold = 255 * c / clusters, 255 * abs(2 * c - clusters) / clusters
        return int(255 - fold), int(share), int(255 - share)

    return tuple(colour(c) for c in range(clusters))


def palette_colour(prediction: Column, palette: Sequence[Colour]) -> Column:
    """struct(red, green, blue) of a cluster; null for null or an id outside the palette."""
    entries = [
        F.struct(F.lit(r).alias("red"), F.lit(g).alias("green"), F.lit(b).alias("blue"))
        for r, g, b in palette
    ]
    return F.get(F.array(*entries), prediction)


def colour_class(value: Column, low: Column, high: Column, classes: int = 8) -> Column:
    """Class 0..classes-1 of a value, linear between low and high and clipped outside."""
    position = F.floor((value - low) * F.lit(classes) / (high - low))
    return (
        F.when(value.isNotNull(), F.least(F.greatest(position, F.lit(0)), F.lit(classes - 1)))
        .cast("int")
    )


def class_colour(number: Column, palette: Sequence[str] = MAP_PALETTE, missing: str = "gray") -> Column:
    """Colour name of a class; ``missing`` for null, as for a lot without a value."""
    return F.coalesce(F.get(F.array(*map(F.lit, palette)), number), F.lit(missing))
