"""Vegetation indices as Column expressions over the band columns B01..B12.

Each index is a scaled ratio cut to an integer towards zero, which is what a Spark
cast from double to int does. A zero denominator gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropscan.session import bound_methods

BANDS = tuple(f"B{number:02d}" for number in range(1, 13))

BLUE, GREEN, RED, RED_EDGE, NIR, SWIR = "B02", "B03", "B04", "B05", "B08", "B11"


def _band(name: str) -> Column:
    return F.col(name).cast("double")


def truncated_ratio(scale: int, numerator: Column, denominator: Column) -> Column:
    return F.try_divide(F.lit(float(scale)) * numerator, denominator).cast("int")


def normalised_difference(high: str, low: str, scale: int = 10_000) -> Column:
    a, b = _band(high), _band(low)
    return truncated_ratio(scale, a - b, a + b)


def renormalised_difference() -> Column:
    nir, red = _band(NIR), _band(RED)
    return truncated_ratio(20_000, nir - red, F.sqrt(nir + red))


def red_blue_difference() -> Column:
    nir2, red, blue = F.lit(2.0) * _band(NIR), _band(RED), _band(BLUE)
    return truncated_ratio(10_000, nir2 - red - blue, nir2 + red + blue)


IndexBuilder = Callable[[], Column]

# LCI alone is scaled by 100; LAI and GLI are the same ratio under two names.
INDICES: dict[str, IndexBuilder] = {
    "NDVI": lambda: normalised_difference(NIR, RED),
    "GNDVI": lambda: normalised_difference(NIR, GREEN),
    "RDVI": renormalised_difference,
    "RBNDVI": red_blue_difference,
    "LCI": lambda: normalised_difference(NIR, RED_EDGE, scale=100),
    "LAI": lambda: normalised_difference(RED_EDGE, RED),
    "SCI": lambda: normalised_difference(SWIR, NIR),
    "NDMI": lambda: normalised_difference(NIR, SWIR),
    "GLI": lambda: normalised_difference(RED_EDGE, RED),
}


def register_index(name: str, builder: IndexBuilder) -> None:
    """Make a further index available by name to ``with_indices``."""
    if name in INDICES:
        raise ValueError(f"index {name} is already registered")
    INDICES[name] = builder


def index(name: str) -> Column:
    return INDICES[name]().alias(name)


def with_indices(pixels: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Add the named indices (all registered ones by default) in one projection."""
    bound_methods(pixels.sparkSession)
    chosen = list(INDICES) if names is None else list(names)
    return pixels.withColumns({name: INDICES[name]() for name in chosen})
