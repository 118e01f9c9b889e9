"""Min-max and standard scaling over all pixels or scene by scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join

SCENE = ("tile_x", "tile_y", "date")

# Scaled column suffix -> column it scales.
SCALED_SOURCES = {
    "NIR": "B08", "RED": "B04", "GRN": "B03", "NDVI": "NDVI",
    "LCI": "LCI", "LAI": "LAI", "SCI": "SCI", "GNDVI": "GNDVI",
}


def _extremes(names: Sequence[str]) -> list[Column]:
    low = [F.min(SCALED_SOURCES[n]).alias(f"min_{n}") for n in names]
    high = [F.max(SCALED_SOURCES[n]).alias(f"max_{n}") for n in names]
    return low + high


def extremes(pixels: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """min_<name> and max_<name> of every named column in one aggregation pass."""
    return pixels.groupBy(*by).agg(*_extremes(names))


def scaled(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); 0.0 where the column is constant, null stays null."""
    span = high - low
    ratio = (value - low).cast("double") / span.cast("double")
    return F.when(value.isNull(), F.lit(None)).when(span == 0, F.lit(0.0)).otherwise(ratio)


def minmax_scaled(
    pixels: DataFrame,
    names: Sequence[str] | None = None,
    scope: str = "scene",
    fitted_on: DataFrame | None = None,
    clustered: bool = False,
) -> DataFrame:
    """Add Scaled_<name> columns; ``scope`` is "scene" or "global".

    The extremes are those of ``fitted_on``, by default of the pixels themselves.
    A scene without any row there gets nulls. ``clustered`` says that both are bucketed by
    scene: the extremes are then joined bucket by bucket, without an exchange or an eager job.

    Both scopes read the pixels twice and never shuffle them in the usual case:
    once for the extremes, which combine before the shuffle, and once for the
    scaled columns. The global extremes come back as a one-row scalar subquery.
    """
    names = list(SCALED_SOURCES if names is None else names)
    fitted_on = pixels if fitted_on is None else fitted_on
    if scope == "global":
        row = fitted_on.agg(F.struct(*_extremes(names)).alias("extremes"))
        joined = pixels.withColumn("_extremes", row.scalar())
        bound = lambda kind, n: F.col("_extremes")[f"{kind}_{n}"]
        extra = ["_extremes"]
    elif scope == "scene":
        bounds = extremes(fitted_on, names, SCENE)
        if clustered:
            joined = pixels.join(bounds.hint("merge"), list(SCENE), "left")
        else:
            joined = lookup_join(pixels, bounds, SCENE, spread=("x", "y"), how="left")
        bound = lambda kind, n: F.col(f"{kind}_{n}")
        extra = [f"{kind}_{n}" for kind in ("min", "max") for n in names]
    else:
        raise ValueError(f"unknown scope {scope!r}")
    columns = {
        f"Scaled_{n}": scaled(F.col(SCALED_SOURCES[n]), bound("min", n), bound("max", n))
        for n in names
    }
    return joined.withColumns(columns).drop(*extra)


MINMAX_SQL = """
SELECT tile_x, tile_y, date, x, y, {columns}
FROM (SELECT *, (SELECT struct({bounds}) FROM {{image}}) AS m FROM {{image}}) i
"""


def minmax_sql(image: DataFrame) -> DataFrame:
    """The SQL form: every column against the extremes of the whole table.

    The one row of extremes is a scalar subquery, so no cross join is planned.
    """
    sources = SCALED_SOURCES.items()
    bounds = ", ".join(f"min({c}) AS min_{n}, max({c}) AS max_{n}" for n, c in sources)
    columns = ", ".join(
        f"CAST({c} - m.min_{n} AS DOUBLE) / nullif(m.max_{n} - m.min_{n}, 0) AS {n}_scaled"
        for n, c in sources
    )
    text = MINMAX_SQL.format(columns=columns, bounds=bounds)
    return image.sparkSession.sql(text, image=image)


Moments = dict[str, tuple[float, float]]


def moments(pixels: DataFrame, columns: Sequence[str]) -> Moments:
    """Mean and population deviation of every column: what a standard scaler keeps."""
    row = pixels.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.stddev_pop(c).alias(f"dev_{c}") for c in columns)).first()
    return {c: (row[f"mean_{c}"], row[f"dev_{c}"]) for c in columns}


def standard_scaled(
    pixels: DataFrame, columns: Sequence[str], fitted: Moments | None = None
) -> DataFrame:
    """Add Standard_<column> = (v - mean) / population deviation.

    Mean and deviation are those ``fitted`` earlier, by default of the pixels themselves.
    """
    if fitted is None:
        parts = [F.avg(c).alias(f"mean_{c}") for c in columns]
        parts += [F.stddev_pop(c).alias(f"dev_{c}") for c in columns]
        row = pixels.agg(F.struct(*parts).alias("moments"))
        pixels = pixels.withColumn("_moments", row.scalar())
        bound = lambda kind, c: F.col("_moments")[f"{kind}_{c}"]
    else:
        bound = lambda kind, c: F.lit(fitted[c][kind == "dev"]).cast("double")

    def standard(c: str) -> Column:
        dev = bound("dev", c)
        return (F.col(c) - bound("mean", c)) / F.when(dev == 0, F.lit(1.0)).otherwise(dev)

    return pixels.withColumns({f"Standard_{c}": standard(c) for c in columns}).drop("_moments")
