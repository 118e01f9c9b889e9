"""Number helpers with the rounding and display rules of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, places: int) -> Column:
    """Scale, round half to even, scale back, all in binary doubles."""
    factor = F.lit(float(10**places))
    return F.rint(value.cast("double") * factor) / factor


def display_number(value: Column, pattern: Column) -> Column:
    """Thousands-grouped text for the patterns '0,0' and '$0,0'; null for any other."""
    grouped = F.format_number(value, 0)
    return F.when(pattern == "0,0", grouped).when(
        pattern == "$0,0", F.concat(F.lit("$"), grouped)
    )
