"""Daily series: ordering, tallies, precision and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropscan.functions.numbers import round_half_even

from .quantiles import group_quantiles

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def with_date(rows: DataFrame, column: str, name: str = "date") -> DataFrame:
    return rows.withColumn(name, F.to_date(column))


def sorted_series(rows: DataFrame, date: str, *ties: str) -> DataFrame:
    """Rows in date order. The tie columns let the range partitions split a busy date."""
    return rows.orderBy(date, *ties)


def head(rows: DataFrame, count: int, *order: str) -> DataFrame:
    """First rows in a total order, as a top-k that keeps ``count`` rows per task."""
    return rows.orderBy(*order).limit(count)


def _number(value: str) -> Column:
    """The value as double, NaN read as null."""
    number = F.col(value).cast("double")
    return F.when(~F.isnan(number), number)


def describe_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of ``value`` per group.

    Null groups are left out; null and NaN are no values.
    """
    rows = rows.filter(F.col(by).isNotNull()).select(by, _number(value).alias(value))
    basics = rows.groupBy(by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return basics.join(group_quantiles(rows, by, value, QUARTILES), by, "left")


def group_totals(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Group sums as mean times count; null and NaN are no values."""
    number = _number(value)
    return rows.groupBy(by).agg((F.avg(number) * F.count(number)).alias("total"))


def label_table(
    rows: DataFrame, by: str, label: str, labels: Sequence[str], other: str = "Other"
) -> DataFrame:
    """Wide count table: one column per label, and ``other`` for every other label and null."""
    listed = F.coalesce(F.col(label).isin(list(labels)), F.lit(False))
    return rows.groupBy(by).agg(
        *(F.count_if(F.col(label) == name).alias(name) for name in labels),
        F.count_if(~listed).alias(other),
    )


def tally_table(
    tallies: DataFrame, by: str, tally: str, labels: Sequence[str], other: str = "Other"
) -> DataFrame:
    """The same table from rows that already hold a map label -> count; a null map counts nothing."""
    whole = F.aggregate(
        F.coalesce(F.map_values(tally), F.array().cast("array<int>")), F.lit(0).cast("long"),
        lambda n, v: n + F.coalesce(v, F.lit(0)),
    )
    found = [F.coalesce(F.try_element_at(tally, F.lit(n)), F.lit(0)).alias(n) for n in labels]
    wide = tallies.select(by, *found, whole.alias(other))
    listed = sum((F.col(n) for n in labels), F.lit(0))
    return wide.groupBy(by).agg(
        *(F.sum(n).alias(n) for n in labels), F.sum(F.col(other) - listed).alias(other)
    )


def with_precision(
    table: DataFrame, positive: str, labels: Sequence[str], other: str = "Other"
) -> DataFrame:
    """Row total over all labels, listed or not, and the positive share, half-even to 2 places."""
    total = F.lit(0)
    for label in [*labels, other]:
        total = total + F.col(label)
    return table.withColumn("Total", total).withColumn(
        "Precision", round_half_even(F.try_divide(F.col(positive), F.col("Total")), 2)
    )
