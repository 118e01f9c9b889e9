"""Summary statistics of several columns at once, with exact quantiles.

One pass makes counts, moments, extremes and, from a mergeable sketch, a bracket of values around each
wanted rank. A second pass counts what lies below each bracket and keeps only what lies inside: a few
thousandths of a large group. The brackets are then known to hold their ranks or not; those of a group
whose sketch was off are opened wide, and that group is passed over once more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropscan.session import stored

from .joins import lookup_join

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}

#: The sketch is off by one in this many ranks at most; brackets reach four times as far.
ACCURACY = 2_000
REACH = 4 / ACCURACY


def numeric_columns(rows: DataFrame, *but: str) -> list[str]:
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def _numbers(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """The group and the columns as v0, v1, ...; NaN is no value."""
    def number(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)

    return rows.filter(F.col(by).isNotNull()).select(
        F.col(by).alias("g"), *(number(c).alias(f"v{i}") for i, c in enumerate(columns)))


def _first_pass(numbers: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    ends = [x for share in shares for x in (max(0.0, share - REACH), min(1.0, share + REACH))]
    parts = []
    for i in range(len(columns)):
        v = f"v{i}"
        parts += [
            F.count(v).alias(f"count{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.percentile_approx(v, ends, ACCURACY).alias(f"ends{i}"),
        ]
    return numbers.groupBy("g").agg(*parts)


def _bracketed(numbers: DataFrame, brackets: DataFrame, columns: int, shares: int) -> DataFrame:
    """(g, c, q, v, n): how often each value inside a bracket occurs, and as null how many lie below it.

    Each column's brackets are sorted out in the task that reads the row; below and equal ones
    combine there, so what is shuffled are the different values inside.
    """
    joined = lookup_join(numbers, brackets, ["g"], spread=[f"v{i}" for i in range(columns)])
    marks = []
    for i in range(columns):
        for q in range(shares):
            v, low, high = F.col(f"v{i}"), F.get(f"ends{i}", F.lit(2 * q)), F.get(f"ends{i}", F.lit(2 * q + 1))
            inside = F.struct(F.lit(i).alias("c"), F.lit(q).alias("q"), F.when(v >= low, v).alias("v"))
            marks.append(F.when(v <= high, inside))
    kept = F.filter(F.array(*marks), lambda m: m.isNotNull())
    return joined.select("g", F.explode(kept).alias("m")).groupBy("g", "m.c", "m.q", "m.v").agg(F.count(F.lit(1)).alias("n"))


def _ranks(counts: DataFrame, sizes: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(g, c, q, place, below, inside): the wanted rank from 0, and how many values the bracket has below and in it."""
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("q") + 1)
    held = counts.groupBy("g", "c", "q").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("inside"))
    return held.join(sizes, ["g", "c"]).withColumn("place", (F.col("size") - 1) * share)


def _at_ranks(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, c, q, quantile): linear between the values at the two ranks around ``place``.

    Values are range-partitioned, so that a bracket of any size is spread over tasks; totals by
    partition tell which ones hold the ranks, and only those are put in order.
    """
    key = ["g", "c", "q"]
    ranged = counts.filter(F.col("v").isNotNull()).repartitionByRange(*key, "v")
    parts = stored(ranged.select(*key, "v", "n", F.spark_partition_id().alias("part")), "bracketed-counts")
    before = Window.partitionBy(*key).orderBy("part")
    totals = parts.groupBy(*key, "part").agg(F.sum("n").alias("n")).withColumn("first", F.sum("n").over(before) - F.col("n"))
    wanted = ranks.select(*key, "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"), "below")
    wanted = wanted.withColumn("at", F.col("rank") - F.col("below"))
    holds = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n"))
    targets = stored(
        totals.join(wanted, key).filter(holds).select(*key, "part", "place", "rank", (F.col("at") - F.col("first")).alias("at")), "wanted-ranks")
    inside = Window.partitionBy(*key, "part").orderBy("v")
    ordered = parts.join(targets.select(*key, "part").distinct(), [*key, "part"], "left_semi").withColumn(
        "first", F.sum("n").over(inside) - F.col("n"))
    found = ordered.join(targets, [*key, "part"]).filter(holds)
    low, high = F.min("v"), F.max("v")
    return found.groupBy(*key).agg((low + (high - low) * (F.max("place") - F.min("rank"))).alias("quantile"))


def describe_all(
    rows: DataFrame, by: str, columns: Sequence[str] | None = None, quantiles: Mapping[str, float] = QUARTILES
) -> DataFrame:
    """One row per group and column: count, mean, std, min, the quantiles and max; all numeric columns by default.

    Null groups are left out; null and NaN are no values, and a column without any has count 0 and nulls. Quantiles
    are exact and linear between neighbours. Rows of one group, and equal values, may be any number.
    """
    columns = list(columns) if columns is not None else numeric_columns(rows, by)
    shares = list(quantiles.values())
    numbers = _numbers(rows, by, columns)
    basics = stored(_first_pass(numbers, columns, shares), "column-statistics")
    brackets = basics.select("g", *(f"ends{i}" for i in range(len(columns))))
    counts = stored(_bracketed(numbers, brackets, len(columns), len(shares)), "brackets")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"count{i}").alias("size")) for i in range(len(columns)))))
    sizes = basics.select("g", each.alias("of")).select("g", "of.*").filter("size > 0")
    ranks = _ranks(counts, sizes, shares)
    off = stored(sizes.join(ranks.filter("floor(place) >= below AND ceil(place) < below + inside").groupBy("g", "c").agg(
        F.count(F.lit(1)).alias("held")), ["g", "c"], "left").filter(F.coalesce("held", F.lit(0)) < len(shares)).select("g").distinct(), "missed-groups")
    if not off.isEmpty():
        wide = F.array(*[F.lit(float("-inf")), F.lit(float("inf"))] * len(shares))
        again = _bracketed(numbers, off.select("g", *(wide.alias(f"ends{i}") for i in range(len(columns)))), len(columns), len(shares))
        counts = stored(counts.join(off, "g", "left_anti").unionByName(again), "brackets")
        ranks = _ranks(counts, sizes, shares)
    found = _at_ranks(counts, ranks).groupBy("g", "c").agg(
        *(F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(name) for q, name in enumerate(quantiles)))
    long = F.explode(F.array(*(
        F.struct(F.lit(i).alias("c"), F.lit(name).alias("column"), *(F.col(f"{s}{i}").alias(s) for s in ("count", "mean", "std", "min", "max")))
        for i, name in enumerate(columns))))
    stats = basics.select("g", long.alias("of")).select("g", "of.*")
    return stats.join(found, ["g", "c"], "left").select(
        F.col("g").alias(by), "column", "count", "mean", "std", "min", *quantiles, "max")
