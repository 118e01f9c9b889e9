"""Exact quantiles per group without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropscan.session import stored


def _holds(rank: str) -> Column:
    return F.col(rank).between(F.col("first_rank"), F.col("first_rank") + F.col("size") - 1)


def group_quantiles(
    rows: DataFrame, by: str, value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per ``by``, exact for any group size.

    1. Equal values are counted once, so a value held by many rows becomes one row.
    2. The counts are range-partitioned by group and value and stored with their partition number:
       a large group is spread over partitions by value, small groups share one.
    3. Totals per group and partition tell which partitions hold the wanted ranks, and only
       those parts of the groups are put in order.

    Returns ``by`` and one column per entry of ``quantiles``.
    """
    values = rows.select(by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counts = values.groupBy(by, "v").agg(F.count(F.lit(1)).alias("size"))
    ranged = counts.repartitionByRange(by, "v")
    parts = stored(ranged.select(by, "v", "size", F.spark_partition_id().alias("part")), "ranged-counts")

    # As many rows as there are groups and partitions together, at most.
    in_group = Window.partitionBy(by).orderBy("part")
    totals = (
        parts.groupBy(by, "part")
        .agg(F.sum("size").alias("size"))
        .withColumn("first_rank", F.sum("size").over(in_group) - F.col("size"))
        .withColumn("n", F.sum("size").over(Window.partitionBy(by)))
    )
    asked = F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(share).alias("share"))
        for name, share in quantiles.items()
    ))
    places = (
        totals.select(by, "part", "first_rank", "size", "n", F.explode(asked).alias("asked"))
        .withColumn("place", (F.col("n") - 1) * F.col("asked.share"))
        .withColumn("group_rank", F.explode(F.array_distinct(F.array(
            F.floor("place"), F.ceil("place")
        ))))
    )
    targets = stored(
        places.filter(_holds("group_rank")).select(
            by, "part", F.col("asked.name").alias("name"), "place", "group_rank",
            (F.col("group_rank") - F.col("first_rank")).alias("part_rank"),
        ),
        "wanted-ranks",
    )

    needed = targets.select(by, "part").distinct()
    in_part = Window.partitionBy(by, "part").orderBy("v")
    ordered = parts.join(needed, [by, "part"], "left_semi").withColumn(
        "first_rank", F.sum("size").over(in_part) - F.col("size")
    )
    found = ordered.join(targets, [by, "part"]).filter(_holds("part_rank"))
    low, high = F.min("v"), F.max("v")
    fraction = F.max("place") - F.min("group_rank")
    answers = found.groupBy(by, "name").agg((low + (high - low) * fraction).alias("quantile"))
    return answers.groupBy(by).agg(
        *(F.max(F.when(F.col("name") == name, F.col("quantile"))).alias(name) for name in quantiles)
    )
