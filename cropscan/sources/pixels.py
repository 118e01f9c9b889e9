"""Pixel tables in Parquet."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from cropscan.functions.indices import BANDS
from cropscan.operators.packing import packed
from cropscan.operators.scaling import SCENE
from cropscan.session import no_shuffle_left, settings, stored_for_a_while

PIXEL_SCHEMA = (
    "tile_x INT, tile_y INT, x INT, y INT, date DATE, mask INT, red INT, green INT, blue INT, "
    + ", ".join(f"{band} INT" for band in BANDS)
)


PREDICTION_SCHEMA = "tile_x INT, tile_y INT, date DATE, x INT, y INT, prediction INT"


def read_pixels(spark: SparkSession, path: str, schema: str = PIXEL_SCHEMA) -> DataFrame:
    """Scan a pixel table with a declared schema, so no file is opened to infer one."""
    return spark.read.schema(schema).parquet(path)


#: The exchange of a layout starts with at least so many partitions, of which Spark puts small ones together: their number follows the
#: bytes. With the few that a session may have, what a task sorts would grow with the table. Beyond 200 Spark's map tasks sort their rows too.
LAYOUT_PARTITIONS = 200
_PARTITIONS, _INITIAL = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def write_pixels(pixels: DataFrame, path: str, partition_by: Sequence[str] = ("date",)) -> None:
    """Snappy Parquet, by default one folder per date with the tiles in order inside. It replaces the table at
    ``path``; ``scenes.replace_scenes`` is for single scenes of one.

    Rows are range-partitioned by folder, tile and row of the image, so that a date is spread over
    tasks however large it is, and row-group statistics find a tile. With ``SCENE`` there is one
    folder per scene; the driver lists all of them on reading, so that is for few scenes. What is exchanged and ordered
    are packed rows, of less than half the bytes.
    """
    order = [*partition_by, *(c for c in ("tile_x", "tile_y", "y", "x") if c not in partition_by)]
    conf = pixels.sparkSession.conf
    start = max(LAYOUT_PARTITIONS, int(conf.get(_INITIAL, None) or conf.get(_PARTITIONS)))
    narrow, columns = packed(pixels)
    with settings(pixels.sparkSession, {_INITIAL: str(start)}), no_shuffle_left(pixels.sparkSession):
        ranges = narrow.repartitionByRange(*(columns[c] for c in order))
        rest = [c for c in narrow.columns if c not in order]
        ordered = ranges.select(*(columns[c].alias(c) for c in order), *rest).sortWithinPartitions(*order)
        (
            ordered.select(*(c if c in order else columns[c].alias(c) for c in pixels.columns))
            .write.mode("overwrite")
            .option("compression", "snappy")
            .partitionBy(*partition_by)
            .parquet(path)
        )


def write_predictions(scored: DataFrame, path: str) -> None:
    """The predictions of scored pixels as tile, date, x, y, prediction, laid out like the pixels.

    Partitioning by range runs its input once for a sample and once more for the rows. So the scoring is run once and its narrow
    rows are stored first.
    """
    with stored_for_a_while(scored.select(*SCENE, "x", "y", "prediction"), "predictions") as rows:
        write_pixels(rows, path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_pixels(spark, path, PREDICTION_SCHEMA)


#: Rows that a bucket is to hold: some 160 MB of a full pixel table while it is shuffled.
BUCKET_ROWS = 1 << 21


def bucket_count(rows: DataFrame, least: int = 8, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets for as many rows, so that no task's share grows with the table. This counts them."""
    return max(least, -(-rows.count() // bucket_rows))


def save_clustered(
    pixels: DataFrame, name: str, path: str, buckets: int, keys: Sequence[str] = SCENE
) -> DataFrame:
    """The pixels as table ``name`` under ``path``, bucketed and sorted by ``keys``.

    Rows of equal keys are in one bucket, so grouping or joining on them needs no exchange. By scene, for
    reports: a scene is an image, which bounds its rows. By ``PIXEL``, for pixels and predictions that are painted
    together: tables of as many buckets are joined bucket by bucket. ``bucket_count`` says how many to take. Rows are packed
    while they are exchanged.
    """
    narrow, columns = packed(pixels)
    with no_shuffle_left(pixels.sparkSession):
        (
            narrow.repartition(buckets, *(columns[k] for k in keys)).select(*(columns[c].alias(c) for c in pixels.columns))
            .write.mode("overwrite").option("path", path)
            .bucketBy(buckets, *keys).sortBy(*keys)
            .saveAsTable(name)
        )
    return pixels.sparkSession.table(name)


def rows_to_table(spark: SparkSession, rows: Iterable[Sequence[Any]], schema: str) -> DataFrame:
    """A small in-memory table with a declared schema."""
    return spark.createDataFrame(list(rows), schema)


def scan_table(spark: SparkSession, table: DataFrame) -> DataFrame:
    return spark.sql("SELECT * FROM {table}", table=table)
