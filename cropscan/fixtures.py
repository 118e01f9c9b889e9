"""Crop-imagery views derived from the star-schema test tables, as Spark plans.

``pixel_obs`` turns order lines into pixels: every (order, line) is a cell of a
64 x 64 tile seen on four dates. The other views follow from it or from the
customer, supplier, orders and events tables. Nothing is subset: each view reads
its whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropscan.functions.indices import BANDS
from cropscan.functions.keys import image_key, pixel_table_key
from cropscan.operators.raster import tuple_bands
from cropscan.operators.scaling import SCENE
from cropscan.operators.scenes import COLOUR_IMAGE

SIDE = 64
DATES = 4
FIRST_DATE = "2016-12-22"
IMAGE_THRESHOLD = 4190

# Fixed k-means centres for Scaled_NDVI, LCI, LAI, GNDVI, SCI; cluster 0 is "harvested".
CENTRES = ((0.3, 0.3, 0.5, 0.3, 0.7), (0.5, 0.5, 0.5, 0.5, 0.5), (0.7, 0.7, 0.5, 0.7, 0.3))

# Fixed starts of several fits, with one centre that no pixel is nearest to.
STARTS = (
    CENTRES,
    ((0.1, 0.1, 0.1, 0.1, 0.9), (0.9, 0.9, 0.9, 0.9, 0.1), (9.0, 9.0, 9.0, 9.0, 9.0)),
    ((0.2, 0.8, 0.5, 0.5, 0.5), (0.8, 0.2, 0.5, 0.5, 0.5), (0.5, 0.5, 0.2, 0.8, 0.5)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell: its number p and the seeds of its values. (order, line) repeats."""
    p = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(p.alias("p")).agg(
        F.min("l_partkey").alias("pk"),
        F.min("l_suppkey").alias("sk"),
        F.min("l_quantity").cast("long").alias("q"),
    )


def _place() -> dict[str, Column]:
    return {
        "tile_x": F.expr("CAST(7680 + 512 * (p DIV 4096 % 16) AS INT)"),
        "tile_y": F.expr("CAST(10240 + 512 * (p DIV 4096 DIV 16) AS INT)"),
        "x": F.expr("CAST(p % 64 AS INT)"),
        "y": F.expr("CAST(p DIV 64 % 64 AS INT)"),
    }


def _mask() -> Column:
    dx, dy = F.col("x") - 32, F.col("y") - 32
    return F.when(dx * dx + dy * dy <= 784, 0).otherwise(1)


#: Order lines a task gets when cells are brought together by tile.
TILE_TASK_LINES = 200_000


def _by_tile(spark: SparkSession, sf_dir: str, placed: DataFrame) -> DataFrame:
    """The cells dealt out by tile: four numbers a cell are exchanged, not the wide pixels of every date."""
    lines = table(spark, sf_dir, "lineitem").count()
    parts = max(spark.sparkContext.defaultParallelism, -(-lines // TILE_TASK_LINES))
    return placed.repartition(parts, "tile_x", "tile_y")


def pixel_obs(spark: SparkSession, sf_dir: str, by_tile: bool = False) -> DataFrame:
    """The pixels; ``by_tile`` has all of a tile in one task, so what is gathered by scene is not exchanged again."""
    p, d, q, pk, sk = (F.col(c) for c in ("p", "d", "q", "pk", "sk"))
    cloudy = (p + d) % 11 == 0
    grey = 200 + p % 56
    overcast = F.expr("p DIV 4096 = 0 AND d = 3")  # one scene without a clear pixel

    def colour(a: int, b: int, c: int) -> Column:
        return F.when(overcast, 240).when(cloudy, grey).otherwise((p * a + d * b + q * c) % 256).cast("int")

    def band(k: int) -> Column:
        seed = pk * (7 * k + 3) + sk * (11 * k + 5) + p * (13 * k + 1) + d * (101 * k + 17)
        return (300 + seed % 3900).cast("int")

    placed = _cells(spark, sf_dir).withColumns(_place())
    if by_tile:
        placed = _by_tile(spark, sf_dir, placed)
    days = F.explode(F.sequence(F.lit(0), F.lit(DATES - 1)))
    return placed.withColumn("d", days).select(
        "tile_x", "tile_y", "x", "y",
        F.date_add(F.lit(FIRST_DATE).cast("date"), (d * 10).cast("int")).alias("date"),
        _mask().alias("mask"),
        colour(31, 57, 3).alias("red"),
        colour(17, 91, 5).alias("green"),
        colour(13, 29, 7).alias("blue"),
        *(band(k).alias(name) for k, name in enumerate(BANDS, start=1)),
    )


def mask_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGBA mask pixels per tile: opaque black inside the field, opaque white outside."""
    shade = F.when(_mask() == 0, 0).otherwise(255)
    return _cells(spark, sf_dir).withColumns(_place()).select(
        "tile_x", "tile_y", "x", "y",
        *(shade.alias(c) for c in ("r", "g", "b")), F.lit(255).alias("a"),
    )


def scene_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_x, tile_y, date, band of the images there are.

    The colour image always exists; a band image only if some pixel of the scene
    reaches IMAGE_THRESHOLD in that band, which leaves gaps here and there.
    """
    peaks = pixel_obs(spark, sf_dir).groupBy(*SCENE).agg(*(F.max(b).alias(b) for b in BANDS))
    colour = F.lit(IMAGE_THRESHOLD).alias(COLOUR_IMAGE)
    return (
        peaks.select(*SCENE, colour, *BANDS)
        .unpivot(list(SCENE), [COLOUR_IMAGE, *BANDS], "band", "peak")
        .filter(F.col("peak") >= IMAGE_THRESHOLD)
        .drop("peak")
    )


def scene_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as image file names."""
    keys = image_key(F.col("tile_x"), F.col("tile_y"), F.col("band"), F.col("date"))
    return scene_catalogue(spark, sf_dir).select(keys.alias("key"))


def object_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed object handles of each scene's pixel table in two folders, and of the folders."""
    name = pixel_table_key(F.col("tile_x"), F.col("tile_y"), F.col("date"))
    entries = F.array(
        F.concat(F.lit("img512/"), name), F.concat(F.lit("img32/"), name), F.lit("img512/")
    )
    scenes = pixel_obs(spark, sf_dir).select(*SCENE).distinct()
    return scenes.select(F.explode(entries).alias("entry")).select(
        F.format_string("s3.ObjectSummary(bucket_name='scenes', key='%s')", "entry").alias("key")
    )


COLOUR_FIELDS = ("mask", "red", "green", "blue")


def images(spark: SparkSession, sf_dir: str, fields: Sequence[str]) -> DataFrame:
    """Row-major scene images: width, height and an array of SIDE * SIDE structs of ``fields``.

    Built scan line by scan line; cells without an observation are null. Both
    collected groups are bounded by the image size.
    """
    absent = F.lit(None).cast("struct<" + ",".join(f"{c}:int" for c in fields) + ">")
    across = F.sequence(F.lit(0), F.lit(SIDE - 1))
    lines = (
        pixel_obs(spark, sf_dir, by_tile=True)
        .groupBy(*SCENE, "y")
        .agg(F.map_from_entries(F.collect_list(F.struct("x", F.struct(*fields)))).alias("m"))
        .select(
            *SCENE, "y",
            F.transform(across, lambda x: F.try_element_at("m", x)).alias("line"),
        )
    )
    blank = F.array_repeat(absent, SIDE)
    return (
        lines.groupBy(*SCENE)
        .agg(F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("m"))
        .select(
            *SCENE, F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"),
            F.flatten(
                F.transform(across, lambda y: F.coalesce(F.try_element_at("m", y), blank))
            ).alias("pixels"),
        )
    )


def colour_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tuple image per scene: pixels of (mask, red, green, blue)."""
    return images(spark, sf_dir, COLOUR_FIELDS)


def band_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scalar image per scene and band; every third column of tiles lacks B07."""
    planes = tuple_bands(images(spark, sf_dir, BANDS), BANDS)
    return planes.filter("NOT (band = 'B07' AND tile_x DIV 512 % 3 = 0)")


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images of half the size, for every second column of tiles."""
    half = (F.col("width") / 2).cast("int")
    return colour_images(spark, sf_dir).filter("tile_x DIV 512 % 2 = 1").select(
        *SCENE, half.alias("width"), half.alias("height"), F.lit(COLOUR_IMAGE).alias("band")
    )


def cover_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata text per scene with its cloud cover; every fifth scene's names none."""
    scenes = pixel_obs(spark, sf_dir).groupBy(*SCENE).agg(F.sum("red").alias("seed"))
    cover = F.when(F.col("seed") % 5 != 0, F.col("seed") % 101)
    return scenes.select(*SCENE, F.to_json(F.struct(cover.alias("cloud-cover"), F.lit("L1C").alias("level"))).alias("text"))


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("SEGPAR"),
        F.col("c_name").alias("PLAN"),
        F.col("c_nationkey").alias("nid"),
    )


def lot_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as addresses: most lots have none, and some addresses are unknown."""
    known = F.when(F.col("s_acctbal") >= 0, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("SEGPAR"), known.alias("ADDRESS")
    )


def lot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly order count and whole-number price figures per lot."""
    whole = F.floor("o_totalprice").cast("long")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("SEGPAR"), F.year("o_orderdate").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("sale_price_count"),
            F.max(whole).alias("sale_price_mean"),
            F.min(whole).alias("min_income"),
        )
    )


def lot_geometry() -> Column:
    """A closed square with whole-number corners, placed by the lot number."""
    left = (F.col("SEGPAR") % 360).cast("double")
    low = F.floor(F.col("SEGPAR") / 360).cast("double")
    ring = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    corners = F.array(*(F.array(left + dx, low + dy) for dx, dy in ring))
    return F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates"))
