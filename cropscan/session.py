"""Session settings and the shared folder every durable intermediate is written to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# The JVM does not compile methods above 8000 bytecodes. Whole-stage code of a wide
# pixel projection can pass that size and then runs interpreted, several times slower;
# with this limit such a stage falls back to smaller generated methods.
JIT_METHOD_LIMIT = "8000"
_METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"


def build_session(cores: int | str = "*", app: str = "cropscan", **conf: str) -> SparkSession:
    """Local session for tests and the bench. On a cluster use the session you are given."""
    threads = os.cpu_count() if cores == "*" else int(cores)
    settings = {
        "spark.sql.shuffle.partitions": str(threads),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        _METHOD_SETTING: JIT_METHOD_LIMIT,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_methods(spark: SparkSession) -> None:
    """The same limit for a session that was made elsewhere. The setting is only ever lowered."""
    if int(spark.conf.get(_METHOD_SETTING, "65535")) > int(JIT_METHOD_LIMIT):
        spark.conf.set(_METHOD_SETTING, JIT_METHOD_LIMIT)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """``values`` as session settings for what runs inside the block; what was set before comes back."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def no_shuffle_left(spark: SparkSession):
    """What runs inside the block deletes its shuffle files at its end; else they stay until the driver happens to collect its garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where none is named, one is made for a local master, as in tests; on a cluster that is an error,
    since every executor would write to its own disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cropscan-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard_intermediates(spark: SparkSession) -> None:
    """Delete what this process wrote under the shared folder; results that read it end with that."""
    while _made:
        delete_path(spark, _made.pop())


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    The blocks live in the shared folder, so losing an executor afterwards does
    not recompute the plan that made them.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is large or read often. ``options`` are the writer's.

    Unlike a cache it outlives executors and takes no executor memory.
    """
    path = path or fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_for_a_while(df: DataFrame, name: str, **options) -> Iterator[DataFrame]:
    """The same, removed at the end of the block: only eager work belongs inside it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    try:
        yield stored(df, name, path, **options)
    finally:
        delete_path(spark, path)
