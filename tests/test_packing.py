import datetime as dt
import json
import os
import pathlib
import subprocess
import sys

import pytest

from cropscan.operators.packing import packed
from cropscan.sources import read_pixels, save_clustered, write_pixels

KINDS = "a TINYINT, b INT, c INT, d DATE, e SMALLINT, f BIGINT, g STRING, h DOUBLE, i BOOLEAN, j INT, `k.x` BIGINT, _word0 INT"
ROWS = [
    (1, -2**31, None, dt.date(1, 1, 1), 5, 2**63 - 1, "a", 1.5, True, 7, 3, 0),
    (None, 2**31 - 1, None, dt.date(9999, 12, 31), 5, -2**63, None, None, None, 7, None, 1),
    (3, 0, None, None, 5, 0, "b", 2.5, False, None, -2**61, None),
]


def unpacked(rows):
    narrow, columns = packed(rows)
    return narrow.select(*(columns[c].alias(c) for c in rows.columns))


def test_packed_rows_come_back_exactly(spark):
    """Extremes, nulls, one value throughout, no value at all, types and ranges that stay as they are."""
    rows = spark.createDataFrame(ROWS, KINDS)
    back = unpacked(rows)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert [c for c in packed(rows)[0].columns if not c.startswith("__word")] == ["f", "g", "h", "i"]
    assert unpacked(rows.limit(0)).count() == 0
    assert unpacked(rows.select("g")).count() == 3
    assert unpacked(rows.select("j").dropna()).collect() == [(7,), (7,)]


def test_rows_that_changed_since_stop_the_query(spark, tmp_path):
    at = tmp_path / "value"

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(at.read_text())], pa.int32())], names=["v"])

    for other in ("8", "-1"):
        at.write_text("7")
        rows = spark.range(1, numPartitions=1).mapInArrow(read, "v INT")
        narrow, columns = packed(rows)
        assert narrow.select(columns["v"]).collect() == [(7,)]
        at.write_text(other)
        with pytest.raises(Exception, match="differs from what it was"):
            narrow.select(columns["v"]).collect()


DAY = dt.date(2017, 1, 1)
PIXEL_KINDS = "tile_x INT, tile_y INT, x INT, y INT, date DATE, mask INT, red INT, green INT, blue INT, B01 INT"
PIXELS = [
    (1, 2, 0, 0, DAY, 0, 1, 2, 3, -2**31), (1, 2, 0, 0, DAY, 0, 1, 2, 3, -2**31), (None, 2, 1, 0, DAY, None, 1, 2, 3, 2**31 - 1),
    (2**31 - 1, -5, 0, 0, None, 0, None, 2, 3, None)]


def test_ranges_keep_nulls_and_far_values(spark, tmp_path):
    rows = spark.createDataFrame(PIXELS, PIXEL_KINDS)
    path = str(tmp_path / "pixels")
    write_pixels(rows, path)
    back = read_pixels(spark, path, PIXEL_KINDS).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_buckets_keep_nulls_and_far_values(spark, tmp_path):
    rows = spark.createDataFrame(PIXELS, PIXEL_KINDS)
    table = save_clustered(rows, "packed_layout", str(tmp_path / "clustered"), 4, ("tile_x", "date"))
    assert sorted(map(str, table.collect())) == sorted(map(str, rows.collect()))
    assert "Exchange" not in table.groupBy("tile_x", "date").count()._jdf.queryExecution().executedPlan().toString()
    assert table.groupBy("tile_x", "date").count().count() == 3
    spark.sql("DROP TABLE packed_layout")


SIZES = """
import glob, sys, time
from pyspark.sql import functions as F
from cropscan.functions.indices import BANDS
from cropscan.session import build_session
from cropscan.sources import save_clustered, write_pixels

run = sys.argv[1]
spark = build_session(2, **{"spark.driver.memory": "1g", "spark.local.dir": f"{run}/local", "spark.sql.warehouse.dir": f"{run}/tables",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{run}/events", "spark.eventLog.compress": "false"})
drawn = lambda name, n: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n)).cast("int").alias(name)
rows = spark.range(200_000, numPartitions=4).select(
    (drawn("tile_x", 16) * 512).cast("int").alias("tile_x"), drawn("tile_y", 100_000), drawn("x", 64), drawn("y", 64),
    F.date_add(F.lit("2017-01-01").cast("date"), drawn("date", 30)).alias("date"), drawn("mask", 2),
    *(drawn(c, 256) for c in ("red", "green", "blue")), *(drawn(b, 3900) for b in BANDS))
if sys.argv[2] == "ranges":
    write_pixels(rows, f"{run}/pixels")
else:
    save_clustered(rows, "sizes", f"{run}/clustered", 8)
until = time.time() + 30
while left := glob.glob(f"{run}/local/**/shuffle_*.data", recursive=True):
    assert time.time() < until, f"shuffle files stay: {left}"
    time.sleep(0.2)
spark.stop()
"""


@pytest.mark.parametrize("layout", ["ranges", "buckets"])
def test_layouts_exchange_narrow_rows_and_leave_no_shuffle_files(tmp_path, layout):
    """Some 75 bytes a pixel were exchanged with a slot for each column."""
    (tmp_path / "events").mkdir()
    (tmp_path / "sizes.py").write_text(SIZES)
    root = str(pathlib.Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, str(tmp_path / "sizes.py"), str(tmp_path), layout], capture_output=True, text=True, timeout=300,
                          env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    written = [
        event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
        for file in (tmp_path / "events").rglob("events_*") for event in map(json.loads, file.read_text().splitlines())
        if event["Event"] == "SparkListenerTaskEnd"]
    assert 200_000 < sum(written) < 200_000 * 50
