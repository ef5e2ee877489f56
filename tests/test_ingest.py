"""Ingest by a file stream over several deliveries."""

import os
import time

from pyspark.sql import functions as F

from tessella.streaming import ingest


def test_a_later_delivery_with_old_times_is_read(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def deliver(name, days):
        (folder / name).write_bytes(name.encode())
        then = time.time() - days * 86400
        os.utime(folder / name, (then, then))

    def names():
        to_tiles = lambda batch: batch.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(0).alias("level"))
        ingest.ingest_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint"), to_tiles, "*.tif").awaitTermination()
        return sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    deliver("new.tif", 0)
    assert names() == ["new.tif"]
    deliver("next.tif", 0)
    assert names() == ["new.tif", "next.tif"]
    deliver("month.tif", 30)
    deliver("decades.tif", 18_000)
    assert names() == ["decades.tif", "month.tif", "new.tif", "next.tif"]
