"""Keeping tile tables up to date with changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.cover import stale_tiles
from tessella.schema import TILE_KEY
from tessella.session import join_side_table

c = F.col


def changed_since(mtime: Column, since: Column) -> Column:
    """False only when the times agree to the second; equality counts, not order."""
    return ~F.coalesce(F.date_trunc("second", mtime) == since, F.lit(False))


def refresh_tiles(tiles: DataFrame, images: DataFrame, rebuild) -> DataFrame:
    """Tiles of unchanged images, and rebuilt tiles of the stale ones.

    ``rebuild`` makes tiles from a table of image headers and is called with the stale images only.
    """
    stale = stale_tiles(tiles, images).select("image_id").distinct()
    kept = tiles.join(stale, "image_id", "left_anti")
    return kept.unionByName(rebuild(images.join(stale, "image_id", "left_semi")), allowMissingColumns=True)


#: Longer than any file is old: Spark passes over files this much older than the newest one it has seen.
MAX_FILE_AGE = "36500d"
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def ingest_stream(spark: SparkSession, directory: str, table: str, checkpoint: str, to_tiles, pattern: str = "*"):
    """Follow a folder: new files are decoded to tiles and added to the tile table at ``table``.

    ``to_tiles`` maps a batch of binary files to tiles with ``level``.  Each micro-batch is written to
    a folder named by its number, so a batch that is run again replaces its own output.  A file counts as new by its path,
    however old its modification time is; Spark keeps all paths it has seen.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFileAge", MAX_FILE_AGE)
    files = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)

    def write(batch: DataFrame, number: int) -> None:
        to_tiles(batch).write.mode("overwrite").partitionBy("level").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_tiles(spark: SparkSession, table: str) -> DataFrame:
    """The tile table as of now: newest version of every tile over all batches."""
    from tessella.operators.stats import latest_tile

    return latest_tile(spark.read.parquet(table), tuple(TILE_KEY))


def not_modified(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Requests with ``since`` and whether their image must be sent."""
    joined = join_side_table(requests, images.select("image_id", "mtime"), ["image_id"], "left", spread_by=["since"])
    return joined.withColumn("modified", changed_since(c("mtime"), c("since")))
