"""A tile store in versions: what is read stays as it is while images are added, replaced or taken out.

    store/data/version=7/level=0/...   tiles of the images that version 7 wrote
    store/manifest/7                   one row per image (path, mtime, length, image_id, version): who wrote its tiles last
    store/CURRENT                      the number of the version that readers see

A version writes the tiles of its images only, then a manifest, then moves CURRENT in one step.  A job that dies
before that leaves nothing visible, and the next one writes the same version anew.  One writer at a time; readers are
not blocked and keep the version they began with.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import join_side_table, kept_once
from tessella.sources.storage import locate, qualified, write_path
from tessella.sources.tiff import list_files

c = F.col
MANIFEST = "path string, mtime timestamp, length long, image_id long, version long"


def current_version(spark: SparkSession, store: str) -> int:
    """The version readers see, 0 if there is none yet."""
    where, name = locate(posixpath.join(qualified(spark, store), "CURRENT"))
    if where.get_file_info(name).type.name != "File":
        return 0
    with where.open_input_file(name) as file:
        return int(file.read())


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """One row per image of a version (of the current one): path, mtime, length, image_id, and the version of its tiles."""
    version = current_version(spark, store) if version is None else version
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/{version}")


def read_store(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The tiles of a version: of each image those that its last writer wrote, none of earlier grids.

    Versions without a live image are pruned as partitions; the manifest is broadcast if it is small, else joined with a
    salt from the tile, so that one image with most of the tiles is spread.
    """
    live = manifest(spark, store, version).select("image_id", "version")
    tiles = spark.read.option("basePath", f"{store}/data").parquet(f"{store}/data")
    tiles = tiles.withColumn("version", c("version").cast("long"))
    return join_side_table(tiles, live, ["image_id", "version"], "inner", spread_by=["tile"]).drop("version")


def publish(spark: SparkSession, store: str, tiles: DataFrame, written: DataFrame, kept: DataFrame) -> int:
    """Write ``tiles`` as a new version and make it current.

    ``written`` has the manifest rows (without version) of the images in ``tiles``, ``kept`` those that stay as they are.
    """
    version = current_version(spark, store) + 1
    key = ["level", "image_id", "h_seq", "v_seq", "tile"]
    ordered = tiles.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.write.mode("overwrite").partitionBy("level").parquet(f"{store}/data/version={version}")
    rows = written.withColumn("version", F.lit(version).cast("long")).select(*_names())
    rows.unionByName(kept.select(*_names())).write.mode("overwrite").parquet(f"{store}/manifest/{version}")
    write_path(posixpath.join(qualified(spark, store), "CURRENT"), str(version).encode())
    return version


def _names() -> list[str]:
    return [part.split()[0] for part in MANIFEST.split(", ")]


def replace_images(spark: SparkSession, store: str, tiles: DataFrame) -> int | None:
    """Put ``tiles`` in the place of all tiles of their images; files of other images are not touched.

    Images that are new come in without a path.  Returns the new version, None if there are no tiles.
    """
    images = tiles.select("image_id").distinct()
    before = manifest(spark, store)
    written = images.join(before.drop("version"), "image_id", "left")
    if images.isEmpty():
        return None
    return publish(spark, store, tiles, written, before.join(images, "image_id", "left_anti"))


def ingest_changed(spark: SparkSession, directory: str, store: str, to_tiles: Callable[[DataFrame], DataFrame], pattern: str = "*.tif*") -> int | None:
    """Bring the store up to a folder: files that are new or have another time or length are decoded, images whose file
    is gone leave, all others stay as they are.  Returns the new version, None if nothing has changed.

    ``to_tiles`` maps files (path, mtime, length, image_id) to tiles with that image_id.  The listing is compared with
    the manifest by an anti-join, whatever the times are: a file that comes back older or smaller counts as changed.
    What has changed is written down once, so that tiles and manifest agree if files change meanwhile.
    """
    listing = list_files(spark, directory, pattern).withColumn("image_id", F.xxhash64("path"))
    before = manifest(spark, store)
    same = ["path", "mtime", "length"]
    changed = kept_once(listing.join(before.select(*same), same, "left_anti"))
    kept = before.join(changed, "path", "left_anti").join(listing.select("path"), "path", "left_semi")
    if changed.isEmpty() and kept.count() == before.count():
        return None
    return publish(spark, store, to_tiles(changed), changed, kept)


def follow(spark: SparkSession, directory: str, store: str, to_tiles: Callable[[DataFrame], DataFrame], checkpoint: str, pattern: str = "*.tif*", every: str = "1 minute"):
    """``ingest_changed`` at every trigger of a stream; returns the streaming query."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, number: ingest_changed(spark, directory, store, to_tiles, pattern))
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
