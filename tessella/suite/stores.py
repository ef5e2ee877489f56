"""Layered TIFF files through the data source, and tile stores in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.operators import tiles as TI
from tessella.sources import sinks as SI
from tessella.sources import tiff as TF
from tessella.streaming import versions as VE
from tessella.suite.files import _folder, _pixels
from tessella.suite.registry import query

c = F.col


def _inverted(tiles: DataFrame) -> DataFrame:
    return TI.map_blocks(tiles, lambda block, row: 255 - block)


def _pictures(tiles: DataFrame, folder: str) -> None:
    """Every image of 16 pixel tiles as one TIFF named by its id."""
    files = SI.encode_pyramids(tiles, fx.TILE).withColumn("file", F.concat(c("image_id").cast("string"), F.lit(".tif")))
    SI.write_files(files, folder).agg(F.sum("bytes")).collect()


def _by_name(df: DataFrame) -> DataFrame:
    return df.withColumn("image_id", F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long"))


def _layered(spark, sf) -> str:
    """Pictures of three levels with two layers, the second one inverted."""
    from tessella.suite.rendering import stored

    tiles = stored(spark, sf)
    folder = _folder(spark, "layers")
    _pictures(tiles.withColumn("h_seq", F.lit(0)).unionByName(_inverted(tiles).withColumn("h_seq", F.lit(1))), folder)
    return folder


@query(
    "tiff_layers",
    """SELECT image_id, h_seq, (y // 4)::int AS y, (x // 4)::int AS x, CASE h_seq WHEN 0 THEN v ELSE 255 - v END AS v
    FROM vec8 JOIN vec_size s USING (image_id), (SELECT unnest([0, 1]) AS h_seq) WHERE y % 4 = 0 AND x % 4 = 0 AND y // 4 < s.h // 4""",
)
def _(spark, sf):
    """The smallest level of all layers, by a filter that the data source takes."""
    tiles = _by_name(TF.tiff_tiles(spark, _layered(spark, sf)).where("level = 0"))
    return TI.tiles_to_pixels(tiles, fx.TILE, fx.TILE, ("image_id", "h_seq")).select("image_id", "h_seq", "y", "x", c("v").cast("int").alias("v"))


@query(
    "tiff_directories",
    """SELECT image_id, h_seq, level, 2 - level AS native_level, 64 >> (2 - level) AS width, h >> (2 - level) AS height, 4 >> (2 - level) AS ntx,
      (((h >> (2 - level)) + 15) // 16)::int AS nty, 'layer ' || h_seq AS name, 1.0::double AS scale
    FROM vec_size, (SELECT unnest([0, 1]) AS h_seq), (SELECT unnest([0, 1, 2]) AS level)""",
)
def _(spark, sf):
    found = _by_name(TF.scan_directories(spark, _layered(spark, sf)))
    return found.select("image_id", "h_seq", "level", "native_level", "width", "height", "ntx", "nty", "name", "scale")


@query("ingest_changed", "SELECT image_id, y, x, c, CASE WHEN image_id % 2 = 0 THEN 255 - v ELSE v END AS v FROM vec8 WHERE image_id % 2 = 1 OR y < 16")
def _(spark, sf):
    """Two deliveries into one folder: pictures with even ids come back inverted and with their first 16 rows only."""
    tiles = fx.vector_tiles(spark, sf, "grey")
    folder, store = _folder(spark, "delivered"), _folder(spark, "store")
    to_tiles = lambda files: TF.read_tiff(files)
    _pictures(tiles, folder)
    VE.ingest_changed(spark, folder, store, to_tiles)
    _pictures(_inverted(tiles.where("image_id % 2 = 0 AND ty = 0")), folder)
    VE.ingest_changed(spark, folder, store, to_tiles)
    return _pixels(_by_name(VE.read_store(spark, store)), fx.TILE)


@query("replace_images", "SELECT image_id, y, x, c, CASE WHEN image_id % 3 = 1 THEN 255 - v ELSE v END AS v FROM vec8 WHERE image_id % 3 <> 1 OR x < 32")
def _(spark, sf):
    """A store whose images 1, 4, ... are replaced by inverted ones of half the width."""
    tiles, store = fx.vector_tiles(spark, sf, "grey"), _folder(spark, "store")
    VE.replace_images(spark, store, tiles)
    VE.replace_images(spark, store, _inverted(tiles.where("image_id % 3 = 1 AND tx < 2")))
    return _pixels(VE.read_store(spark, store), fx.TILE)


@query(
    "encoded_metadata",
    """SELECT image_id, level, CASE WHEN image_id % 2 = 0 THEN 'profile ' || image_id END AS icc, '<x:xmpmeta>' || image_id || '</x:xmpmeta>' AS xmp,
      round((72 + image_id) * (64 >> (2 - level)) / 64.0::double, 4) AS dpi_x, 1 AS dpi_units FROM vec_size, (SELECT unnest([0, 1, 2]) AS level)""",
)
def _(spark, sf):
    """Colour profile, XMP and resolution of written files: one tile of every level, profiles of up to 20 bytes."""
    from tessella.suite.files import _heads
    from tessella.suite.rendering import stored

    profile = F.concat(F.lit("profile "), c("image_id").cast("string"), F.when(c("image_id") % 2 == 1, F.lit(" of many bytes")).otherwise(F.lit("")))
    images = _heads(spark, sf).withColumns(
        {
            "icc": F.encode(profile, "UTF-8"),
            "xmp": F.encode(F.format_string("<x:xmpmeta>%d</x:xmpmeta>", "image_id"), "UTF-8"),
            "colorspace": F.lit("sRGB"), "dpi_x": 72 + c("image_id"), "dpi_y": 72 + c("image_id"), "dpi_units": F.lit(1),
        }
    )
    tiles = SI.with_description(stored(spark, sf).where("tile = 0"), images, max_icc=20, is_region=True)
    folder = _folder(spark, "described")
    SI.save_encoded(tiles.withColumn("file", F.format_string("%d/%d.tif", "level", "image_id")), folder, "tiff")
    found = _by_name(TF.scan_headers(spark, folder))
    text = lambda name: F.decode(name, "UTF-8").alias(name)
    level = F.regexp_extract("path", r"/(\d+)/\d+\.tif$", 1).cast("int").alias("level")
    return found.select("image_id", level, text("icc"), text("xmp"), F.round(c("dpi_x").cast("double"), 4).alias("dpi_x"), "dpi_units")
