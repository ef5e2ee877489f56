"""Files written by tasks from the given tables and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.operators import geometry as G
from tessella.operators import tiles as TI
from tessella.plans import export as EX
from tessella.session import shared_dir
from tessella.sources import files as FI
from tessella.sources import sinks as SI
from tessella.sources import tiff as TF
from tessella.suite.registry import query
from tessella.suite.resampling import sizes

c = F.col


def _folder(spark, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _written(spark, tiles: DataFrame, fmt: str, deflate: bool = True) -> str:
    """Every tile as a file named by its key."""
    folder = _folder(spark, fmt)
    name = F.concat_ws("_", c("image_id"), c("tx"), c("ty"))
    encoded = SI.encode_tiles(tiles, "png" if fmt == "png" else "tiff", deflate)
    SI.write_files(encoded.withColumn("file", F.concat(name, F.lit(f".{fmt}"))), folder).agg(F.sum("bytes")).collect()
    return folder


def _named(tiles: DataFrame) -> DataFrame:
    """Image id and place of a read tile from its file name."""
    parts = lambda k: F.regexp_extract("path", r"(\d+)_(\d+)_(\d+)\.[a-z]+$", k)
    return tiles.withColumns({"image_id": parts(1).cast("long"), "tx": parts(2).cast("int"), "ty": parts(3).cast("int")})


def _pixels(tiles: DataFrame, tile: int) -> DataFrame:
    return TI.tiles_to_pixels(tiles, tile, tile).select("image_id", "y", "x", "c", c("v").cast("int").alias("v"))


@query("scan_files", """SELECT format, count(*) AS n FROM (SELECT DISTINCT image_id, x // 16, y // 16 FROM vec8), (SELECT unnest(['TIFF', 'UNSUPPORTED']) AS format) GROUP BY ALL""")
def _(spark, sf):
    tiles = fx.vector_tiles(spark, sf, "grey")
    found = FI.scan_files(spark, _written(spark, tiles, "tif")).unionByName(FI.scan_files(spark, _written(spark, tiles, "png")))
    return found.groupBy("format").agg(F.count("*").alias("n"))


@query("scan_images_png", "SELECT image_id, y, x, c, v FROM rgb")
def _(spark, sf):
    folder = _written(spark, fx.vector_tiles(spark, sf, "rgb"), "png")
    return _pixels(_named(FI.scan_images(spark, folder)), fx.TILE)


@query("scan_images_retiled", "SELECT count(*) AS n, sum(v * (x % 16 % 8 + 1))::bigint AS weighted FROM rgb")
def _(spark, sf):
    folder = _written(spark, fx.vector_tiles(spark, sf, "rgb"), "tif", deflate=False)
    pixels = TI.tiles_to_pixels(FI.scan_images(spark, folder, tile=8), 8, 8)
    return pixels.agg(F.count("*").alias("n"), F.sum((c("v") * (c("x") % 8 + 1)).cast("long")).alias("weighted"))


@query("scan_tiff_16bit", "SELECT image_id, y, x, c, v FROM ord")
def _(spark, sf):
    return _pixels(_named(TF.scan_tiff(spark, _written(spark, fx.order_tiles(spark, sf), "tif"))), fx.ORDERS_TILE)


@query("scan_tiff_float", "SELECT image_id, y, x, c, round(v, 6) + 0.0 AS v FROM vec")
def _(spark, sf):
    tiles = _named(TF.scan_tiff(spark, _written(spark, fx.vector_tiles(spark, sf), "tif", deflate=False)))
    return TI.tiles_to_pixels(tiles, fx.TILE, fx.TILE).select("image_id", "y", "x", "c", (F.round("v", 6) + 0.0).alias("v"))


@query("scan_headers", """SELECT width, height, 3 AS channels, 8 AS bpc, 'sRGB' AS colorspace, 1 AS num_levels, count(*) AS n FROM (
    SELECT least(16, 22 - tx * 16)::int AS width, least(16, h - ty * 16)::int AS height FROM (SELECT DISTINCT image_id, x // 16 AS tx, y // 16 AS ty FROM rgb) JOIN vec_size USING (image_id)) GROUP BY ALL""")
def _(spark, sf):
    found = TF.scan_headers(spark, _written(spark, fx.vector_tiles(spark, sf, "rgb"), "tif"))
    return found.groupBy("width", "height", "channels", "bpc", "colorspace", "num_levels").agg(F.count("*").alias("n"))


@query("write_tiles", "SELECT image_id, y, x, c, v FROM vec8")
def _(spark, sf):
    folder = _folder(spark, "tiles")
    SI.write_tiles(fx.vector_tiles(spark, sf, "grey"), folder)
    return _pixels(spark.read.parquet(folder), fx.TILE)


def _heads(spark, sf) -> DataFrame:
    s = sizes(spark, sf).select("image_id", F.concat(F.lit("img/"), c("image_id").cast("string")).alias("path"), c("img_w").alias("width"), c("img_h").alias("height"))
    return G.with_pyramid(s, fx.TILE, fx.TILE)


@query("export_collection", """SELECT 'img/' || image_id || '_files/' || (lv + deep - 2) || '/' || tx || '_' || ty || '.png' AS file
    FROM (SELECT image_id, lv, w, h, deep, tx, unnest(range(0, (h + 15) // 16)) AS ty FROM (SELECT *, unnest(range(0, (w + 15) // 16)) AS tx FROM (
      SELECT image_id, n AS lv, 64 >> (2 - n) AS w, h >> (2 - n) AS h, ceil(log2(greatest(64, h)))::int AS deep FROM vec_size, (SELECT unnest([0, 1, 2]) AS n))))""")
def _(spark, sf):
    """Every tile of every level as a PNG under its Deep Zoom path."""
    from tessella.suite.rendering import stored

    return EX.export_collection(_heads(spark, sf), stored(spark, sf), _folder(spark, "deepzoom")).where("bytes > 0").select("file")


@query("export_manifests", """SELECT 'img/' || image_id || '.dzi' AS file, length('<Image xmlns="http://schemas.microsoft.com/deepzoom/2008" TileSize="16" Overlap="0" Format="png"><Size Width="64" Height="' || h || '"/></Image>') AS bytes FROM vec_size""")
def _(spark, sf):
    return EX.write_manifests(_heads(spark, sf), _folder(spark, "manifests"))


@query("render_tile_ranges", """SELECT event_id, (ty * 4 + tx)::int AS tile FROM (SELECT event_id, tx, unnest(range(a // 4, b // 4 + 1)) AS ty FROM (
    SELECT event_id, a, b, unnest(range(least(a % 4, b % 4), greatest(a % 4, b % 4) + 1)) AS tx FROM (SELECT event_id, event_id % n AS a, greatest(event_id % n, user_id % n) AS b FROM (SELECT e.*, (h + 15) // 16 * 4 AS n FROM events e JOIN vec_size ON image_id = event_id % (SELECT count(*) FROM vec_size)))))""")
def _(spark, sf):
    from tessella.suite.rendering import count_images, stored

    e = fx.table(spark, sf, "events").withColumn("image_id", c("event_id") % count_images(spark, sf))
    e = e.join(_heads(spark, sf).select("image_id", (F.ceil(c("height") / 16) * 4).alias("n")), "image_id")
    r = e.select("event_id", "image_id", F.lit(2).alias("level"), (c("event_id") % c("n")).cast("int").alias("start_tile"), (c("user_id") % c("n")).cast("int").alias("end_tile"))
    out = EX.render_tile_ranges(r, G.level_geometry(_heads(spark, sf)), stored(spark, sf), _folder(spark, "ranges"))
    return out.where("bytes > 0 AND error IS NULL").select("event_id", "tile")


@query("ingest_stream", "SELECT image_id, y, x, c, v FROM vec8")
def _(spark, sf):
    """A folder followed as a stream; its files become a tile table."""
    from tessella.streaming import ingest as IN

    folder, table = _written(spark, fx.vector_tiles(spark, sf, "grey"), "tif"), _folder(spark, "table")

    def to_tiles(batch: DataFrame) -> DataFrame:
        tiles = _named(TF.read_tiff(batch.select("path", "length"))).drop("path")
        return tiles.withColumns({"tile": c("ty") * 4 + c("tx"), "mtime": F.current_timestamp()})

    IN.ingest_stream(spark, folder, table, f"{table}-checkpoint", to_tiles, "*.tif").awaitTermination()
    return _pixels(IN.latest_tiles(spark, table), fx.TILE)
