"""Static tile sets: every tile of every level under the paths that tile clients ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import catalog as B
from tessella.operators import geometry as G

c = F.col

#: Tiles of a level that are the work of one row of `tile_paths` before it is exploded.
RUN = 4096


def tile_paths(images: DataFrame, ext: str = "png") -> DataFrame:
    """One row per tile with its Deep Zoom, Zoomify and IIIF path.

    Levels are exploded first, and runs of up to ``RUN`` tiles of them spread over the cluster, then the tiles of a run; a
    single very large image is not the work of one task, and a small level is moved as one row.  The texts that all tiles of
    a level have in common are made before the runs are moved, which keeps them from being made for every tile.  The number
    of partitions is the session's: a run is a few bytes and stands for many tiles, so sizes do not tell how many are needed.
    """
    shape = ("native_level", "width", "height", "tile_w", "tile_h", "ntx", "nty")
    head = images.select(
        "image_id", "path", "width", "height", F.size("levels").alias("_n"),
        "levels", G.zoomify_discard(c("levels")).alias("_discard"), F.explode("levels").alias("lv"),
    )
    smaller = F.filter("levels", lambda v: (v["level"] < c("lv.level")) & (v["level"] >= c("_discard")))
    before = F.aggregate(smaller, F.lit(0).cast("long"), lambda n, v: n + v["ntx"].cast("long") * v["nty"])
    head = head.withColumns({"_before": before, "level": c("lv.level"), **{f"_{k}": c(f"lv.{k}") for k in shape}}).drop("levels", "lv")
    head = head.where("_ntx > 0 AND _nty > 0").withColumn("_last", c("_ntx").cast("long") * c("_nty") - 1)
    level = {k: c(f"_{k}") for k in shape}
    across, down = B.iiif_steps(level)
    common = {
        "_across": across, "_down": down, "_inner": B.iiif_inner(level, ext),
        "_folder": B.deepzoom_folder(c("level"), c("width"), c("height"), c("_n")), "_shown": B.zoomify_level(c("level"), c("_discard")),
    }
    runs = head.withColumns(common).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(c("_last") / RUN))))
    rows = runs.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "level", "_run")
    cells = rows.withColumn("_tile", F.explode(F.sequence(c("_run") * RUN, F.least(c("_last"), (c("_run") + 1) * RUN - 1))))
    cells = cells.withColumns({"tx": (c("_tile") % c("_ntx")).cast("int"), "ty": F.expr("int(_tile div _ntx)")})
    return cells.select(
        "image_id", "level", "tx", "ty",
        (c("ty") * c("_ntx") + c("tx")).alias("tile"),
        B.deepzoom_path(c("level"), c("tx"), c("ty"), c("width"), c("height"), c("_n"), ext, c("_folder")).alias("deepzoom"),
        B.zoomify_path(c("level"), c("tx"), c("ty"), c("_discard"), c("_before") + c("_tile"), ext, c("_shown")).alias("zoomify"),
        B.iiif_path(level, c("tx"), c("ty"), ext, (c("_across"), c("_down")), c("_inner")).alias("iiif"),
    )


def export_collection(images: DataFrame, tiles: DataFrame, directory: str, layout: str = "deepzoom", ext: str = "png") -> DataFrame:
    """Write every tile of every level under its client path; returns (file, bytes).

    The tile table is joined on its key, so the work is spread by tile, not by image.
    """
    from tessella.sources.sinks import encode_tiles, write_files

    paths = tile_paths(images, ext).select("image_id", "level", "tile", c(layout).alias("file"))
    joined = tiles.join(paths, ["image_id", "level", "tile"])
    return write_files(encode_tiles(joined, ext), directory)


def write_manifests(images: DataFrame, directory: str, layout: str = "deepzoom", base: str = "", ext: str = "png") -> DataFrame:
    """Write the manifest of each image beside its tiles, whose files end in ``ext``; returns (file, bytes)."""
    from tessella.sources.sinks import write_files

    text = {
        "deepzoom": (F.concat(c("path"), F.lit(".dzi")), B.deepzoom_manifest(ext)),
        "zoomify": (F.concat(c("path"), F.lit("/ImageProperties.xml")), B.zoomify_manifest()),
        "iiif": (F.concat(c("path"), F.lit("/info.json")), B.iiif_info(base)),
    }
    name, body = text[layout]
    return write_files(images.select(name.alias("file"), F.encode(body, "UTF-8").alias("encoded")), directory)


def render_tile_ranges(requests: DataFrame, levels: DataFrame, tiles: DataFrame, directory: str, fmt: str = "png") -> DataFrame:
    """Encoded tiles of rectangles between two tile numbers: each wanted tile is encoded and written once, and requests get
    the name of its file, so no bytes travel with them.

    ``requests`` have image_id, level, start_tile, end_tile and own columns (see logs.tile_commands).  The result has them
    with tile, tx, ty, h_seq, v_seq, file, bytes and error, a row for each tile (and plane of it) that is asked for.  A
    tile the store does not have, a level that does not exist and a rectangle without a first tile are a row with an ``error``
    and without file.  Repeated requests keep all their rows.
    """
    from tessella.operators.cover import tile_rectangle
    from tessella.session import join_side_table
    from tessella.sources.sinks import encode_tiles, write_files

    key = ["image_id", "level", "tile"]
    # Everything that can be hashed spreads the requests of a popular image or tile.
    spread = [f.name for f in requests.schema if f.dataType.typeName() not in ("map", "variant")]
    sized = join_side_table(requests, levels.select("image_id", "level", "ntx"), ["image_id", "level"], "left", spread_by=spread)
    known = (c("ntx") > 0) & (c("start_tile") >= 0)
    cells = tile_rectangle(sized.where(known), c("start_tile"), c("end_tile"), c("ntx")).drop("ntx")
    wanted = join_side_table(tiles, cells.select(*key).distinct(), key, "left_semi", spread_by=["h_seq", "v_seq"])
    named = wanted.withColumn("file", F.concat_ws("/", "image_id", F.concat_ws("_", "h_seq", "v_seq"), "level", F.concat("tile", F.lit(f".{fmt}"))))
    written = write_files(encode_tiles(named, fmt), directory)
    part = F.split("file", "[/_.]")
    files = written.select(
        part[0].cast("long").alias("image_id"), part[3].cast("int").alias("level"), part[4].cast("int").alias("tile"),
        part[1].cast("int").alias("h_seq"), part[2].cast("int").alias("v_seq"), "file", "bytes",
    )
    served = join_side_table(cells, files.distinct(), key, "left", spread_by=spread)
    served = served.withColumn("error", F.when(c("file").isNull(), F.lit("no such tile")))
    reason = F.when(c("ntx").isNull(), F.lit("no such level")).otherwise(F.lit("no such tile"))
    none = sized.where(~F.coalesce(known, F.lit(False))).withColumn("error", reason).drop("ntx")
    return served.unionByName(none, allowMissingColumns=True)
