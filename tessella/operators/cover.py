"""Joining requests with images, levels and tiles.

Viewports become tile numbers by ``sequence``; after that every join is an equality on the tile key,
which Spark can hash, prune and, on a bucketed tile table, run without moving the tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.geometry import int_
from tessella.operators.tiles import GEOMETRY, regrid
from tessella.schema import TILE_KEY
from tessella.session import BROADCAST_BYTES, BROADCAST_ROWS, join_counted, join_side_table, kept_once

c = F.col


def attach_image(requests: DataFrame, images: DataFrame, on: str = "image_id") -> DataFrame:
    """Headers for requests; ``error`` marks requests for unknown images.

    A catalogue that is counted to be small is broadcast, a large one is hashed, and a header wanted by very many
    requests is split by the skew rule of adaptive execution.
    """
    found = images.withColumn("_found", F.lit(True))
    joined = join_counted(requests, found, [on], "left")
    return joined.withColumn("error", F.when(c("_found").isNull(), "image not found")).drop("_found")


def missing_images(requests: DataFrame, images: DataFrame, on: str = "image_id") -> DataFrame:
    return join_counted(requests, images.select(on), [on], "left_anti")


def attach_level(requests: DataFrame, levels: DataFrame) -> DataFrame:
    return requests.join(levels, ["image_id", "level"])


def tile_cover(regions: DataFrame, left: Column, top: Column, width: Column, height: Column, tile_w: Column, tile_h: Column, ntx: Column, nty: Column | None = None) -> DataFrame:
    """One row per tile of the grid a pixel region touches: tx, ty, tile.  Rows first, then columns of each.

    The grid has ntx (and, if given, nty) tiles; what lies beyond it counts for the border tile, not for a tile of the
    next row.
    """
    border_x = F.greatest(ntx, F.lit(1)) - 1
    first_x, last_x = F.least(F.floor(left / tile_w), border_x), F.least(F.ceil((left + width) / tile_w) - 1, border_x)
    first_y, last_y = F.floor(top / tile_h), F.ceil((top + height) / tile_h) - 1
    if nty is not None:
        first_y, last_y = F.least(first_y, nty - 1), F.least(last_y, nty - 1)
    rows = regions.withColumns({"_fx": int_(first_x), "_lx": int_(last_x), "_ntx": int_(ntx)})
    rows = rows.withColumn("ty", F.explode(F.sequence(int_(first_y), int_(last_y))))
    cells = rows.withColumn("tx", F.explode(F.sequence("_fx", "_lx")))
    return cells.withColumn("tile", c("ty") * c("_ntx") + c("tx")).drop("_fx", "_lx", "_ntx")


def tile_rectangle(ranges: DataFrame, start: Column, end: Column, ntx: Column) -> DataFrame:
    """Tiles of the rectangle between two tile numbers; a missing or smaller end means one tile."""
    last = F.greatest(start, F.coalesce(end, start))
    sx, ex = start % ntx, last % ntx
    rows = ranges.withColumns({"_a": int_(F.least(sx, ex)), "_b": int_(F.greatest(sx, ex)), "_n": int_(ntx)})
    rows = rows.withColumn("ty", F.explode(F.sequence(int_(F.floor(start / ntx)), int_(F.floor(last / ntx)))))
    cells = rows.withColumn("tx", F.explode(F.sequence("_a", "_b")))
    return cells.withColumn("tile", c("ty") * c("_n") + c("tx")).drop("_a", "_b", "_n")


def curve(tx: Column, ty: Column) -> Column:
    """Morton key of a tile: the bits of its column and row in turn, so a square of tiles is a few short runs of keys."""
    bit = lambda value, i, place: F.call_function("shiftleft", F.call_function("shiftright", value, i).bitwiseAND(1).cast("long"), place)
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(0).cast("long"), lambda key, i: key.bitwiseOR(bit(tx, i, i * 2)).bitwiseOR(bit(ty, i, i * 2 + 1)))


def key_ranges(wanted: DataFrame, limit: int = 256) -> Column:
    """A condition on level, image_id and curve that every wanted tile meets: at most ``limit`` ranges of keys.

    ``wanted`` has level, image_id and curve.  Ranges are taken within blocks of 16 by 16 tiles; if these are too many,
    within larger ones, then within images, then over all images.  As a filter with constants it reaches the file reader,
    where it skips what a store ordered by these columns holds elsewhere.
    """
    for shift in (8, 16, 62):
        block = F.call_function("shiftright", c("curve"), F.lit(shift))
        ranges = wanted.groupBy("level", "image_id", block.alias("b")).agg(F.min("curve").alias("lo"), F.max("curve").alias("hi")).limit(limit + 1).collect()
        if len(ranges) <= limit:
            each = [(c("level") == r.level) & (c("image_id") == r.image_id) & c("curve").between(r.lo, r.hi) for r in ranges]
            return _any(each)
    ranges = wanted.groupBy("level").agg(F.min("image_id").alias("lo"), F.max("image_id").alias("hi")).collect()  # one row per level
    return _any([(c("level") == r.level) & c("image_id").between(r.lo, r.hi) for r in ranges])


def _any(conditions: list[Column]) -> Column:
    """Whether one of the conditions holds, as a balanced tree."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def prune_tiles(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keep the levels that ``wanted`` asks for: a table partitioned by level is pruned when the plan runs.

    A level halves its image, so there are at most as many as a size has bits, and their list can be broadcast.
    """
    # the comparison, always true of a level, tells the optimiser that this side is worth pruning by
    return tiles.join(F.broadcast(wanted.where("level >= 0").select("level").distinct()), "level", "left_semi")


#: Tiles of a small set of keys are found by a broadcast of the keys unless each is asked for more often than this.
FAN_OUT = 8


def join_wanted(wanted: DataFrame, tiles: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``wanted`` (plane key, tile, tx, ty and own columns, ``keys`` among them) with the tiles it asks for, where they are.

    The distinct places are written down and measured.  If the wanted rows are few and ask for a tile only a few times,
    they are broadcast and the tiles stay where they are; in a store with a ``curve`` column (sinks.write_curve_store) the
    places become ranges of keys that skip files and row groups.  Else both sides are shuffled, the wanted rows spread by
    tile and request, so that one wide region or one much wanted tile is the work of many tasks.
    """
    on_curve = "curve" in tiles.columns
    grouped = wanted.groupBy(*TILE_KEY, "tx", "ty").agg(F.count("*").alias("n"))
    places = kept_once(grouped.select(*TILE_KEY, curve(c("tx"), c("ty")).alias("curve"), "n"))  # a key per place, not per wanted row
    count, rows = places.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = wanted.drop("tx", "ty")
    small = rows <= min(max_rows, FAN_OUT * count)
    if small:
        size = F.octet_length(F.to_json(F.struct(*[c(f"`{n}`") for n in wanted.columns])))
        small = wanted.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= max_bytes
    source = tiles.where(key_ranges(places)).drop("curve") if on_curve and count <= max_rows else prune_tiles(tiles.drop("curve"), places)
    if small:
        return source.join(F.broadcast(wanted), TILE_KEY)
    slots = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartition(slots, *TILE_KEY, *keys).join(source, TILE_KEY)


def region_cells(regions: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """A row for every tile a region (GEOMETRY columns, ntx and, if there is one, nty) is cut from."""
    # Bilinear weights never reach beyond the window, so the cover is that of the window itself.
    nty = c("nty") if "nty" in regions.columns else None
    return tile_cover(regions, c("src_x"), c("src_y"), c("src_w"), c("src_h"), F.lit(tile_w), F.lit(tile_h), c("ntx"), nty)


def get_region(regions: DataFrame, tiles: DataFrame, keys: list[str], tile_w: int, tile_h: int, out_tile: int, mode: str = "nearest", before=None, using: tuple[str, ...] = ()) -> DataFrame:
    """Cut, and if asked resize, flip and turn, regions out of tile tables; output is tiles again.

    ``regions`` has ``keys``, the plane key, ntx (and nty) and the GEOMETRY columns of tiles.regrid.  Tiles that the store does
    not have are black; `completeness` tells which regions they are in.
    """
    # Only what the cut needs travels with each wanted tile.
    carried = dict.fromkeys([*keys, *TILE_KEY, "tx", "ty", *GEOMETRY, *[u for u in using if u in regions.columns]])
    joined = join_wanted(region_cells(regions, tile_w, tile_h).select(*carried), tiles, keys)
    return regrid(joined, keys, tile_w, tile_h, out_tile, out_tile, mode, before, using)


def completeness(regions: DataFrame, tiles: DataFrame, keys: list[str], tile_w: int, tile_h: int) -> DataFrame:
    """How much of each region the store holds: keys, wanted, found (tiles), complete, error.

    Every region has a row.  Only tile keys are read.  A region without a level (unknown image or level) or without a
    tile is an error, as is one with absent tiles.
    """
    known = regions.where("ntx IS NOT NULL AND src_w > 0 AND src_h > 0")
    cells = region_cells(known, tile_w, tile_h).select(*keys, *TILE_KEY, "tx", "ty")
    # a tile stored in several versions counts once
    stored = tiles.select(*TILE_KEY, *[n for n in ("tx", "ty", "curve") if n in tiles.columns]).dropDuplicates(TILE_KEY).drop("tx", "ty")
    found = join_wanted(cells, stored, keys).groupBy(*keys).agg(F.count("*").alias("found"))
    wanted = cells.groupBy(*keys).agg(F.count("*").alias("wanted"))
    out = regions.select(*keys).distinct().join(wanted, keys, "left").join(found, keys, "left").na.fill(0, ["wanted", "found"])
    error = F.when(c("wanted") == 0, "level not found").when(c("found") == 0, "no tile found").when(c("found") < c("wanted"), F.concat((c("wanted") - c("found")).cast("string"), F.lit(" tiles not found")))
    return out.withColumn("complete", (c("found") == c("wanted")) & (c("wanted") > 0)).withColumn("error", error)


def join_stack(bands: DataFrame, images: DataFrame, position: str = "pos") -> DataFrame:
    """Name and scale of each band by its position in the image's stack.

    The name falls back to the band number, the scale to 1.  The stack stays an array of the header
    row, so the join is on the image alone.
    """
    spread = [n for n in (position, "tile", "x", "y") if n in bands.columns]
    joined = join_side_table(bands, images.select("image_id", "stack"), ["image_id"], "left", spread_by=spread)
    layer = F.get("stack", c(position))
    return joined.withColumns(
        {
            "name": F.coalesce(F.nullif(layer["name"], F.lit("")), c("h_seq").cast("string")),
            "scale": F.coalesce(layer["scale"].cast("double"), F.lit(1.0)),
        }
    ).drop("stack")


def stale_tiles(tiles: DataFrame, images: DataFrame) -> DataFrame:
    """Stored tiles whose time differs from their image's; headers only, without tile data."""
    header = images.select("image_id", c("mtime").alias("image_mtime"))
    return join_side_table(tiles.drop("data"), header, ["image_id"], "inner", spread_by=["tile"]).where("mtime <> image_mtime")


def missing_tiles(wanted: DataFrame, tiles: DataFrame, key: tuple[str, ...] = tuple(TILE_KEY)) -> DataFrame:
    """Wanted keys that the tile table does not have.  Its keys are broadcast only if they are counted to be few."""
    return join_counted(wanted, tiles.select(*key), [*key], "left_anti")
