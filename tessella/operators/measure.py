"""Reading sample values at points, along lines and through all bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.cover import join_stack
from tessella.operators.tiles import block_of, runs
from tessella.schema import FIXED
from tessella.session import join_side_table

c = F.col
_SPOT = ["image_id", "level", "tile"]


def locate(points: DataFrame, tile_w: int, tile_h: int, ntx: Column) -> DataFrame:
    """Add tile, px, py (place inside the tile) to rows with level coordinates x, y."""
    ty, tx = F.floor(c("y") / tile_h), F.floor(c("x") / tile_w)
    return points.withColumns(
        {
            "tile": (ty * ntx + tx).cast("int"),
            "px": (c("x") % tile_w).cast("int"),
            "py": (c("y") % tile_h).cast("int"),
        }
    )


def sample_tiles(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """(image_id, level, tile, px, py, h_seq, v_seq, c, v, bpc, sample_type) for located points.

    Wanted places are made distinct and gathered per tile first: a sorted array with at most one entry per pixel of
    a tile, however many requests ask for it.  These arrays go to the tiles: by a broadcast of measured size, so that
    tile data stays where it is, else by a shuffle in which the bands of a tile are spread.  Each tile is read once, and
    the values go back to the requests by a join on the place.
    """
    spot = c("py") * F.lit(1 << 16) + c("px")
    per_tile = points.groupBy(*_SPOT).agg(F.sort_array(F.collect_set(spot)).alias("spots"))
    joined = join_side_table(tiles, per_tile, _SPOT, "inner", spread_by=["h_seq", "v_seq"])
    fields = [*_SPOT, "h_seq", "v_seq"]
    types = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = ", ".join(f"{f} {types[f]}" for f in fields) + ", px int, py int, c int, v double, bpc int, sample_type string"
    names = [*fields, "px", "py", "c", "v", "bpc", "sample_type"]
    source = joined.select(*fields, "spots", "width", "height", "channels", "bpc", "sample_type", "data")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            index, xs, ys, cs, vs, depths, kinds = [], [], [], [], [], [], []
            for i, row in enumerate(batch.to_pylist()):
                block = block_of(row)
                h, w, channels = block.shape
                py, px = np.divmod(np.array(row["spots"]), 1 << 16)
                inside = (px < w) & (py < h)
                px, py = px[inside], py[inside]
                values = block[py, px].astype(np.float64)
                n = values.size
                index += [i] * n
                xs.append(np.repeat(px, channels))
                ys.append(np.repeat(py, channels))
                cs.append(np.tile(np.arange(channels), len(px)))
                vs.append(values.reshape(-1))
                depths += [row["bpc"]] * n
                kinds += [row["sample_type"]] * n
            taken = pa.array(index, pa.int64())
            columns = [batch.column(k).take(taken) for k in range(len(fields))]
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
            columns += [flat(xs, pa.int32()), flat(ys, pa.int32()), flat(cs, pa.int32()), flat(vs, pa.float64())]
            columns += [pa.array(depths, pa.int32()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(pick, schema)


def read_points(points: DataFrame, tiles: DataFrame, tile_w: int, tile_h: int, ntx: Column) -> DataFrame:
    """Every band and channel value at each point (image_id, level, x, y and own columns)."""
    located = locate(points, tile_w, tile_h, ntx)
    values = sample_tiles(located, tiles)
    return located.join(values, [*_SPOT, "px", "py"]).drop("tile", "px", "py")


def reflectance(v: Column, bpc: Column, sample_type: Column) -> Column:
    """8 and 16 bit to 0..1; deeper and float samples as they are."""
    scaled = F.when(bpc == 8, v / 255.0).when(bpc == 16, v / 65535.0)
    return F.when(sample_type == FIXED, F.coalesce(scaled, v)).otherwise(v)


def band_positions(values: DataFrame) -> DataFrame:
    """Position of each band among its image's bands (the order a stack lists them in)."""
    from pyspark.sql import Window

    bands = values.select("image_id", "h_seq").distinct()
    order = Window.partitionBy("image_id").orderBy("h_seq")  # one row per band of an image
    return bands.withColumn("pos", F.row_number().over(order) - 1)


def spectrum(points: DataFrame, tiles: DataFrame, images: DataFrame, tile_w: int, tile_h: int, ntx: Column) -> DataFrame:
    """Reflectance through all bands at many points at once, with band names from the stack."""
    values = read_points(points, tiles, tile_w, tile_h, ntx)
    named = join_stack(_with_positions(values, tiles), images)
    return named.withColumn("reflectance", reflectance(c("v"), c("bpc"), c("sample_type"))).drop("pos", "scale")


def _with_positions(values: DataFrame, tiles: DataFrame) -> DataFrame:
    """Position of each value's band among the stored bands of the tile table, not among the rows found."""
    return join_side_table(values, band_positions(tiles), ["image_id", "h_seq"], "inner", spread_by=["x", "y"])


def profile(lines: DataFrame, tiles: DataFrame, images: DataFrame, tile_w: int, tile_h: int, ntx: Column) -> DataFrame:
    """Values along horizontal or vertical lines (x1, y1, x2, y2), all bands and channels, times scale.

    x2 > x1 makes a row, else y2 > y1 a column, else one point; the end is not included.
    """
    across, down = c("x2") > c("x1"), c("y2") > c("y1")
    length = F.when(across, c("x2") - c("x1")).when(down, c("y2") - c("y1")).otherwise(1)
    steps = lines.withColumn("i", F.explode(F.sequence(F.lit(0), length - 1)))
    points = steps.withColumns(
        {"x": c("x1") + F.when(across, c("i")).otherwise(0), "y": c("y1") + F.when(~across & down, c("i")).otherwise(0)}
    )
    values = read_points(points, tiles, tile_w, tile_h, ntx)
    named = join_stack(_with_positions(values, tiles), images)
    return named.withColumn("intensity", c("v") * c("scale")).drop("pos", "v", "scale")


def profile_arrays(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """One array per line, band and channel; its length is that of the line."""
    gathered = profiles.groupBy(*keys, "h_seq", "name", "c").agg(F.array_sort(F.collect_list(F.struct("i", "intensity"))).alias("p"))
    return gathered.select(*keys, "h_seq", "name", "c", c("p.intensity").alias("profile"))


def spectral_cube(points: DataFrame, tiles: DataFrame, tile_w: int, tile_h: int, ntx: Column) -> DataFrame:
    """(image_id, level, x, y, c, spectrum): the vector of all bands at each point."""
    values = read_points(points.select("image_id", "level", "x", "y").distinct(), tiles, tile_w, tile_h, ntx)
    gathered = values.groupBy("image_id", "level", "x", "y", "c").agg(F.array_sort(F.collect_list(F.struct("h_seq", "v"))).alias("s"))
    return gathered.select("image_id", "level", "x", "y", "c", c("s.v").alias("spectrum"))
