"""Whole-image geometry: re-tiling, pyramids, resizing, flips, turns and crops.

All of them are one `regrid`: samples are reduced where the source tile lies and shuffled once as
output-sized pieces.  Image sizes come from a narrow per-image table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.geometry import int_
from tessella.operators.tiles import regrid, whole_image
from tessella.schema import PLANE_KEY
from tessella.session import join_side_table

c = F.col


def sized(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tiles with their image's width and height as img_w, img_h."""
    return join_side_table(tiles, sizes, ["image_id"], "inner", spread_by=["tx", "ty"])


def _finish(out: DataFrame) -> DataFrame:
    return out.withColumnsRenamed({"out_w": "img_w", "out_h": "img_h"})


def _whole(tiles: DataFrame, tile: int, out_tile: int, mode: str = "nearest", **change: Column) -> DataFrame:
    """regrid of tiles with img_w, img_h; ``change`` overrides GEOMETRY columns."""
    geometry = {**whole_image(c("img_w"), c("img_h")), **change}
    return _finish(regrid(tiles.withColumns(geometry), PLANE_KEY, tile, tile, out_tile, out_tile, mode))


def retile(tiles: DataFrame, tile: int, out_tile: int) -> DataFrame:
    return _whole(tiles, tile, out_tile)


def crop(tiles: DataFrame, tile: int, width: int, height: int) -> DataFrame:
    """Top-left part."""
    w, h = int_(F.least(c("img_w"), F.lit(width))), int_(F.least(c("img_h"), F.lit(height)))
    return _whole(tiles, tile, tile, src_w=w, src_h=h, dst_w=w, dst_h=h)


def flip(tiles: DataFrame, tile: int, orientation: int) -> DataFrame:
    """2 turns the image upside down, anything else left to right."""
    change = {"flip_y": F.lit(True)} if orientation == 2 else {"flip_x": F.lit(True)}
    return _whole(tiles, tile, tile, **change)


# A quarter turn is a transposition after mirroring one axis of the source.
TURNS = {90: ("flip_y", "transpose"), 180: ("flip_x", "flip_y"), 270: ("flip_x", "transpose")}


def rotate(tiles: DataFrame, tile: int, angle: int) -> DataFrame:
    """Clockwise by a multiple of 90 degrees; other angles change nothing."""
    steps = TURNS.get(angle % 360, ())
    return _whole(tiles, tile, tile, **{s: F.lit(True) for s in steps}) if steps else tiles


def resize(tiles: DataFrame, tile: int, width: int | Column, height: int | Column, mode: str = "bilinear") -> DataFrame:
    w = width if isinstance(width, Column) else F.lit(width)
    h = height if isinstance(height, Column) else F.lit(height)
    return _whole(tiles, tile, tile, mode, dst_w=int_(w), dst_h=int_(h))


def build_pyramid(tiles: DataFrame, tile: int, rule: str = "floor", include_full: bool = True) -> DataFrame:
    """All smaller levels by pixel skipping, in one pass over the full level.

    Every full-size tile is scanned and decoded once and gives its share of each level (a third of its size in
    all); there is no level-by-level chain.  ``level`` counts up from the smallest.
    """
    from tessella.operators.geometry import pyramid

    levels = F.filter(pyramid(c("img_w"), c("img_h"), F.lit(tile), F.lit(tile), rule), lambda v: (v["width"] > 0) & (v["height"] > 0) & (F.lit(include_full) | (v["native_level"] > 0)))
    step = lambda v: F.pow(F.lit(2.0), v["native_level"]).cast("int").alias("step")
    moves = F.transform(levels, lambda v: F.struct(v["level"].cast("int").alias("level"), step(v), v["width"].cast("int").alias("dst_w"), v["height"].cast("int").alias("dst_h")))
    prepared = tiles.withColumns({**whole_image(c("img_w"), c("img_h")), "level": c("level").cast("int") if "level" in tiles.columns else F.lit(0), "moves": moves})
    return _finish(regrid(prepared, PLANE_KEY, tile, tile, tile, tile, each="moves"))
