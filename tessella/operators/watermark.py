"""Additive watermark placed once per tile or once per block of an image."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tessella.operators.tiles import map_blocks

def prepare_mark(rgba: np.ndarray, opacity: float) -> np.ndarray:
    """RGBA picture to RGB premultiplied by opacity and alpha, as 8-bit values."""
    alpha = rgba[..., 3:4].astype(float) / 255.0
    return np.floor(rgba[..., :3] * opacity * alpha).astype(np.uint8)


def draw(image_id: int, by: int, bx: int, which: int) -> float:
    """Repeatable number in 0..1 for a block; the same digest is available in SQL."""
    digest = hashlib.md5(f"{image_id}/{by}/{bx}/{which}".encode()).hexdigest()
    return int(digest[:8], 16) / 4294967296.0


def stamp(block: np.ndarray, mark: np.ndarray, x0: int, y0: int, width: int, height: int, size: int, image_id: int, probability: float) -> np.ndarray:
    """Add the mark to the part of an image that starts at (x0, y0).

    ``size`` is the block side; blocks do not exceed the image, and the mark keeps inside its block.
    """
    h, w, channels = block.shape
    whole = width <= size and height <= size
    side_x, side_y = (width, height) if whole else (size, size)
    factor, top = (256, 65535) if block.dtype == np.uint16 else (1, 255)
    out = block.astype(np.int64)
    for by in range(y0 // side_y, (y0 + h - 1) // side_y + 1):
        for bx in range(x0 // side_x, (x0 + w - 1) // side_x + 1):
            if not draw(image_id, by, bx, 0) < probability:
                continue
            bw, bh = min(side_x, width - bx * side_x), min(side_y, height - by * side_y)
            mh, mw = min(mark.shape[0], bh), min(mark.shape[1], bw)
            dx = int(draw(image_id, by, bx, 1) * (bw - mark.shape[1])) if bw > mark.shape[1] else 0
            dy = int(draw(image_id, by, bx, 2) * (bh - mark.shape[0])) if bh > mark.shape[0] else 0
            left, upper = bx * side_x + dx, by * side_y + dy
            xa, xb = max(left, x0), min(left + mw, x0 + w)
            ya, yb = max(upper, y0), min(upper + mh, y0 + h)
            if xa < xb and ya < yb:
                part = mark[ya - upper : yb - upper, xa - left : xb - left, : min(channels, 3)]
                out[ya - y0 : yb - y0, xa - x0 : xb - x0, : part.shape[2]] += part.astype(np.int64) * factor
    return np.minimum(out, top).astype(block.dtype)


def watermark(tiles: DataFrame, mark: np.ndarray, tile: int, probability: float = 1.0, block: int | None = None) -> DataFrame:
    """Mark tiles that carry img_w, img_h; ``block`` defaults to twice the tile side.  The mark goes to each executor once."""
    size = block or 2 * tile
    shared = tiles.sparkSession.sparkContext.broadcast(mark)
    use = ("image_id", "tx", "ty", "img_w", "img_h")

    def run(b: np.ndarray, r: dict) -> np.ndarray:
        return stamp(b, shared.value, r["tx"] * tile, r["ty"] * tile, r["img_w"], r["img_h"], size, r["image_id"], probability)

    return map_blocks(tiles, run, using=use)


def watermark_tiles(tiles: DataFrame, mark: np.ndarray, probability: float = 1.0) -> DataFrame:
    """Tile jobs: each tile is a picture of its own with one mark."""
    shared = tiles.sparkSession.sparkContext.broadcast(mark)

    def run(b: np.ndarray, r: dict) -> np.ndarray:
        return stamp(b, shared.value, 0, 0, b.shape[1], b.shape[0], max(b.shape[:2]), r["image_id"] * 1_000_003 + r["tile"], probability)

    return map_blocks(tiles, run, using=("image_id", "tile"))
