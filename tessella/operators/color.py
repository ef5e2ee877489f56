"""Colour and range transforms on tile tables.

A chain of block functions runs in one Arrow pass, so tiles cross to Python once per chain.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import pixelops as P
from tessella.operators.tiles import map_blocks, runs
from tessella.schema import FIXED


def default_range(bpc: Column, sample_type: Column, header_max: Column | None = None) -> Column:
    """Channel maximum when the header has none (or 0)."""
    by_depth = (
        F.when((bpc == 32) & (sample_type == FIXED), 4294967295.0)
        .when(bpc == 32, 1.0)
        .when(bpc > 8, F.when(bpc == 12, 4095.0).otherwise(65535.0))
        .otherwise(255.0)
    )
    return by_depth if header_max is None else F.coalesce(F.nullif(header_max, F.lit(0.0)), by_depth)


def apply_minmax(lo: Column, hi: Column, channel: Column, new_lo: Column, new_hi: Column) -> tuple[Column, Column]:
    """Override the range arrays for one channel, or for all when ``channel`` is '-'.

    A channel that does not exist changes nothing.
    """

    def put(values: Column, new: Column) -> Column:
        number = channel.try_cast("int")
        return F.transform(values, lambda v, i: F.when((channel == "-") | (number == i), new).otherwise(v))

    return put(lo, new_lo), put(hi, new_hi)


def chain(*steps) -> callable:
    """Compose block functions of one argument."""

    def run(block: np.ndarray, row: dict) -> np.ndarray:
        for step in steps:
            block = step(block)
        return block

    return run


def apply(tiles: DataFrame, *steps) -> DataFrame:
    return map_blocks(tiles, chain(*steps))


def normalize(tiles: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Range columns hold one number per channel, or one for all."""
    return map_blocks(tiles, lambda b, r: P.normalize(b, r[lo], r[hi]), using=(lo, hi))


def gamma(tiles: DataFrame, g: float) -> DataFrame:
    return apply(tiles, partial(P.gamma, g=g))


def log_transform(tiles: DataFrame) -> DataFrame:
    return apply(tiles, P.log_transform)


def invert(tiles: DataFrame) -> DataFrame:
    return apply(tiles, P.invert)


def contrast(tiles: DataFrame, c: float) -> DataFrame:
    return apply(tiles, partial(P.contrast, c=c))


def scale_to_8bit(tiles: DataFrame) -> DataFrame:
    return apply(tiles, P.scale_to_8bit)


def colormap(tiles: DataFrame, name: str) -> DataFrame:
    return apply(tiles, partial(P.colormap, name=name))


def hillshade(tiles: DataFrame, h_angle: int, v_angle: int) -> DataFrame:
    return apply(tiles, partial(P.hillshade, h_angle=h_angle, v_angle=v_angle))


def twist(tiles: DataFrame, matrix: list[list[float]]) -> DataFrame:
    return apply(tiles, partial(P.twist, matrix=matrix))


def lab_to_srgb(tiles: DataFrame) -> DataFrame:
    return apply(tiles, P.lab_unpack, P.lab_to_srgb)


def srgb_to_lab(tiles: DataFrame) -> DataFrame:
    return apply(tiles, P.srgb_to_lab)


def greyscale(tiles: DataFrame) -> DataFrame:
    return apply(tiles, P.greyscale)


def flatten(tiles: DataFrame, bands: int) -> DataFrame:
    return apply(tiles, partial(P.flatten, bands=bands))


def triplicate(tiles: DataFrame) -> DataFrame:
    return apply(tiles, P.triplicate)


def unpack_samples(tiles: DataFrame, min_is_white: bool | Column = False) -> DataFrame:
    """Widen packed tiles (``bpc`` 1, 2, 4, 6, 10, 12, 14) to 8 or 16 bit, whatever depths the table mixes.

    ``min_is_white`` is one answer for all tiles or a column with each tile's own; null counts as false.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    names = tiles.columns
    white = min_is_white if isinstance(min_is_white, Column) else F.lit(min_is_white)

    def run(batches):
        for batch in runs(batches):
            depths, blocks = [], []
            for r in batch.select(["width", "height", "channels", "bpc", "data", "_white"]).to_pylist():
                if r["bpc"] in (8, 16, 32, 64):
                    depths.append(r["bpc"])
                    blocks.append(r["data"])
                else:
                    wide = P.unpack_bits(r["data"], r["height"], r["width"], r["channels"], r["bpc"], r["_white"])
                    depths.append(wide.dtype.itemsize * 8)
                    blocks.append(wide.tobytes())
            done = {"bpc": pa.array(depths, pa.int32()), "data": pa.array(blocks, pa.binary())}
            yield pa.RecordBatch.from_arrays([done.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)

    return tiles.withColumn("_white", F.coalesce(white, F.lit(False))).mapInArrow(run, T.StructType(list(tiles.schema)))
