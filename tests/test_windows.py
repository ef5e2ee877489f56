"""Kernels inside windows: samples are moved once, as they are stored, and requests are served tiles, not pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import tiles as TI
from tessella.operators.cover import region_cells
from tessella.suite import rendering  # noqa: F401
from tessella.suite.registry import QUERIES
from tests.rasters import image, random_image, tiles

KERNEL = np.arange(25.0).reshape(5, 5) % 4
WINDOWS = [(1, 3, 5, 30, 21, 30, 21), (2, 0, 0, 50, 45, 50, 45), (3, 7, 9, 1, 1, 1, 1), (4, 4, 8, 41, 3, 41, 3), (5, 11, 2, 33, 40, 21, 55)]
half = lambda b, r: b.astype(float) / 2 + 1
smooth = lambda b, r: TI.convolve_block(b, KERNEL)


def asked(spark, flips=False):
    made = spark.createDataFrame(WINDOWS, "k long, src_x int, src_y int, src_w int, src_h int, dst_w int, dst_h int")
    odd = (F.col("k") % 2 == 1) & F.lit(flips)
    return made.withColumns({"flip_x": odd, "flip_y": ~odd & F.lit(flips), "transpose": odd, "step": F.lit(None).cast("int"), "image_id": F.lit(1).cast("long"),
                             "level": F.lit(0), "h_seq": F.lit(0), "v_seq": F.lit(90), "ntx": F.lit(13), "nty": F.lit(12)})


def wanted(spark, windows, stored):
    cells = region_cells(windows, 4, 4).select("k", "tx", "ty", "src_x", "src_y", "src_w", "src_h")
    return cells.join(stored.select("tx", "ty", *TI._SHAPE), ["tx", "ty"])


def through_halo(windows, joined, out_tile):
    """The same by a region of tiles whose borders are read a second time."""
    same = windows.withColumns({"dst_w": F.col("src_w"), "dst_h": F.col("src_h"), "flip_x": F.lit(False), "flip_y": F.lit(False), "transpose": F.lit(False)})
    cut = joined.join(same.select("k", "dst_w", "dst_h", "flip_x", "flip_y", "transpose", "step"), "k")
    region = TI.with_halo(TI.regrid(cut, ["k"], 4, 4, out_tile, out_tile, before=half), 2, ["k"])
    done = TI.map_blocks(region, lambda b, r: smooth(TI.padded(b, r["halo"], 2), r), using=("halo",), drop=("halo",)).drop("out_w", "out_h")
    geometry = windows.withColumns({"src_x": F.lit(0), "src_y": F.lit(0)}).select("k", *TI.GEOMETRY)
    return TI.regrid(done.join(geometry, "k"), ["k"], out_tile, out_tile, out_tile, out_tile)


def rows(out):
    return sorted((r.k, r.tx, r.ty, r.out_w, r.out_h, r.width, r.height, r.bpc, bytes(r.data)) for r in out.collect())


@pytest.mark.parametrize("block", [8, 128])
def test_windows_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(TI, "WINDOW_BLOCK", block)
    a = random_image(21, 45, 50, 2)
    windows = asked(spark).where("dst_w = src_w")
    out = TI.filter_windows(wanted(spark, windows, tiles(spark, a, 4)), windows, ["k"], 4, 4, 6, 2, smooth, before=half).cache()
    for k, x, y, w, h, *_ in WINDOWS[:-1]:
        want = TI.convolve_block(np.pad(half(a[y : y + h, x : x + w], {}), ((2, 2), (2, 2), (0, 0)), mode="edge"), KERNEL)
        assert np.array_equal(image(out.where(f"k = {k}"), 6), want)


@pytest.mark.parametrize("block", [1, 12])
def test_holes_repeats_and_turns_as_by_borders_of_tiles(spark, monkeypatch, block):
    monkeypatch.setattr(TI, "WINDOW_BLOCK", block)
    windows = asked(spark, flips=True)
    stored = tiles(spark, random_image(22, 45, 50, 1), 4)
    holes = stored.where("(tx * 7 + ty * 5) % 6 > 1 AND NOT (tx BETWEEN 3 AND 6 AND ty BETWEEN 2 AND 6)")
    for some in (holes, stored.unionByName(stored.where("tx = 2"))):
        joined = wanted(spark, windows, some)
        got = TI.filter_windows(joined, windows, ["k"], 4, 4, 6, 2, smooth, before=half)
        assert rows(got) == rows(through_halo(windows, joined, 6))
    assert TI.filter_windows(joined.limit(0), windows, ["k"], 4, 4, 6, 2, smooth).count() == 0


def test_requests_are_served_tiles(spark, tmp_path):
    vectors = spark.range(60).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("id") * 7 + i * 5) % 200 / 100.0 - 1).cast("float")).alias("embedding"))
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(5).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("render_regions", "render_regions_convolved"):
        lines = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
        first = lambda word: next(i for i, line in enumerate(lines) if word in line)
        assert first("MapInArrow") < min(first("Join"), first("Exchange"))
