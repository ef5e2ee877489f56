"""Tile-form geometry against NumPy on odd sizes, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import resample as R
from tessella.operators import stats
from tessella.operators import tiles as TI
from tests.rasters import image, random_image, tiles

SIZES = [(1, 1), (7, 8), (9, 17), (20, 13)]


@pytest.mark.parametrize("h,w", SIZES)
def test_turns_and_flips(spark, h, w):
    a = random_image(1, h, w, 3)
    t = tiles(spark, a, 8)
    for angle, k in ((90, -1), (180, 2), (270, 1)):
        assert (image(R.rotate(t, 8, angle), 8) == np.rot90(a, k)).all()
    assert (image(R.flip(t, 8, 1), 8) == a[:, ::-1]).all()
    assert (image(R.flip(R.flip(t, 8, 2), 8, 2), 8) == a).all()
    four = t
    for _ in range(4):
        four = R.rotate(four, 8, 90)
    assert (image(four, 8) == a).all()


@pytest.mark.parametrize("h,w", SIZES)
def test_retile_crop_pyramid(spark, h, w):
    a = random_image(2, h, w, 2, "u2")
    t = tiles(spark, a, 8)
    assert (image(R.retile(t, 8, 5), 5) == a).all()
    assert (image(R.crop(t, 8, 6, 4), 8) == a[:4, :6]).all()
    levels = R.build_pyramid(t, 8)
    top = levels.agg(F.max("level")).first()[0]
    for level in range(top + 1):
        step = 2 ** (top - level)
        assert (image(levels.where(F.col("level") == level), 8) == a[::step, ::step][: h // step, : w // step]).all()


@pytest.mark.parametrize("h,w,nh,nw", [(9, 17, 4, 5), (9, 17, 20, 30), (1, 1, 3, 3), (20, 13, 20, 13)])
def test_resize(spark, h, w, nh, nw):
    a = random_image(3, h, w, 1)
    t = tiles(spark, a, 8)
    ys, xs = np.arange(nh) * h // nh, np.arange(nw) * w // nw
    assert (image(R.resize(t, 8, nw, nh, "nearest"), 8) == a[np.ix_(ys, xs)]).all()
    fy, fx = ((np.arange(nh) * h) % nh / nh)[:, None, None], ((np.arange(nw) * w) % nw / nw)[None, :, None]
    y1, x1 = np.minimum(ys + 1, h - 1), np.minimum(xs + 1, w - 1)
    low = a[np.ix_(ys, xs)] * (1 - fx) + a[np.ix_(ys, x1)] * fx
    high = a[np.ix_(y1, xs)] * (1 - fx) + a[np.ix_(y1, x1)] * fx
    assert (image(R.resize(t, 8, nw, nh), 8) == np.floor(low * (1 - fy) + high * fy + 1e-6)).all()


@pytest.mark.parametrize("side", [1, 3, 5])
def test_convolution_ignores_tile_size(spark, side):
    a = random_image(4, 17, 18, 2, "f8")
    kernel = list(np.random.default_rng(side).random(side * side))
    r = side // 2
    want = TI.convolve_block(np.pad(a, ((r, r), (r, r), (0, 0)), mode="edge"), np.array(kernel).reshape(side, side))
    for tile in (4, 8, 16, 32):
        assert np.allclose(image(TI.convolve(tiles(spark, a, tile), kernel), tile), want, rtol=0, atol=1e-12)


def test_identity_kernel_and_counts(spark):
    a = random_image(5, 11, 9, 1)
    t = tiles(spark, a, 4)
    assert (image(TI.convolve(t, [0, 0, 0, 0, 1, 0, 0, 0, 0]), 4) == a).all()
    assert stats.histogram(t).agg(F.sum("n")).first()[0] == a.size


def test_shuffled_side_join_matches_broadcast(spark):
    from tessella.session import join_side_table

    a = random_image(6, 16, 16, 1)
    t = tiles(spark, a, 4).drop("img_w", "img_h")
    side = spark.createDataFrame([(1, 16, 16), (2, 9, 9)], "image_id long, img_w int, img_h int")
    few = join_side_table(t, side, ["image_id"], "inner", spread_by=["tx", "ty"], max_rows=0, spread=4)
    many = join_side_table(t, side, ["image_id"], "inner", spread_by=["tx", "ty"])
    assert sorted(map(tuple, few.drop("data").collect())) == sorted(map(tuple, many.drop("data").select(few.drop("data").columns).collect()))
    assert few.count() == 16


def test_watermark_is_independent_of_tiles(spark):
    from tessella.operators import watermark as W

    a = random_image(7, 21, 30, 3)
    mark = W.prepare_mark(random_image(8, 5, 6, 4), 0.7)
    want = W.stamp(a, mark, 0, 0, 30, 21, 16, 1, 0.5)
    for tile in (4, 7, 40):
        assert (image(W.watermark(tiles(spark, a, tile), mark, tile, 0.5, 16), tile) == want).all()


def test_tile_watermark_keeps_each_tile_whole(spark):
    from tessella.operators import watermark as W

    a = np.zeros((16, 16, 3), np.uint8)
    mark = np.full((2, 3, 3), 9, np.uint8)
    out = image(W.watermark_tiles(tiles(spark, a, 8), mark), 8)
    assert out.sum() == 4 * mark.sum()  # one whole mark in each of the four tiles
    for y in (0, 8):
        for x in (0, 8):
            assert out[y : y + 8, x : x + 8].sum() == mark.sum()
    assert (image(W.watermark_tiles(tiles(spark, a, 8), mark, 0.0), 8) == a).all()


def test_prune_tiles(spark):
    from tessella.operators.cover import prune_tiles

    t = R.build_pyramid(tiles(spark, random_image(9, 20, 20), 8), 8)
    wanted = spark.createDataFrame([(0,), (1,), (1,)], "level int")
    assert {r.level for r in prune_tiles(t, wanted).select("level").distinct().collect()} == {0, 1}


def test_region_reads_only_the_levels_it_needs(spark, tmp_path):
    from tessella.operators.cover import get_region

    stored = R.build_pyramid(tiles(spark, random_image(9, 40, 40), 8), 8).drop("out_w", "out_h")
    stored.write.partitionBy("level").parquet(str(tmp_path / "store"))
    table = spark.read.parquet(str(tmp_path / "store"))
    window = "1L AS k, image_id, h_seq, v_seq, level, 5 AS ntx, 3 AS src_x, 4 AS src_y, 9 AS src_w, 7 AS src_h, 9 AS dst_w, 7 AS dst_h, false AS flip_x, false AS flip_y, false AS transpose, cast(null as int) AS step"
    top = table.agg({"level": "max"}).first()[0]
    regions = table.where(f"level = {top} AND tile = 0").selectExpr(*window.split(", ")).persist()
    out = get_region(regions, table, ["k"], 8, 8, 16)
    assert "dynamicpruning" in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert len(got) == 1 and (got[0].width, got[0].height) == (9, 7)


def test_cover_stays_in_the_grid(spark):
    from pyspark.sql import functions as F

    from tessella.operators.cover import tile_cover

    rows = spark.createDataFrame([(0, 64, 1), (1, 63, 1), (2, 0, 200), (3, 60, 10)], "k int, x int, w int")
    got = tile_cover(rows, F.col("x"), F.lit(0), F.col("w"), F.lit(1), F.lit(16), F.lit(16), F.lit(4), F.lit(4))
    assert sorted((r.k, r.tile) for r in got.collect()) == [(0, 3), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (3, 3)]


def test_latest_tile_keeps_tiles_without_time(spark):
    from tessella.operators.stats import latest_tile

    rows = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (2, 7, "c"), (2, None, "d"), (None, 3, "e"), (None, 4, "f")], "k int, mtime long, data string")
    assert sorted(r.data for r in latest_tile(rows, ("k",)).collect()) == ["a", "c", "f"]


def test_uri_map_has_no_limit(spark):
    from tessella.operators.logs import uri_map

    maps = spark.createDataFrame([(f"p{i}", "IIP") for i in range(3000)] + [("p1/x", "iiif"), ("", "zoomify"), ("q", "ftp"), (None, "iip")], "prefix string, protocol string")
    log = spark.createDataFrame([("/p2999/a?b",), ("/p1/x/y",), ("/other/z",), ("/q/z",), ("p1/a",), (None,), ("/" + "s" * 200_000,)], "uri string")
    got = {r.uri: r.request for r in uri_map(log, maps).collect()}
    assert got["/p2999/a?b"] == "fif=a" and got["/p1/x/y"] == "iiif=y" and got["/other/z"] == "zoomify=other/z"
    assert got["/q/z"] == "zoomify=q/z" and got["p1/a"] == "p1/a" and got[None] is None and len(got["/" + "s" * 200_000]) == 200_008


def test_equal_requests_are_rendered_once(spark):
    from tessella.operators import geometry as G
    from tessella.plans import render as RE

    a = random_image(10, 16, 16)
    t = tiles(spark, a, 8).drop("img_w", "img_h")
    rows = [(i, 1, 0.0, 0.0, 1.0, 1.0, 16, 16, True, True) for i in range(50)]
    schema = "k int, image_id long, rx double, ry double, rw double, rh double, wid int, hei int, maintain_aspect boolean, allow_upscaling boolean"
    heads = G.with_pyramid(spark.createDataFrame([(1, 16, 16)], "image_id long, width int, height int"), 16, 16)
    levels = heads.withColumn("levels", F.transform("levels", lambda v: v.withField("tile_w", F.lit(8)).withField("tile_h", F.lit(8)).withField("ntx", F.lit(2)).withField("nty", F.lit(2))))
    prepared = RE.prepare(G.plan_views(spark.createDataFrame(rows, schema).join(levels, "image_id")))
    ranges = spark.createDataFrame([(1, [0.0], [255.0])], "image_id long, lo array<double>, hi array<double>")
    spaces = spark.createDataFrame([(1, "GREYSCALE")], "image_id long, image_space string")
    out = RE.render_regions(prepared, t, RE.image_statistics(t, ranges, spaces), 8, 32)
    assert out.count() == 1
    assert (image(out, 32) == a).all()
    assert RE.serve(prepared.select("k", "render_key"), out).count() == 50
