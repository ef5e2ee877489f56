"""Branches of a rendering batch, statistics on demand, pyramids from one decode, measurements without moving tiles."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import geometry as G
from tessella.operators import measure as M
from tessella.operators import resample as R
from tessella.plans import render as RE
from tests.rasters import image, random_image, tiles

REQUEST = "k int, image_id long, rx double, ry double, rw double, rh double, wid int, hei int, maintain_aspect boolean, allow_upscaling boolean, contrast double, equalize boolean"


def batch(spark, rows, size=32, tile=8):
    heads = G.with_pyramid(spark.createDataFrame([(1, size, size)], "image_id long, width int, height int"), tile, tile)
    return RE.prepare(G.plan_views(spark.createDataFrame(rows, REQUEST).join(heads, "image_id")))


def sides(spark):
    ranges = spark.createDataFrame([(1, [0.0], [255.0])], "image_id long, lo array<double>, hi array<double>")
    return ranges, spark.createDataFrame([(1, "GREYSCALE")], "image_id long, image_space string")


def test_plain_tiles_go_through_as_stored(spark):
    a = random_image(1, 32, 32)
    t = R.build_pyramid(tiles(spark, a, 8), 8)
    whole = (0.25, 0.5, 0.25, 0.25, 8, 8, True, True)
    rows = [(1, 1, *whole, 1.0, False), (2, 1, *whole, 2.0, False), (3, 1, 0.25, 0.5, 0.25, 0.25, 5, 5, True, True, 1.0, False), (4, 1, 0.1, 0.5, 0.25, 0.25, 8, 8, True, True, 1.0, False)]
    prepared = batch(spark, rows)
    assert {r.k for r in prepared.where(RE.is_plain_tile(8)).collect()} == {1}
    ranges, spaces = sides(spark)
    out = RE.render_regions(prepared, t, RE.statistics_for(prepared, t, ranges, spaces), 8, 16)
    got = {r.k: r for r in RE.serve(prepared.select("k", "render_key"), out).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert bytes(got[1].data) == a[16:24, 8:16].tobytes() and (got[1].out_w, got[1].out_h, got[1].tile) == (8, 8, 0)
    assert bytes(got[2].data) != bytes(got[1].data) and got[3].width == 5
    narrow = prepared.where("k = 1").select("render_key", "image_id", "h_seq", "v_seq", "level", "lv_width", "lv_height", *RE.GEOMETRY, *RE.OPS)
    only = RE._plain_tiles(narrow.withColumns({"lo": F.array(F.lit(0.0)), "hi": F.array(F.lit(255.0)), "image_space": F.lit("GREYSCALE"), "bin_lo": F.lit(0), "bin_hi": F.lit(0), "threshold": F.lit(0), "hist": F.array(F.lit(0))}), t, ["render_key"], 8)
    assert [bytes(r.data) for r in only.collect()] == [a[16:24, 8:16].tobytes()]


def test_plain_tiles_of_other_kinds_take_the_steps(spark):
    a = random_image(2, 32, 32, 1, "u2")
    t = tiles(spark, a, 8).withColumn("level", F.lit(2))
    prepared = batch(spark, [(1, 1, 0.0, 0.0, 0.25, 0.25, 8, 8, True, True, 1.0, False)])
    ranges, spaces = sides(spark)
    out = RE.render_regions(prepared, t, RE.statistics_for(prepared, t, ranges, spaces), 8, 16).collect()
    assert len(out) == 1 and bytes(out[0].data) == (a[:8, :8] >> 8).astype(np.uint8).tobytes()


def test_no_histogram_without_need(spark):
    t = R.build_pyramid(tiles(spark, random_image(3, 32, 32), 8), 8)
    ranges, spaces = sides(spark)
    view = (0.1, 0.2, 0.5, 0.5, 8, 8, True, True)
    plain = RE.statistics_for(batch(spark, [(1, 1, *view, 2.0, False)]), t, ranges, spaces)
    assert "MapInArrow" not in plain._jdf.queryExecution().optimizedPlan().toString() and plain.first().hist is None
    for row in ((1, 1, *view, -1.0, False), (1, 1, *view, 1.0, True)):
        asked = RE.statistics_for(batch(spark, [row]), t, ranges, spaces)
        assert asked.first() == RE.image_statistics(t, ranges, spaces).select(*asked.columns).first()


def test_pyramid_decodes_a_tile_once(spark):
    a = random_image(4, 70, 50, 3)
    out = R.build_pyramid(tiles(spark, a, 8), 8)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    levels = out.select("level").distinct().count()
    for level in range(levels):
        step = 1 << (levels - 1 - level)
        want = a[::step, ::step][: 70 // step, : 50 // step]
        assert (image(out.where(f"level = {level}"), 8) == want).all()
    smaller = R.build_pyramid(tiles(spark, a, 8), 8, include_full=False)
    assert smaller.select("level").distinct().count() == levels - 1


def test_measurements_leave_tiles_where_they_are(spark, tmp_path):
    bands = [random_image(10 + b, 20, 20) for b in range(5)]
    every = tiles(spark, bands[0], 8).withColumn("h_seq", F.lit(0))
    for b in range(1, 5):
        every = every.unionByName(tiles(spark, bands[b], 8).withColumn("h_seq", F.lit(3 * b)))
    every.drop("img_w", "img_h").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    images = spark.createDataFrame([(1, [("a", 2.0), ("b", 1.0), ("c", 1.0), ("d", 1.0), ("e", 1.0)])], "image_id long, stack array<struct<name:string,scale:float>>")
    points = spark.createDataFrame([(i, 1, 0, i % 20, i * 7 % 20) for i in range(60)], "p int, image_id long, level int, x int, y int")
    out = M.spectrum(points, stored, images, 8, 8, F.lit(3))
    source = M.sample_tiles(M.locate(points, 8, 8, F.lit(3)), stored)
    plan = source._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    got = {(r.p, r.name): r.reflectance for r in out.collect()}
    assert len(got) == 300
    for i in range(60):
        for b, name in enumerate("abcde"):
            assert got[i, name] == bands[b][i * 7 % 20, i % 20, 0] / 255.0
