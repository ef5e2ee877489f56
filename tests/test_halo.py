"""Neighbourhoods by blocks of the grid: results over holes and repeats, and what the plans read and move."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import tiles as TI
from tessella.sources import sinks
from tests.rasters import image, random_image, tiles

KERNEL = [float(i % 4) for i in range(25)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def want(a, kernel=KERNEL):
    side = int(len(kernel) ** 0.5)
    r = side // 2
    return TI.convolve_block(np.pad(a, ((r, r), (r, r), (0, 0)), mode="edge"), np.array(kernel).reshape(side, side))


@pytest.fixture(scope="module")
def raster():
    return random_image(11, 45, 50, 2, "f8")


def test_blocks_of_any_side(spark, raster):
    r = lambda b, row: TI.convolve_block(b, np.array(KERNEL).reshape(5, 5))
    for side in (1, 2, 4, 50):
        got = TI.map_neighbourhoods(tiles(spark, raster, 4), 2, r, side=side)
        assert np.allclose(image(got, 4), want(raster), rtol=0, atol=1e-12)


def test_tiles_are_read_and_moved_once(spark, raster, tmp_path):
    path = str(tmp_path / "tiles")
    tiles(spark, raster, 4).write.parquet(path)
    text = plan(TI.convolve(spark.read.parquet(path), KERNEL))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_bucketed_tiles_stay(spark, raster, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    source = tiles(spark, raster, 4)
    sinks.save_block_table(source, name, reach=2, side=3, buckets=4, path=str(tmp_path))
    got = TI.convolve_table(spark, name, KERNEL)
    text = plan(got)
    assert text.count("FileScan") == 2 and "Exchange" not in text
    assert np.allclose(image(got, 4), want(raster), rtol=0, atol=1e-12)
    small = [1.0] * 9  # the strips are wider than this kernel needs
    assert np.allclose(image(TI.convolve_table(spark, name, small), 4), want(raster, small), rtol=0, atol=1e-12)
    assert set(got.columns) == set(source.columns)
    with pytest.raises(ValueError, match="strips of 2"):
        TI.convolve_table(spark, name, [1.0] * 49)
    kept = lambda t: spark.table(t).agg(F.sum(F.octet_length("data"))).first()[0]
    assert kept(f"{name}_rims") < 4 * kept(name)


def test_holes_repeat_the_nearest_samples(spark):
    """A tile alone, a corner neighbour without edges, and a missing corner between two edges."""
    a = random_image(12, 12, 12, 1, "f8")
    r = lambda b, row: b
    block = lambda x, y: a[y * 4 : y * 4 + 4, x * 4 : x * 4 + 4]

    def middle(*gone):
        left = tiles(spark, a, 4).where(~F.concat_ws(",", "tx", "ty").isin([f"{x},{y}" for x, y in gone]))
        for side in (1, 4):
            row = TI.map_neighbourhoods(left, 1, r, side=side).where("tx = 1 AND ty = 1").first()
            yield np.frombuffer(row.data).reshape(row.height, row.width)

    everything = {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}
    for got in middle(*everything):
        assert (got == np.pad(block(1, 1)[..., 0], 1, mode="edge")).all()
    for got in middle(*(everything - {(0, 0)})):
        assert (got == np.pad(block(1, 1)[..., 0], 1, mode="edge")).all()
    for got in middle((0, 0)):
        around = a[3:9, 3:9, 0].copy()
        around[0, 0] = around[0, 1]
        assert (got == around).all()


def test_repeats_nulls_empty_and_other_columns(spark, raster):
    t = tiles(spark, raster, 8).withColumns({"dxy": F.lit("own"), "strip": F.lit(1)})
    twice = TI.convolve(t.unionByName(t), KERNEL)
    assert twice.count() == 2 * t.count()
    assert twice.distinct().count() == t.count()
    assert [r.dxy for r in twice.select("dxy").distinct().collect()] == ["own"]
    unnamed = TI.convolve(t.withColumn("image_id", F.lit(None).cast("long")), KERNEL)
    assert np.allclose(image(unnamed, 8), want(raster), rtol=0, atol=1e-12)
    assert TI.convolve(t.limit(0), KERNEL).count() == 0


def test_tile_key_joins_leave_a_saved_tile_table_where_it_is(spark, raster):
    name = f"t{uuid.uuid4().hex}"
    sinks.save_tile_table(tiles(spark, raster, 8), name, buckets=4)
    both = spark.table(name).join(spark.table(name).select("image_id", "h_seq", "v_seq", "level", "tile", F.lit(1).alias("one")).hint("merge"), ["image_id", "h_seq", "v_seq", "level", "tile"])
    assert "Exchange" not in plan(both) and both.count() == 42
    spark.sql(f"DROP TABLE {name}")
