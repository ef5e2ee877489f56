"""Joins with tables of unknown size: what the plan's own estimate calls small is not broadcast."""

import pytest
from pyspark.sql import functions as F

from tessella import session
from tessella.operators import cover

MANY = session.BROADCAST_ROWS + 1


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def catalogue(spark, rows=MANY):
    """Its estimate, 8 bytes a row, is below Spark's broadcast threshold."""
    return spark.range(rows).select(F.col("id").alias("image_id"), F.lit(1).alias("mtime"))


@pytest.mark.parametrize("copies", [1, 4])
def test_a_large_side_table_is_not_broadcast_by_its_estimate(spark, copies):
    rows = spark.range(100).select((F.col("id") * 5).alias("image_id"), F.col("id").alias("tile"))
    bound = dict(max_rows=250 * copies // session.SALTED, max_bytes=1 << 30)
    out = session.join_side_table(rows, catalogue(spark, 250), ["image_id"], "left", spread_by=["tile"], **bound)
    assert "Broadcast" not in plan(out)
    assert ("_salt" in plan(out)) == (copies > 1)
    assert out.count() == 100 and out.where("mtime = 1").count() == 50


def test_catalogues_are_counted(spark):
    rows = spark.range(1000).select((F.col("id") * 400).alias("image_id"))
    for out, n in (
        (cover.attach_image(rows, catalogue(spark)).where("error IS NULL"), 501),
        (cover.missing_images(rows, catalogue(spark)), 499),
        (cover.missing_tiles(rows, catalogue(spark), ("image_id",)), 499),
    ):
        assert "Broadcast" not in plan(out)
        assert out.count() == n
    few = cover.attach_image(rows, catalogue(spark, 401))
    assert "BroadcastHashJoin" in plan(few) and few.where("error IS NULL").count() == 2


def test_a_wide_catalogue_is_measured(spark):
    wide = catalogue(spark, 100).withColumn("text", F.repeat(F.lit("x"), 1000))
    rows = spark.range(10).select(F.col("id").alias("image_id"))
    assert "BroadcastHashJoin" in plan(session.join_counted(rows, wide, ["image_id"], "left"))
    assert "Broadcast" not in plan(session.join_counted(rows, wide, ["image_id"], "left", max_bytes=50_000))


def test_histograms_go_with_requests_that_equalise(spark):
    from tessella.plans.render import with_ranges

    work = spark.createDataFrame([(1, True), (2, False)], "k int, equalize boolean").selectExpr(
        "*", "array(1L, 2L) AS hist", "array(0D) AS lo", "array(255D) AS hi", "cast(null as string) AS minmax_channel", "cast(null as double) AS minmax_lo", "cast(null as double) AS minmax_hi"
    )
    assert {r.k: r.hist for r in with_ranges(work).collect()} == {1: [1, 2], 2: None}
