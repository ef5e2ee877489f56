"""Reading wanted tiles: curve-ordered stores, key ranges, broadcasts of small key sets, holes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cover
from tessella.plans import render as RE
from tessella.sources import sinks
from tests.rasters import image, random_image, tiles

WINDOW = "1L AS k, 7L AS image_id, 0 AS h_seq, 90 AS v_seq, 0 AS level, 16 AS ntx, 16 AS nty, 20 AS src_x, 36 AS src_y, 17 AS src_w, 9 AS src_h, 17 AS dst_w, 9 AS dst_h, false AS flip_x, false AS flip_y, false AS transpose, cast(null as int) AS step"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """40 images of 16 by 16 tiles in a curve-ordered store, and one of them."""
    pictures = {i: random_image(i, 128, 128) for i in range(40)}
    every = tiles(spark, pictures[0], 8, 0)
    for i in range(1, 40):
        every = every.unionByName(tiles(spark, pictures[i], 8, i))
    folder = str(tmp_path_factory.mktemp("curve") / "store")
    sinks.write_curve_store(every.drop("img_w", "img_h"), folder, row_group=1024)
    return spark.read.parquet(folder), pictures


def rows_of_scan(df):
    """Rows that the file reader hands on, after running the frame."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()) if "Scan parquet" in leaves.apply(i).nodeName())


def test_curve_is_the_morton_key(spark):
    got = {(r.x, r.y): r.k for r in spark.range(0, 1 << 12).selectExpr("int(id % 64) AS x", "int(id div 64) AS y").withColumn("k", cover.curve(F.col("x"), F.col("y"))).collect()}
    for (x, y), key in got.items():
        assert key == sum(((x >> i) & 1) << 2 * i | ((y >> i) & 1) << 2 * i + 1 for i in range(6))
    assert spark.range(1).select(cover.curve(F.lit(2**31 - 1), F.lit(2**31 - 1))).first()[0] == 2**62 - 1


def test_a_region_reads_a_small_part_of_the_level(spark, store):
    table, pictures = store
    regions = spark.sql(f"SELECT {WINDOW}")
    wanted = cover.region_cells(regions, 8, 8).withColumn("curve", cover.curve(F.col("tx"), F.col("ty")))
    read = rows_of_scan(table.where(cover.key_ranges(wanted)))
    assert 0 < read < 0.05 * 40 * 256
    out = cover.get_region(regions, table, ["k"], 8, 8, 64)
    assert (image(out, 64) == pictures[7][36:45, 20:37]).all()


def test_few_keys_leave_the_tiles_where_they_are(spark, store):
    table, _ = store
    cells = cover.region_cells(spark.sql(f"SELECT {WINDOW}"), 8, 8)
    found = cover.join_wanted(cells, table, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    many = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50))))
    spread = cover.join_wanted(many, table, ["k"])
    assert "hashpartitioning" in spread._jdf.queryExecution().executedPlan().toString()
    assert spread.count() == 50 * found.count() == 50 * cells.count()


def test_key_ranges_cover_what_is_wanted_at_every_size(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), int(x)) for a, b, x in zip(rng.integers(0, 3, 900), rng.integers(0, 80, 900), rng.integers(0, 1 << 14, 900), strict=True)]
    wanted = spark.createDataFrame(rows, "level int, image_id long, curve long")
    for limit in (2000, 300, 100, 3):
        assert wanted.where(cover.key_ranges(wanted, limit)).count() == 900
    assert wanted.where(cover.key_ranges(wanted.where("false"))).count() == 0


def test_completeness(spark, store):
    table, _ = store
    regions = spark.sql(f"SELECT {WINDOW} UNION ALL SELECT {WINDOW.replace('1L AS k', '2L AS k').replace('7L', '99L')} UNION ALL SELECT {WINDOW.replace('1L AS k', '3L AS k').replace('16 AS ntx', 'null AS ntx')}")
    holes = table.where("NOT (image_id = 7 AND tx = 3)")
    for source in (holes, holes.drop("curve")):
        got = {r.k: (r.wanted, r.found, r.complete, r.error) for r in cover.completeness(regions, source, ["k"], 8, 8).collect()}
        assert got == {1: (6, 4, False, "2 tiles not found"), 2: (6, 0, False, "no tile found"), 3: (0, 0, False, "level not found")}
    assert [(r.k, r.complete, r.error) for r in cover.completeness(regions.where("k = 1"), table, ["k"], 8, 8).collect()] == [(1, True, None)]


def test_every_tile_request_has_a_row(spark):
    a = random_image(3, 16, 24)
    t = tiles(spark, a, 8).drop("img_w", "img_h").where("tile <> 4")
    levels = spark.createDataFrame([(1, 0, 3, 2)], "image_id long, level int, ntx int, nty int")
    requests = spark.createDataFrame([(1, 0, 90, 0, i) for i in range(8)] + [(2, 0, 90, 0, 0), (1, 0, 90, 5, 0)], "image_id long, h_seq int, v_seq int, level int, tile int")
    ranges = spark.createDataFrame([(1, [0.0], [255.0])], "image_id long, lo array<double>, hi array<double>")
    spaces = spark.createDataFrame([(1, "GREYSCALE")], "image_id long, image_space string")
    out = RE.render_tiles(requests, t, RE.image_statistics(t, ranges, spaces), levels).collect()
    got = {(r.image_id, r.level, r.tile): (r.error, None if r.data is None else bytes(r.data)) for r in out}
    assert len(out) == 10
    for i in (0, 1, 2, 3, 5):
        assert got[1, 0, i] == (None, a[i // 3 * 8 : i // 3 * 8 + 8, i % 3 * 8 : i % 3 * 8 + 8].tobytes())
    assert got[1, 0, 4] == ("tile not found", None)
    assert {got[k][0] for k in ((1, 0, 6), (1, 0, 7))} == {"tile not in the grid"} and got[2, 0, 0][0] == got[1, 5, 0][0] == "level not found"

