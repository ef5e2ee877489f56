"""Tile ranges: every tile encoded once, every request answered."""

import os

import pytest
from pyspark.sql import functions as F

from tessella import session
from tessella.plans import export
from tests.rasters import random_image, tiles

LEVELS = "image_id long, level int, ntx int"
REQUESTS = "image_id long, level int, start_tile int, end_tile int, k int, file_no string"


def served(spark, tmp_path, requests, gone=()):
    store = tiles(spark, random_image(3, 12, 16), 4).where(~F.col("tile").isin(*gone) if gone else F.lit(True))
    out = export.render_tile_ranges(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame([(1, 0, 4)], LEVELS), store, str(tmp_path))
    return out.select("k", "tile", "file", "bytes", "error").collect()


@pytest.mark.parametrize("broadcast", [True, False])
def test_popular_tiles_are_one_file(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(session.join_side_table, "__defaults__", ("left", None, 0, 4, 0))
    rows = served(spark, tmp_path, [(1, 0, 1, 6, k, "x") for k in range(50)])
    assert len(rows) == 50 * 4 and {r.tile for r in rows} == {1, 2, 5, 6}
    files = {r.file for r in rows}
    assert len(files) == 4 and all(os.path.getsize(tmp_path / f) == n for f, n in {(r.file, r.bytes) for r in rows})


def test_every_request_has_a_row(spark, tmp_path):
    requests = [(1, 0, 0, 5, 0, None), (1, 9, 0, 5, 1, None), (2, 0, 0, None, 2, None), (1, 0, None, 5, 3, None), (1, 0, 7, None, 4, "a"), (1, 0, 7, None, 4, "a"), (None, 0, 1, 1, 5, None), (1, 0, -1, 1, 6, None)]
    rows = served(spark, tmp_path, requests, gone=(4,))
    by = lambda k: sorted((r.tile, r.error) for r in rows if r.k == k)
    assert by(0) == [(0, None), (1, None), (4, "no such tile"), (5, None)]
    assert by(1) == by(2) == by(5) == [(None, "no such level")]
    assert by(3) == by(6) == [(None, "no such tile")]
    assert by(4) == [(7, None), (7, None)]


def test_nothing_asked(spark, tmp_path):
    assert served(spark, tmp_path, []) == []
