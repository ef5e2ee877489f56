"""Batches are worked on in runs of bounded size; tile counts without an expanded row for every total."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import geometry as G
from tessella.operators import stats
from tessella.operators import tiles as TI
from tessella.operators.tiles import INPUT_BYTES, runs
from tessella.plans import export
from tests import rasters


def test_runs_are_bounded_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([b"x" * 4096] * 10_000)], names=["k", "data"])
    parts = list(runs([batch, batch.slice(0, 0), batch.slice(3, 1)]))
    assert len(parts) > 20 and max(p.nbytes for p in parts) <= INPUT_BYTES
    assert [k for p in parts for k in p.column(0).to_pylist()] == [*range(10_000), 3]


def test_tile_counts_sum_totals_from_totals(spark):
    rows = [(1, 0, 1, 1), (1, 1, 2, 3), (1, 1, 1, 1), (2, 0, 4, 1), (None, 0, 5, 1), (None, None, 1, 2)]
    levels = spark.createDataFrame(rows, "image_id long, level int, ntx int, nty int")
    out = stats.tile_counts(levels)
    want = levels.rollup("image_id", "level").agg(F.sum(F.col("ntx").cast("long") * F.col("nty")).alias("n_tiles"))
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=lambda r: [str(v) for v in r]) == sorted(map(tuple, want.collect()), key=lambda r: [str(v) for v in r])
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert stats.tile_counts(levels.where("false")).count() == 0


def test_tile_paths_go_by_runs_of_tiles(spark, monkeypatch):
    heads = spark.createDataFrame([(1, "a.tif", 1000, 700), (2, "b.tif", 90, 5000)], "image_id long, path string, width int, height int")
    images = G.with_pyramid(heads, 16, 16)
    every = lambda: sorted(map(tuple, export.tile_paths(images).collect()))
    whole = every()
    n = G.level_geometry(images).selectExpr("sum(ntx * nty)").first()[0]
    assert len(whole) == len(set(whole)) == n
    assert all(r[4] == r[3] * ntx + r[2] for r in whole for ntx in [-(-(1000 if r[0] == 1 else 90) // 16)] if r[1] == max(q[1] for q in whole if q[0] == r[0]))
    monkeypatch.setattr(export, "RUN", 7)
    assert every() == whole


def test_texts_of_a_level_are_made_before_its_tiles(spark):
    heads = spark.createDataFrame([(1, "a.tif", 1000, 700), (2, "b.tif", 90, 5000), (3, None, 30, 16)], "image_id long, path string, width int, height int")
    paths = export.tile_paths(G.with_pyramid(heads, 16, 16))
    lines = paths._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert not any(w in line for line in lines[:moved] for w in ("LOG2", "POWER", "pow("))
    assert "REPARTITION_BY_NUM" in lines[moved]  # not joined by size
    assert paths.where("image_id = 3").where("coalesce(deepzoom, zoomify, iiif) IS NOT NULL").count() == 0
    tops = {(r.image_id, r.level): (r.n, r.t) for r in paths.groupBy("image_id", "level").agg(F.count("*").alias("n"), F.sum("tile").alias("t")).collect()}
    assert tops[1, 6] == (63 * 44, 63 * 44 * (63 * 44 - 1) // 2)
    edge = {(r.tx, r.ty): r.iiif for r in paths.where("image_id = 1 AND level = 6 AND tx IN (0, 62) AND ty IN (0, 43)").collect()}
    assert edge == {(x, y): f"a.tif/{x * 16},{y * 16},{w},{h}/{w},/0/default.png" for x, w in ((0, 16), (62, 8)) for y, h in ((0, 16), (43, 12))}


class Caught:
    """Stands in for a tile table and gives the function that `mapInArrow` gets."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_pixels_of_small_tiles_share_batches(spark, monkeypatch):
    table = spark.createDataFrame([], "k long, tx int, ty int, width int, height int, channels int, bpc int, sample_type string, data binary")
    rng = np.random.default_rng(3)
    rows = [(i % 9 if i % 7 else None, i % 5, i // 5, *((3, 2, 1, 16) if i % 3 else (2, 2, 2, 8)), "FIXEDPOINT") for i in range(300)]
    data = [rng.integers(0, 256, w * h * n * bpc // 8).astype("u1").tobytes() for _, _, _, w, h, n, bpc, _ in rows]
    batch = pa.table({n: v for n, v in zip(table.columns, [*zip(*rows), data])}).to_batches()[0]
    run = TI.tiles_to_pixels(Caught(table.schema), 8, 8, keys=("k",))
    want = []
    for (k, tx, ty, w, h, n, bpc, _), d in zip(rows, data):
        block = np.frombuffer(d, "<u2" if bpc == 16 else "u1").reshape(h, w, n)
        want += [(k, ty * 8 + y, tx * 8 + x, b, float(block[y, x, b])) for y in range(h) for x in range(w) for b in range(n)]
    order = lambda r: str(r)
    got = list(run([batch]))
    assert len(got) == 2  # one for each shape
    assert sorted((tuple(r.values()) for g in got for r in g.to_pylist()), key=order) == sorted(want, key=order)
    monkeypatch.setattr(TI, "PIXELS", 100)
    parts = list(run([batch]))
    assert max(p.num_rows for p in parts) <= 100 and sum(p.num_rows for p in parts) == len(want)
    with pytest.raises(ValueError):
        list(run([batch.set_column(8, "data", pa.array([b"x"] * 300))]))


def test_windows_that_keep_their_size_need_no_position_per_sample(monkeypatch):
    rng = np.random.default_rng(4)
    expected, cases = [], []
    for _ in range(500):
        start, cells, win, length, out = (int(v) for v in (rng.integers(0, 30), rng.integers(1, 9), rng.integers(0, 30), rng.integers(0, 30), rng.integers(1, 12)))
        at, source, _ = TI.axis_taps(start, start + cells, win, length, length, None, False) if length else ([], [], [])
        for flip in (False, True):
            pairs = sorted((length - 1 - int(o) if flip else int(o), int(s) - start) for o, s in zip(at, source))
            cases.append((start, cells, win, length, flip, out))
            expected.append(pairs)
    monkeypatch.setattr(TI, "axis_taps", None)
    for case, pairs in zip(cases, expected):
        made = []
        for t, place, cut in TI.axis_cuts(*case):
            cells = range(cut.start, cut.stop)[:: -1 if case[4] else 1]
            made += [(t * case[5] + place + i, s) for i, s in enumerate(cells)]
        assert sorted(made) == pairs
    block = rasters.random_image(5, 8, 8)
    row = {"src_x": 2, "src_y": 3, "src_w": 4, "src_h": 2, "dst_w": 4, "dst_h": 2, "step": None, "flip_x": True, "flip_y": False, "transpose": True}
    (tx, ty, oy, ox, part), = TI._pieces(row, block, 0, 0, 16, 16, False)
    assert (tx, ty, oy, ox) == (0, 0, 0, 0) and (part == block[3:5, 2:6][:, ::-1].transpose(1, 0, 2)).all()
