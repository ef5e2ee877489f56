"""Tile stores in versions: deliveries, replacements, readers of older versions, aborted writers."""

import os
from pathlib import Path

import pytest

from tessella.sources import sinks, tiff
from tessella.streaming import versions
from tests.rasters import image, random_image, tiles

NAMES = ["a.tif", "b.tif", "c.tif"]


def deliver(folder, name, picture, seconds=None):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(sinks.tiff_stack([("x", 1.0, [picture])], 8))
    if seconds is not None:
        os.utime(folder / name, (seconds, seconds))


def shown(spark, store):
    found = versions.read_store(spark, store).cache()
    paths = [r.path for r in found.select("path").distinct().collect()]
    return {p.rsplit("/", 1)[1]: image(found.where(found.path == p), 8) for p in paths}


def files(store):
    return {p: p.stat().st_mtime_ns for p in Path(store, "data").rglob("*.parquet")}


def test_deliveries(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    pictures = {n: random_image(i, 20, 24) for i, n in enumerate(NAMES)}
    for n, p in pictures.items():
        deliver(folder, n, p)
    run = lambda: versions.ingest_changed(spark, str(folder), store, tiff.read_tiff)
    assert run() == 1 and run() is None
    before = files(store)
    pictures["b.tif"] = random_image(7, 9, 9)  # smaller, and older than what it replaces
    deliver(folder, "b.tif", pictures["b.tif"], 1_000_000)
    assert run() == 2
    got = shown(spark, store)
    assert all((got[n] == p).all() for n, p in pictures.items()) and got["b.tif"].shape == (9, 9, 1)
    after = files(store)
    assert all(after[p] == t for p, t in before.items())
    assert {p.parts[-3] for p in after if p not in before} == {"version=2"}
    (folder / "c.tif").unlink()
    assert run() == 3 and set(shown(spark, store)) == {"a.tif", "b.tif"}
    assert set(r.path.rsplit("/", 1)[1] for r in versions.manifest(spark, store, 1).collect()) == set(NAMES)
    assert run() is None


def test_replacing_one_of_many_writes_its_files_only(spark, tmp_path):
    store = str(tmp_path / "store")
    pictures = {i: random_image(i, 16, 16) for i in range(12)}
    every = tiles(spark, pictures[0], 8, 0)
    for i in range(1, 12):
        every = every.unionByName(tiles(spark, pictures[i], 8, i))
    assert versions.replace_images(spark, store, every) == 1
    before, old = files(store), versions.read_store(spark, store)
    pictures[5] = random_image(50, 8, 24)
    assert versions.replace_images(spark, store, tiles(spark, pictures[5], 8, 5)) == 2
    now = versions.read_store(spark, store)
    for i, p in pictures.items():
        assert (image(now.where(now.image_id == i), 8) == p).all()
    assert image(old.where(old.image_id == 5), 8).shape == (16, 16, 1)  # a reader of version 1 still has it
    assert all(files(store)[p] == t for p, t in before.items())
    assert versions.replace_images(spark, store, every.where("image_id = 99")) is None


def test_an_aborted_writer_leaves_nothing_visible(spark, tmp_path):
    store, folder = str(tmp_path / "store"), tmp_path / "in"
    deliver(folder, "a.tif", random_image(1, 16, 16))
    versions.ingest_changed(spark, str(folder), store, tiff.read_tiff)
    deliver(folder, "b.tif", random_image(2, 16, 16))

    def failing(batch):
        from pyspark.sql import functions as F

        return tiff.read_tiff(batch).withColumn("tile", F.raise_error(F.lit("stop")).cast("int"))

    with pytest.raises(Exception, match="stop"):
        versions.ingest_changed(spark, str(folder), store, failing)
    assert versions.current_version(spark, store) == 1 and set(shown(spark, store)) == {"a.tif"}
    assert versions.ingest_changed(spark, str(folder), store, tiff.read_tiff) == 2
    assert set(shown(spark, store)) == {"a.tif", "b.tif"}


def test_a_stream_follows_the_folder(spark, tmp_path):
    import time

    store, folder = str(tmp_path / "store"), tmp_path / "in"
    deliver(folder, "a.tif", random_image(1, 16, 16))
    stream = versions.follow(spark, str(folder), store, tiff.read_tiff, str(tmp_path / "checkpoint"), every="1 second")
    until = time.time() + 60
    while versions.current_version(spark, store) < 1 and time.time() < until:
        time.sleep(0.5)
    deliver(folder, "a.tif", random_image(2, 8, 8))
    while versions.current_version(spark, store) < 2 and time.time() < until:
        time.sleep(0.5)
    stream.stop()
    assert shown(spark, store)["a.tif"].shape == (8, 8, 1)
