"""Encoded files by the data source: metadata comes back, a job that fails leaves nothing."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.sources import sinks, tiff
from tests.rasters import image, random_image, tiles


def chunks(data):
    """Chunks of a PNG; their checksums must be right."""
    at, out = 8, {}
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        out[kind.decode()] = body
        at += 12 + size
    return out


def described(spark, a, **columns):
    t = tiles(spark, a, 8).withColumn("file", F.format_string("sub/%d.bin", "tile"))
    return t.withColumns({k: F.lit(v) for k, v in columns.items()})


def test_tiff_metadata_comes_back(spark, tmp_path):
    a = random_image(1, 8, 8, 3)
    profile, xmp = bytes(range(256)) * 3, "<x:xmpmeta>ü</x:xmpmeta>".encode()
    out = tmp_path / "out"
    sinks.save_encoded(described(spark, a, icc=profile, xmp=xmp, dpi_x=300.5, dpi_y=150.0, dpi_units=2).withColumn("file", F.lit("x.tif")), str(out), "tiff")
    head = tiff.scan_headers(spark, str(out)).first()
    assert bytes(head.icc) == profile and bytes(head.xmp) == xmp
    assert (head.dpi_x, head.dpi_y, head.dpi_units) == (300.5, 150.0, 2)
    assert (image(tiff.scan_tiff(spark, str(out)), 8) == a).all()


def test_png_metadata_comes_back(spark, tmp_path):
    out = tmp_path / "out"
    sinks.save_encoded(described(spark, random_image(2, 16, 16), icc=b"profile", xmp=b"<x/>", dpi_x=254.0, dpi_y=127.0, dpi_units=1), str(out))
    names = sorted(p.name for p in (out / "sub").iterdir())
    assert names == ["0.bin", "1.bin", "2.bin", "3.bin"]
    found = chunks((out / "sub" / "0.bin").read_bytes())
    assert zlib.decompress(found["iCCP"].split(b"\0", 1)[1][1:]) == b"profile"
    assert found["iTXt"] == b"XML:com.adobe.xmp\0\0\0\0\0<x/>" and struct.unpack(">IIB", found["pHYs"]) == (10_000, 5_000, 1)
    assert list(found)[0] == "IHDR" and list(found)[-2:] == ["IDAT", "IEND"]
    sinks.save_encoded(described(spark, random_image(3, 8, 8)), str(tmp_path / "bare"))
    assert list(chunks((tmp_path / "bare" / "sub" / "0.bin").read_bytes())) == ["IHDR", "IDAT", "IEND"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    t = described(spark, random_image(4, 32, 32)).repartition(4)
    broken = t.withColumn("data", F.when(F.col("tile") == 13, F.lit(b"x")).otherwise(F.col("data")))
    with pytest.raises(Exception):  # noqa: B017
        sinks.save_encoded(broken, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_files_are_added_to_a_folder(spark, tmp_path):
    out = tmp_path / "out"
    sinks.save_encoded(described(spark, random_image(5, 8, 8)), str(out))
    sinks.save_encoded(described(spark, random_image(6, 8, 8)).withColumn("file", F.lit("other/1.png")), str(out))
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["other/1.png", "sub/0.bin"]
    assert os.listdir(tmp_path) == ["out"]
