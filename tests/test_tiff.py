"""Hand-made TIFF files: pyramids, depths, byte orders, big files, stacks and splits."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import sinks, tiff
from tests.rasters import image, random_image


def build(pages, order="<", big=False, deflate=False):
    """pages: (array, tile, bits, extra fields).  Tiles are padded to full size and packed."""
    out = bytearray(struct.pack(order + "2sH", b"II" if order == "<" else b"MM", 43 if big else 42))
    out += struct.pack(order + ("HHQ" if big else "I"), *((8, 0, 0) if big else (0,)))
    link = 8 if big else 4
    word = "Q" if big else "I"
    for array, tile, bits, extra in pages:
        h, w, channels = array.shape
        offsets, counts = [], []
        for ty in range(-(-h // tile)):
            for tx in range(-(-w // tile)):
                full = np.zeros((tile, tile, channels), array.dtype)
                part = array[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
                full[: part.shape[0], : part.shape[1]] = part
                if bits in (8, 16, 32):
                    raw = full.astype(full.dtype.newbyteorder(order)).tobytes()
                else:
                    flags = (full.reshape(tile, -1, 1) >> np.arange(bits - 1, -1, -1)) & 1
                    raw = np.packbits(flags.reshape(tile, -1).astype(np.uint8), axis=1).tobytes()
                raw = zlib.compress(raw) if deflate else raw
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        fields = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * channels), 259: (3, [8 if deflate else 1]), 262: (3, [1 if channels == 1 else 2]),
                  277: (3, [channels]), 322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, counts), 339: (3, [3 if array.dtype.kind == "f" else 1] * channels)}
        fields.update(extra)
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            body = values.encode() + b"\0" if kind == 2 else struct.pack(order + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
            n = len(body) if kind == 2 else len(values)
            size = 8 if big else 4
            if len(body) > size:
                at = len(out)
                out += body
                body = struct.pack(order + word, at)
            entries += struct.pack(order + "HH" + word, tag, kind, n) + body.ljust(size, b"\0")
        at = len(out)
        out[link : link + struct.calcsize(word)] = struct.pack(order + word, at)
        out += struct.pack(order + ("Q" if big else "H"), len(fields)) + entries
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big,deflate", [(False, False), (True, True)])
def test_pyramid(spark, tmp_path, order, big, deflate):
    a = random_image(1, 40, 50, 3, "u2")
    (tmp_path / "p.tif").write_bytes(build([(a, 16, 16, {315: (2, "someone")}), (a[::2, ::2], 16, 16, {254: (4, [1])})], order, big, deflate))
    tiles = tiff.scan_tiff(spark, str(tmp_path), split_bytes=2048)
    assert (image(tiles.where("level = 1"), 16) == a).all()
    assert (image(tiles.where("level = 0"), 16) == a[::2, ::2]).all()
    assert tiff.scan_tiff(spark, str(tmp_path), levels=[0]).select("level").distinct().collect() == [(0,)]
    head = tiff.scan_headers(spark, str(tmp_path)).first()
    assert (head.width, head.height, head.num_levels, head.channels, head.bpc) == (50, 40, 2, 3, 16)
    assert head.metadata["creator"] == "someone" and head.max == [65535.0] * 3 and head.levels[1].width == 25


@pytest.mark.parametrize("bits", [1, 2, 4, 6, 10, 12, 14])
def test_packed_depths(spark, tmp_path, bits):
    from tessella.functions.pixelops import widen

    a = (random_image(bits, 20, 33, 1, "u2") % (1 << bits)).astype(np.uint16)
    (tmp_path / "d.tif").write_bytes(build([(a, 16, bits, {})]))
    assert (image(tiff.scan_tiff(spark, str(tmp_path)), 16) == widen(a.astype(np.uint32), bits)).all()


def test_stack(spark, tmp_path):
    a, b = random_image(1, 16, 16), random_image(2, 16, 16)
    page = lambda name, scale: {254: (4, [2]), 269: (2, name), 37439: (12, [scale])}
    (tmp_path / "s.tif").write_bytes(build([(a, 16, 8, page("red", 1.5)), (b, 16, 8, page("blue", 2.0))]))
    head = tiff.scan_headers(spark, str(tmp_path)).first()
    assert [(s.name, s.scale) for s in head.stack] == [("red", 1.5), ("blue", 2.0)] and head.num_levels == 1
    tiles = tiff.scan_tiff(spark, str(tmp_path))
    assert (image(tiles.where("h_seq = 1"), 16) == b).all() and (image(tiles.where("h_seq = 0"), 16) == a).all()


@pytest.mark.parametrize("channels,kind", [(1, "u1"), (2, "u1"), (3, "u2"), (4, "u1"), (1, "f4")])
def test_own_files_come_back(spark, tmp_path, channels, kind):
    a = random_image(3, 9, 11, channels, "u2" if kind == "u2" else "u1").astype(kind)
    (tmp_path / "x.tif").write_bytes(sinks.tiff(a))
    assert (image(tiff.scan_tiff(spark, str(tmp_path)), 16) == a).all()


def test_file_kinds(spark, tmp_path):
    from tessella.sources.files import scan_files

    (tmp_path / "a.bin").write_bytes(bytes.fromhex("0000000C6A5020200D0A00"))
    (tmp_path / "b.bin").write_bytes(bytes.fromhex("FFD8FFE000104A464946"))
    (tmp_path / "c.bin").write_bytes(b"hi")
    found = {r.path[-5:]: (r.format, r.error is None) for r in scan_files(spark, str(tmp_path)).collect()}
    assert found == {"a.bin": ("JPEG2000", True), "b.bin": ("JPEG", True), "c.bin": (None, False)}


def test_partitioned_table(spark, tmp_path):
    from tests.rasters import tiles

    a = random_image(4, 20, 20)
    sinks.write_tiles(tiles(spark, a, 8), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert (image(back.where(F.col("level") == 0), 8) == a).all()
    plan = back.where("level = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan


# predictors, planes, left-out tiles


def _predicted(a):
    """Horizontal differences of each padded tile, by the file's byte order."""
    out = a.copy()
    out[:, 1:] = a[:, 1:] - a[:, :-1]
    return out


@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_horizontal_predictor(spark, tmp_path, kind):
    a = random_image(5, 16, 32, 3, kind)
    b = np.concatenate([_predicted(a[:, :16]), _predicted(a[:, 16:])], axis=1)
    (tmp_path / "p.tif").write_bytes(build([(b, 16, a.dtype.itemsize * 8, {317: (3, [2])})], deflate=True))
    assert (image(tiff.scan_tiff(spark, str(tmp_path)), 16) == a).all()


def test_float_predictor(spark, tmp_path):
    a = np.random.default_rng(6).standard_normal((16, 16, 1)).astype(">f4")
    planes = a.view(np.uint8).reshape(16, 16, 4).transpose(0, 2, 1).reshape(16, 64)
    rows = planes.copy()
    rows[:, 1:] = planes[:, 1:] - planes[:, :-1]
    stored = rows.reshape(16, 16, 4).copy().view("<f4").reshape(16, 16, 1)
    (tmp_path / "f.tif").write_bytes(build([(stored, 16, 32, {317: (3, [3])})]))
    assert (image(tiff.scan_tiff(spark, str(tmp_path)), 16) == a.astype("f4")).all()


def test_separate_planes_read_the_first(spark, tmp_path):
    a, b = random_image(7, 16, 16), random_image(8, 16, 16)
    whole = build([(np.concatenate([a, b]), 16, 8, {257: (4, [16]), 284: (3, [2]), 277: (3, [2]), 258: (3, [8, 8])})])
    (tmp_path / "s.tif").write_bytes(whole)
    assert (image(tiff.scan_tiff(spark, str(tmp_path)), 16) == a).all()


def test_left_out_tiles_are_zero(spark, tmp_path):
    a = random_image(9, 16, 32)
    (tmp_path / "l.tif").write_bytes(build([(a, 16, 8, {325: (4, [256, 0])})]))
    got = image(tiff.scan_tiff(spark, str(tmp_path)), 16)
    assert (got[:, :16] == a[:, :16]).all() and not got[:, 16:].any()


# layers with pyramids


def layered(seed, layers=3, h=40, w=50):
    out = []
    for i in range(layers):
        a = random_image(seed + i, h, w, 1, "u2")
        out.append((f"layer {i}", 1.5 + i, [a, a[::2, ::2], a[::4, ::4]]))
    return out


def test_layers_have_levels(spark, tmp_path):
    stack = layered(20)
    (tmp_path / "l.tif").write_bytes(sinks.tiff_stack(stack, 16))
    tiles = tiff.scan_tiff(spark, str(tmp_path))
    for h_seq, (_, _, levels) in enumerate(stack):
        for native, a in enumerate(levels):
            assert (image(tiles.where(f"h_seq = {h_seq} AND level = {2 - native}"), 16) == a).all()
    rows = tiff.scan_directories(spark, str(tmp_path)).orderBy("h_seq", "native_level").collect()
    assert [(r.h_seq, r.level, r.width, r.height, r.name, r.scale) for r in rows] == [
        (i, 2 - n, a.shape[1], a.shape[0], name, scale) for i, (name, scale, levels) in enumerate(stack) for n, a in enumerate(levels)
    ]
    head = tiff.scan_headers(spark, str(tmp_path)).first()
    assert head.num_levels == 3 and [s.name for s in head.stack] == ["layer 0", "layer 1", "layer 2"]


# the data source


def test_data_source_equals_the_scan(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.tif").write_bytes(sinks.tiff_stack(layered(30 + i), 16))
    (tmp_path / "broken.tif").write_bytes(b"nothing")
    (tmp_path / "other.png").write_bytes(b"nothing")
    scan = tiff.scan_tiff(spark, str(tmp_path)).drop("encoding")
    source = tiff.tiff_tiles(spark, str(tmp_path), split_bytes=3000)
    every = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert every(source) == every(scan) and source.where("error IS NOT NULL").count() == 1
    for condition in ("level = 0 AND tile < 3", "h_seq IN (1, 2) AND ty >= 1", "tile = 5", "tx <> 1", "level = 9", "tx = 1 AND width < 16", "path LIKE '%f1.tif' AND level = 1"):
        assert every(source.where(condition)) == every(scan.where(condition)), condition
    key = scan.select("image_id").where("path LIKE '%f2.tif'").first()[0]
    assert every(source.where(F.col("image_id") == key)) == every(scan.where(F.col("image_id") == key))
    plan = source.where("level = 0 AND tile < 3")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


class Counting:
    """A file that counts what is read."""

    def __init__(self, stream, tally):
        self.stream, self.tally = stream, tally

    def read(self, size):
        self.tally.append((self.stream.tell(), size))
        return self.stream.read(size)

    def __getattr__(self, name):
        return getattr(self.stream, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()


def test_pushed_filters_read_few_bytes(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, LessThan, StringContains

    path = tmp_path / "big.tif"
    a = random_image(40, 640, 640, 1, "u2")
    path.write_bytes(sinks.tiff_stack([("a", 1.0, [a, a[::2, ::2], a[::4, ::4]])], 16, deflate=False))
    tally = []
    plain = tiff.open_path
    monkeypatch.setattr(tiff, "open_path", lambda p: Counting(plain(p), tally))

    def read(filters):
        reader = tiff.TiffTiles({"path": str(tmp_path), "splitBytes": "100000"}).reader(None)
        left = list(reader.pushFilters(filters))
        tally.clear()
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return left, rows, sum(n for _, n in tally)

    other = StringContains(("path",), "big")
    left, rows, few = read([EqualTo(("level",), 0), LessThan(("tile",), 10), other])
    assert left == [other] and sorted(r["tile"] for r in rows) == list(range(10)) and {r["level"] for r in rows} == {0}
    _, rows, every = read([])
    assert len(rows) == 40 * 40 + 20 * 20 + 10 * 10
    parts = path.stat().st_size // 100000 + 1
    assert few < 10 * 512 + 80 + parts * 2000
    # each tile once, and each entry of an offset table once, over all parts
    assert every < path.stat().st_size + parts * 2000
