"""Tiled TIFF pyramids and stacks as tables.

Files are listed without their content, and a file of many bytes is read in parts: a part has a run of the wanted
tiles of each directory and reads the directories, its run of the offset tables and these tiles.  One very large file
is thus read by many tasks, an offset table is read once altogether, and no header is read on the driver.

``read_tiff`` reads a table of files.  ``tiff_tiles`` is a data source: filters on h_seq, v_seq, level, tile, tx, ty, path and
image_id are pushed into it, so that files, directories and tiles that are not wanted are not touched.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from tessella.functions.pixelops import unpack_bits
from tessella.sources.storage import locate, open_path, qualified
from tessella.streaming.ingest import BINARY_FILE

# TIFF field types as (struct code, bytes).
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4),
         10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}

# TIFF tag numbers.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 254, 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
X_RES, Y_RES, RES_UNIT, SUB_IFDS = 282, 283, 296, 330
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SAMPLE_FORMAT, MIN_SAMPLE, MAX_SAMPLE, STONITS = 339, 340, 341, 37439
TEXT_TAGS = {"creator": 315, "rights": 33432, "date": 306, "description": 270, "title": 269, "pagename": 285, "software": 305,
             "make": 271, "model": 272}
XMP, ICC = 700, 34675
PLANAR, PREDICTOR = 284, 317
NONE, DEFLATE, ADOBE_DEFLATE = 1, 32946, 8

#: What a broken or unsupported file makes the reader raise.
UNREADABLE = (ValueError, KeyError, IndexError, TypeError, OSError, struct.error, zlib.error)


class Header:
    """Directories of one open TIFF file; field values are read when asked for."""

    def __init__(self, stream) -> None:
        self.stream = stream
        start = self._at(0, 16)
        self.order = "<" if start[:2] == b"II" else ">"
        self.big = struct.unpack(self.order + "H", start[2:4])[0] == 43
        pointer = struct.unpack(self.order + ("Q" if self.big else "I"), start[8:16] if self.big else start[4:8])[0]
        self.pages: list[dict] = []
        while pointer:
            page, pointer = self._directory(pointer)
            self.pages.append(page)

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def _directory(self, offset: int) -> tuple[dict, int]:
        head, entry, word = ("Q", 20, 8) if self.big else ("H", 12, 4)
        size = struct.calcsize(head)
        n = struct.unpack(self.order + head, self._at(offset, size))[0]
        raw = self._at(offset + size, n * entry + word)
        fields = {}
        for i in range(n):
            part = raw[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(self.order + "HH", part[:4])
            count = struct.unpack(self.order + ("Q" if self.big else "I"), part[4 : 4 + word])[0]
            fields[tag] = (kind, count, part[4 + word :])
        following = struct.unpack(self.order + ("Q" if self.big else "I"), raw[n * entry : n * entry + word])[0]
        return fields, following

    def get(self, page: dict, tag: int, default=None):
        """All values of a field as a tuple, or its bytes for text."""
        if tag not in page:
            return default
        kind, count, inline = page[tag]
        code, width = TYPES.get(kind, ("s", 1))
        size = width * count
        if size > len(inline):
            inline = self._at(struct.unpack(self.order + ("Q" if self.big else "I"), inline)[0], size)
        if code == "s":
            return inline[:size]
        values = struct.unpack(self.order + code * count, inline[:size])
        return tuple(a / b if b else 0.0 for a, b in zip(values[::2], values[1::2])) if len(code) == 2 else values

    def raw(self, page: dict, tag: int) -> bytes | None:
        """A field as bytes; files give profiles and XMP as bytes or as undefined values."""
        value = self.get(page, tag)
        return value if value is None or isinstance(value, bytes) else bytes(value)

    def one(self, page: dict, tag: int, default=0):
        return self.get(page, tag, (default,))[0]

    def run(self, page: dict, tag: int, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi of a field of whole numbers; only they are read."""
        kind, count, inline = page[tag]
        code, width = TYPES[kind]
        hi = min(hi, count)
        if width * count > len(inline):
            start = struct.unpack(self.order + ("Q" if self.big else "I"), inline)[0]
            raw = self._at(start + lo * width, max(hi - lo, 0) * width)
        else:
            raw = inline[lo * width : hi * width]
        return np.frombuffer(raw, np.dtype(code).newbyteorder(self.order)).astype(np.int64)

    def text(self, page: dict, tag: int) -> str | None:
        value = self.get(page, tag)
        return None if value is None else value.split(b"\0")[0].decode("utf-8", "replace")

    def layout(self) -> tuple[list[dict], list[dict]]:
        """(levels from full size down, stack layers).

        Reduced images in the first page's SubIFDs are the pyramid; without them, all further tiled
        pages are, unless they have the same size: then they are layers.
        """
        first = self.pages[0]
        levels = [first, *self.reduced(first)]
        nested = len(levels) > 1
        if not nested:
            levels += [p for p in self.pages[1:] if TILE_W in p]
        size = lambda p: (self.one(p, WIDTH), self.one(p, HEIGHT))
        same = len(levels) > 1 and size(levels[0]) == size(levels[1])
        pages = [p for p in self.pages if self.one(p, SUBFILE) == 2] if nested or same else []
        return (levels[:1] if same and pages else levels), pages

    def reduced(self, page: dict) -> list[dict]:
        """Smaller images of a page, from its SubIFDs."""
        pages = [self._directory(pointer)[0] for pointer in self.get(page, SUB_IFDS, ())]
        return [p for p in pages if self.one(p, SUBFILE) == 1]

    def directories(self) -> list[tuple[int, int, dict]]:
        """(h_seq, level, page) of all levels of all layers.

        A layer is numbered by its directory and has a pyramid of its own, whose levels count like those of the first
        layer: full size is the highest number.
        """
        pyramid, layers = self.layout()
        top = len(pyramid) - 1
        found = [(0, top - i, p) for i, p in enumerate(pyramid)]
        for number, page in enumerate(self.pages):
            if number and any(page is p for p in layers):
                found += [(number, top - i, p) for i, p in enumerate([page, *self.reduced(page)]) if i <= top]
        return found

    def shape(self, page: dict) -> dict:
        tiled = TILE_W in page
        w, h = self.one(page, WIDTH), self.one(page, HEIGHT)
        tw = self.one(page, TILE_W) if tiled else w
        th = self.one(page, TILE_H) if tiled else min(self.one(page, ROWS_PER_STRIP, h), h)
        return {"width": w, "height": h, "tile_w": tw, "tile_h": th, "ntx": -(-w // tw), "nty": -(-h // th), "tiled": tiled}


def _undo_float_predictor(raw: bytes, h: int, w: int, channels: int, size: int) -> np.ndarray:
    """Rows hold the differences of their samples' bytes, the highest bytes of all samples first."""
    rows = np.frombuffer(raw, np.uint8, h * w * channels * size).reshape(h, w * size, channels)
    parts = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(h, size, w * channels).transpose(0, 2, 1)
    return np.ascontiguousarray(parts).view(f">f{size}").reshape(h, w, channels).astype(f"<f{size}")


def decode(header: Header, page: dict, shape: dict, tile: int, raw: bytes):
    """(width, height, channels, bpc, sample type, data) of one stored tile, widened and cropped."""
    bits, channels = header.one(page, BITS, 1), header.one(page, SAMPLES, 1)
    if header.one(page, PLANAR, 1) == 2:
        channels = 1  # planes are stored one after another; the first one is read
    packing, predictor = header.one(page, COMPRESSION, NONE), header.one(page, PREDICTOR, 1)
    if not raw:
        raw, predictor = bytes(-(-shape["tile_w"] * channels * bits // 8) * shape["tile_h"]), 1  # a tile that was left out
    elif packing in (DEFLATE, ADOBE_DEFLATE):
        raw = zlib.decompress(raw)
    elif packing != NONE:
        raise ValueError(f"TIFF compression {packing} is not supported")
    tx, ty = tile % shape["ntx"], tile // shape["ntx"]
    w = min(shape["tile_w"], shape["width"] - tx * shape["tile_w"])
    h = min(shape["tile_h"], shape["height"] - ty * shape["tile_h"])
    stored_h = shape["tile_h"] if shape["tiled"] else h
    white = header.one(page, PHOTOMETRIC, 1) == 0
    floating = header.one(page, SAMPLE_FORMAT, 1) == 3
    if bits in (8, 16, 32):
        kind = np.dtype(f"{header.order}{'f' if floating else 'u'}{bits // 8}")
        block = np.frombuffer(raw, kind, stored_h * shape["tile_w"] * channels).reshape(stored_h, shape["tile_w"], channels)
        block = block.astype(kind.newbyteorder("<"))
        if predictor == 2 and not floating:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        elif predictor == 3 and floating:
            block = _undo_float_predictor(raw, stored_h, shape["tile_w"], channels, bits // 8)
        elif predictor != 1:
            raise ValueError(f"TIFF predictor {predictor} is not supported for these samples")
    elif predictor != 1:
        raise ValueError(f"TIFF predictor {predictor} is not supported for {bits} bits")
    else:
        block = unpack_bits(raw, stored_h, shape["tile_w"], channels, bits, white)
    block = np.ascontiguousarray(block[:h, :w])
    return w, h, channels, block.dtype.itemsize * 8, "FLOATINGPOINT" if floating else "FIXEDPOINT", block.tobytes()


def list_files(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """(path, mtime, length): a listing; file content is not read."""
    files = spark.read.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length")


_TILE_DDL = (
    "image_id long, path string, h_seq int, v_seq int, level int, tile int, tx int, ty int, width int, height int, "
    "channels int, bpc int, sample_type string, data binary, error string"
)


_NAMES = [f.split()[0] for f in _TILE_DDL.split(", ")]
_ARROW = [pa.int64(), pa.string()] + [pa.int32()] * 10 + [pa.string(), pa.binary(), pa.string()]


class Wanted:
    """Conditions (column, operator, value) on h_seq, v_seq, level, tile, tx and ty; all of them hold for a wanted tile."""

    TESTS = {"=": np.equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "in": np.isin}
    COLUMNS = ("h_seq", "v_seq", "level", "tile", "tx", "ty")

    def __init__(self, conditions: list[tuple[str, str, object]] | None = None) -> None:
        self.conditions = conditions or []

    def holds(self, **values) -> np.ndarray | bool:
        """Whether the conditions on the columns that are given hold."""
        out = True
        for column, test, value in self.conditions:
            if column in values:
                out = out & self.TESTS[test](values[column], value)
        return out

    def bounds(self, shape: dict) -> tuple[int, int]:
        """A range of tile numbers of a directory with all wanted tiles in it."""
        lo, hi = 0, shape["ntx"] * shape["nty"]
        for column, test, value in self.conditions:
            step = {"tile": 1, "ty": shape["ntx"]}.get(column)
            values = list(value) if test == "in" else [value]
            if step and values:
                if test in ("=", "in", ">", ">="):
                    lo = max(lo, (min(values) + (test == ">")) * step)
                if test in ("=", "in", "<", "<="):
                    hi = min(hi, (max(values) + (test != "<")) * step)
        return lo, max(lo, hi)

    def tiles(self, shape: dict, part: int, parts: int) -> np.ndarray:
        """Numbers of the wanted tiles of a directory that fall to one of ``parts`` parts."""
        lo, hi = self.bounds(shape)
        tile = np.arange(lo + (hi - lo) * part // parts, lo + (hi - lo) * (part + 1) // parts)
        return tile[np.broadcast_to(self.holds(tile=tile, tx=tile % shape["ntx"], ty=tile // shape["ntx"]), tile.shape)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(columns, _ARROW, strict=True)], names=_NAMES)


def read_part(path: str, image_id: int, part: int, parts: int, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    """One part of a file's wanted tiles, in batches of a few megabytes."""
    with open_path(path) as stream:
        try:
            header = Header(stream)
            pages = [d for d in header.directories() if wanted.holds(h_seq=d[0], v_seq=90, level=d[1])]
        except UNREADABLE as problem:
            if part == 0 and not wanted.conditions:
                yield _batch([(image_id, path, *[None] * (len(_NAMES) - 3), f"unreadable file: {problem}")])
            return
        rows, size = [], 0
        for h_seq, level, page in pages:
            try:
                shape = header.shape(page)
                tiles = wanted.tiles(shape, part, parts)
                if not len(tiles):
                    continue
                lo, hi = int(tiles[0]), int(tiles[-1]) + 1
                offsets = header.run(page, TILE_OFFSETS if shape["tiled"] else STRIP_OFFSETS, lo, hi)
                counts = header.run(page, TILE_COUNTS if shape["tiled"] else STRIP_COUNTS, lo, hi)
            except UNREADABLE as problem:
                if part == 0:
                    rows.append((image_id, path, h_seq, 90, level, *[None] * (len(_NAMES) - 6), f"unreadable directory: {problem}"))
                continue
            for tile in tiles.tolist():
                try:
                    stream.seek(int(offsets[tile - lo]))
                    out = (*decode(header, page, shape, tile, stream.read(int(counts[tile - lo]))), None)
                except UNREADABLE as problem:
                    out = (*[None] * 6, f"unreadable tile: {problem}")
                rows.append((image_id, path, h_seq, 90, level, tile, tile % shape["ntx"], tile // shape["ntx"], *out))
                size += len(out[-2] or b"")
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def scan_tiff(spark: SparkSession, path: str, pattern: str = "*.tif*", levels: list[int] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Tiles of all TIFF files under ``path``."""
    return read_tiff(list_files(spark, path, pattern), levels, split_bytes)


def read_tiff(files: DataFrame, levels: list[int] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Tiles of a table of files (path, length).  A file or tile that cannot be read is a row with ``error`` and no data.
    Levels not in ``levels`` (0 is the smallest) are not read."""
    wanted = Wanted(None if levels is None else [("level", "in", list(levels))])
    parts = files.withColumn("parts", (F.floor(F.col("length") / split_bytes) + 1).cast("int"))
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    source = parts.select(F.xxhash64("path").alias("image_id"), "path", "part", "parts").repartition("path", "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                yield from read_part(wanted=wanted, **item)

    return source.mapInArrow(read, _TILE_DDL).withColumn("encoding", F.lit("RAW"))


@dataclass
class FilePart(InputPartition):
    path: str
    image_id: int
    part: int
    parts: int


class TiffReader(DataSourceReader):
    """Reader of ``tiff_tiles``; the filters it takes are exact, the others go back to Spark."""

    _TESTS = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in"}

    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*.tif*")
        self.split_bytes = int(options.get("splitbytes", 64 << 20))
        self.conditions: list[tuple[str, str, object]] = []
        self.files: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column, test = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None, self._TESTS.get(type(f))
            if column in Wanted.COLUMNS and test:
                self.conditions.append((column, test, list(f.value) if test == "in" else f.value))
            elif column in Wanted.COLUMNS and isinstance(f, IsNotNull):
                self.conditions.append((column, ">=", -(1 << 31)))
            elif column in ("path", "image_id") and test in ("=", "in"):
                self.files.append((column, test, list(f.value) if test == "in" else [f.value]))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        """Parts of the files below the path whose path and image_id are wanted."""
        where, name = locate(self.path)
        found = where.get_file_info(name)
        if found.type == fs.FileType.Directory:
            infos = [f for f in where.get_file_info(fs.FileSelector(name, recursive=True)) if f.type == fs.FileType.File]
        else:
            infos = [found] if found.type == fs.FileType.File else []
        prefix = "file:" if isinstance(where, fs.LocalFileSystem) else self.path[: len(self.path) - len(self.path.partition("://")[2].partition("/")[2]) - 1]
        out = []
        for info in sorted(infos, key=lambda f: f.path):
            path = prefix + ("" if info.path.startswith("/") else "/") + info.path
            leaf = info.base_name
            if fnmatch(leaf, self.pattern) and not leaf.startswith(("_", ".")):
                values = {"path": path, "image_id": image_key(path)}
                if all(values[column] in wanted for column, _, wanted in self.files):
                    parts = info.size // self.split_bytes + 1
                    out += [FilePart(path, values["image_id"], part, parts) for part in range(parts)]
        return out

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from read_part(partition.path, partition.image_id, partition.part, partition.parts, Wanted(self.conditions))


def image_key(path: str) -> int:
    """image_id of a path, as xxhash64 in Spark."""
    from xxhash import xxh64_intdigest

    key = xxh64_intdigest(path.encode(), 42)
    return key - (1 << 64) if key >> 63 else key


class TiffTiles(DataSource):
    """``spark.read.format("tiff_tiles").load(folder)``; options pathGlobFilter and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "tiff_tiles"

    def schema(self) -> str:
        return _TILE_DDL

    def reader(self, schema) -> TiffReader:
        return TiffReader({k.lower(): v for k, v in self.options.items()})


def tiff_tiles(spark: SparkSession, path: str, pattern: str = "*.tif*", split_bytes: int = 64 << 20) -> DataFrame:
    """Tiles of all TIFF files under ``path`` by the data source, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffTiles)
    return spark.read.format("tiff_tiles").option("pathGlobFilter", pattern).option("splitBytes", str(split_bytes)).load(qualified(spark, path))


def scan_directories(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """The directory tree of TIFF files: a row for every level of every layer.

    image_id, path, h_seq, level, native_level (0 is full size), width, height, tile_w, tile_h, ntx, nty, bits, channels,
    compression, name and scale of the layer, error.  A file that cannot be read is a row with only ``error``.
    """
    names = ["h_seq", "level", "native_level", "width", "height", "tile_w", "tile_h", "ntx", "nty", "bits", "channels", "compression"]
    ddl = "image_id long, path string, " + ", ".join(f"{n} int" for n in names) + ", name string, scale double, error string"
    files = list_files(spark, path, pattern).select(F.xxhash64("path").alias("image_id"), "path")

    def describe(path: str) -> Iterator[tuple]:
        with open_path(path) as stream:
            try:
                header = Header(stream)
                found = header.directories()
                top = max(level for _, level, _ in found)
                for h_seq, level, page in found:
                    shape = header.shape(page)
                    layer = header.pages[h_seq]
                    facts = [header.one(page, BITS, 1), header.one(page, SAMPLES, 1), header.one(page, COMPRESSION, NONE)]
                    yield (h_seq, level, top - level, *[shape[n] for n in names[3:9]], *facts, header.text(layer, TEXT_TAGS["title"]), float(header.one(layer, STONITS, 1.0)), None)
            except UNREADABLE as problem:
                yield (*[None] * (len(names) + 2), f"unreadable file: {problem}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, path, *row) for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in describe(path)]
            if rows:
                types = [pa.int64(), pa.string(), *[pa.int32()] * len(names), pa.string(), pa.float64(), pa.string()]
                arrays = [pa.array(col, t) for col, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["image_id", "path", *names, "name", "scale", "error"])

    return files.mapInArrow(read, ddl)


def scan_headers(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """Catalogue rows of TIFF files: sizes, depth, ranges, levels, stack and metadata."""
    files = list_files(spark, path, pattern).select(F.xxhash64("path").alias("image_id"), "path", "mtime")
    times = files.select("path", "mtime")
    level = "struct<level:int,native_level:int,width:int,height:int,tile_w:int,tile_h:int,ntx:int,nty:int>"
    schema = (
        "image_id long, path string, width int, height int, channels int, bpc int, sample_type string, colorspace string, "
        f"min array<float>, max array<float>, dpi_x float, dpi_y float, dpi_units int, levels array<{level}>, "
        "stack array<struct<name:string,scale:float>>, metadata map<string,string>, icc binary, xmp binary, error string"
    )
    space = {8: "CIELAB", 1: "GREYSCALE", 0: "GREYSCALE"}

    def describe(header: Header) -> dict:
        pyramid, layers = header.layout()
        first = pyramid[0]
        bits, channels = header.one(first, BITS, 1), header.one(first, SAMPLES, 1)
        floating = header.one(first, SAMPLE_FORMAT, 1) == 3
        wide = 8 if bits < 8 else 16 if bits < 16 and bits > 8 else bits
        top = {8: 255.0, 16: 65535.0}.get(wide, 1.0 if floating else 4294967295.0)
        fill = lambda tag, default: [float(v) or default for v in header.get(first, tag, (0,) * channels)]
        shapes = []
        for i, page in enumerate(pyramid):
            shape = header.shape(page)
            shape.pop("tiled")
            shapes.append({"level": len(pyramid) - 1 - i, "native_level": i, **shape})
        text = {k: header.text(first, tag) for k, tag in TEXT_TAGS.items()}
        if STONITS in first:
            text["scale"] = f"{header.one(first, STONITS):g}"
        scale = lambda p: float(header.one(p, STONITS, 1.0))
        return {
            "width": shapes[0]["width"], "height": shapes[0]["height"], "channels": channels, "bpc": wide,
            "sample_type": "FLOATINGPOINT" if floating else "FIXEDPOINT",
            "colorspace": "BINARY" if bits == 1 else space.get(header.one(first, PHOTOMETRIC, 1), "sRGB"),
            "min": fill(MIN_SAMPLE, 0.0), "max": fill(MAX_SAMPLE, top),
            "dpi_x": float(header.one(first, X_RES, 0.0)), "dpi_y": float(header.one(first, Y_RES, 0.0)),
            "dpi_units": header.one(first, RES_UNIT, 1) - 1, "levels": shapes,
            "stack": [{"name": header.text(p, TEXT_TAGS["title"]) or "", "scale": scale(p)} for p in layers],
            "metadata": [(k, v) for k, v in text.items() if v is not None],
            "icc": header.raw(first, ICC), "xmp": header.raw(first, XMP),
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = pa.struct([(k, pa.int32()) for k in ("level", "native_level", "width", "height", "tile_w", "tile_h", "ntx", "nty")])
        types = {
            "min": pa.list_(pa.float32()), "max": pa.list_(pa.float32()), "dpi_x": pa.float32(), "dpi_y": pa.float32(), "levels": pa.list_(lv),
            "stack": pa.list_(pa.struct([("name", pa.string()), ("scale", pa.float32())])), "metadata": pa.map_(pa.string(), pa.string()),
            "icc": pa.binary(), "xmp": pa.binary(), "sample_type": pa.string(), "colorspace": pa.string(), "error": pa.string(),
        }
        names = ["width", "height", "channels", "bpc", "sample_type", "colorspace", "min", "max", "dpi_x", "dpi_y", "dpi_units", "levels", "stack", "metadata", "icc", "xmp", "error"]
        for batch in batches:
            rows = []
            for path in batch.column(1).to_pylist():
                with open_path(path) as stream:
                    try:
                        rows.append({**describe(Header(stream)), "error": None})
                    except UNREADABLE as problem:
                        rows.append({**dict.fromkeys(names), "error": f"unreadable file: {problem}"})
            if rows:
                columns = [batch.column(0), batch.column(1)] + [pa.array([r[n] for r in rows], types.get(n, pa.int32())) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "path", *names])

    found = files.select("image_id", "path").mapInArrow(read, schema)
    found = found.join(times, "path", "left").select(*found.columns, "mtime")
    return found.withColumn("format", F.lit("TIFF")).withColumn("num_levels", F.size("levels"))
