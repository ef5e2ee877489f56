"""Writing tile tables and encoded tile files."""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessella.operators.tiles import BLOCK_SIDE, block_of, block_place, rim_strips
from tessella.schema import PLANE_KEY
from tessella.session import join_side_table
from tessella.sources.storage import locate, qualified, write_path


def write_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet tile table: a folder per level; files hold runs of neighbouring tiles.

    The range partitioning is by image and tile, so one large image is spread over many files and
    readers can skip row groups by key.
    """
    ordered = tiles.repartitionByRange("level", "image_id", "h_seq", "v_seq", "tile").sortWithinPartitions("level", "image_id", "h_seq", "v_seq", "tile")
    ordered.write.mode(mode).partitionBy("level").parquet(path)


def write_curve_store(tiles: DataFrame, path: str, mode: str = "errorifexists", row_group: int = 8 << 20) -> None:
    """Parquet tile table for reading regions: a folder per level, tiles of an image along a Morton curve.

    A region is a few runs of ``curve`` keys; with small row groups, statistics of image_id and curve skip all others
    (cover.join_wanted makes the filters).
    """
    from tessella.operators.cover import curve

    key = ["level", "image_id", "curve", "h_seq", "v_seq"]
    ordered = tiles.withColumn("curve", curve(tiles["tx"], tiles["ty"])).repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.write.mode(mode).option("parquet.block.size", row_group).partitionBy("level").parquet(path)


def save_tile_table(tiles: DataFrame, name: str, buckets: int = 256) -> None:
    """Bucketed table: joins on the tile key then leave the tiles where they are."""
    key = ["image_id", "h_seq", "v_seq", "level", "tile"]
    tiles.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)


def save_block_table(tiles: DataFrame, name: str, reach: int = 3, side: int = BLOCK_SIDE, buckets: int = 256, path: str | None = None) -> None:
    """Table bucketed by blocks of the tile grid, and a table ``<name>_rims`` with the strips that cross their borders.

    Neighbourhoods of up to ``reach`` samples are then computed where the tiles lie (tiles.convolve_table).  The reach is
    set last, so a table that was left half written is not taken.
    """
    key = [*PLANE_KEY, "bx", "by"]
    parts = {f"{name}_rims": rim_strips(tiles, reach, PLANE_KEY, side), name: tiles.withColumns(block_place(side))}
    for table, rows in parts.items():
        writer = rows.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key)
        (writer.option("path", f"{path}/{table}") if path else writer).saveAsTable(table)
    tiles.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('tessella.reach' = '{reach}')")


def png(block: np.ndarray, level: int = 1, dpm: tuple[int, int] | None = None, icc: bytes | None = None, xmp: bytes | None = None) -> bytes:
    """PNG of 1 to 4 channels, 8 or 16 bit; ``dpm`` is the resolution in pixels per metre."""
    h, w, channels = block.shape
    color = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    wide = block.astype(">u2") if block.dtype.itemsize == 2 else block.astype(np.uint8)
    rows = np.ascontiguousarray(wide).view(np.uint8).reshape(h, -1)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, wide.dtype.itemsize * 8, color, 0, 0, 0))
    if icc:
        out += chunk(b"iCCP", b"ICC profile\0\0" + zlib.compress(icc))
    if dpm:
        out += chunk(b"pHYs", struct.pack(">IIB", *dpm, 1))
    if xmp:
        out += chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp)
    return out + chunk(b"IDAT", zlib.compress(lines, level)) + chunk(b"IEND", b"")


def _described(row: dict) -> tuple[tuple[int, int] | None, list]:
    """Resolution of a row in pixels per metre, and the TIFF fields of its resolution, profile and XMP."""
    x, y, units = row.get("dpi_x") or 0, row.get("dpi_y") or 0, row.get("dpi_units") or 0
    per_metre = {1: 1 / 0.0254, 2: 100.0}.get(units)
    dpm = (round(x * per_metre), round(y * per_metre)) if per_metre and x > 0 and y > 0 else None
    ratio = lambda v: (round(v * 10_000), 10_000)
    fields = [(282, 5, ratio(x)), (283, 5, ratio(y)), (296, 3, (units + 1,))] if x > 0 and y > 0 else []
    fields += [(34675, 7, row["icc"])] if row.get("icc") else []
    return dpm, fields + ([(700, 1, row["xmp"])] if row.get("xmp") else [])


_TILE = ("width", "height", "channels", "bpc", "sample_type", "data")
#: Columns that the encoders take besides the tile, where a table has them.
DESCRIBING = ("icc", "xmp", "dpi_x", "dpi_y", "dpi_units")


def encode_row(row: dict, fmt: str, deflate: bool = True) -> bytes:
    """The tile of a row as a PNG or TIFF file, with its profile, XMP and resolution."""
    dpm, fields = _described(row)
    if fmt == "png":
        return png(block_of(row), dpm=dpm, icc=row.get("icc"), xmp=row.get("xmp"))
    return tiff(block_of(row), deflate, fields)


def _directory(fields: list[tuple[int, int, tuple | bytes]], start: int, following: int = 0) -> bytes:
    """A little-endian TIFF directory to stand at ``start``, with the values that do not fit into it behind it."""
    fields = sorted(fields)
    data_at, extra, entries = start + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, values in fields:
        packed = values if isinstance(values, bytes) else struct.pack("<" + {3: "H", 4: "I", 5: "I", 12: "d"}[kind] * len(values), *values)
        count = len(values) // 2 if kind == 5 else len(values)
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, kind, count, data_at + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, count) + packed.ljust(4, b"\0")
    return struct.pack("<H", len(fields)) + entries + struct.pack("<I", following) + extra


def _sample_fields(block: np.ndarray, deflate: bool) -> list[tuple[int, int, tuple]]:
    h, w, channels = block.shape
    fields = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (block.dtype.itemsize * 8,) * channels), (259, 3, (8 if deflate else 1,)),
              (262, 3, (2 if channels > 2 else 1,)), (277, 3, (channels,)), (284, 3, (1,)), (339, 3, ((3 if block.dtype.kind == "f" else 1),) * channels)]
    return [*fields, (338, 3, (2,))] if channels in (2, 4) else fields


def tiff(block: np.ndarray, deflate: bool = True, extra: list[tuple[int, int, tuple | bytes]] | None = None) -> bytes:
    """One-strip little-endian TIFF; the last of 2 or 4 channels is alpha.  ``extra`` are further fields (tag, type, values)."""
    body = np.ascontiguousarray(block.astype(block.dtype.newbyteorder("<"))).tobytes()
    body = zlib.compress(body, 1) if deflate else body
    fields = [*_sample_fields(block, deflate), (273, 4, (8,)), (278, 4, (block.shape[0],)), (279, 4, (len(body),)), *(extra or [])]
    start = 8 + len(body) + len(body) % 2
    return struct.pack("<2sHI", b"II", 42, start) + body + b"\0" * (len(body) % 2) + _directory(fields, start)


def tiff_stack(layers: list[tuple[str, float, list[np.ndarray]]], tile: int, deflate: bool = True) -> bytes:
    """Tiled TIFF of layers (name, scale, levels from full size down); smaller levels are SubIFDs of their layer."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4

    def put(level: np.ndarray, more: list) -> int:
        """Tiles and directory of one level; where the directory stands."""
        offsets, counts = [], []
        for ty in range(-(-level.shape[0] // tile)):
            for tx in range(-(-level.shape[1] // tile)):
                full = np.zeros((tile, tile, level.shape[2]), level.dtype.newbyteorder("<"))
                part = level[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
                full[: part.shape[0], : part.shape[1]] = part
                raw = zlib.compress(full.tobytes(), 1) if deflate else full.tobytes()
                offsets.append(len(out))
                counts.append(len(raw))
                out.extend(raw)
        out.extend(b"\0" * (len(out) % 2))
        place = len(out)
        grid = [(322, 4, (tile,)), (323, 4, (tile,)), (324, 4, tuple(offsets)), (325, 4, tuple(counts))]
        out.extend(_directory([*_sample_fields(level, deflate), *grid, *more], place))
        return place

    for name, scale, levels in layers:
        smaller = tuple(put(level, [(254, 4, (1,))]) for level in levels[1:])
        nested = [(330, 4, smaller)] if smaller else []
        place = put(levels[0], [(254, 4, (2 if len(layers) > 1 else 0,)), (269, 2, name.encode() + b"\0"), (37439, 12, (scale,)), *nested])
        out[link : link + 4] = struct.pack("<I", place)
        link = place + 2 + 12 * struct.unpack("<H", out[place : place + 2])[0]
    return bytes(out)


def encode_pyramids(tiles: DataFrame, tile: int, deflate: bool = True) -> DataFrame:
    """image_id, encoded: each image as one tiled TIFF, with a layer for every h_seq and its levels as SubIFDs.

    An image with all its levels is put together in one task, so this is for pictures of ordinary size; a
    collection of very large ones is written tile by tile (`encode_tiles`).  Layers take ``name`` and ``scale`` from columns
    of the tiles, if there are any.  Absent tiles are black.
    """
    more = [n for n in ("name", "scale") if n in tiles.columns]
    read = ["h_seq", "level", "tx", "ty", "width", "height", "channels", "bpc", "sample_type", "data", *more]

    def build(group: pa.Table) -> pa.Table:
        planes: dict[int, dict[int, list]] = {}
        for row in group.select(read).to_pylist():
            planes.setdefault(row["h_seq"], {}).setdefault(row["level"], []).append(row)
        layers = []
        for h_seq, levels in sorted(planes.items()):
            pictures = [_assembled(rows, tile) for _, rows in sorted(levels.items(), reverse=True)]
            first = next(iter(levels.values()))[0]
            layers.append((first.get("name") or f"layer {h_seq}", float(first.get("scale") or 1.0), pictures))
        return pa.table({"image_id": pa.array([group.column("image_id")[0].as_py()], pa.int64()), "encoded": pa.array([tiff_stack(layers, tile, deflate)], pa.binary())})

    return tiles.select("image_id", *read).groupBy("image_id").applyInArrow(build, "image_id long, encoded binary")


def _assembled(rows: list[dict], tile: int) -> np.ndarray:
    blocks = [(r["ty"] * tile, r["tx"] * tile, block_of(r)) for r in rows]
    out = np.zeros((max(y + b.shape[0] for y, _, b in blocks), max(x + b.shape[1] for _, x, b in blocks), blocks[0][2].shape[2]), blocks[0][2].dtype)
    for y, x, block in blocks:
        out[y : y + block.shape[0], x : x + block.shape[1]] = block
    return out


def encode_tiles(tiles: DataFrame, fmt: str = "png", deflate: bool = True) -> DataFrame:
    """Add ``encoded``: each tile as a PNG or TIFF file, with profile, XMP and resolution from the columns DESCRIBING."""
    read = [*_TILE, *[n for n in DESCRIBING if n in tiles.columns]]
    names = tiles.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema) + ", encoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [encode_row(r, fmt, deflate) for r in batch.select(read).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], names=[*names, "encoded"])

    return tiles.mapInArrow(run, schema)


def with_description(tiles: DataFrame, images: DataFrame, max_icc: int = -1, is_region: bool = False, processed: Column | None = None) -> DataFrame:
    """Tiles with the columns DESCRIBING by the rules for output: resolution of the level, a profile of up to ``max_icc``
    bytes (-1: any, 0: none) unless the colours are ``processed``, XMP with regions only.

    ``images`` has image_id, width, levels, colorspace, icc, xmp, dpi_x, dpi_y and dpi_units; it is joined by measured size.
    """
    from tessella.operators import catalog as B

    c, no = F.col, F.lit(False)
    head = images.select("image_id", "width", "height", "colorspace", "icc", "xmp", "dpi_x", "dpi_y", "dpi_units", F.explode("levels").alias("lv"))
    x, y = B.dpi_for_level(c("lv"))
    head = head.select("image_id", c("lv.level").alias("level"), "colorspace", "icc", "xmp", x.alias("dpi_x"), y.alias("dpi_y"), "dpi_units")
    joined = join_side_table(tiles, head, ["image_id", "level"], "left", spread_by=["tile"])
    icc = B.embed_icc(F.octet_length("icc"), max_icc, no if processed is None else processed, no, no, c("colorspace"))
    xmp = B.embed_xmp(F.octet_length("xmp"), F.lit(is_region))
    return joined.withColumns({"icc": F.when(icc, c("icc")), "xmp": F.when(xmp, c("xmp"))}).drop("colorspace")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class EncodedWriter(DataSourceArrowWriter):
    """Files of a job: tasks put them under a hidden folder beside the target, the commit moves them in.

    A new folder appears with all its files at once, by one move.  A job that fails leaves nothing.  A task that is run
    again writes the same names.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.format = options["path"].rstrip("/"), options.get("format", "png")
        self.deflate, self.name = options.get("deflate", "true") == "true", options.get("name", "file")
        folder, leaf = posixpath.split(self.path)
        self.draft = posixpath.join(folder, f".{leaf}.{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names = []
        for batch in iterator:
            wanted = [self.name, *_TILE, *[n for n in DESCRIBING if n in batch.schema.names]]
            for row in batch.select(wanted).to_pylist():
                leaf = row[self.name].lstrip("/")
                write_path(posixpath.join(self.draft, leaf), encode_row(row, self.format, self.deflate))
                names.append(leaf)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        where, draft = locate(self.draft)
        _, target = locate(self.path)
        where.create_dir(draft, recursive=True)
        if where.get_file_info(target).type.name == "NotFound":
            where.move(draft, target)
            return
        for name in (n for m in messages if m for n in m.names):
            where.create_dir(posixpath.dirname(posixpath.join(target, name)), recursive=True)
            where.move(posixpath.join(draft, name), posixpath.join(target, name))
        where.delete_dir(draft)

    def abort(self, messages: list[Written | None]) -> None:
        where, draft = locate(self.draft)
        if where.get_file_info(draft).type.name != "NotFound":
            where.delete_dir(draft)


class EncodedTiles(DataSource):
    """``tiles.write.format("encoded_tiles").mode("append")``: a PNG or TIFF file for every row, named by a column.

    Options: format (png or tiff), name (the column, file), deflate.
    """

    @classmethod
    def name(cls) -> str:
        return "encoded_tiles"

    def writer(self, schema, overwrite: bool) -> EncodedWriter:
        if overwrite:
            raise ValueError("encoded_tiles adds files to a folder or makes a new one; it does not overwrite")
        return EncodedWriter({k.lower(): v for k, v in self.options.items()})


def save_encoded(tiles: DataFrame, directory: str, fmt: str = "png", name: str = "file", deflate: bool = True) -> None:
    """Write every row as a file under ``directory``; all files appear when the job has succeeded."""
    spark = tiles.sparkSession
    spark.dataSource.register(EncodedTiles)
    shown = tiles.select(name, *_TILE, *[n for n in DESCRIBING if n in tiles.columns])
    writer = shown.write.format("encoded_tiles").mode("append").option("format", fmt).option("name", name).option("deflate", str(deflate).lower())
    writer.save(qualified(spark, directory))


def write_files(encoded: DataFrame, directory: str, name: str = "file") -> DataFrame:
    """Write the ``encoded`` bytes of each row from the tasks; returns (name, bytes) of what was written.

    The result is lazy: the files are there once it has been read.
    """
    root = qualified(encoded.sparkSession, directory).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for leaf, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                write_path(posixpath.join(root, leaf.lstrip("/")), data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[name, "bytes"])

    return encoded.select(name, "encoded").mapInArrow(run, f"{name} string, bytes long")
