"""Finding image files and reading pictures that Spark itself can decode."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.constants import SIGNATURES
from tessella.sources.storage import open_path
from tessella.sources.tiff import list_files


def classify(head: Column) -> Column:
    """Format by the first ten bytes."""
    text = F.hex(F.substring(head, 1, 10))
    out = F.lit("UNSUPPORTED")
    for name, magic in SIGNATURES:
        out = F.when(text.startswith(magic), name).otherwise(out)
    return out


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(image_id, path, mtime, length, format, error): a listing with ten bytes read per file."""
    files = list_files(spark, path, pattern).select(F.xxhash64("path").alias("image_id"), "path", "mtime", "length")
    names = files.columns

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for p in batch.column(1).to_pylist():
                with open_path(p) as stream:
                    starts.append(stream.read(10))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.binary())], names=[*names, "head"])

    read = files.mapInArrow(head, "image_id long, path string, mtime timestamp, length long, head binary")
    short = F.octet_length("head") < 10
    return read.select(
        *names, F.when(~short, classify(F.col("head"))).alias("format"), F.when(short, "unable to read initial bytes").alias("error")
    )


def scan_images(spark: SparkSession, path: str, tile: int | None = None) -> DataFrame:
    """Whole baseline pictures (JPEG, PNG, plain TIFF) as tiles, channels in R, G, B order.

    A picture is one row of Spark's image source, so this is for files that fit a row; its tiles leave
    the task as separate rows.  Without ``tile`` the picture is one tile.  A file that cannot be decoded is one row
    with an ``error`` and no data.
    """
    source = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)
    flat = source.select(F.xxhash64("image.origin").alias("image_id"), F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.data")
    schema = (
        "image_id long, path string, h_seq int, v_seq int, level int, tile int, tx int, ty int, width int, height int, channels int, "
        "bpc int, sample_type string, data binary, img_w int, img_h int, error string"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.string()] + [pa.int32()] * 10 + [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if not r["data"] or (r["nChannels"] or 0) < 1:
                    blank = (r["image_id"], r["path"], *[None] * (len(names) - 3), "undecodable picture")
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(blank, kinds)], names=names)
                    continue
                block = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                if r["nChannels"] >= 3:
                    block = np.concatenate([block[..., 2::-1], block[..., 3:]], axis=2)
                side_w, side_h = tile or r["width"], tile or r["height"]
                ntx = -(-r["width"] // side_w)
                rows = []
                for ty in range(-(-r["height"] // side_h)):
                    for tx in range(ntx):
                        part = block[ty * side_h : (ty + 1) * side_h, tx * side_w : (tx + 1) * side_w]
                        rows.append((r["image_id"], r["path"], 0, 90, 0, ty * ntx + tx, tx, ty, part.shape[1], part.shape[0], part.shape[2], 8, "FIXEDPOINT", part.tobytes(), r["width"], r["height"], None))
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), kinds)], names=names)

    return flat.mapInArrow(cut, schema)
