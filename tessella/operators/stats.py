"""Histograms and what is derived from them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import pixelops
from tessella.operators.tiles import block_of, map_blocks, runs
from tessella.schema import VERSION_KEY
from tessella.session import join_side_table

BINS = 256
_READ = ["width", "height", "channels", "bpc", "sample_type", "data"]


def histogram(tiles: DataFrame, key: str = "image_id", lo: str | None = None, hi: str | None = None) -> DataFrame:
    """(key, bin, n): one 256-bin histogram for all channels of an image.

    Deeper samples are first mapped to 8 bit by the range columns ``lo`` and ``hi``.  Tiles are counted
    where they lie; at most 256 numbers per image and batch reach the partial and final sums.  Pass
    only thumbnail tiles for the cheap estimate, or all tiles of a level for the exact answer.
    """
    key_type = tiles.schema[key].dataType.simpleString()
    ranges = [c for c in (lo, hi) if c]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for row in (row for part in runs([batch]) for row in part.to_pylist()):
                block = block_of(row)
                if row["bpc"] > 8:
                    block = pixelops.contrast(pixelops.normalize(block, row[lo], row[hi]), 1.0)
                if block.shape[2] > 1:
                    block = np.floor(block.mean(axis=2) + 0.5).astype(np.uint8)
                n = np.bincount(block.reshape(-1), minlength=BINS)
                sums[row[key]] = sums[row[key]] + n if row[key] in sums else n
            if sums:
                table = np.stack(list(sums.values()))
                rows, bins = np.nonzero(table)
                keys = pa.array(list(sums), batch.schema.field(0).type).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(bins.astype(np.int32)), pa.array(table[rows, bins].astype(np.int64))],
                    names=[key, "bin", "n"],
                )

    partial = tiles.select(key, *_READ, *ranges).mapInArrow(count, f"{key} {key_type}, bin int, n long")
    return partial.groupBy(key, "bin").agg(F.sum("n").alias("n"))


def pixel_histogram(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """The same from 8-bit pixel rows: mean over channels, then counts."""
    mean = pixels.groupBy(key, "h_seq", "v_seq", "level", "y", "x").agg(F.avg("v").alias("m"))
    return mean.groupBy(key, F.round("m").cast("int").alias("bin")).agg(F.count("*").alias("n"))


def data_range(tiles: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, c, lo, hi): range of the samples per channel; partial ranges come from each batch."""
    key_type = tiles.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            keys, channel, low, high = [], [], [], []
            for i, row in enumerate(batch.to_pylist()):
                block = block_of(row)
                keys += [i] * block.shape[2]
                channel += range(block.shape[2])
                low += block.min(axis=(0, 1)).astype(float).tolist()
                high += block.max(axis=(0, 1)).astype(float).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(channel, pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())],
                names=[key, "c", "lo", "hi"],
            )

    partial = tiles.select(key, *_READ).mapInArrow(scan, f"{key} {key_type}, c int, lo double, hi double")
    return partial.groupBy(key, "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def range_arrays(ranges: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, lo[], hi[]): one array entry per channel."""
    gathered = ranges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c", "lo", "hi"))).alias("r"))
    return gathered.select(key, F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


def cdf(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """Running sum of the bins; a window partition is one image with at most 256 rows."""
    w = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cdf", F.sum("n").over(w))


def otsu_threshold(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, threshold): bin with the largest between-class variance, the first on ties, else 0."""
    up = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    n = F.col("n").cast("double")
    moment = n * F.col("bin")
    sums = hist.select(
        key,
        "bin",
        F.sum(n).over(up).alias("wb"),
        F.sum(moment).over(up).alias("sb"),
        F.sum(n).over(whole).alias("np"),
        F.sum(moment).over(whole).alias("sn"),
    )
    wf = F.col("np") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("sn") - F.col("sb")) / wf
    score = F.when((F.col("wb") > 0) & (wf > 0), F.col("wb") * wf * gap * gap).otherwise(0.0)
    best = sums.groupBy(key).agg(F.max(F.struct(score.alias("s"), (-F.col("bin")).alias("b"))).alias("m"))
    return best.select(key, F.when(F.col("m.s") > 0, -F.col("m.b")).otherwise(0).cast("int").alias("threshold"))


def stretch_range(hist: DataFrame, key: str = "image_id", shift: Column | int = 0) -> DataFrame:
    """(key, lo, hi): first and last bin in use, moved up for deeper fixed-point samples."""
    factor = F.pow(F.lit(2.0), shift if isinstance(shift, Column) else F.lit(shift))
    used = hist.where("n > 0").groupBy(key).agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"))
    return used.select(key, (F.col("b0") * factor).alias("lo"), (F.col("b1") * factor).alias("hi"))


def histogram_arrays(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, hist): the 256 counts of an image as one array."""
    counts = hist.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    return counts.select(key, dense.alias("hist"))


def equalize_table(hist: DataFrame, pixels: DataFrame | None, key: str = "image_id", standard: bool = False) -> DataFrame:
    """(key, lut): 256-entry map per image.

    ``pixels`` (key, np) holds the pixel count of the output; the first count is divided by it unless
    ``standard`` asks for the textbook form.
    """
    running = cdf(hist, key)
    gathered = running.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("bin", "cdf"))).alias("h"), F.max("cdf").alias("total")
    )
    if not standard:
        gathered = gathered.join(pixels, key)
    first = F.col("h")[0]["cdf"]
    low = first if standard else first / F.col("np")
    room = (F.col("total") - first) if standard else F.col("total")
    filled = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        F.expr("named_struct('out', cast(array() as array<bigint>), 'i', 0)"),
        lambda acc, b: F.struct(
            F.array_append(
                acc["out"],
                F.when((acc["i"] < F.size("h")) & (F.get("h", acc["i"])["bin"] == b), F.get("h", acc["i"])["cdf"])
                .when(acc["i"] > 0, F.element_at(acc["out"], -1))
                .otherwise(F.lit(0).cast("long")),
            ).alias("out"),
            (acc["i"] + F.when((acc["i"] < F.size("h")) & (F.get("h", acc["i"])["bin"] == b), 1).otherwise(0)).alias("i"),
        ),
        lambda acc: acc["out"],
    )
    value = lambda n: F.pmod(F.round((BINS - 1) / room * (n - low)).cast("int"), F.lit(256))
    return gathered.select(key, F.transform(filled, value).alias("lut"))


def equalize(tiles: DataFrame, luts: DataFrame, key: str = "image_id") -> DataFrame:
    """Map 8-bit tiles through their image's table."""
    joined = join_side_table(tiles, luts, [key], "inner", spread_by=["tx", "ty"])
    return map_blocks(joined, lambda b, r: pixelops.lookup(b, r["lut"]), using=("lut",), drop=("lut",))


def binarize(tiles: DataFrame, thresholds: DataFrame, key: str = "image_id") -> DataFrame:
    joined = join_side_table(tiles, thresholds, [key], "inner", spread_by=["tx", "ty"])
    return map_blocks(joined, lambda b, r: pixelops.binary(b, r["threshold"]), using=("threshold",), drop=("threshold",))


def tile_counts(levels: DataFrame) -> DataFrame:
    """Tiles per image and level, with image and grand totals.

    Levels are dealt by image and summed once; images are summed from that and the total from the images, so no task
    has three groups of every level of a whole file split.
    """
    n = levels.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tiles = F.col("ntx").cast("long") * F.col("nty")
    dealt = levels.select("image_id", "level", tiles.alias("n_tiles")).repartition(int(n), "image_id")
    per_level = dealt.groupBy("image_id", "level").agg(F.sum("n_tiles").alias("n_tiles"))
    per_image = per_level.groupBy("image_id").agg(F.sum("n_tiles").alias("n_tiles"))
    total = per_image.agg(F.sum("n_tiles").alias("n_tiles"), F.count("*").alias("_n")).where("_n > 0").drop("_n")
    none = lambda name: F.lit(None).cast(levels.schema[name].dataType).alias(name)
    return per_level.unionByName(per_image.withColumn("level", none("level"))).unionByName(
        total.withColumns({"image_id": none("image_id"), "level": none("level")})
    )


def latest_tile(tiles: DataFrame, key: tuple[str, ...] = tuple(VERSION_KEY)) -> DataFrame:
    """Newest version of each tile.

    The winner is found on the narrow key columns with map-side combining, and the data joins on the key and the
    time, so a key with very many versions is no hot group.  A version without time is older than any other; a NULL
    in the key is a value like others.
    """
    names = [f"_{k}" for k in (*key, "mtime")]
    newest = tiles.groupBy(*key).agg(F.max("mtime").alias("mtime")).toDF(*names)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip((*key, "mtime"), names)])
    return tiles.join(newest, same).drop(*names).dropDuplicates([*key])


def distinct_tiles(wanted: DataFrame, key: tuple[str, ...] = tuple(VERSION_KEY)) -> DataFrame:
    """One row per tile for a batch of requests, so that no tile is read twice."""
    return wanted.select(*key).distinct()


def compression_ratio(tiles: DataFrame) -> DataFrame:
    raw = F.col("width").cast("long") * F.col("height") * F.col("channels") * F.col("bpc") / 8
    return tiles.groupBy("level", "encoding").agg(
        F.sum(F.octet_length("data")).alias("encoded_bytes"),
        F.sum(raw).alias("raw_bytes"),
        (F.sum(F.octet_length("data")) / F.sum(raw)).alias("ratio"),
    )
