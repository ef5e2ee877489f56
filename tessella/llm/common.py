"""Helpers of the training-data operators: word classes, text bytes as NumPy arrays, checkpoints and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import shared_dir
from tessella.sources.storage import qualified

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte tables.  Bytes of 128 and up only occur inside UTF-8 characters beyond ASCII.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
BLANK_BYTES = np.zeros(256, dtype=bool)
BLANK_BYTES[[32, *range(9, 14)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that later steps neither repeat it nor
    depend on an executor that may be gone."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own under the shared one."""
    return f"{qualified(spark, shared_dir(spark))}/{kind}-{uuid.uuid4().hex}"


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, and where each row starts and ends in them; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    whole = np.frombuffer(data, np.uint8) if data is not None and last > first else np.zeros(0, np.uint8)
    return whole[first:last], offsets - first


def row_blocks(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``limit`` bytes together; a longer row comes alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def text_blocks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of blocks of a text column, so that arrays made from it stay small."""
    data, offsets = text_bytes(column)
    for lo, hi in row_blocks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of true bytes; a run never goes on into the next row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = inside[starts]
    ends = starts[1:] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (two rounds of shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_SEEDS = np.random.default_rng(7)
_BYTE_VALUES = _SEEDS.integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = np.ones(1, np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over seeded byte values, then mixed with the length."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    most = int(lengths.max())
    if most > len(_POWERS):
        factors = np.full(most, 0xD1342543DE82EF95, np.uint64)
        factors[0] = 1
        _POWERS = np.multiply.accumulate(factors)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    values = _BYTE_VALUES[data[np.repeat(starts, lengths) + place]] * _POWERS[place]
    return mixed(np.add.reduceat(values, begin) + lengths.astype(np.uint64))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): vertex v and the smallest vertex it is connected with.

    Alternates two contractions until nothing moves: every vertex hands the smallest neighbour to its larger
    neighbours, then to its smaller ones.  Minima are aggregates, combined before the shuffle, and go back by
    joins that adaptive execution can split, so a vertex with many neighbours is no group of its own.
    """
    links = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = kept(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct()
    return links.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
