"""Packing documents into sequences along a space-filling curve.

A document becomes a vector of hashed byte trigrams, projected to three dimensions; its place on a Hilbert curve
through them is the key of a range sort, so neighbours along the order read alike.  Every range partition is packed
for itself: its documents follow each other without gaps and are cut where a sequence is full.  What is left at the
end of a partition is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_blocks
from tessella.llm.tokens import encode_all

#: Places of the hashed vector, dimensions of the projection, bits of each coordinate.
PLACES, DIMENSIONS, BITS = 256, 3, 20
_PROJECTION = np.random.default_rng(3).standard_normal((PLACES, DIMENSIONS))


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of trigram counts of the texts in a block (damped by the square root)."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    counts = np.zeros(rows * PLACES, np.int64)
    if len(data) > 2:
        code = data.astype(np.uint32)
        mix = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA6B) + code[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(24)
        row = np.repeat(np.arange(rows), lengths)
        whole = row[:-2] == row[2:]
        counts += np.bincount(row[:-2][whole] * PLACES + mix[whole], minlength=rows * PLACES)
    weights = np.sqrt(counts.reshape(rows, PLACES))
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer ``points`` (n, dimensions) below 2^bits on the Hilbert curve.

    The curve's Gray code is undone bit by bit from the top: a coordinate whose bit is set flips the lower bits of the
    first one, otherwise the two exchange them; then the bits of all coordinates are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            flip = (x[d] >> bit) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> bit) & 1 == 1, turn ^ ((1 << bit) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> bit) & 1
    return key


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert key of every text; a projected coordinate between -2 and 2 is cut into 2^BITS steps."""
    out = np.zeros(len(column), np.int64)
    for lo, hi, data, offsets in text_blocks(column):
        place = np.clip((vectors(data, offsets) @ _PROJECTION + 2) / 4, 0, 1 - 1e-9)
        out[lo:hi] = hilbert_keys((place * (1 << BITS)).astype(np.int64))
    return out


class Packer:
    """Cuts documents, given in order, into pieces of sequences; a piece is (doc, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, first: int, length: int) -> None:
        self.sequence, self.length, self.filled = first, length, 0
        self.open: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, self.length - self.filled)
            self.open.append((doc, start, ids[start : start + take], len(ids)))
            self.filled += take
            start += take
            if self.filled == self.length:
                yield from self._close(self.open)
                self.open, self.filled = [], 0

    def finish(self) -> Iterator[tuple]:
        """The pieces of the last sequence, cut anew into sequences of falling powers of two."""
        left, size = self.open, 1 << max(self.filled.bit_length() - 1, 0)
        while left:
            while size > sum(len(p[2]) for p in left):
                size >>= 1
            part, rest, room = [], [], size
            for doc, start, ids, tokens in left:
                if room:
                    part.append((doc, start, ids[:room], tokens))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], tokens))
                room = max(0, room - len(ids))
            yield from self._close(part)
            left = rest

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, tokens in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.sequence, offset
            offset += len(ids)
        self.sequence += 1


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, sequences_per_task: int = 1 << 33) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and still has its end id.  Documents with equal keys are ordered by doc_id (null first) and
    the hash of their text, so a task that is run again packs alike; rows that repeat are packed as often as they come.
    """

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array(curve_keys(texts))

    order = ["_key", "doc_id", "_h"]
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h")).withColumn("_key", key("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() * sequences_per_task, length)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for lo, hi, ids, counts in encode_all(tokenizer, batch.column("text")):
                ends = np.cumsum(counts)
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                pieces = [p for doc, x, y in zip(names[lo:hi], np.concatenate([[0], ends[:-1]]), ends, strict=True) for p in packer.add(doc, ids[x:y])]
                packer.open = [(d, s, i.copy(), t) for d, s, i, t in packer.open]
                if pieces:
                    yield _batch(pieces)
        last = list(packer.finish())
        if last:
            yield _batch(last)

    return rows.mapInArrow(fill, ", ".join(f"{n} long" for n in _NAMES))


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names=_NAMES)
