"""Token-id files: a concatenated id array, with document boundaries and doc_ids in Elias-Fano form.

A folder holds shards in ascending doc_id order.  A shard is

    ids, fixed width (2 bytes if the vocabulary allows, else 4) | index | length of the index (8 bytes) | b"TSIDS1"

and the index is a JSON line with the counts, then the sections of two Elias-Fano sequences: where documents end
in the id array, and the doc_ids less the smallest.  n values below u take n * (2 + log2(u / n)) bits: the low bits
of each value, packed, and the high bits in unary.  The position of every 512th one is sampled, so that the i-th
value is found by a look at a few bytes behind a sample: no table of 64-bit offsets.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import kept, row_blocks
from tessella.llm.tokens import encode_all, encoder
from tessella.sources.storage import locate

MAGIC, SAMPLE = b"TSIDS1", 512


class EliasFano:
    """A non-decreasing sequence of integers from 0 up."""

    def __init__(self, count: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.width, self.low, self.high, self.samples = count, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(bool).ravel(), bitorder="little")
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, bool)
        flags[ones] = True
        return cls(n, width, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def sections(self) -> tuple[list[int], bytes]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return [self.count, self.width, *map(len, parts)], b"".join(parts)

    @classmethod
    def read(cls, sizes: list[int], data: memoryview) -> EliasFano:
        count, width, a, b, c = sizes
        part = lambda lo, n, kind: np.frombuffer(data[lo : lo + n], kind)
        return cls(count, width, part(0, a, np.uint8), part(a, b, np.uint8), part(a + b, c, "<u8"))

    def _low(self, i: int) -> int:
        at, n = i * self.width, self.width
        piece = int.from_bytes(self.low[at // 8 : (at + n + 7) // 8].tobytes(), "little")
        return piece >> at % 8 & (1 << n) - 1

    def __getitem__(self, i: int) -> int:
        """The i-th value, by select on the high bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left, at = i % SAMPLE, start // 8
        skip = start % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[at : at + 256], bitorder="little")[skip:])
            if left < len(ones):
                place = at * 8 + skip + int(ones[left])
                return (place - i) << self.width | self._low(i)
            left, at, skip = left - len(ones), at + 256, 0

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.width)
        bits = np.unpackbits(self.low, count=self.count * self.width, bitorder="little").reshape(self.count, self.width)
        return high + (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Shard:
    """Reader of one file: boundaries and doc_ids by select, ids by range reads."""

    def __init__(self, path: str) -> None:
        where, name = locate(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(14, size - 14)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        length = int.from_bytes(tail[:8], "little")
        head, _, body = self.file.read_at(length, size - 14 - length).partition(b"\n")
        meta, data = json.loads(head), memoryview(body)
        self.documents, self.nulls, self.least, self.kind = meta["documents"], meta["nulls"], meta["least"], np.dtype(meta["kind"])
        ends = meta["ends"]
        self.ends = EliasFano.read(ends, data)
        self.names = EliasFano.read(meta["names"], data[sum(ends[2:]) :])

    def doc_id(self, i: int) -> int | None:
        return self.names[i] + self.least if i < self.documents - self.nulls else None

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.read(lo, hi)

    def read(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((hi - lo) * self.kind.itemsize, lo * self.kind.itemsize), self.kind)


def write_shard(path: str, blocks: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]], wide: bool) -> tuple[int, int]:
    """Write blocks of (doc_ids, ids, counts), null doc_ids last; documents and ids written.

    Ids take 4 bytes if ``wide``, else 2; an id that does not fit is an error.

    Ids go out block by block, only boundaries and doc_ids stay in memory.  The file is written under a hidden name
    and moved, so a task that is run again leaves a whole file.
    """
    where, name = locate(path)
    folder, leaf = posixpath.split(name)
    where.create_dir(folder, recursive=True)
    draft = posixpath.join(folder, f".{leaf}.{uuid.uuid4().hex}")
    kind = "<u4" if wide else "<u2"
    names: list[int | None] = []
    counts: list[np.ndarray] = [np.zeros(0, np.int64)]
    with where.open_output_stream(draft) as out:
        for docs, ids, sizes in blocks:
            if not wide and len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError(f"id {int(ids.max())} does not fit two bytes")
            out.write(ids.astype(kind).tobytes())
            names += docs
            counts.append(sizes)
        known = [d for d in names if d is not None]
        least = known[0] if known else 0
        ends = np.cumsum(np.concatenate(counts))
        end_sizes, end_data = EliasFano.of(ends).sections()
        name_sizes, name_data = EliasFano.of(np.array([d - least for d in known], np.uint64)).sections()
        meta = {"documents": len(names), "nulls": len(names) - len(known), "least": least, "kind": kind, "ends": end_sizes, "names": name_sizes}
        index = json.dumps(meta).encode() + b"\n" + end_data + name_data
        out.write(index + len(index).to_bytes(8, "little") + MAGIC)
    where.move(draft, name)
    return len(names), int(ends[-1]) if len(ends) else 0


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode every text, append ``end_id``, and write shards in ascending doc_id order; returns the shard table.

    Ids take 2 bytes if the vocabulary and ``end_id`` allow, else 4.  A null text is empty.  Rows with equal doc_ids follow each other by the hash of their text; rows without doc_id
    come last.  Range partitioning by (doc_id, hash) also splits a doc_id that very many rows share.
    The shard table (shard, path, documents, ids, before: ids of all shards before it) has a row per file.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("_h").asc()]
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path = f"{folder}/ids-{shard:06d}.tsids"

        def blocks():
            for batch in batches:
                names = batch.column("doc_id").to_pylist()
                for lo, hi, ids, counts in encode_all(tokenizer, batch.column("text")):
                    yield names[lo:hi], np.insert(ids, np.cumsum(counts), end_id), counts + 1

        documents, ids = write_shard(path, blocks(), max(encoder(tokenizer).largest, end_id) > 0xFFFF)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "documents": [documents], "ids": [ids]})

    shards = kept(rows.mapInArrow(write, "shard long, path string, documents long, ids long").where("documents > 0"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document, from the files of a shard table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                ends = shard.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                known = shard.names.all().astype(np.int64) + shard.least
                for lo, hi in row_blocks(np.concatenate([[0], ends]), 1 << 20):
                    ids = shard.read(int(starts[lo]), int(ends[hi - 1])).astype("<u4")
                    cut = [ids[a:b] for a, b in zip(starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo], strict=True)]
                    names = [*known[lo:hi].tolist(), *[None] * (hi - max(lo, len(known)))][: hi - lo]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(starts[lo:hi] + row["before"]), pa.array(ends[lo:hi] - starts[lo:hi]), pa.array([zlib.crc32(x) for x in cut], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = max(1, shards.count())  # one task a file: adaptive execution would join these short rows into few tasks
    return shards.select("shard", "path", "before").repartition(files, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_table(spark: SparkSession, folder: str) -> DataFrame:
    """The shard table of a folder written earlier, from a listing of its files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.tsids").load(folder).select("path")
    numbered = files.withColumn("shard", F.regexp_extract("path", r"ids-(\d+)\.tsids$", 1).cast("long"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                ids = shard.ends[shard.documents - 1] if shard.documents else 0
                yield pa.RecordBatch.from_pydict({"shard": [row["shard"]], "path": [row["path"]], "documents": [shard.documents], "ids": [ids]})

    found = numbered.mapInArrow(look, "shard long, path string, documents long, ids long")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
