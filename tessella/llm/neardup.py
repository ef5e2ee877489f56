"""Near-duplicate documents by min-max hashing: bands of signatures propose, full shingle sets decide.

Under each random permutation of the shingle hashes both the smallest and the largest value are kept, so one hash
evaluation gives two signature values, each equal for two sets with the probability of their similarity.  Bands of
``rows`` values each are the buckets; their number is chosen so that a pair at the threshold shares none with a
probability below ``miss``.

Texts with equal sets are one class from the start.  Every bucket then compares its most connected class, the hub, with
its other classes, which settles groups of copies at one comparison each.  What is left, classes in buckets that still
hold several components, is compared by an exact prefix filter on their rarest shingles.  So no bucket emits
all its pairs, and every pair of a bucket is compared, shown to be below the threshold, or already connected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import BLANK_BYTES, LOWER_BYTES, components, kept, mixed, span_hashes, text_blocks, word_spans
from tessella.session import join_side_table

#: Partners of one hub that are compared in one group, about.  A hub's set is sent once to each group, and the number
#: of groups follows the partners.
PARTNERS = 256


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text.

    A-Z are lower-cased; words are runs without blank, tab or line end.  A text of fewer than ``words`` words has its
    whole sequence as one shingle; without words its set is empty.
    """
    factors = np.array([pow(0xA0761D6478BD642F, k + 1, 2**64) for k in range(words)], np.uint64)
    for lo, hi, data, offsets in text_blocks(column):
        low = LOWER_BYTES[data]
        starts, ends = word_spans(~BLANK_BYTES[low], offsets)
        hashes = span_hashes(low, starts, ends)
        first = np.searchsorted(starts, offsets)
        n = len(hashes) - words + 1
        rolled = hashes[:0]
        if n > 0:
            rolled = sum((hashes[k : k + n] * factors[k] for k in range(words)), np.zeros(n, np.uint64))
            rolled = mixed(rolled)
        for row in range(hi - lo):
            a, b = int(first[row]), int(first[row + 1])
            if b - a >= words:
                yield lo + row, np.unique(rolled[a : b - words + 1])
            elif b > a:
                short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield lo + row, mixed(np.array([short], np.uint64))
            else:
                yield lo + row, hashes[:0]


def class_key(values: np.ndarray) -> bytes:
    """128-bit digest of a shingle set: texts with equal ones are one class."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _row_hashes() -> list[Column]:
    """Two hashes that together stand for a row's doc_id and text, nulls included."""
    doc = F.col("doc_id").cast("long")
    return [F.xxhash64(doc, "text").alias("h"), F.xxhash64("text", F.lit(1), doc).alias("g")]


def band_count(similarity: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def min_max(values: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set under each permutation value * factor + shift (modulo 2^64)."""
    low, high = np.full(len(factors), 2**64 - 1, np.uint64), np.zeros(len(factors), np.uint64)
    for at in range(0, len(values), 4096):
        seen = values[at : at + 4096, None] * factors + shifts
        np.minimum(low, seen.min(axis=0), out=low)
        np.maximum(high, seen.max(axis=0), out=high)
    return np.concatenate([low, high])


def sketches(docs: DataFrame, words: int, similarity: float, rows: int, miss: float) -> DataFrame:
    """Per document: doc_id, h and g (``_row_hashes``), n_shingles, cls (`class_key` of its set; null for an empty set), bands."""
    bands = band_count(similarity, rows, miss)
    seeds = np.random.default_rng(11)
    count = -(-bands * rows // 2)
    factors = seeds.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1)
    shifts = seeds.integers(0, 2**64, count, dtype=np.uint64)
    spread = seeds.integers(0, 2**64, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, found = [], [], []
            for _, values in shingle_sets(batch.column("text"), words):
                sizes.append(len(values))
                if len(values):
                    classes.append(class_key(values))
                    marks = min_max(values, factors, shifts)[: bands * rows].reshape(bands, rows)
                    keys = mixed((mixed(marks) * spread).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                    found.append(keys.view(np.int64))
                else:
                    classes.append(None)
                    found.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), batch.column("g"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), lists],
                names=["doc_id", "h", "g", "n_shingles", "cls", "bands"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), "text", *_row_hashes())
    return kept(texts.mapInArrow(sketch, "doc_id long, h long, g long, n_shingles long, cls binary, bands array<long>"))


def class_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls and set (sorted distinct shingle hashes) of the classes in ``wanted`` (cls, h and g of one member)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, values = batch.column("cls"), [], []
            for row, found in shingle_sets(batch.column("text"), words):
                rows.append(row)
                values.append(found)
            ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
            own = pa.array([class_key(v) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, own, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cls", "own", "set"])

    members = docs.select("text", *_row_hashes())
    chosen = members.join(wanted, ["h", "g"]).select("cls", "text")
    # a row that is repeated as a whole brings its set more than once
    return kept(chosen.mapInArrow(build, "cls binary, own binary, set array<long>").where("cls = own").drop("own").dropDuplicates(["cls"]))


def parts_of(pairs: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """``pairs`` (a, b) with part: the partners of one a are dealt into groups of about ``partners``."""
    pairs = kept(pairs)
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > partners)
    dealt = join_side_table(pairs, many.select("a", F.ceil(F.col("n") / partners).alias("parts")), ["a"], "left", spread_by=["b"])
    return dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union.  a's set goes to each group of its partners."""
    pairs = parts_of(pairs)
    hubs = pairs.select("a", "part").distinct().join(sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), "a")
    others = pairs.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b")
    both = others.join(hubs, ["a", "part"]).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * percent).drop("part", "sa", "sb", "shared")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-7) -> DataFrame:
    """Per document: doc_id, h, g, n_shingles, cls, component_id (smallest doc_id it is linked with, itself included), kept.

    A null or empty text has an empty set and is linked with nothing.  Rows that repeat a doc_id each get a row; equal
    texts are one class, so their component is the same.  A null doc_id takes part; if nothing in its component has a
    doc_id, component_id is null, and kept is true for rows whose doc_id equals component_id, null included.
    """
    marked = sketches(docs, words, percent / 100, rows, miss)
    member = F.min(F.struct("h", "g")).alias("member")
    classes = marked.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), member, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    entries = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = kept(entries.join(shared, "bucket"))
    degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))
    members = kept(members.drop("size").join(degree, "cls"))
    labels = None
    if members.head(1):
        wanted = classes.join(degree.select("cls"), "cls", "left_semi").select("cls", "member.h", "member.g")
        sets = class_sets(docs, wanted, words)
        order = Window.partitionBy("bucket").orderBy(F.col("degree").desc(), "cls")
        hubs = members.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("bucket", F.col("cls").alias("a"), F.col("n").alias("na"))
        near = (F.col("cls") != F.col("a")) & (F.least("n", "na") * 100 >= F.greatest("n", "na") * percent)
        found = kept(links(members.join(hubs, "bucket").where(near).select("a", F.col("cls").alias("b")).distinct(), sets, percent))
        labels = kept(components(found))
        members = members.join(labels.select(F.col("v").alias("cls"), "label"), "cls", "left")
        left = kept(_open(members.select("bucket", "cls", F.coalesce("label", "cls").alias("comp"))))
        if left.head(1):
            more = kept(links(_prefix_pairs(left, sets, percent), sets, percent))
            if more.head(1):
                labels = components(found.unionByName(more))
    if labels is None:
        labelled = classes.select("cls", "doc_id", F.col("cls").alias("label"))
    else:
        named = labels.select(F.col("v").alias("cls"), "label")
        labelled = classes.select("cls", "doc_id").join(named, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("least"))
    of_class = labelled.join(least, "label").select("cls", "least")
    out = marked.drop("bands").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "h", "g", "n_shingles", "cls", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _open(members: DataFrame) -> DataFrame:
    """cls and comp of the classes in buckets that hold more than one component."""
    several = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return members.join(several, "bucket").select("cls", "comp").distinct()


def _prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``left`` (cls, comp) in different components that can reach the threshold; none that does is missed.

    With shingles ordered from the rarest on, two sets with an overlap of at least ``need`` have their first common
    shingle at positions up to n - need in both.  Copies that differ too much from their hub start with shingles of
    their own changes, so they meet few others.  In the rows of one shingle, the component with most of them is only
    compared with the others, never within itself.
    """
    tokens = left.join(sets, "cls").select("cls", "comp", F.size("set").alias("n"), F.explode("set").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    ranked = tokens.join(often, "token", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy("often", "token")) - 1)
    heads = kept(ranked.where(f"often > 1 AND place <= n - (n * {percent} + 99) div 100").select("token", "cls", "comp", "n", "place"))
    counts = heads.groupBy("token", "comp").agg(F.count("*").alias("rows"))
    main = counts.groupBy("token").agg(F.max(F.struct("rows", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    shared = heads.join(main.select("token", F.col("top.comp").alias("main")), "token")
    few = shared.where("comp <> main").select("token", F.col("cls").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"))
    need = f"(({percent} * (n + na) + {99 + percent}) div {100 + percent})"
    both = few.join(shared, "token").where("comp <> ca AND (comp = main OR a < cls)").where(f"pa <= na - {need} AND place <= n - {need}")
    return both.select(F.col("a").alias("b"), F.col("cls").alias("a")).distinct()


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id, once.  Documents without words stay."""
    judged = near_duplicates(docs, words, percent).where("kept").select(F.col("h").alias("_h"), F.col("g").alias("_g")).distinct()
    h, g = _row_hashes()
    keyed = docs.withColumns({"_h": h, "_g": g}).join(judged, ["_h", "_g"], "left_semi")
    # rows that repeat come once; the join has brought them together
    return keyed.dropDuplicates(["_h", "_g"]).select(*docs.columns)
