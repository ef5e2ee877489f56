"""Language identification by string kernels.

Two texts are compared by the n-grams of 1 to 4 characters both have (a blended spectrum of presences), divided by
the geometric mean of how many each has.  Ridge regression with this kernel, one language against the rest, is
fitted on the Nyström approximation by a few landmark texts.  Its decision is linear in the presences, so whole
batches are scored by one matrix product: presences times (landmark presences times coefficients).

N-grams are hashed into ``SIZE`` places.  Fitting takes at most ``per_class`` texts of each language (the first in
hashed order of doc_id); what comes to the driver are their presence bits, SIZE / 8 bytes a text, not the texts.

A decision is trusted if its margin, the lead over the next language, reaches a bound that depends on the size of the
text.  Bounds are measured on all held-out texts that were decided as labelled, and on their beginnings for short texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import kept, row_blocks, text_bytes

SIZE, LONGEST = 1 << 15, 4
UNKNOWN = "und"
#: For the bounds: beginnings of held-out texts that are measured, in characters; how many margins a size needs; the
#: quantile of clean margins, and the part of it that is enough.
BEGINNINGS, LEAST, RARE, ENOUGH = (32, 128, 512), 20, 0.01, 0.5
_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = [[(0x9E3779B1 * (n * 7 + k + 1) | 1) & 0xFFFFFFFF for k in range(n)] for n in range(1, LONGEST + 1)]


def presences(texts: list[str | None], rows: int = 64, chars: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last row, and the matrix (rows, SIZE) of which hashed n-grams each lower-cased text has.

    Work goes by up to ``chars`` characters; a longer text is taken in pieces that overlap by LONGEST - 1.
    """
    for lo in range(0, len(texts), rows):
        some = [(t or "").lower() for t in texts[lo : lo + rows]]
        found = np.zeros((len(some), SIZE), np.float32)
        pieces = [(i, t[a : a + chars + LONGEST - 1]) for i, t in enumerate(some) for a in range(0, max(1, len(t) - LONGEST + 1), chars)]
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= chars):
                size += len(pieces[end][1])
                end += 1
            _mark(found, pieces[at:end])
            at = end
        yield lo, lo + len(some), found


def _mark(found: np.ndarray, pieces: list[tuple[int, str]]) -> None:
    code = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.array([i for i, _ in pieces]), [len(p) for _, p in pieces])
    piece = np.repeat(np.arange(len(pieces)), [len(p) for _, p in pieces])
    flat = found.reshape(-1)
    for factors in _FACTORS:
        n = len(factors)
        count = len(code) - n + 1
        if count <= 0:
            break
        h = code[:count] * np.uint32(factors[0])
        for k in range(1, n):
            h += code[k : k + count] * np.uint32(factors[k])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        place = row[:count] * SIZE + (h >> np.uint32(17))
        flat[place if n == 1 else place[piece[:count] == piece[n - 1 :]]] = 1.0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that only a few megabytes of text are Python strings at a time."""
    for batch in batches:
        for lo, hi in row_blocks(text_bytes(batch.column("text"))[1], 1 << 21):
            yield batch.slice(lo, hi - lo)


def _size_class(sizes: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(sizes, 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # (SIZE, labels)
    bounds: np.ndarray | None = None  # least margin by size class; None if there was too little to measure them on

    def values(self, texts: list[str | None]) -> Iterator[tuple[str | None, np.ndarray, int]]:
        """Each text, its decisions (labels), and how many places its n-grams have."""
        for lo, hi, found in presences(texts):
            sizes = found.sum(axis=1)
            yield from zip(texts[lo:hi], (found @ self.weights) / np.sqrt(np.maximum(sizes, 1))[:, None], sizes.astype(int), strict=True)

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (softmax of the decisions) of each text; UNKNOWN and 0 without any letter."""
        names, scores = [], []
        for text, value, _ in self.values(texts):
            if text is None or not self.labels or not _LETTER.search(text):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                chance = np.exp(4 * (value - value.max()))
                names.append(self.labels[int(value.argmax())])
                scores.append(float(chance.max() / chance.sum()))
        return names, scores

    def margins(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, margin and size class of each text.  The margin of a single language is its decision."""
        out = []
        for _, value, size in self.values(texts):
            high = np.sort(value)[::-1]
            out.append((self.labels[int(value.argmax())], float(high[0] - high[1] if len(high) > 1 else high[0]), int(_size_class(size))))
        return out

    def settle(self, texts: list[str | None], langs: list[str | None]) -> tuple[list[bool], list[str | None]]:
        """Whether each text stays, and its language.

        A text without a letter goes, and one whose margin is below the bound.  The language decided replaces a null or
        another one.  Without bounds no text goes for its margin and only nulls are filled; without a model nothing
        but the letter counts.
        """
        stay = [bool(text and _LETTER.search(text)) for text in texts]
        if not self.labels:
            return stay, langs
        out = []
        for i, (name, margin, size) in enumerate(self.margins(texts)):
            if self.bounds is None:
                out.append(name if langs[i] is None else langs[i])
            else:
                stay[i] = stay[i] and margin >= self.bounds[size]
                out.append(name)
        return stay, out


def measured(found: dict[int, tuple[int, float]]) -> np.ndarray | None:
    """Bounds by size class from the number of clean margins of each and their RARE quantile, ENOUGH of it.  A class with
    fewer than LEAST margins has the bound of the next smaller one, whose margins are lower; with none such it has no bound."""
    if sum(n for n, _ in found.values()) < LEAST:
        return None
    bounds, last = np.full(int(_size_class(np.array(SIZE))) + 1, -np.inf), -np.inf
    for size in range(len(bounds)):
        n, low = found.get(size, (0, 0.0))
        if n >= LEAST:
            last = ENOUGH * low if low > 0 else -np.inf
        bounds[size] = last
    return bounds


def rare_margins(margins: DataFrame) -> dict[int, tuple[int, float]]:
    """size -> (rows, RARE quantile of margin), exact over all rows (margin, size).

    Equal margins are counted once.  The driver gets counts of narrow bins (at most 32,768 of a size), then the values at
    the two ranks wanted of each size, which are found inside their bins.
    """
    place = F.floor(F.greatest(F.least("margin", F.lit(16.0)), F.lit(-16.0)) * 1024).cast("int")
    counted = kept(margins.groupBy("size", "margin").agg(F.count("*").alias("n")).withColumn("bin", place))
    rows: dict[int, int] = {}
    ranks: list[tuple[int, int, int, int]] = []  # size, bin, rank in the bin, rank
    bins: dict[int, list] = {}
    for r in counted.groupBy("size", "bin").agg(F.sum("n").alias("n")).orderBy("size", "bin").collect():
        bins.setdefault(r["size"], []).append((r["bin"], r["n"]))
    for size, own in bins.items():
        rows[size] = sum(n for _, n in own)
        first = int((rows[size] - 1) * RARE)
        for rank in {first, min(first + 1, rows[size] - 1)}:
            before = 0
            for place_, n in own:
                if before + n > rank:
                    ranks.append((size, place_, rank - before, rank))
                    break
                before += n
    if not ranks:
        return {}
    asked = margins.sparkSession.createDataFrame(ranks, "size int, bin int, inside long, rank long")
    upto = F.sum("n").over(Window.partitionBy("size", "bin").orderBy("margin"))
    near = counted.join(F.broadcast(asked.select("size", "bin").distinct()), ["size", "bin"], "left_semi").withColumn("upto", upto)
    at = near.join(F.broadcast(asked), ["size", "bin"]).where((F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("n") <= F.col("inside")))
    values: dict[int, list] = {}
    for r in at.select("size", "rank", "margin").orderBy("size", "rank").collect():
        values.setdefault(r["size"], []).append(r["margin"])
    part = lambda n: (n - 1) * RARE - int((n - 1) * RARE)
    return {size: (n, float(np.quantile(values[size], part(n)))) for size, n in rows.items()}


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Presences as unit vectors (rows, SIZE) from packed bits (rows, SIZE / 8)."""
    found = np.unpackbits(bits, axis=1).astype(np.float32)
    return found / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))


def regression(bits: np.ndarray, labels: list[str], landmarks: int, ridge: float, rows: int = 64) -> Model:
    """Fit on packed presences (texts, SIZE / 8): landmarks are taken in turn from every language.

    Only the landmarks and ``rows`` texts at a time are unpacked; what is kept of a text is its kernel with the landmarks.
    """
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((SIZE, 0), np.float32))
    target = np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)
    turn = np.zeros(len(labels), np.int64)
    for name in names:
        own = np.flatnonzero(np.array(labels) == name)
        turn[own] = np.arange(len(own))
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    marks = unpacked(bits[chosen])
    kernel = np.concatenate([unpacked(bits[lo : lo + rows]) @ marks.T for lo in range(0, len(bits), rows)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel @ root
    fit = np.linalg.solve(mapped.T @ mapped + ridge * len(labels) * np.eye(mapped.shape[1]), mapped.T @ target)
    return Model(names, marks.T @ (root @ fit).astype(np.float32))


def held_out() -> Column:
    """Documents that are never learned from; false for a null doc_id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _chosen(docs: DataFrame, per_class: int, parts: int = 64) -> DataFrame:
    """The first ``per_class`` rows of each language in hashed order of doc_id: _id, _lang, nth.

    A language's rows are first cut down in ``parts`` groups, so that the last order is over few rows of it.
    """
    known = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    known = known.withColumn("_part", F.pmod("_h", F.lit(parts)))
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "doc_id"))).where(F.col("nth") <= per_class)
    chosen = kept(first(first(known, "lang", "_part"), "lang"))
    return chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "nth")


def _texts(docs: DataFrame, chosen: DataFrame, per_class: int) -> DataFrame:
    """text, _lang, nth of the chosen rows.  Rows that repeat a doc_id are ordered by the hash of their text and cut
    again, so a language has ``per_class`` texts at most."""
    near = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    near = near.select("text", "_lang", "nth", F.xxhash64("text").alias("_h"), F.pmod(F.xxhash64("nth", "text"), F.lit(64)).alias("_part"))
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("nth", "_h"))).where(F.col("_n") <= per_class)
    return first(first(near, "_lang", "_part"), "_lang").select("text", "_lang", F.col("_n").alias("nth"))


def fit(docs: DataFrame, per_class: int = 400, landmarks: int = 160, ridge: float = 1e-4) -> Model:
    """Learn from text and lang of documents with a doc_id, a lang and a letter that are not held out.

    At most ``per_class`` texts of a language are taken, also where many rows share a doc_id; other columns are not
    read, and with nothing to learn from the model has no labels.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column("text").to_pylist()
            bits = [np.packbits(row.astype(bool)).tobytes() if _LETTER.search(text or "") else None for lo, hi, found in presences(texts) for text, row in zip(texts[lo:hi], found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column("nth"), pa.array(bits, pa.binary())], names=["lang", "nth", "bits"])

    # at most per_class rows of each language
    near = _texts(docs, _chosen(docs.where(~held_out()), per_class), per_class)
    rows = near.mapInArrow(build, "lang string, nth int, bits binary").where("bits IS NOT NULL").orderBy("lang", "nth", "bits").collect()
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), SIZE // 8)
    return regression(bits, [r["lang"] for r in rows], landmarks, ridge)


def with_bounds(docs: DataFrame, model: Model) -> Model:
    """``model`` with bounds from all held-out texts that have a language."""
    if not model.labels:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            pairs = [(t, lang) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if t]
            pairs += [(t[:n], lang) for t, lang in pairs for n in BEGINNINGS if len(t) > n]
            pairs = [(t, lang) for t, lang in pairs if _LETTER.search(t)]
            clean = [(margin, size) for (_, lang), (name, margin, size) in zip(pairs, shared.value.margins([t for t, _ in pairs]), strict=True) if name == lang]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in clean], pa.float64()), pa.array([s for _, s in clean], pa.int32())], names=["margin", "size"])

    labelled = docs.where(held_out() & F.col("lang").isNotNull()).select("text", "lang")
    return replace(model, bounds=measured(rare_margins(labelled.mapInArrow(look, "margin double, size int"))))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.  A null text, or one without a letter, is UNKNOWN; with
    nothing to learn from every text is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            names, scores = shared.value.decide(batch.column("text").to_pylist())
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(look, "doc_id long, held_out boolean, lang_pred string, score double")


def of_known_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` that stay by ``Model.settle``, with their language in ``lang``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            stay, langs = shared.value.settle(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            arrays = [pa.array(langs, f.type) if f.name == "lang" else a for f, a in zip(batch.schema, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(look, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
