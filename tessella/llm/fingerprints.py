"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines; a long line also after words that a hash picks, about every 16th), and each
paragraph is digested together with how often it came before.  A sketch adds every digest to one cell in each of
three parts: a count, the sum of digests, the sum of check values.  Two sketches subtract cell by cell, and cells
with a single digest left are peeled off until nothing remains: that recovers the digests in which two versions
differ.  If peeling gets stuck, both versions are sketched again with at least four times the cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import BLANK_BYTES, mixed, span_hashes, word_spans

PARTS, CELLS, EVERY = 3, 8, 16
#: Characters of text that are sketched at a time.
BLOCK = 1 << 19
#: Groups that documents are dealt into, at most: their borders go to the driver.  A group is sorted with spills and streamed.
MOST_GROUPS = 20_000
_PART_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
_POWER = np.uint64(0xD6E8FEB86659FD93)


def digests(text: str) -> np.ndarray:
    """One 64-bit digest per paragraph; a paragraph that repeats gets another digest each time."""
    return block_digests([text])[0]


def block_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of several texts, one text's after the other's, and how many each has."""
    encoded = [text.encode("utf-8", "surrogatepass") for text in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    starts, ends = word_spans(~BLANK_BYTES[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    words = span_hashes(data, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    lines = np.cumsum(data == 10)
    cut = words % np.uint64(EVERY) == 0
    cut[:-1] |= (lines[starts[1:]] != lines[ends[:-1] - 1]) | (row[1:] != row[:-1])
    first = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    powers = np.full(int(place.max()) + 1, _POWER, np.uint64)
    powers[0] = 1
    sums, owner = np.add.reduceat(words * np.multiply.accumulate(powers)[place], first), row[first]
    order = np.lexsort((sums, owner))
    ranked, owner = sums[order], owner[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (owner[1:] != owner[:-1])])
    turn = np.arange(len(ranked)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return mixed(ranked + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.bincount(owner, minlength=len(texts))


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys + np.uint64(0x452821E638D01377)) >> np.uint64(32)


class Sketches:
    """Sketches of several versions one after the other, each of three parts of its own number of cells; sums are modulo 2^64."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = np.asarray(cells, np.int64)
        self.base = PARTS * (np.cumsum(self.cells) - self.cells)
        size = PARTS * int(self.cells.sum())
        self.count, self.keys, self.checks = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)

    def put(self, owner: np.ndarray, keys: np.ndarray, signs: np.ndarray | None = None) -> np.ndarray:
        """Add keys to the sketches ``owner``, or with a sign of -1 take them away; returns the cells that were touched."""
        signs = np.ones(len(keys), np.int64) if signs is None else signs
        factor, cells = signs.astype(np.uint64), self.cells[owner]
        place = (mixed(keys[:, None] ^ _PART_SEEDS) % cells.astype(np.uint64)[:, None]).astype(np.int64)
        place += self.base[owner][:, None] + np.arange(PARTS) * cells[:, None]
        np.add.at(self.count, place, signs[:, None])
        np.add.at(self.keys, place, (keys * factor)[:, None])
        np.add.at(self.checks, place, (_check(keys) * factor)[:, None])
        return place.reshape(-1)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def unpeeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Peel all sketches together: whether each one is too small, then owner, key and sign of what was recovered.

        Every round takes all cells that hold one key, and looks again only at the cells that this has changed.
        """
        of_cell = np.repeat(np.arange(len(self.cells)), PARTS * self.cells)
        looked = np.arange(len(self.count))
        owners, found, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        while len(looked):
            single = looked[np.abs(self.count[looked]) == 1]
            signs = self.count[single]
            factor = signs.astype(np.uint64)
            keys = self.keys[single] * factor
            pure = _check(keys) * factor == self.checks[single]
            owner, keys, signs = of_cell[single[pure]], keys[pure], signs[pure]
            order = np.lexsort((keys, owner))
            owner, keys, signs = owner[order], keys[order], signs[order]
            once = np.ones(len(keys), bool)
            once[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            owner, keys, signs = owner[once], keys[once], signs[once]
            looked = np.unique(self.put(owner, keys, -signs))
            owners.append(owner)
            found.append(keys)
            marks.append(signs)
        small = np.zeros(len(self.cells), bool)
        small[of_cell[(self.count != 0) | (self.keys != 0)]] = True
        return small, np.concatenate(owners), np.concatenate(found), np.concatenate(marks)

    def texts(self) -> list[str]:
        ends = self.base + PARTS * self.cells
        parts = self.count.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u8")
        return [base64.b64encode(b"".join(x[lo:hi].tobytes() for x in parts)).decode() for lo, hi in zip(self.base, ends, strict=True)]


class Sketch(Sketches):
    """The sketch of one version."""

    def __init__(self, cells: int) -> None:
        super().__init__(np.array([cells]))

    def add(self, keys: np.ndarray, signs: np.ndarray | None = None) -> Sketch:
        self.put(np.zeros(len(keys), np.int64), keys, signs)
        return self

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(int(self.cells[0]))
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Keys that are only in the first, and only in the second version; None if the sketch is too small."""
        small, _, keys, signs = self.unpeeled()
        return None if small.any() else (keys[signs > 0], keys[signs < 0])

    def text(self) -> str:
        return self.texts()[0]


def difference(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in ``a`` and only in ``b``, from sketches, larger ones until peeling succeeds."""
    cells = CELLS
    while (found := Sketch(cells).add(a).minus(Sketch(cells).add(b)).peel()) is None:
        cells = max(4 * cells, (len(a) + len(b) + 1) // 2)  # the latter holds them all, were they all different
    return found


class Versions:
    """Versions of texts with their digests and the sketches that are their fingerprints."""

    def __init__(self, texts: list[str]) -> None:
        self.keys, self.counts = block_digests(texts)
        self.first = np.cumsum(self.counts) - self.counts
        self.sketches = Sketches(np.full(len(texts), CELLS))
        self.sketches.put(np.repeat(np.arange(len(texts)), self.counts), self.keys)

    def taken(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the versions ``which`` and the place in ``which`` that each belongs to."""
        counts = self.counts[which]
        owner = np.repeat(np.arange(len(which)), counts)
        return self.keys[np.arange(len(owner)) + np.repeat(self.first[which] - (np.cumsum(counts) - counts), counts)], owner

    def cells_of(self, which: np.ndarray) -> Sketches:
        out = Sketches(self.sketches.cells[which])
        at = (which[:, None] * (PARTS * CELLS) + np.arange(PARTS * CELLS)).reshape(-1)
        out.count, out.keys, out.checks = self.sketches.count[at], self.sketches.keys[at], self.sketches.checks[at]
        return out


def likeness(one: Versions, a: np.ndarray, two: Versions, b: np.ndarray) -> np.ndarray:
    """For versions ``a`` of one and ``b`` of two, pair by pair: the paragraphs that both have, as a part of those that either has;
    1 for two empty texts.

    The fingerprints are subtracted and peeled first; pairs whose sketch is too small get larger ones of their digests.
    """
    apart = np.zeros(len(a), np.int64)
    total = one.counts[a] + two.counts[b]
    pairs, cells = np.arange(len(a)), np.full(len(a), CELLS)
    sketches = one.cells_of(a).minus(two.cells_of(b))
    while len(pairs):
        small, owner, _, _ = sketches.unpeeled()
        apart[pairs] = np.bincount(owner, minlength=len(pairs))
        pairs, cells = pairs[small], cells[small]
        cells = np.maximum(4 * cells, (total[pairs] + 1) // 2)  # the latter holds them all, were they all different
        sketches = Sketches(cells)
        for version, which, sign in ((one, a, 1), (two, b, -1)):
            keys, owner = version.taken(which[pairs])
            sketches.put(owner, keys, np.full(len(keys), sign))
    both, every = (total - apart) / 2, (total + apart) / 2
    return np.where(every > 0, both / np.where(every > 0, every, 1), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last third (of code points, cut down) replaced by as many from the start of the next document."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _destinations(docs: DataFrame, per_task: int) -> tuple[int, list[int], dict[int, int]]:
    """How documents are dealt out in descending order of doc_id: the number of groups, the doc_ids that divide them,
    and for the first doc_id of each group the group before it, which needs that document as well.

    What comes to the driver is a few numbers for each of at most MOST_GROUPS groups.  Rows without doc_id are in the last group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    wanted = min(MOST_GROUPS, max(1, -(-rows.count() // per_task)))
    cuts: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * wanted))).first()[0] or []))
    bounds = np.array(cuts, np.int64)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            group = len(bounds) - np.searchsorted(bounds, ids, "left")
            if len(ids):
                order = np.lexsort((ids, group))
                last = np.flatnonzero(np.append(np.diff(group[order]) > 0, True))
                yield pa.RecordBatch.from_pydict({"group": group[order][last], "head": ids[order][last]})

    heads = sorted((r["group"], r["head"]) for r in rows.mapInArrow(largest, "group long, head long").groupBy("group").agg(F.max("head").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    return len(cuts) + 1, cuts, before


def fingerprints(docs: DataFrame, per_task: int = 4096) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller doc_id; after the smallest comes the largest.  A null text is empty.
    Rows with equal doc_ids follow each other by the hash of their text, rows without doc_id come last.  A single
    document is its own next one.  Documents move once, to their group; the first document of a group also goes to
    the group before.
    """
    groups, cuts, before = _destinations(docs, per_task)
    bounds = np.array(cuts, np.int64)
    every_null = not before

    @F.arrow_udf("array<long>")
    def dealt(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        group = np.where(known, len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "left"), len(bounds))
        out = [[int(g) * 2] for g in group]
        for i, doc in enumerate(ids.to_pylist()):
            if doc in before or every_null:
                out[i].append(before.get(doc, 0) * 2 + 1)
        return pa.array(out, pa.list_(pa.int64()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).select("*", F.explode(dealt("doc_id")).alias("dest"))
    rows = rows.repartitionById(groups, F.expr("cast(dest div 2 as int)"))
    rows = rows.sortWithinPartitions(F.expr("dest div 2"), F.expr("dest % 2"), F.col("doc_id").desc_nulls_last(), "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            arrived = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("dest").to_pylist(), strict=True)
            for block in _blocks([*held, *arrived]):
                out = _compared(block)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
                held = block[-1:]

    return rows.select("doc_id", "text", "dest").mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _blocks(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of rows with about BLOCK characters, at least two rows; each begins with the last row of the one before."""
    at, size = 0, 0
    for i, row in enumerate(rows):
        size += len(row[1])
        if size > BLOCK and i > at:
            yield rows[at : i + 1]
            at, size = i, len(row[1])
    if at < len(rows) - 1 or (rows and not at):
        yield rows[at:]


def _compared(rows: list[tuple]) -> list[tuple]:
    """Result rows of all but the last of ``rows`` (doc_id, text, dest) that are followed by a row of their group."""
    at = np.array([i for i in range(len(rows) - 1) if not rows[i][2] % 2 and rows[i][2] // 2 == rows[i + 1][2] // 2], np.int64)
    if not len(at):
        return []
    others = [edited(rows[i][1], rows[i + 1][1]) for i in at]
    own, changed = Versions([text for _, text, _ in rows]), Versions(others)
    shas = [hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest() for other in others]
    near_edited = likeness(own, at, changed, np.arange(len(at))).tolist()
    near_next = likeness(own, at, own, at + 1).tolist()
    marks, changed_marks = own.sketches.texts(), changed.sketches.texts()
    return [(rows[i][0], len(rows[i][1]), shas[n], marks[i], changed_marks[n], near_edited[n], near_next[n]) for n, i in enumerate(at.tolist())]
