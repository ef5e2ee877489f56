"""Divergence of sources: how far the term shares of each (lang, source) group lie from the other sources of its
language and from the language as a whole.

The matrix of groups and terms is nearly empty, so it is held as K-squared quadtrees (K = 2) over blocks of terms:
a quadrant without counts is one zero bit.  A term that a group lacks has the share of count 0, the same for the whole
quadrant.  So a pair of groups is first priced as if both were empty, term by term the same amount; then each is priced
against an empty partner, a distinct count at a time; what is left is a correction for terms both have.  These are
met by walking a tree jointly for pairs of its rows: a pair of quadrants is entered if both hold counts.

All arithmetic is on integers: shares are billionths rounded down plus 1, prices are rounded down.  Totals may be up to
9 * 10^15 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import LOWER_BYTES, kept, row_blocks, text_bytes, word_spans
from tessella.session import join_side_table

#: Bytes of terms: letters, and all bytes of characters beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Groups in a block of rows; counts in a block of terms, at least and at most; pairs of quadrants walked at a time.
ROWS, ENTRIES, MOST_ENTRIES, WALKED = 1 << 10, 1 << 14, 1 << 20, 1 << 20


def group_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), summed over blocks of a few megabytes of text.
    Null text, lang and source are empty."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            everything, ends = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(ends, 1 << 22):
                data, offsets = everything[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                inside = TERM_BYTES[data]
                starts, stops = word_spans(inside, offsets)
                if not len(starts):
                    continue
                cuts = np.concatenate([[0], np.cumsum(stops - starts)])
                words = np.ascontiguousarray(LOWER_BYTES[data[inside]])
                terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(words)]).dictionary_encode()
                number: dict[tuple, int] = {}
                group = np.array([number.setdefault(name, len(number)) for name in names[lo:hi]])
                count = len(terms.dictionary)
                row = np.searchsorted(offsets, starts, "right") - 1
                cells, n = np.unique(row * count + terms.indices.to_numpy(), return_counts=True)
                pairs, place, per = np.unique(group[cells // count] * count + cells % count, return_inverse=True, return_counts=True)
                langs, sources = (pa.array(x, pa.string()).take(pa.array(pairs // count)) for x in zip(*number, strict=True))
                arrays = [langs, sources, terms.dictionary.take(pa.array(pairs % count)).cast(pa.large_string()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.bincount(place, n).astype(np.int64)), pa.array(per)], names=["lang", "source", "term", "n", "docs"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(look, "lang string, source string, term string, n long, docs long")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), three digits at a time so that nothing overflows."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class QuadTree:
    """A sparse matrix as a K-squared tree: per level, four bits for each quadrant that is not empty.

    Cells come in Morton order.  ``first[level][node]`` is the number of the node's first child on the next level; its
    others follow, so a child's number is a count of bits.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray) -> None:
        self.depth = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        key = np.zeros(len(rows), np.int64)
        for bit in range(self.depth):
            key |= (rows >> bit & 1) << 2 * bit + 1 | (columns >> bit & 1) << 2 * bit
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.bits: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        for level in range(self.depth):
            children = np.unique(key >> 2 * (self.depth - level - 1))
            parents, at, count = np.unique(children >> 2, return_index=True, return_counts=True)
            self.bits.append(np.bitwise_or.reduceat(np.uint8(1) << (children & 3).astype(np.uint8), at) if len(parents) else np.zeros(0, np.uint8))
            self.first.append(np.cumsum(count) - count)

    def child(self, level: int, nodes: np.ndarray, quadrant: int) -> np.ndarray:
        """Number of the child in a quadrant (2 * lower row half + right column half) on the next level, -1 if empty."""
        bits = self.bits[level][nodes]
        before = _ONES[bits & (1 << quadrant) - 1]
        return np.where(bits >> quadrant & 1, self.first[level][nodes] + before, -1)

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells (numbers in Morton order) in the same column and different rows, the upper row first."""
        stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(self.order) else []
        while stack:
            level, upper, lower = stack.pop()
            if level == self.depth:
                apart = upper != lower
                if apart.any():
                    yield upper[apart], lower[apart]
                continue
            pairs = []
            for half in (0, 1):
                for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    above, below = self.child(level, upper, 2 * a + half), self.child(level, lower, 2 * b + half)
                    # a quadrant of rows beside itself: each pair of its halves once
                    both = (above >= 0) & (below >= 0) & ((upper != lower) | (a <= b))
                    pairs.append((above[both], below[both]))
            above, below = (np.concatenate(x) for x in zip(*pairs, strict=True))
            stack += [(level + 1, above[lo : lo + WALKED], below[lo : lo + WALKED]) for lo in range(0, len(above), WALKED)]


_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def pair_prices(sources: np.ndarray, columns: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """(groups, groups), for a block of terms: how much a pair's price differs from that of two empty groups; only above the diagonal.

    ``sources``, ``columns`` and ``counts`` are the cells that are not 0; ``totals`` has N + 2 V of every group.
    """
    many = len(totals)
    empty = share(np.zeros(many, np.int64), totals)
    out = np.zeros((many, many), np.int64)
    if not len(counts):
        return out
    order = np.lexsort((counts, sources))
    row, value = sources[order], counts[order]
    fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]))
    times = np.diff(np.concatenate([fresh, [len(row)]]))
    for lo in range(0, len(fresh), 1 << 10):
        at = fresh[lo : lo + (1 << 10)]
        owner, own = row[at], share(value[at], totals[row[at]])
        against = (price(own[:, None], empty) - price(empty[owner][:, None], empty)) * times[lo : lo + (1 << 10), None]
        np.add.at(out, owner, against)
    out = np.triu(out + out.T, 1)
    tree = QuadTree(sources, columns)
    cell = tree.order
    for upper, lower in tree.meetings():
        g, h = sources[cell[upper]], sources[cell[lower]]
        p, q = share(counts[cell[upper]], totals[g]), share(counts[cell[lower]], totals[h])
        both = price(p, q) - price(p, empty[h]) - price(empty[g], q) + price(empty[g], empty[h])
        np.add.at(out.reshape(-1), g * many + h, both)
    return out


def _corrections(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (sources, a before b), value: the sums of ``pair_prices`` over all blocks of terms.

    ``cells`` (lang, block, rows, source, term, n), ``groups`` (lang, block, rows, source, total): a language's groups
    fall into ``rows`` blocks of about ROWS, and a task has two of them, or one with itself, for one block of terms.
    """

    def walk(block: pa.Table) -> pa.Table:
        term = block.column("term").combine_chunks()
        is_cell = np.asarray(term.is_valid())
        source, part = block.column("source").to_pylist(), block.column("part").to_pylist()
        of = {s: r for s, r, c in zip(source, part, is_cell, strict=True) if not c}
        names = sorted(of)
        number = {s: i for i, s in enumerate(names)}
        row = np.fromiter(map(number.__getitem__, source), np.int64, len(source))
        totals = np.zeros(len(names), np.int64)
        totals[row[~is_cell]] = block.column("total").filter(pa.array(~is_cell)).to_numpy()
        column = term.filter(pa.array(is_cell)).dictionary_encode().indices.to_numpy().astype(np.int64)
        found = pair_prices(row[is_cell], column, block.column("n").filter(pa.array(is_cell)).to_numpy(), totals)
        if block.column("one")[0].as_py() != block.column("two")[0].as_py():
            parts = np.array([of[s] for s in names])
            found[parts[:, None] == parts] = 0
        a, b = np.nonzero(found)
        texts = pa.array(names, pa.string())
        lang = pa.array([block.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.table({"lang": lang, "a": texts.take(pa.array(a)), "b": texts.take(pa.array(b)), "value": pa.array(found[a, b])})

    null, part = F.lit(None), F.pmod(F.xxhash64("source"), "rows")
    both = cells.select("lang", "block", "rows", "source", "term", "n", null.cast("long").alias("total")).unionByName(
        groups.select("lang", "block", "rows", "source", null.cast("string").alias("term"), null.cast("long").alias("n"), "total")
    )
    dealt = both.withColumn("part", part).withColumn("with", F.explode(F.expr("sequence(0L, rows - 1)")))
    dealt = dealt.withColumn("one", F.least("part", "with")).withColumn("two", F.greatest("part", "with")).drop("with", "rows")
    parts = dealt.groupBy("lang", "block", "one", "two").applyInArrow(walk, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank.

    A language keeps the terms that ``least_docs`` of its documents have.  Part ``pair``: every other source of the
    language and the divergence over all kept terms.  Part ``term``: the ``top`` kept terms whose share in the group is
    above that in the language.  Null text, lang and source count as empty; a group without terms has pairs like any
    other; rows that repeat count as often as they come; an empty table gives no rows; other columns are not read.
    The result has a row for every ordered pair of a language's sources; a language's sources are sorted in one task.
    """
    counted = group_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    whole = counted.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(of_term).alias("docs"),
        F.sum("n").over(of_term).alias("lang_n"),
        (F.col("source") == F.min("source").over(of_term)).cast("long").alias("one"),
    )
    terms = kept(whole.where(F.col("docs") >= least_docs).drop("docs"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    names = docs.select(text("lang"), text("source")).distinct()
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.count("*").alias("cells"))
    groups = kept(names.join(sums, ["lang", "source"], "left").na.fill(0, ["n", "one", "cells"]))
    langs = groups.groupBy("lang").agg(F.sum("one").alias("v"), F.sum("n").alias("lang_n_all"), F.sum("cells").alias("cells"), F.count("*").alias("s"))
    size = f"least(greatest({ENTRIES}, s * s), {MOST_ENTRIES})"
    langs = kept(
        langs.select(
            "lang", "v", (F.col("lang_n_all") + 2 * F.col("v")).alias("lang_total"),
            F.expr(f"(cells + {size} - 1) div {size}").alias("blocks"), F.expr(f"(s + {ROWS} - 1) div {ROWS}").alias("rows"),
        )
    )
    groups = kept(groups.join(langs, "lang").select("lang", "source", (F.col("n") + 2 * F.col("v")).alias("total"), "v", "lang_total", "blocks", "rows"))

    placed = join_side_table(terms, langs.select("lang", "blocks", "rows"), ["lang"], "inner", ["term"])
    cells = placed.withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    spread = groups.where("blocks > 0").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    fix = _corrections(cells, spread)

    p = lambda n, total: F.expr(f"1 + cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(20,0)) div cast({total} as decimal(20,0))")
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    empty = groups.select("lang", "source", "v", F.when(F.col("v") > 0, p("0", "greatest(total, 1)")).otherwise(1).alias("z"))
    other = empty.select("lang", F.col("source").alias("item"), F.col("z").alias("q"))
    pairs = empty.withColumnRenamed("z", "p").join(other, "lang").where("source <> item").withColumn("base", F.col("v") * value)
    pairs = pairs.select("lang", "source", "item", "base", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"))
    pairs = pairs.join(fix, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("value", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    sized = join_side_table(terms, groups.select("lang", "source", "total", "lang_total"), ["lang", "source"], "inner", ["term"])
    own = sized.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p("n", "total").alias("p"), p("lang_n", "lang_total").alias("q"))
    best = own.where("p > q").select("lang", "source", "part", "item", value.alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(best)
