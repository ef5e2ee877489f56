"""Hard negatives by slots: for an anchor and each of its positives, the best rows of other labels whose score lies in
a window below the positive's.

The windows of one anchor overlap.  The upper limits of its positives, sorted, cut the scores into disjoint slots, so a
row belongs to one slot at most, however many windows it lies in.  Scores are products of blocks of anchors and rows;
a block keeps the best k rows of every slot of every anchor, and these lists are merged per slot.  A window is its own
slot and all lower ones: going down the slots, the first k rows not below the window's lower limit answer it.  Nothing
else can: a row that is not among the best k of its slot has k better ones in every window it lies in.

Rows and anchors are dealt out in blocks of bounded size, so a label or a vector with most of the rows is many groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import kept

#: Components of the rows, and of the anchors, that a block holds; scores held at a time.
CELLS, SCORED = 1 << 19, 1 << 21
#: Squared length below which a product of two vectors fits a long (and a component an int); and the product of two
#: squared lengths below which doubles hold every partial sum exactly.
FITS, EXACT = 2.0**62, 2.0**104
_LAST = 2**63 - 1


def usable(rows: DataFrame, key: str, vector: str, label: str, factor: int, relabel: Column | None) -> DataFrame:
    """vec_id, label, v (scaled components), n (how many), h: rows that take part, each distinct one once."""
    base = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    base = base.where("label IS NOT NULL AND x IS NOT NULL").where(good)
    base = base.withColumn("v", F.transform("x", lambda c: F.floor(c * F.lit(float(factor))))).where(length < F.lit(FITS))
    if relabel is not None:
        base = base.withColumn("label", relabel.cast("long"))
    base = base.select("vec_id", "label", F.col("v").cast("array<int>").alias("v"), F.size("v").alias("n"))
    return base.withColumn("h", F.xxhash64("vec_id", "label", "v")).distinct()


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), table.column("n")[0].as_py())


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where every partial sum is a whole number they hold, else by longs."""
    a, b = anchors.astype(np.float64), rows.astype(np.float64)
    if (a**2).sum(axis=1).max(initial=0) * (b**2).sum(axis=1).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    return np.stack([rows.astype(np.int64) @ x for x in anchors.astype(np.int64)])


def _first(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first k of the places ``at``, by falling score, then rising id."""
    if len(at) > 4 * k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _dealt(rows: DataFrame, anchors: DataFrame, by: list[str]):
    """Rows and anchors with the same ``by``, grouped in blocks (part, side): each block of rows meets each of anchors."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("rows")).join(anchors.groupBy(*by).agg(F.count("*").alias("anchors")), by)
    room = f"greatest(1L, {CELLS}L div greatest(n, 1))"
    sizes = kept(sizes.select(*by, F.expr(f"(rows + {room} - 1) div {room}").alias("parts"), F.expr(f"(anchors + {room} - 1) div {room}").alias("sides")))
    part, side = F.pmod("h", "parts"), F.pmod("h", "sides")
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    left = rows.join(sizes, by).withColumn("part", part).withColumn("side", every("sides")).withColumn("asks", F.lit(False))
    right = anchors.join(sizes, by).withColumn("side", side).withColumn("part", every("parts")).withColumn("asks", F.lit(True))
    return left.unionByName(right, allowMissingColumns=True).drop("parts", "sides").groupBy(*by, "part", "side")


def _each(group: pa.Table) -> Iterator[tuple[dict, pa.Table, np.ndarray, np.ndarray]]:
    """Every anchor of a block: its row, the block's rows, their ids (null is the last) and their scores."""
    asks = group.column("asks").combine_chunks()
    rows, anchors = group.filter(pc.invert(asks)), group.filter(asks)
    if len(rows) and len(anchors):
        vectors, ids = _matrix(rows), rows.column("vec_id").combine_chunks().fill_null(_LAST).to_numpy()
        step = max(1, SCORED // len(rows))
        for lo in range(0, len(anchors), step):
            some = anchors.slice(lo, step)
            for anchor, scores in zip(some.drop_columns(["v"]).to_pylist(), _scores(_matrix(some), vectors), strict=True):
                yield anchor, rows, ids, scores


def _table(found: list[tuple[dict, int, pa.Table, np.ndarray, np.ndarray]]) -> pa.Table:
    """anchor, ah, slot, vec_id, score of (anchor, slot, rows, places in them, scores)."""
    counts = [len(at) for _, _, _, at, _ in found]
    repeated = lambda values: pa.array(np.repeat(np.array(values, np.int64), counts))
    flat = lambda parts: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64))
    places = flat([at for _, _, _, at, _ in found])
    ids = found[0][2].column("vec_id").combine_chunks().take(places) if found else pa.array([], pa.int64())
    names = [repeated([a["vec_id"] for a, *_ in found]), repeated([a["h"] for a, *_ in found]), repeated([slot for _, slot, *_ in found])]
    return pa.table([*names, ids, flat([s[at] for _, _, _, at, s in found])], names=["anchor", "ah", "slot", "vec_id", "score"])


_FOUND = "anchor long, ah long, slot long, vec_id long, score long"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of every list (anchor, ah, slot), numbered; partial lists are cut before they are shuffled."""
    order = Window.partitionBy("anchor", "ah", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def positives(rows: DataFrame, anchors: DataFrame, count: int) -> DataFrame:
    """anchor, ah, vec_id, score, nth: the first ``count`` other rows of each anchor's label, by blocks of a label."""

    def best(group: pa.Table) -> pa.Table:
        found = []
        for anchor, table, ids, scores in _each(group):
            others = (table.column("h").to_numpy() != anchor["h"]) | (ids != anchor["vec_id"])
            found.append((anchor, 0, table, _first(scores, ids, np.flatnonzero(others), count), scores))
        return _table(found)

    return _merged(_dealt(rows, anchors, ["n", "label"]).applyInArrow(best, _FOUND), count).drop("slot")


def slots(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """anchor, ah, slot, vec_id, score, nth: the first ``k`` rows of other labels in every slot.

    ``anchors`` have the limits of their windows, highest first, in ``highs`` and ``lows``.  Slot j reaches from highs[j]
    down to above highs[j + 1]; what is below lows[j] is in no window and left out.
    """

    def best(group: pa.Table) -> pa.Table:
        found = []
        for anchor, table, ids, scores in _each(group):
            highs, lows = np.array(anchor["highs"]), np.array(anchor["lows"])
            at = np.flatnonzero((scores <= highs[0]) & (scores >= lows[-1]) & (table.column("label").to_numpy() != anchor["label"]))
            slot = np.searchsorted(-highs, -scores[at], "right") - 1
            inside = scores[at] >= lows[slot]
            at, slot = at[inside], slot[inside]
            found += [(anchor, j, table, _first(scores, ids, at[slot == j], k), scores) for j in np.unique(slot).tolist()]
        return _table(found)

    return _merged(_dealt(rows, anchors, ["n"]).applyInArrow(best, _FOUND), k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    count: int = 5,
    k: int = 10,
    least: int = 30,
    most: int = 90,
    relabel: Column | None = None,
    factor: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(factor * x); a score is the integer inner product with the anchor.  For each anchor (rows
    with ``is_anchor``, a condition on vec_id) and each of its first ``count`` other rows of the same label: the first
    ``k`` rows of another label with least * positive_score <= 100 * negative_score <= most * positive_score.  Higher
    scores come first, ties by smaller vec_id, null last.  ``relabel`` is a new label from vec_id and label; a null one
    counts as none.  0 <= least and 0 <= most.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor does a vector so long
    that its scores would not fit a long (2^31 after scaling).  Vectors meet those of their own number of components.
    Rows equal in id, label and components count once; rows that share only the id are rows of their own.
    A zero vector is a vector like any other.  An empty table gives no rows, and other columns are not read.
    """
    every = kept(usable(rows, key, vector, label, factor, relabel).where("label IS NOT NULL"))
    anchors = every.where(F.col("vec_id").isNotNull() & F.coalesce(is_anchor, F.lit(False)))
    near = positives(every, anchors, count)
    # score = 100 * a + b with 0 <= b < 100, so that no product overflows; a window below 0 is empty
    low = F.expr(f"{least} * ((score - pmod(score, 100)) div 100) + ({least} * pmod(score, 100) + 99) div 100")
    high = F.expr(f"{most} * ((score - pmod(score, 100)) div 100) + ({most} * pmod(score, 100)) div 100")
    near = kept(near.withColumn("low", low).withColumn("high", high).where("low <= high"))
    falling = lambda c: F.sort_array(F.collect_list(c), asc=False)
    limits = near.groupBy("anchor", "ah").agg(falling("high").alias("highs"), falling("low").alias("lows"))
    asking = kept(anchors.join(limits.select(F.col("anchor").alias("vec_id"), F.col("ah").alias("h"), "highs", "lows"), ["vec_id", "h"]))

    # at most count * k rows of an anchor, best first
    entry = F.struct((-F.col("score")).alias("down"), F.col("vec_id").isNull().alias("last"), "vec_id", "slot")
    lists = slots(every, asking, k).groupBy("anchor", "ah").agg(F.sort_array(F.collect_list(entry)).alias("best"))
    window = near.withColumn("own", F.col("nth") - 1).withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"})
    down = F.slice(F.filter("best", lambda x: (x["slot"] >= F.col("own")) & (-x["down"] >= F.col("low"))), 1, k)
    out = window.join(lists, ["anchor", "ah"]).select("anchor", "positive_id", "positive_score", F.posexplode(down).alias("place", "row"))
    return out.select(
        F.col("anchor").alias("anchor_id"), "positive_id", (F.col("place") + 1).alias("rank"), F.col("row.vec_id").alias("negative_id"),
        "positive_score", (-F.col("row.down")).alias("negative_score"),
    )
