"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cells, ``width`` wide, of a few random projections.  A query visits its own cell and
perturbed ones (one cell further in some projections) in the order of the estimated chance that a neighbour at the
usual distance lies there, until each table has its share of the ``target`` chance of finding it.  The usual distance
is the median distance of the k-th neighbour over a bounded sample of queries, measured exactly on all rows; the
width follows from it, the number of projections from the number of rows.  Candidates of all tables are ranked
by their exact distance.  A query whose k-th candidate is further than the usual distance visits more cells, with
chances at the distance found, which is no less than that of its true k-th neighbour.  A query with too few candidates,
or whose chances at its distance do not add up within ``CELLS`` cells a table, is answered by an exact search in blocks.

Work on a bucket is dealt out in blocks of rows and queries, so a bucket with most of the rows is many groups.
Vectors that are equal come once as a query, and as candidates only with their k + 1 smallest ids: no other of them
can be among k neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import kept, mixed

ROWS, QUERIES = 4096, 1024  # of a block
CELLS = 4096  # of a table, for a query at its own distance
_erf = np.vectorize(math.erf)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and v (array<double>) of vectors that take part: with an id, without null or non-finite components, not zero."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(good)
    return rows


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((queries - rows) ** 2).sum(axis=-1))


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its number, ids and distances of the k nearest rows, ties to smaller ids.  A matrix product narrows
    down; the distances that count are taken component by component."""
    size = (rows**2).sum(axis=1)
    for lo in range(0, len(queries), 256):
        some = queries[lo : lo + 256]
        near = (some**2).sum(axis=1)[:, None] + size - 2 * some @ rows.T
        for i, row in enumerate(near):
            limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            slack = 1e-9 * (1 + float((some[i] ** 2).sum()) + float(size.max()))
            at = np.flatnonzero(row <= limit + slack)
            exact = _distances(some[i], rows[at])
            order = np.lexsort((ids[at], exact))[:k]
            yield lo + i, ids[at][order], exact[order]


class Tables:
    """The hash functions: ``tables`` times ``projections``, and the order in which a query visits cells."""

    def __init__(self, dims: int, rows: int, distance: float, tables: int, target: float, seed: int = 17) -> None:
        random = np.random.default_rng(seed)
        self.projections = max(2, round(math.log2(max(rows, 2)) / 2.6))
        self.width = 1.9 * distance or 1.0
        self.spread = distance / self.width or 1.0
        self.axes = random.standard_normal((tables, dims, self.projections))
        self.shifts = random.uniform(0, 1, (tables, self.projections))
        self.marks = random.integers(0, 2**64, (tables, self.projections), dtype=np.uint64) | np.uint64(1)
        self.share = 1 - (1 - target) ** (1 / tables)

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return vectors @ self.axes[table] / self.width + self.shifts[table]

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        whole = cells.astype(np.int64).astype(np.uint64)
        return mixed((whole * self.marks[table]).sum(axis=1, dtype=np.uint64) + np.uint64(table)).view(np.int64)

    def visits(self, place: np.ndarray, distance: float | None = None) -> np.ndarray | None:
        """Steps (visits, projections) from the cell of a query at ``place`` within it, likeliest first, until the
        chances add up to the share.  A set of steps is grown from likelier ones by a heap.  With a ``distance`` the
        chances are those at it, and None is returned if CELLS cells do not make up the share."""
        count = self.projections
        cuts = np.stack([-1 - place, -place, 1 - place, 2 - place]) / (self.spread if distance is None else distance / self.width)
        level = 0.5 * (1 + _erf(cuts / math.sqrt(2)))
        below, own, above = np.maximum(np.diff(level, axis=0), 1e-300)
        loss = np.log(np.concatenate([own / below, own / above]))
        order = np.argsort(loss, kind="stable")
        loss = loss[order]
        chance = float(np.prod(own))
        total, out = chance, [np.zeros(count, np.int64)]
        if distance is not None and float(np.prod(below + own + above)) < self.share:
            return None
        heap = [(float(loss[0]), (0,))]
        while heap and total < self.share and (distance is None or len(out) < CELLS):
            lost, steps = heapq.heappop(heap)
            last = steps[-1]
            if last + 1 < len(loss):
                heapq.heappush(heap, (lost - loss[last] + loss[last + 1], (*steps[:-1], last + 1)))
                heapq.heappush(heap, (lost + loss[last + 1], (*steps, last + 1)))
            chosen = order[list(steps)]
            if len(set(chosen % count)) == len(steps):
                move = np.zeros(count, np.int64)
                move[chosen % count] = np.where(chosen < count, -1, 1)
                out.append(move)
                total += chance * math.exp(-lost)
        return np.array(out) if distance is None or total >= self.share else None


def _usual_distance(rows: DataFrame, sample: np.ndarray, dims: int, k: int) -> float:
    """Median, over the sample, of the distance of the k-th nearest row (of the furthest, if there are fewer)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [(q, float(d)) for q, _, near in nearest(sample, _matrix(batch.column("v"), dims), batch.column("vec_id").to_numpy(), k) for d in near]
                yield pa.RecordBatch.from_pydict({"q": [q for q, _ in found], "d": [d for _, d in found]})

    nth = rows.select("vec_id", "v").mapInArrow(look, "q long, d double").withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("d")))
    last = nth.where(F.col("nth") <= k).groupBy("q").agg(F.max("d").alias("d"))
    return float(last.agg(F.coalesce(F.median("d"), F.lit(0.0))).first()[0])


def _compare(pairs: DataFrame, dims: int, k: int) -> DataFrame:
    """q, vec_id, score: for each group (key, part, side) the k nearest rows of each query in it."""

    def top(group: pa.Table) -> pa.Table:
        asked = group.column("asks").to_numpy()
        ids = group.column("id").to_numpy()
        vectors = _matrix(group.column("v").combine_chunks(), dims)
        queries, rows = np.flatnonzero(asked), np.flatnonzero(~asked)
        q, found, score = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(queries) and len(rows):
            for i, near, distance in nearest(vectors[queries], vectors[rows], ids[rows], k):
                q += [ids[queries[i]]] * len(near)
                found.append(near)
                score.append(distance)
        return pa.table({"q": pa.array(q, pa.int64()), "vec_id": pa.array(np.concatenate(found)), "score": pa.array(np.concatenate(score))})

    return pairs.groupBy("key", "part", "side").applyInArrow(top, "q long, vec_id long, score double")


def _blocks(rows: DataFrame, queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows and queries (key, id, v) dealt out by the blocks of their key: every block of rows meets every block of queries."""
    part, side = F.pmod(F.xxhash64("id"), "parts"), F.pmod(F.xxhash64("id"), "sides")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(sizes, "key").select("key", part.alias("part"), every("sides").alias("side"), F.lit(False).alias("asks"), "id", "v")
    right = queries.join(sizes, "key").select("key", every("parts").alias("part"), side.alias("side"), F.lit(True).alias("asks"), "id", "v")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right).repartition(spread, "key", "part", "side")


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def search(rows: DataFrame, is_query, k: int = 10, tables: int = 3, target: float = 0.93, sample: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows found for each row with ``is_query``.

    Every other usable row with as many components is a candidate; ``is_query`` is a condition on vec_id.  Vectors of
    each length have tables of their own and are searched for themselves, one length after the other.  Rows that repeat a vec_id
    count once, with their nearest vector as a candidate and the smallest (of the shortest length) as a query.  Vectors
    that take no part give no rows; an empty table gives none.
    """
    every = kept(usable(rows, key, vector).withColumn("n", F.size("v")).withColumn("h", F.xxhash64("v")))
    asking = every.where(is_query).groupBy("vec_id").agg(F.min(F.struct("n", "h", "v")).alias("s")).select("vec_id", "s.n", "s.h", "s.v")
    lengths = [r["n"] for r in asking.select("n").distinct().orderBy("n").collect()]
    found = [_search(every.where(F.col("n") == n).drop("n"), asking.where(F.col("n") == n).drop("n"), n, k, tables, target, sample) for n in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _search(every: DataFrame, asking: DataFrame, dims: int, k: int, tables: int, target: float, sample: int) -> DataFrame:
    """The search among vectors with ``dims`` components: ``every`` (vec_id, v, h), and of them the queries."""
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    distinct = every.select("h", "v", "vec_id").distinct()
    base = kept(distinct.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("vec_id", "v"))
    queries = kept(asking.groupBy("h", "v").agg(F.min("vec_id").alias("id")))
    members = asking.join(queries, ["h", "v"]).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    count = base.count()
    some = queries.orderBy(F.xxhash64("id")).limit(sample).collect()
    distance = _usual_distance(base, np.array([r["v"] for r in some]), dims, k + 1)
    hashing = Tables(dims, count, distance, tables, target)
    wanted = k + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), dims)
            for table in range(tables):
                keys = hashing.keys(np.floor(hashing.cells(vectors, table)), table)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("vec_id"), batch.column("v")], names=["key", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), dims)
            for table in range(tables):
                cells = hashing.cells(vectors, table)
                own = np.floor(cells)
                for i in range(len(vectors)):
                    keys = hashing.keys(own[i] + hashing.visits(cells[i] - own[i]), table)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), batch.column("id")[i].as_py()))], names=["key", "id"])

    def probe_further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a null key asks for the exact search
        for batch in batches:
            vectors = _matrix(batch.column("v"), dims)
            every_table = [hashing.cells(vectors, table) for table in range(tables)]
            for i, (number, far) in enumerate(zip(batch.column("id").to_pylist(), batch.column("d").to_pylist(), strict=True)):
                steps = []
                for cells in every_table:
                    steps.append(hashing.visits(cells[i] - np.floor(cells[i]), far))
                    if steps[-1] is None:
                        break
                keys = [None] if steps[-1] is None else np.concatenate([hashing.keys(np.floor(every_table[t][i]) + s, t) for t, s in enumerate(steps)])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([number] * len(keys), pa.int64())], names=["key", "id"])

    placed = base.mapInArrow(place, "key long, id long, v array<double>")
    probes = kept(queries.select("id", "v").mapInArrow(probe, "key long, id long").distinct())
    parts = placed.groupBy("key").agg(F.count("*").alias("rows"))

    def candidates(probes: DataFrame) -> DataFrame:
        sides = probes.groupBy("key").agg(F.count("*").alias("asked"))
        sizes = parts.join(sides, "key").select("key", F.expr(f"(rows + {ROWS} - 1) div {ROWS}").alias("parts"), F.expr(f"(asked + {QUERIES} - 1) div {QUERIES}").alias("sides"))
        return _compare(_blocks(placed, probes.join(queries.select("id", "v"), "id"), kept(sizes)), dims, wanted)

    found = kept(_best(candidates(probes), wanted).drop("rank"))
    served = queries.join(found.groupBy("q").agg(F.count("*").alias("n"), F.max("score").alias("d")), F.col("id") == F.col("q"), "left")
    enough = F.coalesce("n", F.lit(0)) >= min(wanted, count)
    again = kept(served.where(enough & (F.col("d") > distance)).select("id", "v", "d").mapInArrow(probe_further, "key long, id long").distinct())
    further = kept(again.where("key IS NOT NULL").join(probes, ["key", "id"], "left_anti"))
    short = served.where(~enough).select("id", "v").unionByName(queries.select("id", "v").join(again.where("key IS NULL").select("id"), "id", "left_semi"))
    if not further.isEmpty():
        found = kept(_best(found.unionByName(candidates(further)), wanted).drop("rank"))
    short = kept(short)
    missing = short.count()
    if missing:
        # exactly, in blocks of rows and queries
        blocks, sides_ = -(-count // ROWS), -(-missing // QUERIES)
        one = lambda df: df.withColumn("key", F.lit(0).cast("long"))
        sizes = every.sparkSession.range(1).select(F.col("id").alias("key"), F.lit(blocks).cast("long").alias("parts"), F.lit(sides_).cast("long").alias("sides"))
        exact = _best(_compare(_blocks(one(base.select(F.col("vec_id").alias("id"), "v")), one(short), sizes), dims, wanted), wanted).drop("rank")
        found = found.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(exact)
    out = members.join(found.select("q", "vec_id", "score"), "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
