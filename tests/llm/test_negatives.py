"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, rank int, h string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, 1, "x", 0) for i, v, label in rows], SCHEMA)


def brute(rows, is_anchor, count=5, k=10, least=30, most=90, relabel=True):
    good = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if relabel and i is not None and i % 7 == 0:
            label = (label + 1) % 10
        w = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in w) < 2**62 and (i, w, label) not in good:
            good.append((i, w, label))
    out = []
    for a in good:
        if a[0] is None or not is_anchor(a[0]):
            continue
        score = lambda b, a=a: sum(x * y for x, y in zip(a[1], b[1], strict=True))
        others = [b for b in good if b != a and len(b[1]) == len(a[1])]
        others.sort(key=lambda b: (-score(b), b[0] is None, b[0] or 0))
        for p in [b for b in others if b[2] == a[2]][:count]:
            inside = [b for b in others if b[2] != a[2] and least * score(p) <= 100 * score(b) <= most * score(p)]
            out += [(a[0], p[0], r, b[0], score(p), score(b)) for r, b in enumerate(inside[:k], 1)]
    return sorted(out, key=str)


def mined(df, **more):
    relabel = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, relabel=relabel, **more)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(seed, count, dims=6):
    random.seed(seed)
    base = [[random.gauss(0.3, 0.5) for _ in range(dims)] for _ in range(40)]
    return [(i, list(random.choice(base)) if i % 3 else [random.gauss(0.2, 0.6) for _ in range(dims)], random.choice([0, 0, 0, 1, 2])) for i in range(count)]


@pytest.mark.parametrize("limits", [{}, {"CELLS": 6 * 20, "SCORED": 70}])
def test_equal_to_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(1, 400)
    assert mined(table(spark, rows).repartition(3)) == brute(rows, lambda i: i % 10 == 0)


def test_other_windows(spark):
    rows = vectors(2, 150)
    assert mined(table(spark, rows), count=9, k=3, least=55, most=101) == brute(rows, lambda i: i % 10 == 0, 9, 3, 55, 101)


def test_odd_tables(spark):
    rows = vectors(3, 60)
    rows += [(70, None, 1), (80, [1.0] * 6, None), (90, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (100, [math.nan] * 6, 0), (110, [math.inf] * 6, 0)]
    rows += [(120, [0.0] * 6, 0), (121, [0.0] * 6, 1), (130, [0.5, 0.25], 0), (131, [0.5, 0.5], 0), (132, [0.5, 0.2], 1), (140, [], 0), (141, [], 0), (142, [], 1)]
    rows += [rows[20], rows[20], (20, [0.4] * 6, 0), (None, [0.3] * 6, 1), (None, [0.3] * 6, 2), (150, [1e300] * 6, 0), (160, [-1.0] * 6, 0), (161, [1.0] * 6, 0)]
    rows += [(200 + i, [0.25] * 6, 3) for i in range(30)]
    got = mined(table(spark, rows).repartition(4))
    assert got == brute(rows, lambda i: i % 10 == 0) and got
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(0, [1.0], 0)])) == []


def test_long_products_are_exact():
    random.seed(4)
    a = np.array([[random.randint(-(2**28), 2**28) for _ in range(8)] for _ in range(5)], np.int32)
    b = np.array([[random.randint(-(2**28), 2**28) for _ in range(8)] for _ in range(9)], np.int32)
    assert negatives._scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    small = negatives._scores(a >> 20, b >> 20)
    assert small.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b >> 20] for p in a >> 20]
