"""Nearest neighbours and URL filters against brute force, odd tables included; the pipeline on a small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import neighbours, urls
from tessella.llm.queries import RULES
from tests.llm.conftest import ODD, frame

QUERY = "vec_id % 100 = 0"


def brute(rows, k=10):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in usable:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in usable if i != q)
            out[q] = [i for _, i in best[:k]]
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in table.collect()])
    got = {}
    for r in neighbours.search(table, QUERY).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    assert all([x[0] for x in sorted(g)] == list(range(1, 11)) and [x[2] for x in sorted(g)] == sorted(x[2] for x in g) for g in got.values())
    assert sum(len({x[1] for x in got[q]} & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_recall_in_every_density(spark):
    rng = np.random.default_rng(3)
    scales = [1.0] * 2500 + [1.5] * 700 + [4.0] * 100 + [0.05] * 700
    rows = [(i * 10, [float(x) for x in rng.normal(0, scale, 12)], scale) for i, scale in enumerate(rng.permutation(scales).tolist())]
    want = brute([r[:2] for r in rows])
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, scale double"), QUERY).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = {}
    for number, _, scale in rows:
        if number in want:
            hits.setdefault(scale, []).append(len(got[number] & set(want[number])) / 10)
    recall = {scale: round(float(np.mean(x)), 3) for scale, x in hits.items()}
    assert len(recall) == 4 and min(recall.values()) >= 0.9, recall


def test_odd_vectors(spark):
    random.seed(8)
    same = [1.0, 2.0, 3.0]
    rows = [(i, [random.gauss(0, 1) for _ in range(3)]) for i in range(1, 60)] + [(i, same) for i in range(100, 400)] + [(800, same)]
    rows += [(None, same), (500, None), (600, [1.0, None, 2.0]), (700, [float("nan"), 1.0, 1.0]), (900, [0.0, 0.0, 0.0]), (1000, [float("inf"), 0.0, 0.0]), (59, rows[58][1])]
    table = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, key string, part int")
    got = {}
    for r in neighbours.search(table, QUERY).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    exact = {100: [*range(101, 111)], 200: [*range(100, 110)], 300: [*range(100, 110)], 800: [*range(100, 110)]}
    assert {q: [v for _, v in sorted(g)] for q, g in got.items()} == exact
    few = table.where("vec_id IN (100, 101, 3)")
    assert neighbours.search(few, QUERY).count() == 2
    assert neighbours.search(table.where("vec_id = 900"), QUERY).count() == 0
    assert neighbours.search(table.where("false"), QUERY).count() == 0


def reference(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (-1,), (len(rule), verdict == "block", rule, verdict))
    return host, path, best and best[2], best[3] if best else "allow"


def test_mixed_lengths(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(6 if i % 3 else 9).tolist()) for i in range(300)] + [(500, rng.standard_normal(20).tolist()), (501, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 50 == 0, target=0.999).collect()
    every = {i: np.array(v) for i, v in rows}
    exact = {}
    for q in [i for i in every if i % 50 == 0]:
        near = sorted((float(np.sqrt(((every[q] - v) ** 2).sum())), i) for i, v in every.items() if i != q and len(v) == len(every[q]))
        exact[q] = [i for _, i in near[:10]]
    hits = sum(r.vec_id in exact[r.query_id] for r in got)
    assert hits >= 0.95 * sum(map(len, exact.values())) and {r.query_id for r in got} == {q for q, near in exact.items() if near}


def test_urls(spark):
    random.seed(9)
    names, parts = ["net", "example.net", "a.example.net", "b.org", "org", "x.b.org", "EXAMPLE.Net", "myexample.net", "", "net."], ["", "/", "/en/", "/en", "/en/x/y", "/de/?q=/en/", "/fr/#a", "/énx/é/", "?/en/"]
    links = [f"http://{a}{b}" for a in names for b in parts] + [None, "", "no scheme/net/", "://net/", "http://", "x://a://net/en/", "http://net/" + "a/" * 50_000]
    rules = [*RULES, ("b.org", "block"), ("x.b.org/en", "allow"), ("example.net/en/x/", "block"), ("net/én", "allow"), ("org/fr/", "block")]
    rows = [(i, u, "h", "p") for i, u in enumerate(links)] + [(None, "http://a.net/", "h", "p")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _h string")
    for some in (RULES, rules):
        want = sorted((str(r[0]), *map(str, reference(r[1], some))) for r in rows)
        for limit in (urls.MAX_RULE_BYTES, 0):
            got = urls.judge(pages, some, max_rule_bytes=limit)
            assert sorted((str(r.page_id), r["host"], r.path, str(r["rule"]), r.verdict) for r in got.collect()) == want
    assert urls.judge(pages.where("false"), RULES).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, ODD).drop("row_id", "h", "key", "cls", "bucket", "rule", "dest", "size")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sequences":
            assert docs.columns == columns
        if name == "near_copies":
            assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(map(str, [3, 7, 20, 21, 5, -4]))
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).count() == 0
