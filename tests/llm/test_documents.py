"""Operators on documents against plain Python, odd tables included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import fingerprints, idfiles, langid, licenses, mixing, neardup, packing, pii
from tessella.llm.common import new_folder, text_bytes
from tessella.llm.tokens import Encoder
from tests.llm.conftest import ODD, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.fixture(scope="module")
def texts(spark):
    from tests.conftest import SF

    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# tokens


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path, texts):
    some = [t for _, t in texts[:80]] + [t or "" for _, t, *_ in ODD]
    some += ["", " ", " a", "a ", "a  b", "a\n b", "a \nb", "don't! stop' 'it it's", "\u0301 e\u0301 x", "<|endoftext|> a", "\0a b", "a\u00a0 b", "x|y | z", "ΟΔΟΣ Σ!"]
    coder = Encoder(path)
    some += [f"a{chr(c)}b {chr(c)}1'S{chr(c)} 'll{chr(c)}\u0301" for c in [*range(1, 0x250), *range(0x250, 0x30000, 61)] if not 0xD800 <= c < 0xE000]
    block = text_bytes(pa.array(some))
    ids, counts = coder.encode(*block)
    again, _ = coder.encode(*block)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert ids.tolist() == again.tolist()


# mixing


def test_mix_is_near_its_targets(spark):
    random.seed(4)
    rows = [(i, "w " * random.choice([0, 1, 5, 40, 900]), "en", random.choice(["a"] * 8 + ["b", "c", "d", None])) for i in range(400)]
    docs = frame(spark, rows)
    got = mixing.mix_report(docs, block_words=16).collect()
    sizes = {r[0]: len(WORD.findall(r[1])) for r in rows}
    assert {r.doc_id: r["size"] for r in got} == sizes
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken, target, own = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        own[r.source] += r["size"]
        target[r.source] = r.target
    assert all(taken[s] == round(t) for s, t in target.items())
    assert all(t <= 3 * own[s] for s, t in target.items())
    left = [(t / w, s) for (s, t), w in zip(sorted(target.items(), key=lambda x: (x[0] is None, x[0] or "")), [1, 2, 3, 1, 2], strict=True) if t < 3 * own[s]]
    assert max(left)[0] - min(left)[0] < 1e-9
    again = mixing.mix_report(docs.repartition(5), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_every_stretch_of_the_mix_has_the_shares(spark):
    rows = [(i, "w " * 50, "en", "abc"[i % 3]) for i in range(300)]
    parts = mixing.sized(frame(spark, rows))
    per = mixing.targets(parts)
    pieces = mixing.mix(parts, per, block_words=10).toPandas()
    share = {"a": 1 / 6, "b": 2 / 6, "c": 3 / 6}
    for end in (60, 300, 900, 1500):
        some = pieces[pieces.slot < end]
        for source, part in share.items():
            assert abs(some[some.source == source].slot.nunique() - part * end) < 5
    assert (pieces.groupby("slot").source.nunique() == 1).all()


def test_mix_of_odd_tables(odd, none):
    got = mixing.mix_report(odd).collect()
    assert len(got) == len(ODD) and sum(r.taken for r in got) > 0
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_report(none).count() == 0
    made = mixing.mixed_documents(odd)
    assert made.columns == odd.columns
    words = Counter()
    for r in made.collect():
        words[r.source] += len(WORD.findall(r.text))
    want = Counter()
    for r in got:
        want[r.source] += r.taken
    assert +words == +want
    assert mixing.mixed_documents(none).count() == 0


def test_mixed_documents_take_what_the_report_says(spark):
    random.seed(9)
    rows = [(1, "a b c d", "en", "s1")] * 3 + [(2, "one two three", "en", "s1"), (1, "a b c d", "en", "s2"), (1, None, "en", "s2"), (None, "x y", "en", None), (None, "x y", "en", None)]
    rows += [(10 + i % 7, " ".join("w" * random.randint(1, 3) for _ in range(random.randint(0, 9))), "en", random.choice(["s1", "s2", "s3", "s4"])) for i in range(60)]
    for table in (rows[:3], rows[:6], rows):
        docs = frame(spark, table).repartition(3)
        report = mixing.mix_report(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()
        made = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
        assert {r.source: r.n for r in report if r.n} == {r.source: r.n for r in made}


# near duplicates


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    random.seed(words)
    base = [[random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 4) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(220):
        copy = list(base[min(i // 12, 11)] if i < 150 else random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            copy[random.randrange(len(copy))] = "changed" + str(random.randrange(9))
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, " ".join(base[0][:5])) for i in range(5)] + [(None, " ".join(base[1])), (3000, "the"), (3001, "THE"), (3002, None), (3003, "")]
    got = neardup.near_duplicates(frame(spark, [(d, t, None, None) for d, t in rows]), words, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_tables(odd, none):
    got = neardup.near_duplicates(odd, 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components([r[:2] for r in ODD], 3, 85)
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.without_near_duplicates(odd, 3, 85)
    assert left.columns == odd.columns
    assert Counter(r.doc_id for r in left.collect()) == {3: 1, 9: 1, None: 1, 11: 1, 12: 1, 13: 1, 7: 1, 20: 1, 21: 1, 5: 1, -4: 1}


def test_many_texts_of_one_doc_id(spark):
    """Rows are found by doc_id and text together, so texts that share an id do not meet each other's classes."""
    random.seed(4)
    base = [[f"w{random.randrange(4000)}" for _ in range(40)] for _ in range(60)]
    rows = [(d, " ".join([*words[:-1], tail])) for words in base for d, tail in ((7, "one"), (None, "two"))]
    rows += rows[:3]
    docs = frame(spark, [(d, t, None, None) for d, t in rows])
    got = neardup.near_duplicates(docs, 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 3, 85)
    marked = neardup.sketches(docs, 3, 0.85, 5, 1e-7)
    wanted = marked.groupBy("cls").agg(F.min(F.struct("h", "g")).alias("m")).select("cls", "m.h", "m.g")
    assert neardup.class_sets(docs, wanted, 3).count() == 120


def test_groups_of_a_hub_follow_its_partners(spark):
    pairs = spark.range(5000).select(F.lit(1).alias("a"), (F.col("id") + 10).alias("b")).unionByName(spark.range(30).select(F.lit(2).alias("a"), (F.col("id") + 10).alias("b")))
    dealt = neardup.parts_of(pairs, 100)
    assert dealt.count() == 5030
    sizes = {(r.a, r.part): r["count"] for r in dealt.groupBy("a", "part").count().collect()}
    assert sum(a == 1 for a, _ in sizes) == 50 and max(sizes.values()) < 200
    assert sizes[2, 0] == 30


# token files


def test_elias_fano():
    random.seed(1)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (700, 3), (2000, 10**6), (1500, 2**40)):
        values = np.sort([random.randint(0, top) for _ in range(n)]).astype(np.uint64)
        sizes, data = idfiles.EliasFano.of(values).sections()
        back = idfiles.EliasFano.read(sizes, memoryview(data))
        assert back.all().tolist() == values.tolist() == [back[i] for i in range(n)]
        assert len(data) * 8 <= n * (3 + max(0, np.log2((top + 1) / max(n, 1)))) + 64 * (n // 512 + 2) + 16


def test_token_files(spark, odd, none, texts):
    rows = [(d, t, None, None) for d, t in texts] + [(d + 10_000 if d is not None else None, t, None, None) for d, t, *_ in ODD]
    folder = new_folder(spark, "ids")
    shards = idfiles.write_token_files(frame(spark, rows).repartition(5), folder, BYTES)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    for table in (shards, idfiles.shard_table(spark, folder)):
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in idfiles.read_token_files(table).collect())
        assert [g[1] for g in got] == [d for d in sorted((r[0] for r in rows), key=lambda d: (d is None, d))]
        assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0
        assert Counter((g[1], g[2], g[3]) for g in got) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, all_ in ids.items() for x in all_)
    first = shards.orderBy("shard").first()
    reader = idfiles.Shard(first.path)
    assert reader.ids(0).tolist() in ids[reader.doc_id(0)] and reader.bounds(0)[0] == 0
    assert idfiles.read_token_files(idfiles.write_token_files(none, new_folder(spark, "ids"), BYTES)).count() == 0


def test_wide_ids(spark, tmp_path):
    docs = frame(spark, [(1, "some words", None, None), (2, None, None, None)])
    got = idfiles.read_token_files(idfiles.write_token_files(docs, new_folder(spark, "ids"), BYTES, end_id=70_000)).collect()
    some = [*Tokenizer.from_file(BYTES).encode("some words").ids, 70_000]
    assert {r.doc_id: r.ids_crc32 for r in got} == {1: zlib.crc32(np.array(some, "<u4").tobytes()), 2: zlib.crc32(np.array([70_000], "<u4").tobytes())}
    with pytest.raises(ValueError):
        idfiles.write_shard(str(tmp_path / "x.tsids"), iter([([1], np.array([70_000], np.uint32), np.array([1]))]), False)


# fingerprints


@pytest.mark.parametrize("per_task", [3, 4096])
def test_fingerprints(spark, texts, none, per_task):
    rows = texts[:60] + [(500, None), (501, ""), (502, texts[0][1]), (503, "x" * 90_000), (504, "a\n" * 400)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, [(d, t, None, None) for d, t in rows]), per_task).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        other = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        a, b, c = (set(fingerprints.digests(x).tolist()) for x in (text, other, following))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert abs(r.near_edited - near(a, b)) < 1e-12 and abs(r.near_next - near(a, c)) < 1e-12
    assert got[502].fingerprint == got[texts[0][0]].fingerprint != got[texts[1][0]].fingerprint
    assert fingerprints.fingerprints(none, per_task).count() == 0


def test_fingerprints_do_not_depend_on_blocks_and_groups(texts, monkeypatch):
    """Texts by blocks of any size, one at a time included, and sketches that are peeled together or alone."""
    texts = [*[t or "" for _, t in texts][:60], "", "", " \n", "a b\nc\n" * 3000, "x"]
    rows = [(len(texts) - i, t, 0) for i, t in enumerate(texts)]
    whole = fingerprints._compared(rows)
    assert len(whole) == len(rows) - 1
    for size in (0, 1, 500, 10**9):
        monkeypatch.setattr(fingerprints, "BLOCK", size)
        blocks = list(fingerprints._blocks(rows))
        assert size != 10**9 or len(blocks) == 1
        assert [r for b in blocks for r in fingerprints._compared(b)] == whole
    assert list(fingerprints._blocks([])) == [] and list(fingerprints._blocks(rows[:1])) == [rows[:1]]
    keys, counts = fingerprints.block_digests(texts)
    assert [k.tolist() for k in np.split(keys, np.cumsum(counts)[:-1])] == [fingerprints.digests(t).tolist() for t in texts]
    for (doc, _, _, mark, _, _, near), (_, text, _), (_, after, _) in zip(whole, rows, rows[1:]):
        a, b = fingerprints.digests(text), fingerprints.digests(after)
        assert mark == fingerprints.Sketch(fingerprints.CELLS).add(a).text()
        mine, other = fingerprints.difference(a, b)
        assert (set(mine.tolist()), set(other.tolist())) == (set(a.tolist()) - set(b.tolist()), set(b.tolist()) - set(a.tolist()))
        every = len(set(a.tolist()) | set(b.tolist()))
        assert near == ((every - len(mine) - len(other)) / every if every else 1.0)


def test_groups_are_bounded(spark, texts, monkeypatch):
    table = frame(spark, [(d, t, None, None) for d, t in texts])
    whole = sorted(fingerprints.fingerprints(table).collect(), key=str)
    monkeypatch.setattr(fingerprints, "MOST_GROUPS", 3)
    assert fingerprints._destinations(table, 1)[0] <= 3
    assert sorted(fingerprints.fingerprints(table, 1).collect(), key=str) == whole


def test_fingerprints_of_odd_tables(spark, odd):
    assert Counter(r.doc_id for r in fingerprints.fingerprints(odd, 4).collect()) == Counter(r[0] for r in ODD)
    single = fingerprints.fingerprints(frame(spark, [(None, "a b\nc", None, None)])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_a_sketch_that_is_too_small_is_built_larger():
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**63, 900).astype(np.uint64)) for s in (1, 2))
    both = np.concatenate([a, b[:20]])
    assert fingerprints.Sketch(8).add(a).minus(fingerprints.Sketch(8).add(b)).peel() is None
    mine, other = fingerprints.difference(both, a)
    assert sorted(mine.tolist()) == sorted(b[:20].tolist()) and not len(other)


# licences


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, odd, none):
    assert len(licenses.rules()) > 300
    cases = [
        "Licensed under the Apache License, Version 2.0 (the terms)", "CC BY-NC 4.0 and cc_by, ccby", "This is under the GNU General Public License, version 3.\nAll rights reserved.",
        "ALL RIGHTS  RESERVED all rights reserved", "allrights reserved; all rights reservedly", "Released under the MIT License.", "SPDX-License-Identifier: BSD-3-Clause", "mit freundlichen Grüßen", "écc by", "cc by",
    ]
    rows = [(100 + i, t, None, None) for i, t in enumerate(cases)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows).union(odd.where("doc_id = 20"))).collect()}
    for doc, text, *_ in rows:
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[100].labels == "apache-2.0" and "cc-by-nc-4.0" in got[101].labels and "gpl-3" in got[102].labels
    assert got[105].labels == "mit" and got[106].labels == "bsd-3-clause" and got[107].labels == "" and got[107].score == 0
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


def test_keywords_lose_no_match():
    assert all(re.fullmatch(b"[0-9a-z]+", r.keyword) for r in licenses.rules())
    notices = [
        'THE SOFTWARE IS PROVIDED "AS IS"', "permission is hereby granted, free of charge", "without warranty of any kind", "redistribution and use in source and binary forms",
        "permission to use, copy, modify, and distribute", "it may not be copied without the prior written permission", "placed in the public domain", "in the public domain",
        "no rights reserved", "some rights reserved", "all rights reserved", "general public license", "proprietary and confidential", "copyright (c) 2001", "cc0",
    ]
    families = [t for label, name, versions, url in licenses.FAMILIES for n in [re.sub(r"[][]", "", name)] for t in (
        f"http://{url}/", f"spdx-license-identifier: {label}", f"{n} license", f"licensed under the {n} licence version {(versions.split() or [''])[0]}", f"released under the terms of the {n}")]
    terms = [t for short, named in licenses.CREATIVE for t in (f"creativecommons.org/licenses/{short}/4.0", f"cc {short} 3.0", f"creative commons {named} 4.0 international license")]
    plain = [*notices, *families, *terms]
    texts = [re.sub("[ ./:]+", gap, t) for t in plain for gap in ("\n", "  ", "\r\n * ", ' "', " / ")] + plain
    data = np.frombuffer(lower("".join(texts)).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = licenses.scan_block(data, offsets)
    for i, text in enumerate(texts):
        low = lower(text).encode()
        want = {(m.start(), m.end(), r.label) for r in licenses.rules() for m in r.pattern.finditer(low)}
        assert {(s, e, r.label) for s, e, r in got.get(i, [])} == want, text
        assert want or not any(t == text for t in notices), text


def test_containment():
    rule = lambda label, priority: licenses.Rule(b"", re.compile(b""), label, priority, 0.5)
    random.seed(2)
    for _ in range(200):
        hits = [(s, s + random.randint(1, 12), rule(random.choice("abc"), random.randint(1, 3))) for s in (random.randrange(20) for _ in range(9))]
        rank = lambda h: (-h[2].priority, h[0] - h[1], h[2].label)
        want = {(h[0], h[1], h[2].label) for h in hits if not any(g is not h and g[0] <= h[0] and g[1] >= h[1] and rank(g) < rank(h) for g in hits)}
        assert {(s, e, r.label) for s, e, r in licenses.resolve(hits)} == want


# personal data


def brute_fixed(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return pii.in_order(out)


def test_fixed_patterns(texts):
    random.seed(3)
    some = ["".join(random.choices("a1.@+- 0(9)é-", k=random.randint(1, 60))) for _ in range(3000)] + [t for _, t in texts]
    some += ["4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (454) 555-9913", "x@@y.z", "0255.1.1.1", "999.1.1.1"]
    assert all(pii.fixed_spans(t) == brute_fixed(t) for t in some)
    pii.fixed_spans("1" * 300_000 + "@" + "a" * 300_000 + " +" + "(" * 300_000)


def test_viterbi_is_the_best_path():
    random_ = np.random.default_rng(5)
    scores, moves, lengths = random_.normal(size=(6, 5, 3)), random_.normal(size=(3, 3)), np.array([5, 1, 3, 4, 2, 5])
    from itertools import product

    found = pii.viterbi(scores, lengths, moves)
    for s, n, tags in zip(scores, lengths, found, strict=True):
        best = max(product(range(3), repeat=int(n)), key=lambda p: sum(s[t, p[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(tags[:n]) == best


def test_field_finds_what_patterns_miss(spark, odd, none):
    model_rows = [(1, 'é der token = "77aa64439e3e49cf46b2d7c90f3602a3d0b907cc" end', None, None), (2, "and password=99aa5a4fcc78305 next", None, None), (3, "the token was lost in 1999", None, None), (4, "mail a@b.de and 10.0.0.1", None, None)]
    docs = frame(spark, model_rows)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[1].spans == "secret:15:55" and got[2].spans == "secret:13:28" and got[3].spans == "" and got[4].spans == "email:5:11,ip:16:24"
    assert got[4].base_sha256 == hashlib.sha256(b"email:5:11,ip:16:24").hexdigest()
    masked = {r.doc_id: r for r in pii.without_personal_data(docs).collect()}
    assert masked[2].text == "and password=<secret> next" and masked[2].n_chars == len(masked[2].text)
    assert masked[3].text == model_rows[2][1]
    assert pii.find(odd).count() == len(ODD) and pii.find(none).count() == 0
    left = pii.without_personal_data(odd)
    assert left.columns == odd.columns and left.count() == len(ODD) and left.where("text IS NULL").count() == 2


def test_secrets_of_letters_and_beside_patterns(spark):
    cases = [
        ("password=correcthorse", "password=<secret>", "secret:9:21"), ('secret = "kjhgfdsapoiu"', 'secret = "<secret>"', "secret:10:22"), ("set pwd: swordfishes now", "set pwd: <secret> now", "secret:9:20"),
        ("pwd=abc@d.com,hunter2secret99 and", "pwd=<email>,<secret> and", "email:4:13,secret:14:29"), ("password=me@corp.example.com tail", "password=<email> tail", "email:9:28"),
    ]
    cases += [(t, t, "") for t in ("a password is needed", "the secret garden was beautiful", "the token = value pair", 'name = "something" here', "key=value", "verantwortlichkeiten", "password reset instructions")]
    docs = frame(spark, [(i, t, None, None) for i, (t, *_) in enumerate(cases)]).coalesce(1)
    spans, texts = ({r.doc_id: r[name] for r in df.collect()} for df, name in ((pii.find(docs), "spans"), (pii.without_personal_data(docs), "text")))
    for i, (text, masked, listed) in enumerate(cases):
        assert (spans[i], texts[i]) == (listed, masked), text
    # what a word announces ends with its row
    raw = [b"the password", b"= correcthorsebattery"]
    first = np.array([0, 2, 4])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends = pii.word_spans(~pii.BLANK_BYTES[data], np.array([0, len(raw[0]), len(data)]))
    assert pii.shapes(data, starts, ends, first)[:, -1].sum() == 0


# language


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    model = langid.fit(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD) and Counter(r.lang_pred for r in rows)["und"] == 5
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert langid.of_known_language(odd, model).count() == len(ODD) - 5
    empty = langid.fit(none)
    assert langid.identify(none, empty).count() == 0 and {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_language_decisions_take_effect(spark):
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    clean = docs.collect()
    junk = [(10**6 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=600)), None, "a", 600) for i in range(40)]
    some = [r for r in clean if r.lang is not None and len(r.text or "") > 300][:40]
    unseen = [d for d in range(2 * 10**6, 2 * 10**6 + 1000) if zlib.crc32(str(d).encode()) % 4 == 2]
    wrong = [(unseen[i], r.text, None if i % 2 else "en" if r.lang == "de" else "de", "a", r.n_chars) for i, r in enumerate(some)]
    every = spark.createDataFrame([*map(tuple, clean), *junk, *wrong], docs.schema)
    model = langid.with_bounds(every, langid.fit(every))
    got = {r.doc_id: r.lang for r in langid.of_known_language(every, model).collect()}
    assert not any(d in got for d, *_ in junk)
    assert sum(r.doc_id in got for r in clean) >= 0.995 * sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in clean)
    assert sum(got.get(w[0]) == r.lang for w, r in zip(wrong, some, strict=True)) >= 39
    # a language the model has not seen
    foreign = docs.where("lang = 'fr'")
    rest = docs.where("lang <> 'fr'")
    model = langid.with_bounds(rest, langid.fit(rest))
    long = foreign.where("n_chars > 300")
    assert langid.of_known_language(long, model).count() <= 0.05 * long.count()
    # nothing to learn from
    bare = docs.withColumn("lang", F.lit(None).cast("string")).where("text rlike '[a-z]'")
    left = langid.of_known_language(bare, langid.with_bounds(bare, langid.fit(bare)))
    assert left.count() == bare.count() and left.where("lang IS NOT NULL").count() == 0


def test_exact_kernel_ridge(spark, texts):
    """With every text a landmark the decisions are those of kernel ridge regression without approximation."""
    rows = [(d, t, "en" if i % 3 else "de", None) for i, (d, t) in enumerate(texts[:60])]
    docs = frame(spark, rows)
    model = langid.fit(docs, landmarks=1000, ridge=1e-3)
    learned = [(r.text, r.lang) for r in docs.where(~langid.held_out()).collect()]
    unit = lambda some: np.concatenate([langid.unpacked(np.packbits(f.astype(bool), axis=1)) for _, _, f in langid.presences(some)]).astype(np.float64)
    known = unit([t for t, _ in learned])
    target = np.where(np.array([lang for _, lang in learned])[:, None] == np.array(["de", "en"]), 1.0, -1.0)
    weights = np.linalg.solve(known @ known.T + 1e-3 * len(learned) * np.eye(len(learned)), target)
    exact = unit([t for _, t, *_ in rows]) @ known.T @ weights
    found = np.array([v for _, v, _ in model.values([t for _, t, *_ in rows])])
    assert model.labels == ["de", "en"] and np.abs(exact - found).max() < 1e-3
    assert (exact.argmax(axis=1) == found.argmax(axis=1)).all()


def test_fit_with_many_rows_of_one_document(spark):
    rows = [(1, f"one text number {i}", "en", None) for i in range(300)] + [(i, f"ein Text {i}", "de", None) for i in range(40)]
    docs = frame(spark, rows)
    chosen = langid._texts(docs, langid._chosen(docs, 5), 5)
    assert {r["_lang"]: r["count"] for r in chosen.groupBy("_lang").count().collect()} == {"en": 5, "de": 5}
    assert set(langid.fit(docs, per_class=5).labels) <= {"en", "de"}


def test_fit_unpacks_few_texts_at_a_time(monkeypatch):
    held = []
    plain = langid.unpacked
    monkeypatch.setattr(langid, "unpacked", lambda bits: held.append(len(bits)) or plain(bits))
    bits = np.random.default_rng(1).integers(0, 256, (500, langid.SIZE // 8), dtype=np.uint8)
    langid.regression(bits, ["a", "b"] * 250, landmarks=20, ridge=1e-3)
    assert max(held) <= 64


def test_presences_of_long_texts_are_whole():
    text = "".join(random.Random(6).choices("abcdefgh ", k=5000))
    (whole,) = (f for *_, f in langid.presences([text]))
    (cut,) = (f for *_, f in langid.presences([text], chars=700))
    assert (whole == cut).all()


# packing


def test_hilbert_neighbours_are_neighbours():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert_keys(grid, 3)
    walk = grid[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark, odd, none, texts):
    rows = [(d, t, None, None) for d, t in texts[:80]] + [(d + 5000, t, None, None) for d, t, *_ in ODD[6:] if d not in (5, None)]
    pieces = packing.pack(frame(spark, rows), WORDS, length=256).toPandas()
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    for r in pieces.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and r.length == len(part) > 0
    by_doc = pieces.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert (by_doc.length.cumsum() - pieces.length == pieces.start).all() and by_doc.length.sum().to_dict() == {d: len(x) for d, x in ids.items()}
    by_sequence = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_sequence.length.cumsum() - pieces.length == pieces.offset).all()
    assert all(n <= 256 and n & (n - 1) == 0 for n in by_sequence.length.sum())
    assert packing.pack(odd, WORDS).agg({"length": "sum"}).first()[0] > 0 and packing.pack(none, WORDS).count() == 0
