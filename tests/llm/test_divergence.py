"""Source divergence against plain Python with whole numbers of any size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import divergence
from tests.llm.conftest import ODD, frame

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        counts[lang, source].update(terms)
        docs[lang].update(terms.keys())
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        terms = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in terms})

        def shares(count, terms=terms):
            total = sum(count[t] for t in terms) + 2 * len(terms)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in terms}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(price(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s]
            best = [(price(p[s][t], q[t]), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= 10}
    return out


def rows(seed, count):
    random.seed(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("X", "y", "é", "ÄB", "日")]
    out = []
    for i in range(count):
        source = random.choice(["s1", "s2", "s3", "é", "z", None])
        some = words[:: 2 if source == "s1" else 1]
        text = " ".join(random.choice(some) for _ in range(random.randint(0, 30)))
        out.append((i, random.choice([text, text + "1" + text, None]), random.choice(["en", "en", "de", None]), source))
    return out + [(900, "", "en", "empty"), (901, None, "fr", "a"), (902, "nur einmal", "fr", "b")]


@pytest.mark.parametrize("limits", [{}, {"ENTRIES": 7, "MOST_ENTRIES": 7, "WALKED": 5}, {"ENTRIES": 11, "MOST_ENTRIES": 11, "ROWS": 2}])
def test_equal_to_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    table = rows(1, 300)
    got = [tuple(r) for r in divergence.audit(frame(spark, table).repartition(5)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(table, 10)


def test_odd_tables(spark, odd, none):
    got = [tuple(r) for r in divergence.audit(odd, least_docs=1).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ODD, 1)
    got = [tuple(r) for r in divergence.audit(odd).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert set(got) == brute(ODD, 10) and {r[4] for r in got} == {0}
    assert divergence.audit(none).count() == 0


def test_shares_of_large_counts_are_exact():
    random.seed(2)
    total = [random.randint(10**14, 9 * 10**15) for _ in range(200)]
    count = [random.randint(0, t - 2) for t in total]
    assert divergence.share(np.array(count), np.array(total)).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(count, total, strict=True)]


def test_large_counts_in_sql(spark):
    big = spark.sql("SELECT 1 + cast(1000000000 as decimal(10,0)) * cast(1234567890123456L + 2 as decimal(20,0)) div cast(7654321987654321L as decimal(20,0)) AS p").first().p
    assert big == 1 + 10**9 * (1234567890123456 + 2) // 7654321987654321


def test_tree_meets_every_pair_of_a_column_once():
    random.seed(3)
    cells = sorted({(random.randrange(9), random.randrange(40)) for _ in range(150)})
    row, column = np.array(cells).T
    tree = divergence.QuadTree(row, column)
    met = Counter()
    for upper, lower in tree.meetings():
        for a, b in zip(tree.order[upper], tree.order[lower], strict=True):
            met[cells[a], cells[b]] += 1
    assert met == {(a, b): 1 for a in cells for b in cells if a[1] == b[1] and a[0] < b[0]}
