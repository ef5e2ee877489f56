import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row_id string, h double, key string, cls string, bucket int, rule string, dest string"


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names the operators use inside."""
    full = [(d, t, lang, s, len(t) if t is not None else None, -1, "x", 0.5, "k", "c", 7, "r", "d") for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b"),
    (3, "Alpha Beta GAMMA delta epsilon zeta eta theta iota kappa", "en", "a"),
    (3, "Alpha Beta GAMMA delta epsilon zeta eta theta iota kappa", "en", "a"),
    (9, None, "de", "a"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", None, None),
    (None, None, None, None),
    (11, "", "en", "b"),
    (12, " \t\n ", "en", None),
    (13, "12345 !!", "fr", "c"),
    (7, "one two", "en", "c"),
    (8, "one two", "en", "é"),
    (20, "word " * 40_000 + "ende", "de", "b"),
    (21, "x" * 200_000, "en", "b"),
    (5, "another text with the same number", "en", "b"),
    (-4, "Größe  und\u00a0Maß — 日本語 mail a@b.de \U0001f600 end", "de", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
