"""Bounds of the language margins: exact quantiles over all held-out texts."""

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import langid


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(float(m), int(s)) for s, n in ((3, 1), (5, 2), (6, 150), (7, 1000), (9, 2501)) for m in np.round(rng.gamma(2, 0.2, n), 3 if s == 9 else 12)]
    found = langid.rare_margins(spark.createDataFrame(rows, "margin double, size int").repartition(7))
    for size in (3, 5, 6, 7, 9):
        own = [m for m, s in rows if s == size]
        assert found[size][0] == len(own)
        assert abs(found[size][1] - np.quantile(own, langid.RARE)) < 1e-12
    assert langid.rare_margins(spark.createDataFrame([], "margin double, size int")) == {}


def test_every_held_out_text_counts(spark, monkeypatch):
    seen = []
    whole = langid.rare_margins
    monkeypatch.setattr(langid, "rare_margins", lambda df: seen.append(df.count()) or whole(df))
    texts = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc def").alias("text"), F.lit("en").alias("lang"))
    held = texts.where(langid.held_out()).count()
    model = langid.with_bounds(texts, langid.fit(texts))
    assert held > 800 and seen == [held]
    assert model.bounds is not None
