"""IIIF texts: a filter on parsed regions stays above the parse, and numbers without a match are null."""

from pyspark.sql import functions as F

from tessella.functions.kernels import leading_number, matched_number
from tessella.operators import geometry as G


def test_a_filter_on_regions_does_not_repeat_the_parse(spark):
    texts = ["full", "Square", "pct:10,20,5,55.5", "1,2,3", "5,5,9999,9999", "3,4,,6", "a,b,c,d", "0,0,0,5", "", None]
    asked = spark.createDataFrame([(i % 4, i, t) for i, t in enumerate(texts)], "image_id long, line int, region string")
    images = spark.createDataFrame([(0, 100, 50), (1, 30, 90), (2, 64, 64)], "image_id long, width int, height int")
    rows = G.with_iiif_region(asked.join(images.hint("merge"), "image_id"))
    good = rows.where("region_error IS NULL")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Join" in line] and not [line for line in plan.splitlines() if "Join" in line and "regexp" in line]
    every = rows.localCheckpoint()
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(good) == order(every.where("region_error IS NULL")) and 0 < good.count() < every.count()
    assert rows.columns == ["image_id", "line", "region", "width", "height", "region_x", "region_y", "region_w", "region_h", "region_error"]
    assert G.with_iiif_region(rows).columns == rows.columns
    found = {r.line: r for r in rows.collect()}
    assert (found[0].region_w, found[4].region_x, found[1].region_h) == (1.0, 0.05, 30 / 90)
    assert found[5].region_error == "incorrect region" and found[8].region_error == "incorrect region"


def test_numbers_at_the_start_of_texts(spark):
    texts = {"": None, "abc": None, "12abc": 12.0, " -.5": -0.5, "1e3x": 1000.0, "+7.": 7.0, "1e999": float("inf"), "x1": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    got = df.select("t", matched_number(F.col("t"), pattern).alias("m"), leading_number(F.col("t")).alias("n"), F.transform(F.array("t"), leading_number)[0].alias("a")).collect()
    assert {r.t: r.m for r in got} == texts
    assert all(r.n == r.a == (r.m or 0.0) for r in got)
