"""Histogram, range, threshold and equalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import pixelops
from tessella.operators import stats
from tessella.operators.tiles import map_blocks, tiles_to_pixels
from tessella.suite.registry import query

_PIX = ["image_id", "y", "x", "c"]


def pixels_of(tiles, tile: int = fx.TILE, digits: int | None = None):
    """(image_id, y, x, c, v) of a tile table; integers unless ``digits`` are asked for."""
    v = F.col("v").cast("int") if digits is None else F.round("v", digits)
    if digits is not None:
        v = F.when(v == 0, 0.0).otherwise(v)
    return tiles_to_pixels(tiles, tile, tile).select(*_PIX, v.alias("v"))


@query("histogram", "SELECT image_id, v AS bin, count(*) AS n FROM vec8 GROUP BY ALL")
def _(spark, sf):
    return stats.histogram(fx.vector_tiles(spark, sf, "grey"))


@query("histogram_rgb", """SELECT image_id, round((r + g + b) / 3.0::double)::int AS bin, count(*) AS n FROM rgbw GROUP BY ALL""")
def _(spark, sf):
    return stats.histogram(fx.vector_tiles(spark, sf, "rgb"))


@query("histogram_pixels", "SELECT image_id, v AS bin, count(*) AS n FROM vec8 GROUP BY ALL")
def _(spark, sf):
    return stats.pixel_histogram(fx.vector_pixels(spark, sf, "grey"))


@query("histogram_texts", """SELECT image_id, v AS bin, sum(n)::bigint AS n FROM (
    SELECT image_id, v, count(*) AS n FROM txt GROUP BY ALL UNION ALL
    SELECT doc_id, 0, ceil(octet_length(encode(text)) / 64.0)::bigint * 64 - octet_length(encode(text)) FROM documents)
    WHERE n > 0 GROUP BY ALL""")
def _(spark, sf):
    return stats.histogram(fx.text_tiles(spark, sf))


@query("histogram_deep", """SELECT image_id, floor(v / 65535.0::double * 255)::int AS bin, count(*) AS n FROM ord GROUP BY ALL""")
def _(spark, sf):
    tiles = fx.order_tiles(spark, sf).withColumns({"lo": F.array(F.lit(0.0)), "hi": F.array(F.lit(65535.0))})
    return stats.histogram(tiles, lo="lo", hi="hi")


@query("data_range", "SELECT image_id, c, min(v)::float::double AS lo, max(v)::float::double AS hi FROM vec GROUP BY ALL")
def _(spark, sf):
    return stats.data_range(fx.vector_tiles(spark, sf))


_HIST = "h AS (SELECT image_id, v AS bin, count(*) AS n FROM vec8 GROUP BY ALL)"
_OTSU = f"""{_HIST}, s AS (SELECT image_id, bin,
      sum(n) OVER u::double AS wb, sum(n * bin) OVER u::double AS sb,
      sum(n) OVER (PARTITION BY image_id)::double AS np, sum(n * bin) OVER (PARTITION BY image_id)::double AS sn
      FROM h WINDOW u AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT image_id, bin, CASE WHEN wb > 0 AND np - wb > 0
      THEN wb * (np - wb) * (sb / wb - (sn - sb) / (np - wb)) * (sb / wb - (sn - sb) / (np - wb)) ELSE 0 END AS score FROM s),
    otsu AS (SELECT image_id, CASE WHEN score > 0 THEN bin ELSE 0 END AS threshold FROM
      (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, bin) AS r FROM t) WHERE r = 1)"""


@query("cdf", f"""WITH {_HIST} SELECT image_id, bin, n,
    (sum(n) OVER (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING))::bigint AS cdf FROM h""")
def _(spark, sf):
    return stats.cdf(stats.histogram(fx.vector_tiles(spark, sf, "grey")))


@query("otsu_threshold", f"WITH {_OTSU} SELECT image_id, threshold FROM otsu")
def _(spark, sf):
    return stats.otsu_threshold(stats.histogram(fx.vector_tiles(spark, sf, "grey")))


@query("binary_white_pixels", f"""WITH {_OTSU} SELECT image_id, count(*) FILTER (v >= threshold) AS white, count(*) AS total
    FROM vec8 JOIN otsu USING (image_id) GROUP BY ALL""")
def binary_white_pixels(spark, sf):
    tiles = fx.vector_tiles(spark, sf, "grey")
    black_white = stats.binarize(tiles, stats.otsu_threshold(stats.histogram(tiles)))
    counts = stats.histogram(black_white)
    return counts.groupBy("image_id").agg(
        F.sum(F.when(F.col("bin") == 255, F.col("n")).otherwise(0)).alias("white"), F.sum("n").alias("total")
    )


@query("binary", f"""WITH {_OTSU} SELECT image_id, y, x, c, CASE WHEN v < threshold THEN 0 ELSE 255 END AS v
    FROM vec8 JOIN otsu USING (image_id)""")
def _(spark, sf):
    tiles = fx.vector_tiles(spark, sf, "grey")
    return pixels_of(stats.binarize(tiles, stats.otsu_threshold(stats.histogram(tiles))))


_LUT = f"""{_HIST}, f AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING)::double AS cdf,
      sum(n) OVER (PARTITION BY image_id)::double AS total, first_value(n) OVER (PARTITION BY image_id ORDER BY bin)::double AS n0 FROM h)"""


@query("equalize", f"""WITH {_LUT}, z AS (SELECT f.image_id, bin, round(255 / total * (cdf - n0 / (w * h)))::int % 256 AS e
      FROM f JOIN vec_size USING (image_id))
    SELECT p.image_id, y, x, c, e AS v FROM vec8 p JOIN z ON p.image_id = z.image_id AND p.v = z.bin""")
def _(spark, sf):
    tiles = fx.vector_tiles(spark, sf, "grey")
    sizes = fx.vector_heights(spark, sf).select("image_id", (F.col("img_h") * 64).cast("double").alias("np"))
    return pixels_of(stats.equalize(tiles, stats.equalize_table(stats.histogram(tiles), sizes)))


@query("equalize_standard", f"""WITH {_LUT}, z AS (SELECT image_id, bin, round(255 / (total - n0) * (cdf - n0))::int AS e FROM f)
    SELECT p.image_id, y, x, c, e AS v FROM vec8 p JOIN z ON p.image_id = z.image_id AND p.v = z.bin""")
def _(spark, sf):
    tiles = fx.vector_tiles(spark, sf, "grey")
    return pixels_of(stats.equalize(tiles, stats.equalize_table(stats.histogram(tiles), None, standard=True)))


@query("contrast_stretch", """WITH r AS (SELECT image_id, min(v)::double AS lo, max(v)::double AS hi FROM vec8 GROUP BY ALL)
    SELECT image_id, y, x, c, floor(least(greatest((v - lo) * (1 / (hi - lo)) * 255, 0), 255))::int AS v FROM vec8 JOIN r USING (image_id)""")
def _(spark, sf):
    from tessella.session import join_side_table

    tiles = fx.vector_tiles(spark, sf, "grey")
    ranges = stats.stretch_range(stats.histogram(tiles))
    joined = join_side_table(tiles, ranges, ["image_id"], "inner", spread_by=["tx", "ty"])
    run = lambda b, r: pixelops.contrast(pixelops.normalize(b, r["lo"], r["hi"]), 1.0)
    return pixels_of(map_blocks(joined, run, using=("lo", "hi"), drop=("lo", "hi")))


@query("contrast_stretch_deep", """WITH r AS (SELECT min(b) * 256.0::double AS lo, max(b) * 256.0::double AS hi
      FROM (SELECT floor(v / 65535.0::double * 255)::int AS b FROM ord))
    SELECT image_id, y, x, c, floor(least(greatest((v - lo) * (1 / (hi - lo)) * 255, 0), 255))::int AS v FROM ord, r""")
def _(spark, sf):
    from tessella.session import join_side_table

    tiles = fx.order_tiles(spark, sf)
    full = tiles.withColumns({"lo": F.array(F.lit(0.0)), "hi": F.array(F.lit(65535.0))})
    ranges = stats.stretch_range(stats.histogram(full, lo="lo", hi="hi"), shift=8)
    joined = join_side_table(tiles, ranges, ["image_id"], "inner", spread_by=["tx", "ty"])
    run = lambda b, r: pixelops.contrast(pixelops.normalize(b, r["lo"], r["hi"]), 1.0)
    return pixels_of(map_blocks(joined, run, using=("lo", "hi"), drop=("lo", "hi")), fx.ORDERS_TILE)
