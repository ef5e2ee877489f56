"""Neighbourhood, resampling and geometry queries, and measurements."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions.kernels import kernel, kernel_column
from tessella.operators import color as O
from tessella.operators import cover, measure as M
from tessella.operators import resample as R
from tessella.operators import tiles as TI
from tessella.operators import watermark as W
from tessella.session import shared_dir
from tessella.sources import sinks as SI
from tessella.suite.registry import query
from tessella.suite.statistics import pixels_of

c = F.col


def sizes(spark, sf) -> DataFrame:
    return fx.vector_heights(spark, sf).select("image_id", F.lit(64).alias("img_w"), "img_h")


def grey(spark, sf) -> DataFrame:
    return R.sized(fx.vector_tiles(spark, sf, "grey"), sizes(spark, sf))


def orders(spark, sf) -> DataFrame:
    height = fx._height(spark, sf, "orders", "o_orderkey", fx.ORDERS_WIDTH).select(F.lit(0).cast("long").alias("image_id"), F.lit(fx.ORDERS_WIDTH).alias("img_w"), "img_h")
    return R.sized(fx.order_tiles(spark, sf), height)


_SUM = "count(*) AS n, sum(v)::bigint AS total, sum(v * ((x * 31 + y * 17) % 1009))::bigint AS weighted"


def summed(pixels: DataFrame, *keys: str) -> DataFrame:
    """Counts and position-weighted sums, for outputs that are as large as their input."""
    place = (c("x") * 31 + c("y") * 17) % 1009
    v = c("v").cast("long")
    return pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * place).alias("weighted"))


@query("retile", """SELECT image_id, y // 24 AS ty, x // 24 AS tx, count(*) AS n, sum(v)::bigint AS total FROM vec8 GROUP BY ALL""")
def _(spark, sf):
    out = R.retile(grey(spark, sf), fx.TILE, 24)
    pixels = TI.tiles_to_pixels(out.withColumn("level", c("tile")), 24, 24)
    return pixels.groupBy("image_id", (c("y") / 24).cast("int").alias("ty"), (c("x") / 24).cast("int").alias("tx")).agg(
        F.count("*").alias("n"), F.sum(c("v").cast("long")).alias("total")
    )


@query("retile_texts", f"SELECT image_id, {_SUM} FROM (SELECT image_id, x, y, v FROM txt UNION ALL SELECT doc_id, 0, 0, 0 FROM documents, (SELECT unnest(range(0, 64)) AS k) WHERE k < (64 - octet_length(encode(text)) % 64) % 64) GROUP BY ALL")
def _(spark, sf):
    """Documents cut to 48 wide tiles; summed per document over all of its bytes."""
    docs = fx.table(spark, sf, "documents").select(
        c("doc_id").alias("image_id"), F.lit(64).alias("img_w"), F.ceil(F.octet_length(F.encode("text", "UTF-8")) / 64).cast("int").alias("img_h")
    )
    out = R.retile(R.sized(fx.text_tiles(spark, sf), docs), fx.TEXT_WIDTH, 48)
    return summed(TI.tiles_to_pixels(out, 48, 48, keys=("image_id",)), "image_id")


@query("build_pyramid", """WITH l AS (SELECT image_id, w, h, unnest(range(0, CASE WHEN h > 32 OR w > 32 THEN 3 ELSE 2 END)) AS k FROM vec_size)
    SELECT p.image_id, ((CASE WHEN l.h > 32 OR l.w > 32 THEN 2 ELSE 1 END) - k)::int AS level, (y >> k)::int AS y, (x >> k)::int AS x, v FROM vec8 p JOIN l USING (image_id)
    WHERE x % (1 << k) = 0 AND y % (1 << k) = 0 AND (x >> k) < (w >> k) AND (y >> k) < (h >> k)""")
def _(spark, sf):
    return TI.tiles_to_pixels(R.build_pyramid(grey(spark, sf), fx.TILE), fx.TILE, fx.TILE).select("image_id", "level", "y", "x", c("v").cast("int").alias("v"))


@query("build_pyramid_large", """WITH s AS (SELECT *, greatest(length(bin(128 // 33)), CASE WHEN h > 32 THEN length(bin(h // 33)) ELSE 0 END)::int AS last FROM ord_size), l AS (SELECT *, unnest(range(0, last + 1)) AS k FROM s)
    SELECT (last - k)::int AS level, count(*) AS n, sum(v)::bigint AS total, sum(v * (((x >> k) * 31 + (y >> k) * 17) % 1009))::bigint AS weighted FROM ord, l
    WHERE x % (1 << k) = 0 AND y % (1 << k) = 0 AND (x >> k) < (w >> k) AND (y >> k) < (h >> k) GROUP BY ALL""")
def _(spark, sf):
    return summed(TI.tiles_to_pixels(R.build_pyramid(orders(spark, sf), fx.ORDERS_TILE), 32, 32), "level")


def _resize_nearest_sql(w: int, h: int) -> str:
    return f"""SELECT s.image_id, j::int AS y, i::int AS x, 0 AS c, v FROM vec_size s, (SELECT unnest(range(0, {w})) AS i), (SELECT unnest(range(0, {h})) AS j)
      JOIN vec8 p ON p.image_id = s.image_id AND p.x = i * 64 // {w} AND p.y = j * s.h // {h}"""


for _w, _h in ((40, 31), (100, 90)):

    @query(f"resize_nearest_{_w}x{_h}", _resize_nearest_sql(_w, _h))
    def _(spark, sf, w=_w, h=_h):
        return pixels_of(R.resize(grey(spark, sf), fx.TILE, w, h, "nearest"))

    @query(f"resize_bilinear_{_w}x{_h}", f"""WITH g AS (SELECT image_id, h, i, j, i * 64 // {_w} AS x0, j * h // {_h} AS y0, (i * 64 % {_w}) / {_w}.0::double AS fx, (j * h % {_h}) / {_h}.0::double AS fy
          FROM vec_size, (SELECT unnest(range(0, {_w})) AS i), (SELECT unnest(range(0, {_h})) AS j)),
        t AS (SELECT image_id, i, j, least(x0 + dx, 63) AS sx, least(y0 + dy, h - 1) AS sy, (CASE WHEN dx = 0 THEN 1 - fx ELSE fx END) * (CASE WHEN dy = 0 THEN 1 - fy ELSE fy END) AS wt
          FROM g, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy))
        SELECT t.image_id, j::int AS y, i::int AS x, 0 AS c, floor(sum(wt * v) + 1e-6::double)::int AS v FROM t JOIN vec8 p ON p.image_id = t.image_id AND p.x = sx AND p.y = sy GROUP BY t.image_id, j, i""")
    def _(spark, sf, w=_w, h=_h):
        return pixels_of(R.resize(grey(spark, sf), fx.TILE, w, h, "bilinear"))


@query("flip_horizontal", "SELECT image_id, y, (w - 1 - x)::int AS x, c, v FROM vec8 JOIN vec_size USING (image_id)")
def _(spark, sf):
    return pixels_of(R.flip(grey(spark, sf), fx.TILE, 1))


@query("flip_vertical", "SELECT image_id, (h - 1 - y)::int AS y, x, c, v FROM vec8 JOIN vec_size USING (image_id)")
def _(spark, sf):
    return pixels_of(R.flip(grey(spark, sf), fx.TILE, 2))


_TURN_SQL = {90: ("x", "h - 1 - y"), 180: ("h - 1 - y", "w - 1 - x"), 270: ("w - 1 - x", "y")}
for _angle, (_y, _x) in _TURN_SQL.items():

    @query(f"rotate_{_angle}", f"SELECT image_id, ({_y})::int AS y, ({_x})::int AS x, c, v FROM vec8 JOIN vec_size USING (image_id)")
    def _(spark, sf, angle=_angle):
        return pixels_of(R.rotate(grey(spark, sf), fx.TILE, angle))


@query("crop", "SELECT image_id, y, x, c, v FROM vec8 WHERE x < 37 AND y < 23")
def _(spark, sf):
    return pixels_of(R.crop(grey(spark, sf), fx.TILE, 37, 23))


@query("get_region", """SELECT o_orderkey AS region, (y - sy)::int AS y, (x - sx)::int AS x, v FROM (SELECT o_orderkey, (o_orderkey % 100)::int AS sx, (o_orderkey // 128)::int AS sy FROM orders) r
    JOIN ord ON x >= sx AND x < sx + 20 AND y >= sy AND y < sy + 3""")
def _(spark, sf):
    """A small window for every order, cut out of the one large image."""
    height = fx._height(spark, sf, "orders", "o_orderkey", fx.ORDERS_WIDTH)
    regions = fx.table(spark, sf, "orders").withColumn("img_h", height.scalar()).select(
        c("o_orderkey").alias("region"), F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("h_seq"), F.lit(90).alias("v_seq"), F.lit(0).alias("level"), F.lit(4).alias("ntx"),
        (c("o_orderkey") % 100).cast("int").alias("src_x"), F.expr("cast(o_orderkey div 128 as int)").alias("src_y"), "img_h",
    )
    h = F.least(F.lit(3), c("img_h") - c("src_y"))
    no = F.lit(False)
    regions = regions.withColumns(
        {"src_w": F.lit(20), "src_h": h, "dst_w": F.lit(20), "dst_h": h, "flip_x": no, "flip_y": no, "transpose": no, "step": F.lit(None).cast("int")}
    )
    out = cover.get_region(regions, fx.order_tiles(spark, sf), ["region"], 32, 32, 64)
    return TI.tiles_to_pixels(out, 64, 64, keys=("region",)).select("region", "y", "x", c("v").cast("int").alias("v"))


# --- convolution ----------------------------------------------------------------------------------


def _convolve_sql(weights: list[float], relation: str, scope: str = "image") -> str:
    side = int(len(weights) ** 0.5)
    half, total = side // 2, sum(weights)
    kernel_rows = ", ".join(f"({i % side - half}, {i // side - half}, {w}::double)" for i, w in enumerate(weights))
    if scope == "tile":
        xs = "greatest(least(p.x + dx, least(p.x // 16 * 16 + 15, w - 1)), p.x // 16 * 16)"
        ys = "greatest(least(p.y + dy, least(p.y // 16 * 16 + 15, h - 1)), p.y // 16 * 16)"
    else:
        xs, ys = "greatest(least(p.x + dx, w - 1), 0)", "greatest(least(p.y + dy, h - 1), 0)"
    div = f" / {total}" if total > 0 else ""
    return f"""WITH tap AS (SELECT p.image_id, p.y, p.x, k, ({xs})::int AS tx, ({ys})::int AS ty FROM {relation} p JOIN vec_size USING (image_id) CROSS JOIN (VALUES {kernel_rows}) AS kk(dx, dy, k))
      SELECT tap.image_id, tap.y, tap.x, 0 AS c, round(sum(k * q.v / 255.0::double){div}, 6) + 0.0 AS v FROM tap
      JOIN {relation} q ON q.image_id = tap.image_id AND q.x = tap.tx AND q.y = tap.ty GROUP BY ALL"""


_FIVE = [float(i % 4) for i in range(25)]
for _name, _weights in (("gaussian", kernel("gaussian")), ("sobel", kernel("sobel")), ("sharpen", kernel("sharpen")), ("5x5", _FIVE)):

    @query(f"convolve_{_name}", _convolve_sql(_weights, "vec8"))
    def _(spark, sf, weights=_weights):
        unit = O.normalize(fx.vector_tiles(spark, sf, "grey").withColumns({"lo": F.lit(0.0), "hi": F.lit(255.0)})).drop("lo", "hi")
        return pixels_of(TI.convolve(unit, weights), digits=6)


@query("convolve_table", _convolve_sql(_FIVE, "vec8"))
def _(spark, sf):
    """Over a table bucketed by blocks of the grid, whose tiles stay in their buckets."""
    unit = O.normalize(fx.vector_tiles(spark, sf, "grey").withColumns({"lo": F.lit(0.0), "hi": F.lit(255.0)})).drop("lo", "hi")
    name = f"blocks_{uuid.uuid4().hex}"
    SI.save_block_table(unit, name, buckets=8, path=shared_dir(spark))
    return pixels_of(TI.convolve_table(spark, name, _FIVE), digits=6)


@query("convolve_tile_scope", _convolve_sql(kernel("emboss"), "vec8", "tile"))
def _(spark, sf):
    unit = O.normalize(fx.vector_tiles(spark, sf, "grey").withColumns({"lo": F.lit(0.0), "hi": F.lit(255.0)}))
    return pixels_of(TI.convolve(unit, kernel("emboss"), scope="tile"), digits=6)


@query("convolve_pixels", _convolve_sql(kernel("gaussian"), "vec8"))
def _(spark, sf):
    """Pixel form: each sample is sent to the places it is needed at, weighted and summed."""
    from tessella.operators.pixels import convolve_pixels

    pixels = fx.vector_pixels(spark, sf, "grey").withColumn("v", c("v") / 255.0)
    out = convolve_pixels(pixels, sizes(spark, sf), kernel("gaussian"))
    return out.select("image_id", "y", "x", "c", (F.round("v", 6) + 0.0).alias("v"))


@query("kernel", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '-1,0,1,-2,0,2,-1,0,1' WHEN 1 THEN '0,-1,0,-1,5,-1,0,-1,0' WHEN 2 THEN '1' WHEN 5 THEN '1,2,3,4,' || event_id || ',6,7,8,9' END AS kernel FROM events""")
def _(spark, sf):
    e = c("event_id")
    spec = (
        F.when(e % 6 == 0, "[Sobel]").when(e % 6 == 1, "sharpen").when(e % 6 == 2, "1").when(e % 6 == 3, "1,2,3,4")
        .when(e % 6 == 4, ",".join(["1"] * 49)).otherwise(F.concat(F.lit("[1,2,3,4,"), e.cast("string"), F.lit(",6,7,8,9]")))
    )
    values = F.transform(kernel_column(spec), lambda v: v.cast("long").cast("string"))
    return fx.table(spark, sf, "events").select("event_id", F.when(values.isNotNull(), F.array_join(values, ",")).alias("kernel"))


# --- watermark ------------------------------------------------------------------------------------

_MARK = np.dstack([np.full((5, 7), 200), np.full((5, 7), 100), np.full((5, 7), 50), np.tile(np.arange(7) * 40, (5, 1))]).astype(np.uint8)
_U = lambda k: f"(('0x' || md5(image_id || '/' || bj || '/' || bi || '/{k}')[1:8])::bigint / 4294967296.0::double)"


def _watermark_sql(probability: float, factor: int, top: int, relation: str, size: str, side: int) -> str:
    return f"""WITH b AS (SELECT p.*, w, h, x // {side} AS bi, y // {side} AS bj FROM {relation} p JOIN {size}),
      o AS (SELECT *, least({side}, w - bi * {side}) AS bw, least({side}, h - bj * {side}) AS bh, {_U(0)} < {probability} AS hit, {_U(1)} AS ux, {_U(2)} AS uy FROM b),
      d AS (SELECT *, x - bi * {side} - (CASE WHEN bw > 7 THEN floor(ux * (bw - 7)) ELSE 0 END)::int AS mx, y - bj * {side} - (CASE WHEN bh > 5 THEN floor(uy * (bh - 5)) ELSE 0 END)::int AS my FROM o)
      SELECT image_id, y, x, c, (CASE WHEN hit AND mx BETWEEN 0 AND 6 AND my BETWEEN 0 AND 4 THEN least(v + floor(200 * 0.8::double * (mx * 40 / 255.0::double))::int * {factor}, {top}) ELSE v END)::int AS v FROM d"""


@query("watermark", _watermark_sql(0.6, 1, 255, "vec8", "vec_size USING (image_id)", 32))
def _(spark, sf):
    return pixels_of(W.watermark(grey(spark, sf), W.prepare_mark(_MARK, 0.8), fx.TILE, 0.6))


@query("watermark_16bit", _watermark_sql(1.0, 256, 65535, "ord", "ord_size ON true", 64))
def _(spark, sf):
    return pixels_of(W.watermark(orders(spark, sf), W.prepare_mark(_MARK, 0.8), fx.ORDERS_TILE), fx.ORDERS_TILE)


# --- measurements ---------------------------------------------------------------------------------

_STACK = "CASE WHEN h_seq % 3 = 0 THEN h_seq::varchar ELSE 'band ' || h_seq END"
_NTX = 4  # tiles across the band image


def band_images(spark) -> DataFrame:
    """The header of the band image: 64 layers, every third one without a name."""
    layer = lambda i: F.struct(F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("band "), i.cast("string"))).alias("name"), (1 + i % 2).cast("float").alias("scale"))
    return spark.range(1).select(c("id").alias("image_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), layer).alias("stack"))


def _points(spark, sf) -> DataFrame:
    """A point for every event, on a vector's pixel."""
    n = fx.table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    e = fx.table(spark, sf, "events").withColumn("n", n.scalar())
    vec = c("event_id") * 7 % c("n")
    return e.select("event_id", F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("level"), (vec % 25).cast("int").alias("x"), F.floor(vec / 25).cast("int").alias("y"))


_SPECTRUM = f"""SELECT event_id, b.x, b.y, h_seq, {_STACK} AS name, round(v, 6) AS reflectance FROM (SELECT event_id, (event_id * 7 % (SELECT count(*) FROM embeddings)) AS vec FROM events) e
    JOIN band b ON b.x = vec % 25 AND b.y = vec // 25"""


@query("spectrum", _SPECTRUM)
def _(spark, sf):
    s = M.spectrum(_points(spark, sf), fx.band_tiles(spark, sf), band_images(spark), 8, 8, F.lit(_NTX))
    return s.select("event_id", "x", "y", "h_seq", "name", F.round("reflectance", 6).alias("reflectance"))


_LINES = """(SELECT c_custkey AS line, (c_custkey % 10)::int AS x1, (c_custkey % h)::int AS y1, (CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 + 9 ELSE 0 END)::int AS x2,
    (CASE WHEN c_custkey % 3 = 1 THEN least(c_custkey % h + 6, h) ELSE 0 END)::int AS y2 FROM customer, (SELECT (max(vec_id) // 25 + 1) AS h FROM embeddings))"""


def _lines(spark, sf) -> DataFrame:
    height = fx._height(spark, sf, "embeddings", "vec_id", 25)
    k = c("c_custkey")
    y1 = (k % c("img_h")).cast("int")
    return fx.table(spark, sf, "customer").withColumn("img_h", height.scalar()).select(
        k.alias("line"), F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("level"), (k % 10).cast("int").alias("x1"), y1.alias("y1"),
        F.when(k % 3 == 0, (k % 10 + 9).cast("int")).otherwise(0).alias("x2"), F.when(k % 3 == 1, F.least(y1 + 6, c("img_h"))).otherwise(0).alias("y2"),
    )


_PROFILE = f"""SELECT line, h_seq, {_STACK} AS name, i, round(v * (1 + h_seq % 2), 6) AS intensity FROM (
      SELECT *, unnest(range(0, CASE WHEN x2 > x1 THEN x2 - x1 WHEN y2 > y1 THEN y2 - y1 ELSE 1 END))::int AS i FROM {_LINES}) l
    JOIN band b ON b.x = x1 + CASE WHEN x2 > x1 THEN i ELSE 0 END AND b.y = y1 + CASE WHEN x2 <= x1 AND y2 > y1 THEN i ELSE 0 END"""


@query("profile", _PROFILE)
def _(spark, sf):
    p = M.profile(_lines(spark, sf), fx.band_tiles(spark, sf), band_images(spark), 8, 8, F.lit(_NTX))
    return p.select("line", "h_seq", "name", "i", F.round("intensity", 6).alias("intensity"))


@query("profile_arrays", f"SELECT line, h_seq, name, count(*)::int AS n, sum(round(intensity * 1000000)::bigint * (i + 1))::bigint AS total FROM ({_PROFILE}) GROUP BY ALL")
def _(spark, sf):
    p = M.profile(_lines(spark, sf), fx.band_tiles(spark, sf), band_images(spark), 8, 8, F.lit(_NTX))
    a = M.profile_arrays(p.withColumn("intensity", F.round("intensity", 6)), ["line"])
    # Whole millionths, so that the order of the sum does not matter.
    parts = F.transform("profile", lambda v, i: F.round(v * 1000000).cast("long") * (i + 1))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, v: s + v)
    return a.select("line", "h_seq", "name", F.size("profile").alias("n"), total.alias("total"))


@query("spectral_cube", "SELECT y, x, count(*)::int AS bands, round(sum(v * (h_seq + 1)), 4) AS total FROM band GROUP BY ALL")
def _(spark, sf):
    cube = M.spectral_cube(_points(spark, sf), fx.band_tiles(spark, sf), 8, 8, F.lit(_NTX))
    total = F.aggregate(F.transform("spectrum", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return cube.select("y", "x", F.size("spectrum").alias("bands"), F.round(total, 4).alias("total"))


@query("join_stack", """SELECT e.event_id, e.user_id % 70 AS h_seq, CASE WHEN user_id % 70 > 63 OR user_id % 70 % 3 = 0 THEN (user_id % 70)::varchar ELSE 'band ' || (user_id % 70) END AS name,
    CASE WHEN user_id % 70 > 63 THEN 1.0::double ELSE 1 + user_id % 70 % 2 END AS scale FROM events e""")
def _(spark, sf):
    bands = fx.table(spark, sf, "events").select("event_id", F.lit(0).cast("long").alias("image_id"), (c("user_id") % 70).alias("h_seq"), (c("user_id") % 70).cast("int").alias("pos"))
    return cover.join_stack(bands, band_images(spark)).select("event_id", "h_seq", "name", "scale")
