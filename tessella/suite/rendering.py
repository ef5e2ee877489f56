"""Composite jobs: whole request tables rendered in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions.kernels import kernel
from tessella.operators import geometry as G
from tessella.operators import logs as L
from tessella.operators import resample as R
from tessella.operators import tiles as TI
from tessella.plans import render as RE
from tessella.session import kept_once
from tessella.suite.registry import RELATIONS, query
from tessella.suite.resampling import grey, sizes

c = F.col

# Requests: one per customer, over all vector images.
RELATIONS["rreq"] = """SELECT c_custkey AS k, image_id, c_custkey % 5 / 10.0::double AS vx, c_custkey % 3 / 10.0::double AS vy,
    0.5::double + c_custkey % 4 / 16.0::double AS vw, 0.4::double + c_custkey % 7 / 16.0::double AS vh,
    (8 + c_custkey % 40)::int AS wid, (CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 6 + c_custkey % 31 END)::int AS hei,
    [1.0, 1.5, -1.0, 0.7][(c_custkey % 4 + 1)::int]::double AS contrast, [1.0, 2.2, -1.0][(c_custkey % 3 + 1)::int]::double AS gamma, c_custkey % 5 = 0 AS inverted,
    c_custkey % 6 = 0 AS bin, c_custkey % 7 = 0 AS eq, (c_custkey % 3)::int AS flip, (c_custkey % 8 // 2 * 90)::int AS rot, h, CASE WHEN h > 32 OR 64 > 32 THEN 2 ELSE 1 END AS last
    FROM customer JOIN vec_size ON image_id = c_custkey % (SELECT count(*) FROM vec_size)"""
RELATIONS["rsized"] = """SELECT *, (vw * 64) / (vh * h) AS ratio, wid AS sw, (CASE WHEN hei = 0 THEN round(wid / ((vw * 64) / (vh * h))) ELSE hei END)::int AS sh FROM rreq"""
RELATIONS["rlevel"] = """SELECT s.*, coalesce((SELECT max(n) FROM (SELECT unnest([0, 1, 2]) AS n) WHERE n <= last AND floor(64 * vw / (1 << n) + 1.1920929e-07::double) >= sw
      AND (hei = 0 OR floor(h * vh / (1 << n) + 1.1920929e-07::double) >= sh)), 0) AS n FROM rsized s"""
RELATIONS["rview"] = """SELECT *, least(round(64 * vx / (1 << n)), 64 >> n)::int AS l, least(round(h * vy / (1 << n)), h >> n)::int AS t, 64 >> n AS lw, h >> n AS lh,
      round(vw * (64.0::double / (1 << n)))::int AS pw0, round(vh * (h / (1 << n)::double))::int AS ph0 FROM rlevel"""
RELATIONS["rwin"] = """SELECT *, greatest(CASE WHEN pw0 + l > lw THEN lw - l ELSE pw0 END, 1)::int AS pw, greatest(CASE WHEN ph0 + t > lh THEN lh - t ELSE ph0 END, 1)::int AS ph FROM rview"""
RELATIONS["thumb"] = "SELECT image_id, v AS bin, count(*) AS n FROM vec8 JOIN vec_size s USING (image_id) WHERE y % 4 = 0 AND x % 4 = 0 AND y // 4 < s.h // 4 GROUP BY ALL"
RELATIONS["thumb_run"] = """SELECT *, sum(n) OVER u::double AS wb, sum(n * bin) OVER u::double AS sb, sum(n) OVER (PARTITION BY image_id)::double AS np,
      sum(n * bin) OVER (PARTITION BY image_id)::double AS sn, first_value(n) OVER (PARTITION BY image_id ORDER BY bin)::double AS n0 FROM thumb WINDOW u AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING)"""
RELATIONS["thumb_otsu"] = """SELECT image_id, CASE WHEN s > 0 THEN bin ELSE 0 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, bin) AS r FROM (
      SELECT image_id, bin, CASE WHEN np - wb > 0 THEN wb * (np - wb) * (sb / wb - (sn - sb) / (np - wb)) * (sb / wb - (sn - sb) / (np - wb)) ELSE 0 END AS s FROM thumb_run)) WHERE r = 1"""
RELATIONS["thumb_range"] = "SELECT image_id, min(bin)::double AS b0, max(bin)::double AS b1 FROM thumb GROUP BY ALL"
RELATIONS["thumb_full"] = """SELECT i.image_id, b AS bin, coalesce(max(wb) FILTER (t.bin <= b), 0) AS cdf, max(np) AS np, max(n0) AS n0
      FROM (SELECT DISTINCT image_id FROM thumb) i CROSS JOIN (SELECT unnest(range(0, 256)) AS b) JOIN thumb_run t USING (image_id) GROUP BY ALL"""


def count_images(spark, sf) -> int:
    """Number of vector images."""
    return fx.table(spark, sf, "embeddings", spread=False).agg(F.max("vec_id")).first()[0] // fx.VECTOR_ROWS + 1


def requests(spark, sf) -> DataFrame:
    k = c("c_custkey")
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % m + 1).cast("int"))
    rows = fx.table(spark, sf, "customer").select(
        k.alias("k"), (k % count_images(spark, sf)).alias("image_id"), (k % 5 / 10.0).alias("rx"), (k % 3 / 10.0).alias("ry"),
        (0.5 + k % 4 / 16.0).alias("rw"), (0.4 + k % 7 / 16.0).alias("rh"), (8 + k % 40).cast("int").alias("wid"),
        F.when(k % 2 == 0, 0).otherwise(6 + k % 31).cast("int").alias("hei"),
        F.lit(False).alias("maintain_aspect"), F.lit(True).alias("allow_upscaling"),
        pick(4, 1.0, 1.5, -1.0, 0.7).alias("contrast"), pick(3, 1.0, 2.2, -1.0).alias("gamma"), (k % 5 == 0).alias("inverted"),
        F.when(k % 6 == 0, "BINARY").alias("colorspace"), (k % 7 == 0).alias("equalize"), (k % 3).cast("int").alias("flip"),
        F.expr("cast(c_custkey % 8 div 2 * 90 as int)").alias("rot"), F.lit("PNG").alias("format"),
    )
    heads = sizes(spark, sf).select("image_id", c("img_w").alias("width"), c("img_h").alias("height"))
    return G.plan_views(rows.join(G.with_pyramid(heads, fx.TILE, fx.TILE), "image_id"))


def stored(spark, sf) -> DataFrame:
    """All levels of the vector images as a tile table."""
    return kept_once(R.build_pyramid(grey(spark, sf), fx.TILE))


def statistics(tiles: DataFrame) -> DataFrame:
    ids = tiles.select("image_id").distinct()
    ranges = ids.select("image_id", F.array(F.lit(0.0)).alias("lo"), F.array(F.lit(255.0)).alias("hi"))
    return RE.image_statistics(tiles, ranges, ids.select("image_id", F.lit("GREYSCALE").alias("image_space")))


_OPS = lambda v: f"""(CASE WHEN contrast = 1 AND gamma = 1 AND NOT inverted THEN {v} ELSE
    floor(least(greatest((CASE WHEN inverted THEN 1 - g ELSE g END) * (255 * CASE WHEN contrast = -1 THEN 1 ELSE contrast END), 0), 255)) END)"""
_GAM = "CASE WHEN gamma = -1 THEN ln(1 + 255 * u) / ln(256.0::double) WHEN gamma = 1 THEN u ELSE pow(greatest(u, 0), gamma) END"
_UNIT = "CASE WHEN contrast = -1 THEN (v - b0) * (1 / (b1 - b0)) ELSE v * (1 / 255.0::double) END"
_TURN = """CASE rot WHEN 90 THEN sh - 1 - fy WHEN 180 THEN sw - 1 - fx WHEN 270 THEN fy ELSE fx END::int AS x, CASE rot WHEN 90 THEN fx WHEN 180 THEN sh - 1 - fy WHEN 270 THEN sw - 1 - fx ELSE fy END::int AS y"""

_RENDER = f"""WITH lit AS (SELECT w.k, p.x >> n AS x, p.y >> n AS y, v, contrast, gamma, inverted, b0, b1 FROM rwin w JOIN vec8 p ON p.image_id = w.image_id AND p.x % (1 << n) = 0 AND p.y % (1 << n) = 0
        AND (p.x >> n) >= l AND (p.x >> n) < l + pw AND (p.y >> n) >= t AND (p.y >> n) < t + ph JOIN thumb_range r ON r.image_id = w.image_id),
      px AS (SELECT k, x, y, {_OPS('v')} AS v FROM (SELECT *, {_GAM} AS g FROM (SELECT *, {_UNIT} AS u FROM lit))),
      g AS (SELECT *, i * pw // sw AS x0, j * ph // sh AS y0, (i * pw % sw) / sw::double AS fx, (j * ph % sh) / sh::double AS fy FROM (SELECT *, unnest(range(0, sw)) AS i FROM (SELECT *, unnest(range(0, sh)) AS j FROM rwin))),
      taps AS (SELECT k, i, j, l + least(x0 + dx, pw - 1) AS sx, t + least(y0 + dy, ph - 1) AS sy, (CASE WHEN dx = 0 THEN 1 - fx ELSE fx END) * (CASE WHEN dy = 0 THEN 1 - fy ELSE fy END) AS wt
        FROM g, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)),
      res AS (SELECT taps.k, i, j, floor(sum(wt * v) + 1e-6::double)::int AS v FROM taps JOIN px ON px.k = taps.k AND px.x = sx AND px.y = sy GROUP BY ALL),
      b AS (SELECT r.k, w.image_id, i, j, sw, sh, flip, rot, eq, CASE WHEN bin THEN CASE WHEN v < threshold THEN 0 ELSE 255 END ELSE v END AS v FROM res r JOIN rwin w USING (k) JOIN thumb_otsu o ON o.image_id = w.image_id),
      e AS (SELECT k, CASE WHEN flip = 1 THEN sw - 1 - i ELSE i END AS fx, CASE WHEN flip = 2 THEN sh - 1 - j ELSE j END AS fy, sw, sh, rot,
        CASE WHEN eq THEN floor(255 / np * (cdf - n0 / (sw * sh)) + 0.5)::int % 256 ELSE v END AS v FROM b JOIN thumb_full f ON f.image_id = b.image_id AND f.bin = b.v)
      SELECT k, {_TURN}, v::int AS v FROM e"""


@query("render_regions", _RENDER)
def render_regions(spark, sf):
    """Regions of every request with level choice, processing, resize, flip and turn."""
    tiles = stored(spark, sf)
    prepared = RE.prepare(requests(spark, sf))
    out = RE.render_regions(prepared, tiles, statistics(tiles), fx.TILE, 32)
    served = RE.serve(prepared.select("k", "render_key"), out)
    return TI.tiles_to_pixels(served, 32, 32, keys=("k",)).select("k", "x", "y", c("v").cast("int").alias("v"))


@query("render_regions_convolved", """WITH w AS (SELECT * FROM rwin), p AS (SELECT w.k, p.x >> n AS x, p.y >> n AS y, v / 255.0::double AS v, l, t, pw, ph FROM w JOIN vec8 p ON p.image_id = w.image_id AND p.x % (1 << n) = 0 AND p.y % (1 << n) = 0
        AND (p.x >> n) >= l AND (p.x >> n) < l + pw AND (p.y >> n) >= t AND (p.y >> n) < t + ph),
      tap AS (SELECT k, x, y, wt, least(greatest(x + dx, l), l + pw - 1) AS tx, least(greatest(y + dy, t), t + ph - 1) AS ty
        FROM p CROSS JOIN (VALUES (-1,-1,1),(0,-1,2),(1,-1,1),(-1,0,2),(0,0,4),(1,0,2),(-1,1,1),(0,1,2),(1,1,1)) AS kk(dx, dy, wt)),
      s AS (SELECT tap.k, tap.x, tap.y, floor(least(greatest(sum(wt * q.v) / 16 * (255 * 0.9731::double), 0), 255))::int AS v FROM tap JOIN p q ON q.k = tap.k AND q.x = tap.tx AND q.y = tap.ty GROUP BY ALL)
      SELECT w.k, j::int AS y, i::int AS x, v FROM (SELECT *, unnest(range(0, sw)) AS i FROM (SELECT *, unnest(range(0, sh)) AS j FROM w)) w JOIN s ON s.k = w.k AND s.x = l + i * pw // sw AND s.y = t + j * ph // sh""")
def _(spark, sf):
    """The same regions smoothed by a kernel whose edges are the region's, then resized to nearest."""
    tiles = stored(spark, sf)
    plain = requests(spark, sf).drop("contrast", "gamma", "inverted", "colorspace", "equalize", "flip", "rot")
    plain = plain.withColumn("contrast", F.lit(0.9731))
    prepared = RE.prepare(plain.withColumn("kernel", F.array(*[F.lit(v) for v in kernel("gaussian")])))
    out = RE.render_regions(prepared, tiles, statistics(tiles), fx.TILE, 16, mode="nearest")
    served = RE.serve(prepared.select("k", "render_key"), out)
    return TI.tiles_to_pixels(served, 16, 16, keys=("k",)).select("k", "y", "x", c("v").cast("int").alias("v"))


# Tile requests: one per event on a tile of the turned full level of any image; ``tile`` is the stored tile behind it.
_TILE_REQ = """(SELECT *, (CASE rot WHEN 180 THEN 4 * nty - asked - 1 WHEN 90 THEN (nty - 1 - asked % nty) * 4 + asked // nty WHEN 270 THEN asked % nty * 4 + 3 - asked // nty ELSE asked END)::int AS tile
    FROM (SELECT e.event_id, s.image_id, (h + 15) // 16 AS nty, event_id // n % (4 * ((h + 15) // 16)) AS asked,
      [1.0, 1.5, -1.0, 0.7][(event_id % 4 + 1)::int]::double AS contrast, [1.0, 2.2, -1.0][(event_id % 3 + 1)::int]::double AS gamma, event_id % 5 = 0 AS inverted,
      event_id % 6 = 0 AS bin, event_id % 7 = 0 AS eq, (event_id % 3)::int AS flip, (event_id % 8 // 2 * 90)::int AS rot
      FROM events e, (SELECT count(*) AS n FROM vec_size) JOIN vec_size s ON s.image_id = event_id % n))"""
_SUMS = """SELECT event_id, count(*) AS n, sum(v3)::bigint AS total, sum(v3 * ((x * 31 + y * 17) % 1009))::bigint AS weighted"""


def tile_requests(spark, sf) -> DataFrame:
    """event_id, plane, level and tile of the turned image."""
    images = count_images(spark, sf)
    events = fx.table(spark, sf, "events").select("event_id", (c("event_id") % images).alias("image_id"), F.expr("cast(event_id % 8 div 2 * 90 as int)").alias("rot"))
    grid = sizes(spark, sf).select("image_id", (F.ceil(c("img_h") / fx.TILE) * 4).alias("_n"))
    return events.join(grid, "image_id").select(
        "event_id", "image_id", "rot", F.lit(0).alias("h_seq"), F.lit(90).alias("v_seq"), F.lit(2).alias("level"),
        (F.floor(c("event_id") / images) % c("_n")).cast("int").alias("tile"),
    )


def tile_levels(spark, sf) -> DataFrame:
    heads = sizes(spark, sf).select("image_id", c("img_w").alias("width"), c("img_h").alias("height"))
    return G.level_geometry(G.with_pyramid(heads, fx.TILE, fx.TILE))


def tile_sums(rows: DataFrame, out: DataFrame) -> DataFrame:
    """Checksums of each distinct rendering, handed to its requests."""
    pixels = TI.tiles_to_pixels(out.withColumns({"tx": F.lit(0), "ty": F.lit(0)}), 16, 16, keys=("render_key",))
    v = c("v").cast("long")
    sums = pixels.groupBy("render_key").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * ((c("x") * 31 + c("y") * 17) % 1009)).alias("weighted"))
    keyed = RE.with_defaults(rows)
    return RE.serve(keyed.select("event_id", RE.tile_key(keyed).alias("render_key")), sums).drop("render_key")


@query("render_tiles", f"""WITH q AS (SELECT q.*, h, v, p.x - tile % 4 * 16 AS i, p.y - tile // 4 * 16 AS j, 16 AS sw, least(16, h - tile // 4 * 16)::int AS sh, b0, b1 FROM {_TILE_REQ} q JOIN vec_size s USING (image_id)
        JOIN vec8 p ON p.image_id = q.image_id AND p.x // 16 = tile % 4 AND p.y // 16 = tile // 4 JOIN thumb_range r ON r.image_id = q.image_id),
      px AS (SELECT *, {_OPS('v')} AS v1 FROM (SELECT *, {_GAM} AS g FROM (SELECT *, {_UNIT} AS u FROM q))),
      b AS (SELECT px.*, CASE WHEN bin THEN CASE WHEN v1 < threshold THEN 0 ELSE 255 END ELSE v1 END AS v2 FROM px JOIN thumb_otsu USING (image_id)),
      e AS (SELECT event_id, CASE WHEN flip = 1 THEN sw - 1 - i ELSE i END AS fx, CASE WHEN flip = 2 THEN sh - 1 - j ELSE j END AS fy, sw, sh, rot,
        CASE WHEN eq THEN floor(255 / np * (cdf - n0 / (sw * sh)) + 0.5)::int % 256 ELSE v2 END AS v3 FROM b JOIN thumb_full f ON f.image_id = b.image_id AND f.bin = b.v2)
      {_SUMS} FROM (SELECT event_id, v3, {_TURN} FROM e) GROUP BY ALL""")
def _(spark, sf):
    """A tile of the full level for every event, with processing inside the tile."""
    e = c("event_id")
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (e % m + 1).cast("int"))
    rows = tile_requests(spark, sf).withColumns(
        {
            "contrast": pick(4, 1.0, 1.5, -1.0, 0.7), "gamma": pick(3, 1.0, 2.2, -1.0), "inverted": e % 5 == 0,
            "colorspace": F.when(e % 6 == 0, "BINARY"), "equalize": e % 7 == 0, "flip": (e % 3).cast("int"), "format": F.lit("PNG"),
        }
    )
    tiles = stored(spark, sf)
    return tile_sums(rows, RE.render_tiles(rows, tiles, statistics(tiles), tile_levels(spark, sf)))


@query("render_minmax", f"""WITH q AS (SELECT q.*, p.x - tile % 4 * 16 AS fx, p.y - tile // 4 * 16 AS fy, 16 AS sw, least(16, h - tile // 4 * 16)::int AS sh,
        CASE event_id % 4 WHEN 0 THEN 20.0::double WHEN 1 THEN 12.5::double ELSE 0 END AS lo, CASE event_id % 4 WHEN 0 THEN 220.0::double WHEN 1 THEN 200.0::double ELSE 255 END AS hi, v
        FROM {_TILE_REQ} q JOIN vec_size s USING (image_id) JOIN vec8 p ON p.image_id = q.image_id AND p.x // 16 = tile % 4 AND p.y // 16 = tile // 4),
      e AS (SELECT *, CASE WHEN event_id % 4 > 1 THEN v ELSE floor(least(greatest((v - lo) * (1 / (hi - lo)) * 255, 0), 255))::int END AS v3 FROM q)
      {_SUMS} FROM (SELECT event_id, v3, {_TURN} FROM e) GROUP BY ALL""")
def _(spark, sf):
    """MINMAX from the log to the picture: all channels, one channel, a channel that does not exist, none."""
    e = c("event_id")
    text = F.when(e % 4 == 0, "-:20,220").when(e % 4 == 1, "0:12.5,2e2").when(e % 4 == 2, "3:20,220")
    asked = F.concat(F.lit("FIF=a.tif"), F.coalesce(F.concat(F.lit("&MINMAX="), text), F.lit("")), F.lit("&CVT=png"))
    log = L.log_to_requests(tile_requests(spark, sf).drop("h_seq", "v_seq").withColumnRenamed("rot", "turn").withColumn("q", asked), "q")
    rows = log.select("event_id", "image_id", c("turn").alias("rot"), "h_seq", "v_seq", "level", "tile", "format", "minmax_channel", "minmax_lo", "minmax_hi")
    tiles = stored(spark, sf)
    return tile_sums(rows, RE.render_tiles(rows, tiles, statistics(tiles), tile_levels(spark, sf)))


@query("render_missing", """WITH cells AS (SELECT w.k, w.image_id, n, unnest(range(t // 16, (t + ph + 15) // 16)) AS ty, l, pw FROM rwin w),
    every AS (SELECT k, image_id, n, ty, unnest(range(l // 16, (l + pw + 15) // 16)) AS tx FROM cells),
    held AS (SELECT k, count(*) AS wanted, count(*) FILTER (NOT (image_id % 4 = 3 OR (tx + ty + image_id) % 3 = 0)) AS found FROM every GROUP BY k)
    SELECT k, wanted, found, wanted = found AS complete, CASE WHEN found = 0 THEN 'no tile found' WHEN found < wanted THEN (wanted - found) || ' tiles not found' END AS error, found > 0 AS rendered FROM held
    UNION ALL SELECT k + 1000000, 0, 0, false, 'level not found', false FROM rreq WHERE k % 50 = 0""")
def _(spark, sf):
    """All requests over a curve-ordered store with holes and without every fourth image; some ask for unknown images."""
    import uuid

    from tessella.session import shared_dir
    from tessella.sources.sinks import write_curve_store

    whole = stored(spark, sf)
    folder = f"{shared_dir(spark)}/curve-{uuid.uuid4().hex}"
    write_curve_store(whole.where("NOT (image_id % 4 = 3 OR (tx + ty + image_id) % 3 = 0)"), folder)
    tiles = spark.read.parquet(folder)
    views = requests(spark, sf)
    unknown = views.where("k % 50 = 0").withColumns({"k": c("k") + 1_000_000, "image_id": F.lit(-1).cast("long"), "lv_ntx": F.lit(None).cast("int")})
    prepared = RE.prepare(views.unionByName(unknown))
    out = RE.render_all(prepared, tiles, statistics(whole), fx.TILE, 32)
    per = out.groupBy("render_key").agg(F.first("wanted").alias("wanted"), F.first("found").alias("found"), F.first("complete").alias("complete"), F.first("error").alias("error"), F.max(c("data").isNotNull()).alias("rendered"))
    return RE.serve(prepared.select("k", "render_key"), per).drop("render_key")
