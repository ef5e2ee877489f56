"""View geometry queries: whole request tables against the whole catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.operators import cover, geometry as G
from tessella.suite.registry import query

c = F.col
LIMIT = 600


def images(spark, sf, rule: str = "floor") -> DataFrame:
    return G.with_pyramid(fx.catalogue(spark, sf), 256, 256, rule)


def requests(spark, sf) -> DataFrame:
    """Requests with their image header."""
    joined = cover.attach_image(fx.view_requests(spark, sf), images(spark, sf))
    return joined.where("error IS NULL")


def planned(spark, sf) -> DataFrame:
    return G.plan_views(requests(spark, sf), LIMIT)


for _rule in ("floor", "ceil"):

    @query(f"level_geometry_{_rule}", f"SELECT image_id, level, native_level, width, height, 256 AS tile_w, 256 AS tile_h, ntx, nty FROM lvl_{_rule}")
    def _(spark, sf, rule=_rule):
        return G.level_geometry(images(spark, sf, rule))


@query("clamp_region", "SELECT image_id, line, vx AS x, vy AS y, vw AS w, vh AS h FROM view")
def _(spark, sf):
    view = G.clamp_region(c("rx"), c("ry"), c("rw"), c("rh"))
    return requests(spark, sf).select("image_id", "line", view.alias("v")).select("image_id", "line", "v.*")


@query("viewport_set", "SELECT image_id, line, vw < 1 OR vh < 1 OR vx > 0 OR vy > 0 AS is_set FROM view")
def _(spark, sf):
    return planned(spark, sf).select("image_id", "line", G.viewport_set(G.fields("view", "x y w h")).alias("is_set"))


@query("request_size", "SELECT image_id, line, sw AS w, sh AS h FROM sized")
def _(spark, sf):
    return planned(spark, sf).select("image_id", "line", c("size_w").alias("w"), c("size_h").alias("h"))


@query("choose_level", "SELECT image_id, line, first_native AS native_level FROM sized JOIN chosen USING (rid)")
def _(spark, sf):
    return planned(spark, sf).select("image_id", "line", c("first_native").alias("native_level"))


@query("limit_level", "SELECT image_id, line, level FROM limited")
def _(spark, sf):
    return planned(spark, sf).select("image_id", "line", c("lv_level").alias("level"))


@query("view_pixels", """SELECT image_id, line, pl AS "left", pt AS top,
    greatest(CASE WHEN pw0 + pl > lw THEN lw - pl ELSE pw0 END, 1)::int AS width, greatest(CASE WHEN ph0 + pt > lh THEN lh - pt ELSE ph0 END, 1)::int AS height FROM planned""")
def _(spark, sf):
    return planned(spark, sf).select("image_id", "line", *[v.alias(k) for k, v in G.fields("pixels", "left top width height").items()])


@query("prevent_upscaling", """SELECT image_id, line, CASE WHEN w = 0 THEN 1 ELSE w END AS w, CASE WHEN h = 0 THEN 1 ELSE h END AS h FROM (
    SELECT image_id, line, CASE WHEN allow_upscaling THEN sw ELSE least(sw, lw) END AS w, CASE WHEN allow_upscaling THEN sh ELSE least(sh, lh) END AS h FROM planned)""")
def _(spark, sf):
    return planned(spark, sf).select("image_id", "line", *[v.alias(k) for k, v in G.fields("out", "w h").items()])


_TILE_REQ = """(SELECT q.image_id, line, i.width, i.height, l.level, l.width AS lw, l.height AS lh, ntx, nty,
      (line % greatest(ntx, 1)) AS tx, (wid % greatest(nty, 1)) AS ty, (wid * 7 % (ntx * nty + 2) - 1)::int AS tile, hei, wid, rot
    FROM req q JOIN img i USING (image_id) JOIN lvl_floor l ON l.image_id = q.image_id AND l.level = 0)"""


def _tile_requests(spark, sf) -> DataFrame:
    r = requests(spark, sf).withColumn("lv", F.element_at("levels", -1))
    return r.withColumns(
        {
            "tx": c("line") % F.greatest(c("lv.ntx"), F.lit(1)),
            "ty": c("wid") % F.greatest(c("lv.nty"), F.lit(1)),
            "tile": (c("wid") * 7 % (c("lv.ntx") * c("lv.nty") + 2) - 1).cast("int"),
        }
    )


@query("is_pure_tile", f"""SELECT image_id, line, ((pl % 256 = 0) AND (pt % 256 = 0) AND w = vw AND h = vh AND w = vw AND h = vh) AS pure FROM (
    SELECT *, CASE WHEN width % 256 > 0 AND pl = lw - lw % 256 THEN lw % 256 ELSE 256 END AS vw, CASE WHEN height % 256 > 0 AND pt = lh - lh % 256 THEN lh % 256 ELSE 256 END AS vh
    FROM (SELECT *, tx * 256 AS pl, ty * 256 AS pt, CASE WHEN line % 2 = 0 THEN 256 ELSE lw % 256 END AS w, CASE WHEN wid % 3 = 0 THEN 256 ELSE lh % 256 END AS h FROM {_TILE_REQ}))""")
def _(spark, sf):
    r = _tile_requests(spark, sf)
    w = F.when(c("line") % 2 == 0, 256).otherwise(c("lv.width") % 256)
    h = F.when(c("wid") % 3 == 0, 256).otherwise(c("lv.height") % 256)
    pixels = F.struct((c("tx") * 256).alias("left"), (c("ty") * 256).alias("top"), w.alias("width"), h.alias("height"))
    return r.withColumn("px", pixels).select(
        "image_id", "line", G.is_pure_tile(c("px"), w, h, c("width"), c("height"), c("lv")).alias("pure")
    )


@query("rotated_tile", f"""SELECT image_id, line, tile, (CASE rot % 360 WHEN 180 THEN ntx * nty - tile - 1
      WHEN 90 THEN (nty - 1 - tile % nty) * ntx + tile // nty WHEN 270 THEN tile % nty * ntx + (ntx - 1 - tile // nty) ELSE tile END)::int AS source
    FROM {_TILE_REQ} WHERE tile >= 0 AND tile < ntx * nty""")
def _(spark, sf):
    r = _tile_requests(spark, sf).where("tile >= 0 AND tile < lv.ntx * lv.nty")
    return r.select("image_id", "line", "tile", G.rotated_tile(c("tile"), c("rot"), c("lv.ntx"), c("lv.nty")).alias("source"))


@query("validate_tile", f"""SELECT image_id, line, tile, CASE WHEN tile < 0 THEN 'invalid resolution or tile number' WHEN tile >= ntx * nty THEN 'tile outside of level' END AS error FROM {_TILE_REQ}""")
def _(spark, sf):
    return _tile_requests(spark, sf).select("image_id", "line", "tile", G.validate_tile(F.lit(0), c("tile"), c("levels")).alias("error"))


@query("validate_line", f"""SELECT image_id, line, CASE WHEN least(wid - 5, hei - 5) < 0 OR wid >= lw OR hei >= lh THEN 'invalid coordinates' END AS error,
    CASE WHEN NOT (wid < 256 AND hei < 256) THEN 'coordinates outside of tile' END AS point_error FROM {_TILE_REQ}""")
def _(spark, sf):
    r = _tile_requests(spark, sf)
    error = G.validate_line(F.lit(0), c("wid") - 5, c("hei") - 5, c("wid"), c("hei"), c("levels"))
    point = G.validate_point(c("wid"), c("hei"), F.lit(256), F.lit(256))
    return r.select("image_id", "line", error.alias("error"), point.alias("point_error"))


_FLAGS_SQL = """(SELECT l_orderkey AS image_id, l_linenumber AS line, CASE WHEN l_quantity::int % 7 = 0 THEN -1.0 WHEN l_quantity::int % 2 = 0 THEN 1.0 ELSE 1.5 END AS cnt,
    CASE WHEN l_partkey % 3 = 0 THEN 2.2 ELSE 1.0 END AS gam, l_suppkey % 5 = 0 AS cm, l_suppkey % 7 = 0 AS eq,
    CASE WHEN l_partkey % 4 = 0 THEN 'BINARY' WHEN l_partkey % 4 = 1 THEN 'GREYSCALE' ELSE 'NONE' END AS space, l_quantity::int % 4 * 90 AS rot FROM lineitem)"""


@query("pipeline_predicates", f"""SELECT image_id, line, cnt <> 1 OR gam <> 1 OR cm AS needs_float, eq OR space = 'BINARY' OR cnt = -1 AS needs_histogram,
    bpc > 8 OR colorspace = 'CIELAB' OR channels = 2 OR channels > 3 OR (space IN ('GREYSCALE', 'BINARY') AND channels = 3 AND bpc = 8)
      OR cnt <> 1 OR gam <> 1 OR cm OR eq OR rot <> 0 AS needs_raw FROM {_FLAGS_SQL} JOIN img USING (image_id)""")
def _(spark, sf):
    q = c("l_quantity").cast("int")
    flags = fx.table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("image_id"),
        c("l_linenumber").alias("line"),
        F.when(q % 7 == 0, -1.0).when(q % 2 == 0, 1.0).otherwise(1.5).alias("cnt"),
        F.when(c("l_partkey") % 3 == 0, 2.2).otherwise(1.0).alias("gam"),
        (c("l_suppkey") % 5 == 0).alias("cm"),
        (c("l_suppkey") % 7 == 0).alias("eq"),
        F.when(c("l_partkey") % 4 == 0, "BINARY").when(c("l_partkey") % 4 == 1, "GREYSCALE").otherwise("NONE").alias("space"),
        (q % 4 * 90).alias("rot"),
    )
    joined = cover.attach_image(flags, fx.catalogue(spark, sf)).where("error IS NULL")
    floating = G.needs_float(c("cnt"), c("gam"), c("cm"))
    raw = G.needs_raw(c("bpc"), c("channels"), c("colorspace"), c("space"), floating, c("eq"), c("rot"), F.lit(0), F.lit(False))
    return joined.select(
        "image_id", "line", floating.alias("needs_float"), G.needs_histogram(c("eq"), c("space"), c("cnt")).alias("needs_histogram"), raw.alias("needs_raw")
    )


# --- IIIF addresses -------------------------------------------------------------------------------

_TEXTS_SQL = """(SELECT q.image_id, line, i.width, i.height,
    CASE line % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'Square' WHEN 2 THEN 'pct:10,20,' || (wid % 100) || ',55.5'
      WHEN 3 THEN wid || ',' || hei || ',100,200' WHEN 4 THEN '0,0,' || hei || ',' || wid WHEN 5 THEN '1,2,3' ELSE '5,5,9999,9999' END AS region,
    CASE wid % 9 WHEN 0 THEN 'max' WHEN 1 THEN 'pct:' || (hei % 100) WHEN 2 THEN hei || ',' WHEN 3 THEN ',' || hei WHEN 4 THEN hei || ',' || wid
      WHEN 5 THEN '!' || hei || ',300' WHEN 6 THEN '^' || (hei * 3) || ',' WHEN 7 THEN '^!900,' || wid ELSE 'abc' END AS size,
    CASE hei % 6 WHEN 0 THEN '0' WHEN 1 THEN '90' WHEN 2 THEN '!180' WHEN 3 THEN '!270' WHEN 4 THEN '45' ELSE 'x' END AS rotation,
    ['default', 'gray', 'bitonal', 'stretch', 'negative', 'Log', 'other'][(wid % 7 + 1)::int] || ['.jpg', '.png?t=1', '.gif', '', '.webp'][(hei % 5 + 1)::int] AS quality
    FROM req q JOIN img i USING (image_id))"""


def _texts(spark, sf) -> DataFrame:
    w, h = c("wid").cast("string"), c("hei").cast("string")

    def case(key, *choices):
        out = F.lit(choices[-1]) if isinstance(choices[-1], str) else choices[-1]
        for i, choice in reversed(list(enumerate(choices[:-1]))):
            out = F.when(key == i, choice).otherwise(out)
        return out

    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return requests(spark, sf).select(
        "image_id", "line", "width", "height",
        case(c("line") % 7, "full", "Square", cat("pct:10,20,", (c("wid") % 100).cast("string"), ",55.5"), cat(w, ",", h, ",100,200"),
             cat("0,0,", h, ",", w), "1,2,3", "5,5,9999,9999").alias("region"),
        case(c("wid") % 9, "max", cat("pct:", (c("hei") % 100).cast("string")), cat(h, ","), cat(",", h), cat(h, ",", w), cat("!", h, ",300"),
             cat("^", (c("hei") * 3).cast("string"), ","), cat("^!900,", w), "abc").alias("size"),
        case(c("hei") % 6, "0", "90", "!180", "!270", "45", "x").alias("rotation"),
        cat(case(c("wid") % 7, "default", "gray", "bitonal", "stretch", "negative", "Log", "other"),
            case(c("hei") % 5, ".jpg", ".png?t=1", ".gif", "", ".webp")).alias("quality"),
    )


_REGION_SQL = f"""SELECT image_id, line, width, height, size, region,
      CASE WHEN region = 'full' THEN 0 WHEN region = 'Square' THEN (1 - CASE WHEN width > height THEN height / width::double ELSE 1 END) / 2 WHEN NOT bad THEN least(greatest(x, 0), 1) END AS x,
      CASE WHEN region = 'full' THEN 0 WHEN region = 'Square' THEN (1 - CASE WHEN height > width THEN width / height::double ELSE 1 END) / 2 WHEN NOT bad THEN least(greatest(y, 0), 1) END AS y,
      CASE WHEN region = 'full' THEN 1 WHEN region = 'Square' THEN CASE WHEN width > height THEN height / width::double ELSE 1 END WHEN NOT bad THEN least(greatest(w, 0), 1) END AS w,
      CASE WHEN region = 'full' THEN 1 WHEN region = 'Square' THEN CASE WHEN height > width THEN width / height::double ELSE 1 END WHEN NOT bad THEN least(greatest(h, 0), 1) END AS h,
      CASE WHEN region NOT IN ('full', 'Square') AND bad THEN 'incorrect region' END AS error
    FROM (SELECT *, n <> 4 OR w <= 0 OR h <= 0 AS bad FROM (
      SELECT image_id, line, width, height, size, region, n, x, y, CASE WHEN x + w0 > 1 THEN 1 - x ELSE w0 END AS w, CASE WHEN y + h0 > 1 THEN 1 - y ELSE h0 END AS h FROM (
        SELECT *, len(p) AS n, coalesce(try_cast(p[1] AS double), 0) / wd AS x, coalesce(try_cast(p[2] AS double), 0) / hd AS y,
          coalesce(try_cast(p[3] AS double), 0) / wd AS w0, coalesce(try_cast(p[4] AS double), 0) / hd AS h0 FROM (
          SELECT *, string_split(replace(region, 'pct:', ''), ',') AS p, CASE WHEN region LIKE 'pct:%' THEN 100 ELSE width END::double AS wd,
            CASE WHEN region LIKE 'pct:%' THEN 100 ELSE height END::double AS hd FROM {_TEXTS_SQL}))))"""


@query("iiif_region", f"SELECT image_id, line, round(x, 9) AS x, round(y, 9) AS y, round(w, 9) AS w, round(h, 9) AS h, error FROM ({_REGION_SQL})")
def _(spark, sf):
    t = G.with_iiif_region(_texts(spark, sf))
    return t.select("image_id", "line", *[F.round(c(f"region_{k}"), 9).alias(k) for k in "xywh"], c("region_error").alias("error"))


@query("iiif_size", f"""SELECT image_id, line, CASE WHEN error IS NULL THEN (CASE WHEN over AND ratio > 1 THEN 600 WHEN over AND aspect THEN round(600 * ratio) WHEN over THEN 600 ELSE w END)::int END AS w,
      CASE WHEN error IS NULL THEN (CASE WHEN over AND ratio <= 1 THEN 600 WHEN over AND aspect THEN round(600 / ratio) WHEN over THEN 600 ELSE h END)::int END AS h,
      aspect AS maintain_aspect, upscale AS allow_upscaling, error FROM (
    SELECT *, w > 600 OR h > 600 AS over, CASE WHEN t = 'abc' THEN 'no comma found' WHEN w IS NULL OR h IS NULL OR w <= 0 OR h <= 0 THEN 'invalid size'
        WHEN NOT upscale AND (w > round(width * rw) OR h > round(height * rh)) THEN 'upscaling needs ^' END AS error FROM (
      SELECT *, CASE WHEN t = 'max' THEN fw WHEN t LIKE 'pct:%' THEN round(fw * pct / 100) WHEN b LIKE ',%' THEN round(tail * ratio) ELSE head END AS w,
        CASE WHEN t = 'max' THEN fh WHEN t LIKE 'pct:%' THEN round(fh * pct / 100) WHEN b LIKE '%,' THEN round(head / ratio) ELSE tail END AS h,
        t = 'max' OR t LIKE 'pct:%' OR t LIKE '!%' OR b LIKE ',%' OR b LIKE '%,' AS aspect FROM (
        SELECT *, replace(t, '!', '') AS b, try_cast(replace(t, 'pct:', '') AS double) AS pct, try_cast(string_split(replace(t, '!', ''), ',')[1] AS double) AS head,
          try_cast(string_split(replace(t, '!', ''), ',')[2] AS double) AS tail, floor(rw * width) AS fw, floor(rh * height) AS fh, (rw * width) / (rh * height) AS ratio FROM (
          SELECT image_id, line, width, height, w AS rw, h AS rh, replace(size, '^', '') AS t, size LIKE '^%' AS upscale FROM ({_REGION_SQL}) WHERE error IS NULL))))""")
def _(spark, sf):
    t = G.with_iiif_size(G.with_iiif_region(_texts(spark, sf)).where("region_error IS NULL"), "size", 3, LIMIT)
    keys = "w h maintain_aspect allow_upscaling error"
    return t.select("image_id", "line", *[v.alias(k) for k, v in G.fields("size", keys).items()])


@query("iiif_rotation", f"""SELECT image_id, line, CASE rotation WHEN '0' THEN 0 WHEN '90' THEN 90 WHEN '!180' THEN 0 WHEN '!270' THEN 270 END AS rot,
    CASE rotation WHEN '0' THEN 0 WHEN '90' THEN 0 WHEN '!180' THEN 2 WHEN '!270' THEN 1 END AS flip,
    CASE rotation WHEN 'x' THEN 'invalid rotation' WHEN '45' THEN 'unsupported rotation' END AS error FROM {_TEXTS_SQL}""")
def _(spark, sf):
    return _texts(spark, sf).withColumn("r", G.iiif_rotation(c("rotation"))).select("image_id", "line", "r.*")


@query("iiif_quality_format", f"""SELECT image_id, line, q AS quality, f AS format, CASE WHEN q = 'gray' THEN 'GREYSCALE' WHEN q = 'bitonal' THEN 'BINARY' END AS colorspace,
      CASE WHEN q = 'stretch' THEN -1.0::double ELSE 1 END AS contrast, q = 'negative' AS inverted, q = 'equalization' AS equalize, CASE WHEN q = 'log' THEN -1.0::double ELSE 1 END AS gamma,
      CASE WHEN f IS NULL THEN 'unsupported output format' WHEN q = 'other' THEN 'unsupported quality' END AS error FROM (
    SELECT image_id, line, string_split(lower(quality), '.')[1] AS q, CASE WHEN quality NOT LIKE '%.%' OR quality LIKE '%.jpg' THEN 'JPEG' WHEN quality LIKE '%.png%' THEN 'PNG' WHEN quality LIKE '%.webp' THEN 'WEBP' END AS f FROM {_TEXTS_SQL})""")
def _(spark, sf):
    return _texts(spark, sf).withColumn("r", G.iiif_quality_format(c("quality"))).select("image_id", "line", "r.*")


@query("deepzoom_tile", """SELECT image_id, line, v.level, (y * ntx + x)::int AS tile FROM (
      SELECT *, least(greatest(r - (dz - n) - 1, 0), n - 1)::int AS level FROM (
        SELECT image_id, line, wid % 14 AS r, line AS x, hei % 5 AS y, ceil(log2(greatest(width, height)))::int AS dz, n
        FROM req JOIN img USING (image_id) JOIN (SELECT image_id, count(*)::int AS n FROM lvl_floor GROUP BY ALL) USING (image_id))) v
    JOIN lvl_floor l USING (image_id, level)""")
def _(spark, sf):
    r = requests(spark, sf)
    t = G.deepzoom_tile(c("wid") % 14, c("line"), c("hei") % 5, c("levels"), c("width"), c("height"))
    return r.withColumn("t", t).select("image_id", "line", "t.*")


@query("zoomify_tile", """SELECT image_id, line, l.level, (hei % 5 * ntx + line)::int AS tile FROM req
    JOIN (SELECT image_id, count(*) AS n, greatest(count(*) FILTER (width < 256 AND height < 256) - 1, 0)::int AS d FROM lvl_floor GROUP BY ALL) USING (image_id)
    JOIN lvl_floor l ON l.image_id = req.image_id AND l.level = wid % n + d""")
def _(spark, sf):
    r = requests(spark, sf)
    t = G.zoomify_tile(c("wid") % F.size("levels"), c("line"), c("hei") % 5, c("levels"))
    valid = c("wid") % F.size("levels") + G.zoomify_discard(c("levels")) < F.size("levels")
    return r.where(valid).withColumn("t", t).select("image_id", "line", "t.*")


# --- joins ----------------------------------------------------------------------------------------


@query("attach_image", """SELECT e.event_id, e.user_id * 331 AS image_id, i.width, i.height, CASE WHEN i.image_id IS NULL THEN 'image not found' END AS error
    FROM events e LEFT JOIN img i ON i.image_id = e.user_id * 331""")
def _(spark, sf):
    r = fx.table(spark, sf, "events").select("event_id", (c("user_id") * 331).alias("image_id"))
    return cover.attach_image(r, fx.catalogue(spark, sf)).select("event_id", "image_id", "width", "height", "error")


@query("missing_images", "SELECT event_id, user_id * 331 AS image_id FROM events WHERE user_id * 331 NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    r = fx.table(spark, sf, "events").select("event_id", (c("user_id") * 331).alias("image_id"))
    return cover.missing_images(r, fx.catalogue(spark, sf))


@query("attach_level", "SELECT q.image_id, line, l.width, l.height, ntx, nty FROM req q JOIN lvl_floor l ON l.image_id = q.image_id AND l.level = line % 4")
def _(spark, sf):
    r = fx.view_requests(spark, sf).select("image_id", "line", (c("line") % 4).alias("level"))
    return cover.attach_level(r, G.level_geometry(images(spark, sf))).select("image_id", "line", "width", "height", "ntx", "nty")


_COVER = """(SELECT image_id, line, level, ntx0 AS ntx, pl // 256 AS sx, (pl + pw + 255) // 256 - 1 AS ex, pt // 256 AS sy, (pt + ph + 255) // 256 - 1 AS ey FROM (
    SELECT *, ceil(lw / 256.0)::int AS ntx0, greatest(CASE WHEN pw0 + pl > lw THEN lw - pl ELSE pw0 END, 1) AS pw, greatest(CASE WHEN ph0 + pt > lh THEN lh - pt ELSE ph0 END, 1) AS ph FROM planned))"""


def covered(spark, sf) -> DataFrame:
    px = [c(f"pixels_{k}") for k in ("left", "top", "width", "height")]
    return cover.tile_cover(planned(spark, sf), *px, c("lv_tile_w"), c("lv_tile_h"), c("lv_ntx")).withColumn("level", c("lv_level"))


@query("tile_cover", f"""SELECT image_id, line, level, tx, ty, (ty * ntx + tx)::int AS tile FROM (
    SELECT image_id, line, level, ntx, tx, unnest(range(sy, ey + 1))::int AS ty FROM (SELECT *, unnest(range(sx, ex + 1))::int AS tx FROM {_COVER}))""")
def _(spark, sf):
    return covered(spark, sf).select("image_id", "line", "level", "tx", "ty", "tile")


@query("distinct_tiles", f"""SELECT DISTINCT image_id, level, (ty * ntx + tx)::int AS tile FROM (
    SELECT image_id, line, level, ntx, tx, unnest(range(sy, ey + 1)) AS ty FROM (SELECT *, unnest(range(sx, ex + 1)) AS tx FROM {_COVER}))""")
def _(spark, sf):
    from tessella.operators import stats

    return stats.distinct_tiles(covered(spark, sf).select("image_id", "level", "tile"), ("image_id", "level", "tile"))


@query("tile_rectangle", f"""SELECT image_id, line, tx, ty, (ty * ntx + tx)::int AS tile FROM (
    SELECT *, unnest(range(a // ntx, b // ntx + 1))::int AS ty FROM (
      SELECT *, unnest(range(least(a % ntx, b % ntx), greatest(a % ntx, b % ntx) + 1))::int AS tx FROM (
        SELECT image_id, line, ntx, a, greatest(a, b) AS b FROM (
          SELECT q.image_id, line, ntx, wid % (ntx * nty) AS a, CASE WHEN line = 1 THEN wid % (ntx * nty) ELSE hei % (ntx * nty) END AS b
          FROM req q JOIN lvl_floor l ON l.image_id = q.image_id AND l.level = 2 WHERE ntx > 0 AND nty > 0))))""")
def _(spark, sf):
    r = requests(spark, sf).where("size(levels) > 2").withColumn("lv", F.get("levels", F.size("levels") - 3)).where("lv.ntx > 0 AND lv.nty > 0")
    n = c("lv.ntx") * c("lv.nty")
    end = F.when(c("line") != 1, c("hei") % n)
    return cover.tile_rectangle(r, c("wid") % n, end, c("lv.ntx")).select("image_id", "line", "tx", "ty", "tile")
