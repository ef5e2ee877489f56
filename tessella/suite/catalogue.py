"""Metadata queries over the whole catalogue, file sequences, paths and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import text as T
from tessella.operators import catalog as B
from tessella.operators import color as O
from tessella.operators import geometry as G
from tessella.operators import stats
from tessella.suite.registry import query
from tessella.suite.views import images

c = F.col
_N = "(SELECT image_id, count(*)::int AS n FROM lvl_floor GROUP BY ALL)"


@query("max_size", """SELECT image_id, CASE WHEN image_id % 4 * 90 % 180 = 90 THEN height || ' ' || width ELSE width || ' ' || height END AS max_size FROM img""")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.max_size(c("image_id") % 4 * 90).alias("max_size"))


@query("resolution_number", f"SELECT image_id, n FROM {_N}")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.resolution_number().alias("n"))


@query("tile_size", "SELECT image_id, '256 256' AS tile_size, '256 256' AS level_tile_size FROM img")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.tile_size().alias("tile_size"), B.tile_size(F.lit(0)).alias("level_tile_size"))


@query("bits_per_channel", "SELECT image_id, bpc FROM img")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.bits_per_channel().alias("bpc"))


_RANGE_SQL = "CASE WHEN bpc = 32 AND sample_type = 'FIXEDPOINT' THEN 4294967295.0::double WHEN bpc = 32 THEN 1 WHEN bpc = 12 THEN 4095 WHEN bpc > 8 THEN 65535 ELSE 255 END"


@query("min_max_sample_values", f"""SELECT image_id, string_agg(format('{{:.9g}}', lo) || ' ' || format('{{:.9g}}', hi), ' ' ORDER BY ch) AS range
    FROM (SELECT image_id, ch, image_id * 0.001::double * ch AS lo, {_RANGE_SQL} + image_id / 7.0::double AS hi FROM (SELECT *, unnest(range(0, channels)) AS ch FROM img)) GROUP BY image_id""")
def _(spark, sf):
    i = images(spark, sf)
    top = O.default_range(c("bpc"), c("sample_type")) + c("image_id") / 7.0
    lo = F.transform(F.sequence(F.lit(0), c("channels") - 1), lambda k: c("image_id") * F.lit(0.001) * k)
    return i.select("image_id", B.min_max_sample_values(lo, F.array_repeat(top, c("channels"))).alias("range"))


@query("resolutions", "SELECT image_id, string_agg(width || ' ' || height, ',' ORDER BY level) AS sizes FROM lvl_floor GROUP BY image_id")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.resolutions().alias("sizes"))


_SPACE_SQL = """'Colorspace,0-' || (n - 1) || ',0:' || CASE WHEN colorspace = 'CIELAB' THEN '1 0 4 3 0 1 2' WHEN colorspace = 'GREYSCALE' THEN '0 0 1 1 0' ELSE '0 0 3 3 0 1 2' END"""


@query("colorspace", f"SELECT image_id, {_SPACE_SQL} AS colorspace FROM img JOIN {_N} USING (image_id)")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.colorspace().alias("colorspace"))


@query("dpi", """SELECT image_id, CASE WHEN dpi_x <> 0 AND dpi_y <> 0 THEN printf('%.6f %.6f',
    CASE dpi_units WHEN 2 THEN dpi_x::double * 100 WHEN 1 THEN dpi_x::double / 0.0254::double ELSE dpi_x::double END,
    CASE dpi_units WHEN 2 THEN dpi_y::double * 100 WHEN 1 THEN dpi_y::double / 0.0254::double ELSE dpi_y::double END) END AS dpi FROM img""")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.dpi().alias("dpi"))


@query("metadata_field", "SELECT image_id, nullif(rights, '') AS rights, title FROM img")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.metadata_field("rights").alias("rights"), B.metadata_field("title").alias("title"))


@query("metadata_json", """SELECT image_id, '{"creator":"' || creator || '",' || CASE WHEN rights <> '' THEN '"rights":"' || rights || '",' ELSE '' END || '"title":"' || title || '"}' AS metadata FROM img""")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.metadata_json().alias("metadata"))


@query("basic_info", f"SELECT image_id, width || ' ' || height AS max_size, n AS resolution_number, {_SPACE_SQL} AS colorspace FROM img JOIN {_N} USING (image_id)")
def _(spark, sf):
    return B.basic_info(images(spark, sf))


@query("summary_info", "SELECT image_id, nullif(rights, '') AS rights, NULL::varchar AS description, creator, NULL::varchar AS date, NULL::varchar AS software FROM img")
def _(spark, sf):
    return B.summary_info(images(spark, sf))


def stacked(spark, sf) -> DataFrame:
    """Images with a stack of 0 to 3 layers, some without a name."""
    layer = lambda i: F.struct(
        F.when((c("image_id") + i) % 3 == 0, "").otherwise(F.concat(F.lit('band "'), i.cast("string"), F.lit('"'))).alias("name"),
        (i * 0.5 + 1).cast("float").alias("scale"),
    )
    layers = F.when(c("image_id") % 4 > 0, F.transform(F.sequence(F.lit(1), (c("image_id") % 4).cast("int")), layer))
    return fx.catalogue(spark, sf).withColumn("stack", F.coalesce(layers, F.expr("cast(array() as array<struct<name: string, scale: float>>)")))


_STACK_SQL = """(SELECT image_id, (i - 1)::int AS id, CASE WHEN (image_id + i) % 3 = 0 THEN '' ELSE 'band "' || i || '"' END AS name, (i * 0.5 + 1)::float AS scale
    FROM (SELECT image_id, unnest(range(1, image_id % 4 + 1)) AS i FROM img))"""


@query("stack_rows", f"SELECT image_id, id, name, scale::double AS scale FROM {_STACK_SQL}")
def _(spark, sf):
    return B.stack_rows(stacked(spark, sf)).withColumn("scale", c("scale").cast("double"))


@query("stack_json", f"""SELECT img.image_id, j AS stack FROM img LEFT JOIN (SELECT image_id, '[' || string_agg('{{"id":' || id || ',"name":"' || replace(name, '"', chr(92) || '"') || '","scale":' || format('{{:.9g}}', scale::double) || '}}', ',' ORDER BY id) || ']' AS j
    FROM {_STACK_SQL} GROUP BY image_id) USING (image_id)""")
def _(spark, sf):
    return stacked(spark, sf).select("image_id", B.stack_json(c("stack")).alias("stack"))


@query("fill_rights", "SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 'all rights' ELSE rights END AS rights FROM img")
def _(spark, sf):
    i = fx.catalogue(spark, sf)
    own = F.when(c("image_id") % 3 == 0, F.map_filter("metadata", lambda k, v: k != "rights")).otherwise(c("metadata"))
    return i.select("image_id", F.try_element_at(B.fill_rights(own, "all rights"), F.lit("rights")).alias("rights"))


# --- manifests ------------------------------------------------------------------------------------


@query("deepzoom_manifest", """SELECT image_id, '<Image xmlns="http://schemas.microsoft.com/deepzoom/2008" TileSize="256" Overlap="0" Format="jpg"><Size Width="' || width || '" Height="' || height || '"/></Image>' AS manifest,
    ceil(log2(greatest(width, height)))::int AS levels FROM img""")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.deepzoom_manifest().alias("manifest"), G.deepzoom_levels(c("width"), c("height")).alias("levels"))


@query("zoomify_manifest", """SELECT image_id, '<IMAGE_PROPERTIES WIDTH="' || img.width || '" HEIGHT="' || img.height || '" NUMTILES="' || n || '" NUMIMAGES="1" VERSION="1.8" TILESIZE="256"/>' AS manifest, d AS discard
    FROM img JOIN (SELECT image_id, 1 + coalesce(sum(ntx * nty) FILTER (NOT (width < 256 AND height < 256)), 0)::bigint AS n, greatest(count(*) FILTER (width < 256 AND height < 256) - 1, 0)::int AS d FROM lvl_floor GROUP BY ALL) USING (image_id)""")
def _(spark, sf):
    return images(spark, sf).select("image_id", B.zoomify_manifest().alias("manifest"), G.zoomify_discard(c("levels")).alias("discard"))


_IIIF_HEAD = """'{"@context":"http://iiif.io/api/image/' || VERSION || '/context.json","protocol":"http://iiif.io/api/image","width":' || img.width || ',"height":' || img.height || ',"sizes":[' || sizes || '],"tiles":[{"width":256,"height":256,"scaleFactors":[' || factors || ']}],'"""
_IIIF_TAIL = """|| CASE WHEN dpi_x > 0 THEN ',"service":[{"@context":"http://iiif.io/api/annex/services/physdim/1/context.json","profile":"http://iiif.io/api/annex/services/physdim","physicalScale":' || 'SCALE' || ',"physicalUnits":"' || CASE WHEN dpi_units = 1 THEN 'in' ELSE 'cm' END || '"}]' ELSE '' END || '}'"""
_IIIF_FROM = """FROM img JOIN (SELECT l.image_id, string_agg('{"width":' || l.width || ',"height":' || l.height || '}', ',' ORDER BY level) FILTER (level = 0 OR native_level > 0) AS sizes,
      string_agg((i.width // greatest(l.width, 1))::varchar, ',' ORDER BY native_level) AS factors FROM lvl_floor l JOIN img i USING (image_id) GROUP BY ALL) USING (image_id)"""


def _without_scale(info):
    """The physical scale is compared as a number of its own; its text form differs by engine."""
    return F.regexp_replace(info, r'"physicalScale":[^,]*', '"physicalScale":SCALE')


@query("iiif_info", f"""SELECT image_id, {_IIIF_HEAD.replace("VERSION", "3")} || '"id":"http://host' || path || '","type":"ImageService3","profile":"level2","maxWidth":5000,"maxHeight":5000,"extraQualities":[' || CASE WHEN channels >= 3 THEN '"color",' ELSE '' END
    || '"gray","bitonal","negative","stretch","equalization","log"],"extraFormats":["tif"],"extraFeatures":["regionByPct","sizeByPct","sizeByConfinedWh","sizeUpscaling","rotationBy90s","mirroring"]'
    || CASE WHEN rights <> '' THEN ',"rights":"' || rights || '"' ELSE '' END {_IIIF_TAIL} AS info {_IIIF_FROM}""")
def _(spark, sf):
    return images(spark, sf).select("image_id", _without_scale(B.iiif_info("http://host", 3)).alias("info"))


@query("iiif_info_v2", f"""SELECT image_id, {_IIIF_HEAD.replace("VERSION", "2")} || '"@id":"http://host' || path || '"' || CASE WHEN rights <> '' THEN ',"license":"' || rights || '"' ELSE '' END {_IIIF_TAIL} AS info,
    channels >= 3 AS has_color {_IIIF_FROM}""")
def _(spark, sf):
    info = _without_scale(B.iiif_info("http://host", 2))
    bare = F.regexp_replace(info, r',"profile":\["\{.*?\}","\{.*?\}"\]', "")
    return images(spark, sf).select("image_id", bare.alias("info"), info.contains("color").alias("has_color"))


_digest = lambda k: f"sum(('0x' || md5({k})[1:8])::bigint)::bigint"


@query("static_tile_paths", f"""SELECT image_id, level, count(*) AS n, {_digest('deepzoom')} AS deepzoom, {_digest('zoomify')} AS zoomify, {_digest('iiif')} AS iiif FROM (SELECT image_id, level, tx, ty, path || '_files/' || (level + dz - n + 1) || '/' || tx || '_' || ty || '.png' AS deepzoom, path || '/TileGroup' || ((before + ty * ntx + tx) // 256) || '/' || (level - d) || '-' || tx || '-' || ty || '.png' AS zoomify,
      path || '/' || (tx * 256 * s) || ',' || (ty * 256 * s) || ',' || least(256 * s, fw - tx * 256 * s) || ',' || least(256 * s, fh - ty * 256 * s) || '/' || least(256, width - tx * 256) || ',/0/default.png' AS iiif FROM (
    SELECT *, unnest(range(0, ntx))::int AS tx FROM (SELECT l.*, (SELECT coalesce(sum(s.ntx * s.nty), 0)::bigint FROM lvl_floor s WHERE s.image_id = l.image_id AND s.level < l.level AND s.level >= d) AS before, i.path, i.width AS fw, i.height AS fh, ceil(log2(greatest(i.width, i.height)))::int AS dz, n, d, (1 << native_level)::bigint AS s, unnest(range(0, nty))::int AS ty
      FROM lvl_floor l JOIN img i USING (image_id) JOIN (SELECT image_id, count(*)::int AS n, greatest(count(*) FILTER (width < 256 AND height < 256) - 1, 0)::int AS d FROM lvl_floor GROUP BY ALL) USING (image_id)))) GROUP BY ALL""")
def _(spark, sf):
    from tessella.plans.export import tile_paths

    digests = [F.sum(F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long")).alias(k) for k in ("deepzoom", "zoomify", "iiif")]
    return tile_paths(images(spark, sf)).groupBy("image_id", "level").agg(F.count("*").alias("n"), *digests)


@query("tile_counts", """SELECT image_id, level, sum(ntx * nty)::bigint AS n_tiles FROM lvl_floor GROUP BY ROLLUP (image_id, level)""")
def _(spark, sf):
    return stats.tile_counts(G.level_geometry(images(spark, sf)))


@query("dpi_for_level", """SELECT image_id, level, round(dpi_x::double * l.width / i.width, 6) AS dpi_x, round(dpi_y::double * l.height / i.height, 6) AS dpi_y FROM img i JOIN lvl_floor l USING (image_id)""")
def _(spark, sf):
    rows = images(spark, sf).withColumn("lv", F.explode("levels"))
    x, y = B.dpi_for_level(c("lv"))
    return rows.select("image_id", "lv.level", F.round(x, 6).alias("dpi_x"), F.round(y, 6).alias("dpi_y"))


@query("embed_icc", """SELECT image_id, coalesce(icc_len > 0 AND icc_len < 8 AND NOT (image_id % 11 = 0) AND NOT image_id % 13 = 0, false) AS embed,
    coalesce(icc_len > 0 AND NOT (image_id % 11 = 0) AND NOT image_id % 13 = 0, false) AS embed_any, false AS embed_none, coalesce(image_id % 2 = 0 AND icc_len > 0, false) AS xmp FROM img""")
def _(spark, sf):
    no, size = F.lit(False), F.octet_length("icc")
    args = (c("image_id") % 11 == 0, no, no, F.when(c("image_id") % 13 == 0, "GREYSCALE"))
    return fx.catalogue(spark, sf).select(
        "image_id",
        B.embed_icc(size, 8, *args).alias("embed"),
        B.embed_icc(size, -1, *args).alias("embed_any"),
        B.embed_icc(size, 0, *args).alias("embed_none"),
        B.embed_xmp(size, c("image_id") % 2 == 0).alias("xmp"),
    )


# --- sequences and paths --------------------------------------------------------------------------


def _sequence_files(spark, sf) -> DataFrame:
    e = fx.table(spark, sf, "events")
    stem = F.concat(F.lit("/seq/obj"), (c("user_id") % 50).cast("string"))
    suffix = F.when((c("user_id") % 50 == 7) & (c("event_id") % 3 == 0), "jp2").otherwise("tif")
    v = F.when(c("event_id") % 2 == 0, 90).otherwise((c("event_id") % 7 * 15).cast("int"))
    h = F.when(c("event_id") % 5 == 0, 0).otherwise((c("event_id") % 36 * 10 + c("event_id") % 3 * 400).cast("int"))
    return e.select(B.sequence_path(stem, h, v, suffix).alias("path"))


_SEQ_SQL = """(SELECT '/seq/obj' || (user_id % 50) AS stem, CASE WHEN user_id % 50 = 7 AND event_id % 3 = 0 THEN 'jp2' ELSE 'tif' END AS suffix,
    (CASE WHEN event_id % 2 = 0 THEN 90 ELSE event_id % 7 * 15 END)::int AS v, (CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 36 * 10 + event_id % 3 * 400 END)::int AS h FROM events)"""


@query("sequence_path", f"SELECT stem || '_pyr_' || printf('%03d_%03d.', h, v) || suffix AS path FROM {_SEQ_SQL}")
def _(spark, sf):
    return _sequence_files(spark, sf)


@query("discover_sequences", f"""SELECT stem, suffix, string_agg(DISTINCT h::varchar, ' ' ORDER BY h::varchar) FILTER (v = 90) AS h_views, string_agg(DISTINCT v::varchar, ' ' ORDER BY v::varchar) FILTER (h = 0) AS v_views
    FROM {_SEQ_SQL} s WHERE stem IN (SELECT stem FROM {_SEQ_SQL} WHERE h = 0 AND v = 90 GROUP BY stem HAVING count(DISTINCT suffix) = 1) GROUP BY ALL""")
def _(spark, sf):
    found = B.discover_sequences(_sequence_files(spark, sf))
    text = lambda a: F.concat_ws(" ", F.array_sort(F.transform(a, lambda x: x.cast("string"))))
    return found.select("stem", "suffix", text(c("h_views")).alias("h_views"), text(c("v_views")).alias("v_views"))


@query("sequence_views", f"""SELECT stem, array_to_string(list_sort(list_distinct(list(h) FILTER (v = 90))), ' ') AS horizontal_views, array_to_string(list_sort(list_distinct(list(v) FILTER (h = 0))), ' ') AS vertical_views
    FROM {_SEQ_SQL} s WHERE stem IN (SELECT stem FROM {_SEQ_SQL} WHERE h = 0 AND v = 90 GROUP BY stem HAVING count(DISTINCT suffix) = 1) GROUP BY ALL""")
def _(spark, sf):
    found = B.discover_sequences(_sequence_files(spark, sf))
    return found.select("stem", B.views(c("h_views")).alias("horizontal_views"), B.views(c("v_views")).alias("vertical_views"))


@query("resolve_path", """SELECT event_id, '/data/' || CASE event_id % 5 WHEN 0 THEN 'a b/' || user_id WHEN 1 THEN user_id || '/x%zz.tif' WHEN 2 THEN 'k/' || user_id WHEN 3 THEN 'etc' || user_id ELSE 'é' || user_id END || '.tif' AS path FROM events""")
def _(spark, sf):
    u = c("user_id").cast("string")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    raw = (
        F.when(c("event_id") % 5 == 0, cat("a+b/", u))
        .when(c("event_id") % 5 == 1, cat(u, "/x%zz.tif"))
        .when(c("event_id") % 5 == 2, cat("....//../k%00/", u))
        .when(c("event_id") % 5 == 3, cat("%2e%2E/../etc", u))
        .otherwise(cat("%C3%A9", u))
    )
    return fx.table(spark, sf, "events").select("event_id", T.resolve_path(raw, "/data/", ".tif").alias("path"))


@query("url_decode", """SELECT page_id, url_decode(replace(replace(url, '/', '%2F'), '=', '+=')) AS plain_before, replace(replace(url, '=', ' ='), '%00', '') AS decoded FROM pages""")
def _(spark, sf):
    p = fx.table(spark, sf, "pages")
    encoded = F.regexp_replace(F.regexp_replace("url", "/", "%2F"), "=", "+=")
    return p.select(
        "page_id",
        F.regexp_replace(T.url_decode(encoded), " =", "+=").alias("plain_before"),
        T.url_decode(encoded).alias("decoded"),
    )


@query("json_escape", """SELECT page_id, replace(replace(html, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS escaped FROM pages""")
def _(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", T.json_escape(c("html")).alias("escaped"))


@query("tokens", """SELECT page_id, (pos - 1)::int AS pos, token FROM (SELECT page_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS t FROM pages))""")
def _(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", F.posexplode(T.tokens(c("url"), "/")).alias("pos", "token"))


@query("http_date", """SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS date FROM events""")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", T.http_date(c("ts")).alias("date"))
