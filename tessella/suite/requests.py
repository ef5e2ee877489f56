"""Request logs, freshness and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.operators import cover, logs as L, stats
from tessella.session import join_counted, shared_dir
from tessella.streaming import demand as D
from tessella.streaming import ingest as IN
from tessella.suite.registry import query
from tessella.suite.views import covered

c = F.col

_PARTS = """(SELECT event_id, ts, event_type, lower(string_split(part, '=')[1]) AS command, substr(part, instr(part, '=') + 1) AS arg, pos0
    FROM (SELECT event_id, ts, event_type, unnest(string_split(q, '&')) AS part, unnest(range(0, len(string_split(q, '&')))) AS pos0 FROM log)
    WHERE instr(part, '=') > 1 AND length(part) > instr(part, '='))"""


@query("log_commands", f"""SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY pos0) - 1)::int AS pos, command, arg, command NOT IN ('foo') AS known FROM {_PARTS}""")
def _(spark, sf):
    return L.log_commands(fx.request_log(spark, sf)).select("event_id", "pos", "command", "arg", "known")


_LAST = ", ".join(f"max_by(arg, pos0) FILTER (command = '{n}') AS {n}" for n in ("fif", "wid", "hei", "rgn", "rot", "cnt", "gam", "inv", "cmp", "shd", "ctw", "cnv", "col", "minmax", "sds", "qlt", "cvt"))


@query("log_to_requests", f"""WITH a AS (SELECT event_id, {_LAST} FROM {_PARTS} GROUP BY event_id)
    SELECT event_id, fif AS path, wid::int AS wid, coalesce(regexp_extract(hei, '^([0-9]+)', 1)::int, 0) AS hei,
      string_split(rgn, ',')[1]::double AS rx, 0.0::double AS ry, 0.5::double AS rw, 0.5::double AS rh,
      CASE WHEN rot = '90' THEN 90 ELSE 0 END AS rot, CASE WHEN rot = '!180' THEN 2 ELSE 0 END AS flip,
      CASE cnt WHEN '1.5' THEN 1.5::double WHEN 'stretch' THEN -1 ELSE 1 END AS contrast, coalesce(lower(cnt) = 'eq', false) AS equalize,
      CASE gam WHEN '2.2' THEN 2.2::double WHEN 'log' THEN -1 ELSE 1 END AS gamma, inv IS NOT NULL AS inverted, cmp AS cmap, shd AS shade,
      CASE WHEN ctw IS NOT NULL THEN '1,0,0;0,1,0;0,0,1' END AS matrix, CASE WHEN cnv IS NOT NULL THEN '-1,0,1,-2,0,2,-1,0,1' END AS kernel,
      CASE WHEN col = 'gray' THEN 'GREYSCALE' END AS colorspace, string_split(minmax, ':')[1] AS minmax_channel,
      CASE WHEN minmax LIKE '0%' THEN 5.0::double WHEN minmax IS NOT NULL THEN 10 END AS minmax_lo, CASE WHEN minmax LIKE '0%' THEN 200.0::double WHEN minmax IS NOT NULL THEN 250 END AS minmax_hi,
      CASE WHEN sds IS NOT NULL THEN 3 ELSE 0 END AS h_seq, 90 AS v_seq, qlt::int AS quality, upper(cvt) AS format FROM a""")
def _(spark, sf):
    r = L.log_to_requests(fx.request_log(spark, sf))
    number = lambda a: F.concat_ws(",", F.transform(a, lambda v: v.cast("int").cast("string")))
    text = {
        "shade": F.when(c("shade").isNotNull(), number(c("shade"))),
        "matrix": F.when(c("matrix").isNotNull(), F.concat_ws(";", F.transform("matrix", number))),
        "kernel": F.when(c("kernel").isNotNull(), number(c("kernel"))),
    }
    return r.withColumns(text).drop("ts", "event_type", "user_id", "q")


@query("command_counts", f"""SELECT date_trunc('hour', ts) AS period, command, count(*) AS n, count(*) FILTER (command = 'foo') AS errors FROM {_PARTS} GROUP BY ALL""")
def _(spark, sf):
    return L.command_counts(L.log_commands(fx.request_log(spark, sf)))


@query("iiif_log", """SELECT event_id, CASE WHEN k = 3 THEN NULL ELSE 'pre/img' || user_id || '.tif' END AS identifier, CASE WHEN k = 1 THEN 3 END AS page, k = 0 AS is_info,
    CASE WHEN k IN (1, 2) THEN 'full' END AS region, CASE WHEN k IN (1, 2) THEN 'max' END AS size, CASE WHEN k IN (1, 2) THEN '0' END AS rotation, CASE WHEN k IN (1, 2) THEN 'default.jpg' END AS quality,
    CASE WHEN k = 3 THEN 'not enough parameters' END AS error FROM (SELECT event_id, user_id, event_id % 4 AS k FROM events)""")
def _(spark, sf):
    name, k = F.concat(F.lit("pre%2Fimg"), c("user_id").cast("string"), F.lit(".tif")), c("event_id") % 4
    uri = F.when(k == 0, F.concat(name, F.lit("/info.json"))).when(k == 1, F.concat(name, F.lit("%3B3/full/max/0/default.jpg")))
    uri = uri.when(k == 2, F.concat(name, F.lit("/full/max/0/default.jpg"))).otherwise("img/0/default.jpg")
    e = fx.table(spark, sf, "events").select("event_id", uri.alias("uri"))
    return L.iiif_log(e).drop("uri")


@query("uri_map", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'iiif=' || split_part(rest, '?', 1) WHEN page_id % 3 = 1 THEN 'fif=' || split_part(rest, '?', 1) ELSE '/other/' || rest END AS request
    FROM (SELECT page_id, substr(url, 8) AS rest FROM pages)""")
def _(spark, sf):
    prefix = F.when(c("page_id") % 3 == 0, "/iiif/").when(c("page_id") % 3 == 1, "/images/").otherwise("/other/")
    rows = fx.table(spark, sf, "pages").select("page_id", F.concat(prefix, F.expr("substring(url, 8)")).alias("uri"))
    maps = spark.createDataFrame([("iiif", "IIIF"), ("images", "IIP"), ("other", "FTP")], "prefix string, protocol string")
    return L.uri_map(rows, maps).drop("uri")


_COVER = """(SELECT image_id, line, level, ntx0 AS ntx, pl // 256 AS sx, (pl + pw + 255) // 256 - 1 AS ex, pt // 256 AS sy, (pt + ph + 255) // 256 - 1 AS ey FROM (
    SELECT *, ceil(lw / 256.0)::int AS ntx0, greatest(CASE WHEN pw0 + pl > lw THEN lw - pl ELSE pw0 END, 1) AS pw, greatest(CASE WHEN ph0 + pt > lh THEN lh - pt ELSE ph0 END, 1) AS ph FROM planned))"""
_CELLS = f"(SELECT image_id, level, (ty * ntx + tx)::int AS tile FROM (SELECT image_id, level, ntx, tx, unnest(range(sy, ey + 1)) AS ty FROM (SELECT *, unnest(range(sx, ex + 1)) AS tx FROM {_COVER})))"


@query("tile_demand", f"SELECT image_id, level, tile, count(*) AS n FROM {_CELLS} GROUP BY ALL")
def _(spark, sf):
    return L.tile_demand(covered(spark, sf))


@query("tile_demand_top", f"SELECT image_id, level, tile, count(*) AS n FROM {_CELLS} GROUP BY ALL ORDER BY n DESC, image_id, level, tile LIMIT 100")
def _(spark, sf):
    return L.tile_demand(covered(spark, sf), top=100)


@query("tile_commands", """SELECT event_id, ['JPEG', 'PNG', 'TIFF', 'JPEG', 'JPEG', 'JPEG'][(k + 1)::int] AS format, CASE WHEN k = 3 THEN 7 ELSE 0 END AS h_seq, CASE WHEN k = 3 THEN 45 ELSE 90 END AS v_seq, (event_id % 9)::int AS level,
    user_id::int AS start_tile, CASE WHEN k = 4 THEN greatest(user_id, 40) ELSE user_id END::int AS end_tile, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS code FROM (SELECT *, event_id % 6 AS k FROM events)""")
def _(spark, sf):
    k, level, tile = c("event_id") % 6, (c("event_id") % 9).cast("string"), c("user_id").cast("string")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    q = (
        F.when(k == 0, cat("JTL=", level, ",", tile)).when(k == 1, cat("PTL=", level, ",", tile)).when(k == 2, cat("ttl=", level, ",", tile))
        .when(k == 3, cat("JTLS=7,", level, ",", tile, ",45")).when(k == 4, cat("TIL=", level, ",", tile, "-40")).otherwise(cat("TIL=", level, ",", tile))
    )
    commands = L.log_commands(fx.table(spark, sf, "events").select("event_id", q.alias("q")))
    depth = F.when(c("event_id") % 2 == 0, 16).otherwise(8)
    return L.tile_commands(commands).select("event_id", "format", "h_seq", "v_seq", "level", "start_tile", "end_tile", L.tile_code(depth).alias("code"))


# --- freshness ------------------------------------------------------------------------------------


def versions(spark, sf) -> DataFrame:
    """Tile versions: each line item is a stored version of a tile of its order's image."""
    return fx.table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("image_id"), F.lit(0).alias("h_seq"), F.lit(90).alias("v_seq"), F.lit(0).alias("level"), (c("l_linenumber") % 3).alias("tile"),
        c("l_returnflag").alias("encoding"), F.lit(75).alias("quality"), F.date_trunc("year", "l_shipdate").alias("mtime"), F.encode("l_linestatus", "UTF-8").alias("data"),
        c("l_quantity").cast("int").alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.lit(8).alias("bpc"),
    )


_VERSIONS = "(SELECT l_orderkey AS image_id, l_linenumber % 3 AS tile, l_returnflag AS encoding, date_trunc('year', l_shipdate)::timestamp AS mtime, l_linestatus AS data, l_quantity::int AS width FROM lineitem)"


@query("latest_tile", f"SELECT image_id, tile, encoding, max(mtime) AS mtime FROM {_VERSIONS} GROUP BY ALL")
def _(spark, sf):
    return stats.latest_tile(versions(spark, sf)).select("image_id", "tile", "encoding", "mtime")


@query("stale_tiles", f"SELECT v.image_id, tile, encoding, v.mtime, o.y AS image_mtime FROM {_VERSIONS} v JOIN (SELECT o_orderkey, date_trunc('year', o_orderdate)::timestamp AS y FROM orders) o ON o_orderkey = image_id WHERE v.mtime <> o.y")
def _(spark, sf):
    images = fx.catalogue(spark, sf).withColumn("mtime", F.date_trunc("year", "mtime"))
    return cover.stale_tiles(versions(spark, sf), images).select("image_id", "tile", "encoding", "mtime", "image_mtime")


@query("missing_tiles", f"SELECT DISTINCT c.image_id, c.tile FROM {_CELLS} c WHERE NOT EXISTS (SELECT 1 FROM {_VERSIONS} v WHERE v.image_id = c.image_id AND v.tile = c.tile)")
def _(spark, sf):
    key = ("image_id", "tile")
    return cover.missing_tiles(stats.distinct_tiles(covered(spark, sf), key), versions(spark, sf), key)


@query("compression_ratio", f"SELECT 0 AS level, encoding, sum(length(data))::bigint AS encoded_bytes, sum(width * 8)::double AS raw_bytes, sum(length(data)) / sum(width * 8)::double AS ratio FROM {_VERSIONS} GROUP BY ALL")
def _(spark, sf):
    return stats.compression_ratio(versions(spark, sf))


@query("changed_since", """SELECT event_id, i.image_id, coalesce(i.mtime <> s.since, true) AS modified FROM (SELECT event_id, user_id * 31 AS image_id, (CASE WHEN event_id % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '1999-01-01' END) AS since
    FROM events JOIN orders ON o_orderkey = user_id * 31) s JOIN img i USING (image_id)""")
def _(spark, sf):
    images = fx.catalogue(spark, sf)
    asked = fx.table(spark, sf, "events").select("event_id", (c("user_id") * 31).alias("image_id"))
    asked = join_counted(asked, images.select("image_id", c("mtime").alias("m")), ["image_id"], "inner")
    asked = asked.withColumn("since", F.when(c("event_id") % 2 == 0, c("m")).otherwise(F.expr("timestamp'1999-01-01'"))).drop("m")
    return IN.not_modified(asked, images).select("event_id", "image_id", "modified")


@query("refresh_tiles", f"""WITH i AS (SELECT o_orderkey AS image_id, date_trunc('year', o_orderdate)::timestamp AS y FROM orders), s AS (SELECT DISTINCT v.image_id FROM {_VERSIONS} v JOIN i USING (image_id) WHERE v.mtime <> i.y)
    SELECT image_id, tile, mtime FROM {_VERSIONS} WHERE image_id NOT IN (SELECT image_id FROM s) UNION ALL SELECT image_id, -1, y FROM i JOIN s USING (image_id)""")
def _(spark, sf):
    images = fx.catalogue(spark, sf).withColumn("mtime", F.date_trunc("year", "mtime"))
    rebuild = lambda stale: stale.select("image_id", F.lit(-1).alias("tile"), "mtime")
    return IN.refresh_tiles(versions(spark, sf), images, rebuild).select("image_id", "tile", "mtime")


_DEMAND = f"SELECT date_trunc('hour', ts) AS period, command, count(*) AS n FROM {_PARTS} GROUP BY ALL"


@query("demand_batch", _DEMAND)
def _(spark, sf):
    return D.demand(fx.request_log(spark, sf))


@query("demand_stream", f"SELECT * FROM ({_DEMAND}) WHERE period + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(spark, sf):
    """The log as a stream, run until all is read; periods that the watermark has closed."""
    run = os.path.join(shared_dir(spark), f"demand-{uuid.uuid4().hex}")
    fx.request_log(spark, sf).select("event_id", "ts", "q").write.parquet(f"{run}/log")
    stream = spark.readStream.schema("event_id long, ts timestamp, q string").parquet(f"{run}/log")
    D.run_available(D.demand(stream), f"{run}/out", f"{run}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{run}/out")
