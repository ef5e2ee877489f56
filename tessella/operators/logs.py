"""Request logs: query strings as rows, as request columns, and what they ask for.

One log row becomes request columns by expressions over its own text; nothing is exploded and
regrouped for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.constants import COLORMAPS, COMMANDS
from tessella.functions.kernels import kernel_column, leading_integer, leading_number
from tessella.functions.text import tokens, url_decode

c = F.col


def _pairs(query: Column) -> Column:
    """(name, arg) of each well-formed part, in order; names in lower case."""
    parts = F.transform(
        F.split(query, "&"),
        lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("name"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("arg")),
    )
    return F.filter(parts, lambda p: (p["name"] != "") & (p["arg"] != ""))


def log_commands(log: DataFrame, query: str = "q") -> DataFrame:
    """One row per command: pos, command, arg, known."""
    rows = log.withColumn("_p", _pairs(c(query))).select(*log.columns, F.posexplode("_p").alias("pos", "_c"))
    known = c("command").isin(*COMMANDS)
    return rows.withColumns({"command": c("_c.name"), "arg": c("_c.arg")}).drop("_c").withColumn("known", known)


def _fired(pairs: Column) -> Column:
    """Commands up to the first CVT, which sends the picture at once."""
    at = F.array_position(F.transform(pairs, lambda p: p["name"]), "cvt")
    return F.when(at > 0, F.slice(pairs, F.lit(1), at)).otherwise(pairs)


def log_to_requests(log: DataFrame, query: str = "q") -> DataFrame:
    """Request columns of each query string; of a repeated command the last one counts."""
    rows = log.withColumn("_p", _fired(_pairs(c(query))))
    names = ["fif", "wid", "hei", "rgn", "rot", "cnt", "gam", "inv", "cmp", "shd", "ctw", "cnv", "col", "minmax", "sds", "qlt", "cvt"]
    last = lambda n: F.try_element_at(F.filter("_p", lambda p: p["name"] == n), F.lit(-1))["arg"]
    rows = rows.withColumns({f"_{n}": last(n) for n in names}).drop("_p")

    region = F.slice(tokens(c("_rgn"), ","), 1, 4)
    rows = rows.withColumn("_r", F.when(F.size(region) == 4, F.transform(region, leading_number)))
    region_ok = F.coalesce((c("_r")[2] > 0) & (c("_r")[3] > 0), F.lit(False))
    part = lambda i, default: F.when(region_ok, F.least(F.greatest(c("_r")[i], F.lit(0.0)), F.lit(1.0))).otherwise(default)

    mirror = c("_rot").startswith("!")
    angle = leading_number(F.regexp_replace("_rot", "^!", ""))
    vertical = mirror & (angle == 180)
    contrast, gamma = F.lower("_cnt"), F.lower("_gam")
    shade = F.transform(F.slice(tokens(c("_shd"), ","), 1, 2), leading_integer)
    matrix_text = F.regexp_extract(url_decode(c("_ctw")), r"\[([^\]]*)\]", 1)
    matrix = F.transform(tokens(matrix_text, ";"), lambda r: F.transform(tokens(r, ","), leading_number))
    color, out = F.lower("_col"), F.lower("_cvt")
    minmax_channel = F.substring_index("_minmax", ":", 1)
    minmax_range = F.substring_index("_minmax", ":", -1)
    wanted = {
        "path": url_decode(c("_fif")),
        "wid": F.coalesce(leading_integer(c("_wid")), F.lit(0)),
        "hei": F.coalesce(leading_integer(c("_hei")), F.lit(0)),
        "rx": part(0, 0.0),
        "ry": part(1, 0.0),
        "rw": part(2, 1.0),
        "rh": part(3, 1.0),
        "rot": F.coalesce(F.when(vertical, 0).otherwise(angle.cast("int")), F.lit(0)),
        "flip": F.coalesce(F.when(vertical, 2).when(mirror, 1), F.lit(0)),
        "contrast": F.when(c("_cnt").isNull() | contrast.isin("eq", "equalization"), 1.0).when(contrast.isin("st", "stretch"), -1.0).otherwise(leading_number(c("_cnt"))),
        "equalize": F.coalesce(contrast.isin("eq", "equalization"), F.lit(False)),
        "gamma": F.when(c("_gam").isNull(), 1.0).when(gamma.isin("log", "logarithm"), -1.0).otherwise(leading_number(c("_gam"))),
        "inverted": c("_inv").isNotNull(),
        "cmap": F.when(F.upper("_cmp").isin(*COLORMAPS), F.upper("_cmp")),
        "shade": F.when(F.size(shade) == 2, shade),
        "matrix": F.when(c("_ctw").isNotNull(), matrix),
        "kernel": F.when(c("_cnv").isNotNull(), kernel_column(url_decode(c("_cnv")))),
        "colorspace": F.when(color.isin("grey", "gray"), "GREYSCALE").when(color == "binary", "BINARY"),
        "minmax_channel": minmax_channel,
        "minmax_lo": F.when(c("_minmax").isNotNull(), leading_number(F.substring_index(minmax_range, ",", 1))),
        "minmax_hi": F.when(c("_minmax").isNotNull(), leading_number(F.substring_index(minmax_range, ",", -1))),
        "h_seq": F.coalesce(leading_integer(F.substring_index("_sds", ",", 1)), F.lit(0)),
        "v_seq": F.when(c("_sds").isNull(), 90).when(c("_sds").contains(","), leading_integer(F.substring_index("_sds", ",", -1))).otherwise(0),
        "quality": F.when(c("_qlt").isNotNull(), leading_integer(F.element_at(F.split("_qlt", ":"), -1))),
        "format": F.when(out.isin("png", "tiff", "webp", "avif"), F.upper(out)).otherwise("JPEG"),
    }
    return rows.withColumns(wanted).drop("_r", *[f"_{n}" for n in names])


TILE_COMMANDS = {"jtl": "JPEG", "ptl": "PNG", "wtl": "WEBP", "atl": "AVIF", "ttl": "TIFF", "jtls": "JPEG", "til": "JPEG"}


def tile_commands(commands: DataFrame) -> DataFrame:
    """Tile requests of a command table: format, h_seq, v_seq, level, start and end tile.

    JTL, PTL, WTL, ATL and TTL are (level, tile), JTLS is (angle, level, tile, angle), TIL is
    (level, from-to).
    """
    names = F.create_map(*[F.lit(x) for kv in TILE_COMMANDS.items() for x in kv])
    rows = commands.where(c("command").isin(*TILE_COMMANDS))
    p = F.transform(tokens(c("arg"), ","), leading_integer)
    legacy, ranged = c("command") == "jtls", c("command") == "til"
    span = F.split(F.substring_index("arg", ",", -1), "-")
    first = F.when(legacy, F.get(p, F.lit(2))).when(ranged, leading_integer(F.get(span, F.lit(0)))).otherwise(F.get(p, F.lit(1)))
    last = F.when(ranged & (F.size(span) > 1), leading_integer(F.get(span, F.lit(1))))
    return rows.withColumns(
        {
            "format": names[c("command")],
            "h_seq": F.when(legacy, F.get(p, F.lit(0))).otherwise(0),
            "v_seq": F.when(legacy, F.get(p, F.lit(3))).otherwise(90),
            "level": F.when(legacy, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0))),
            "start_tile": first,
            "end_tile": F.greatest(F.coalesce(last, first), first),
        }
    )


def tile_code(bpc: Column) -> Column:
    """Compression code of tile ranges: 2 for 8 bit, 3 for 16 bit."""
    return F.when(bpc > 8, 3).otherwise(2)


def iiif_log(log: DataFrame, uri: str = "uri", delimiter: str = ";") -> DataFrame:
    """identifier, page, is_info, region, size, rotation, quality, error of IIIF addresses."""
    s = F.split(url_decode(c(uri)), "/")
    n = F.size(s)
    rows = log.withColumns({"_s": s, "_n": n})
    info = F.element_at("_s", -1).startswith("info")
    enough = info | (c("_n") >= 5)
    name = F.array_join(F.slice("_s", F.lit(1), F.greatest(F.when(info, c("_n") - 1).otherwise(c("_n") - 4), F.lit(0))), "/")
    paged = name.contains(delimiter)
    take = lambda k: F.when(~info & enough, F.try_element_at(c("_s"), F.lit(-k)))
    return rows.withColumns(
        {
            "identifier": F.when(enough, F.when(paged, F.regexp_extract(name, f"^(.*){delimiter}[^{delimiter}]*$", 1)).otherwise(name)),
            "page": F.when(enough & paged, leading_integer(F.substring_index(name, delimiter, -1))),
            "is_info": info,
            "region": take(4),
            "size": take(3),
            "rotation": take(2),
            "quality": take(1),
            "error": F.when(~enough, "not enough parameters"),
        }
    ).drop("_s", "_n")


def uri_map(log: DataFrame, mappings: DataFrame, uri: str = "uri") -> DataFrame:
    """Rewrite addresses by a (prefix, protocol) table; the longest fitting prefix counts.

    Each distinct address is cut at the lengths that prefixes have, and its candidates meet the table by equality,
    so neither table has a limit.
    """
    known = F.create_map(*[F.lit(x) for x in ("iip", "fif", "iiif", "iiif", "zoomify", "zoomify", "deepzoom", "deepzoom")])
    table = mappings.select("prefix", F.get(F.array(known[F.lower("protocol")]), F.lit(0)).alias("_verb")).where("prefix IS NOT NULL AND _verb IS NOT NULL")
    table = table.groupBy("prefix").agg(F.max("_verb").alias("_verb"))
    # one row: the lengths, no more than the longest prefix has characters
    lengths = table.agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    asked = log.select(c(uri).alias("_uri")).where(c("_uri").startswith("/")).distinct().join(F.broadcast(lengths))
    fitting = F.filter("_lengths", lambda n: n < F.length("_uri"))
    cut = asked.select("_uri", F.explode(F.transform(fitting, lambda n: F.substring(c("_uri"), F.lit(2), n))).alias("prefix"))
    best = cut.join(table, "prefix").groupBy("_uri").agg(F.max(F.struct(F.length("prefix").alias("n"), "_verb")).alias("_best"))
    bare = F.substring_index(uri, "?", 1)
    start = c("_best.n") + F.when(c("_best.n") > 0, 2).otherwise(1)
    mapped = F.concat(c("_best._verb"), F.lit("="), F.substring(bare, start + 1, F.length(bare)))
    joined = log.join(best, c(uri) == c("_uri"), "left").withColumn("request", F.coalesce(mapped, c(uri)))
    return joined.drop("_uri", "_best")


def command_counts(commands: DataFrame, ts: str = "ts", period: str = "1 hour") -> DataFrame:
    """Commands and unsupported commands per period."""
    return commands.groupBy(F.window(ts, period)["start"].alias("period"), "command").agg(
        F.count("*").alias("n"), F.sum(F.when(c("known"), 0).otherwise(1)).alias("errors")
    )


def tile_demand(cells: DataFrame, top: int | None = None) -> DataFrame:
    """Requests per covered tile; counts combine before the shuffle.  ``top`` makes it a report."""
    counts = cells.groupBy("image_id", "level", "tile").agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "image_id", "level", "tile").limit(top)
