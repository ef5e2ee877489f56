"""Per-pixel transforms.  Names ending in ``_pixels`` use Column expressions on pixel rows, the others
tile blocks; both are held to the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import color as C
from tessella.functions import constants as K
from tessella.functions.pixelops import light_vector
from tessella.operators import color as O
from tessella.suite.registry import query
from tessella.suite.statistics import pixels_of

_ID = ["image_id", "y", "x"]
_UNIT = "unit AS (SELECT image_id, y, x, c, v / 255.0::double AS v FROM vec8)"


def _r6(v):
    return F.round(v, 6) + F.lit(0.0)


def _units(spark, sf, kind="grey") -> DataFrame:
    """Tiles mapped from 0..255 to 0..1."""
    return O.normalize(fx.vector_tiles(spark, sf, kind).withColumns({"lo": F.lit(0.0), "hi": F.lit(255.0)}))


def _unit_pixels(spark, sf) -> DataFrame:
    return fx.vector_pixels(spark, sf, "grey").withColumn("v", F.col("v") / 255.0)


def _sample_pair(name: str, sql: str, tile_fn, pixel_fn, integer: bool = False):
    """Register both forms of a sample-wise transform of values in 0..1."""
    outer = f"WITH {_UNIT} SELECT image_id, y, x, c, {sql} AS v FROM unit"

    @query(name, outer)
    def _(spark, sf):
        return pixels_of(tile_fn(_units(spark, sf)), digits=None if integer else 6)

    @query(f"{name}_pixels", outer)
    def _(spark, sf):
        v = pixel_fn(F.col("v"))
        return _unit_pixels(spark, sf).select(*_ID, "c", (v if integer else _r6(v)).alias("v"))


_sample_pair("gamma", "round(pow(greatest(v, 0), 2.2::double), 6)", lambda t: O.gamma(t, 2.2), lambda v: C.gamma(v, 2.2))
_sample_pair("log_transform", "round(ln(1 + 255 * v) / ln(256.0::double), 6)", O.log_transform, C.log_transform)
_sample_pair("invert", "round(1 - v, 6)", O.invert, C.invert)
_sample_pair(
    "contrast",
    "floor(least(greatest(v * (255 * 1.7::double), 0), 255))::int",
    lambda t: O.contrast(t, 1.7),
    lambda v: C.contrast(v, 1.7),
    integer=True,
)


# Range of the data, per image, applied to float samples.
_NORM = """WITH r AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM vec GROUP BY ALL)
    SELECT image_id, y, x, c, round((v - lo) * (1 / (hi - lo)), 6) + 0.0 AS v FROM vec JOIN r USING (image_id)"""


@query("normalize", _NORM)
def _(spark, sf):
    from tessella.operators import stats
    from tessella.session import join_side_table

    tiles = fx.vector_tiles(spark, sf)
    ranges = stats.range_arrays(stats.data_range(tiles))
    return pixels_of(O.normalize(join_side_table(tiles, ranges, ["image_id"], "inner", spread_by=["tx", "ty"])), digits=6)


@query("normalize_pixels", _NORM)
def _(spark, sf):
    from tessella.session import join_side_table

    pixels = fx.vector_pixels(spark, sf)
    ranges = pixels.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    joined = join_side_table(pixels, ranges, ["image_id"], "inner", spread_by=["x", "y"])
    return joined.select(*_ID, "c", _r6(C.normalize(F.col("v"), F.col("lo"), F.col("hi"), floating=True)).alias("v"))


_SCALE = "SELECT image_id, y, x, c, v >> 8 AS v FROM ord"


@query("scale_to_8bit", _SCALE)
def _(spark, sf):
    return pixels_of(O.scale_to_8bit(fx.order_tiles(spark, sf)), fx.ORDERS_TILE)


@query("scale_to_8bit_pixels", "SELECT 0::bigint AS image_id, (o_orderkey // 128)::int AS y, (o_orderkey % 128)::int AS x, 0 AS c, ((floor(o_totalprice * 100)::bigint % 65536) >> 8)::int AS v FROM orders")
def _(spark, sf):
    return fx.order_pixels(spark, sf).select(*_ID, "c", C.scale_to_8bit(F.col("v"), 16).alias("v"))


# --- three-channel transforms ---------------------------------------------------------------------


def _wide(spark, sf) -> DataFrame:
    """One row per pixel with columns r, g, b; the row of a vector is cut as an array, without a shuffle."""
    padded = F.concat("embedding", F.expr("array(float(-1), float(-1))"))
    rows = fx.table(spark, sf, "embeddings").select(
        F.expr(f"vec_id div {fx.VECTOR_ROWS}").alias("image_id"),
        (F.col("vec_id") % fx.VECTOR_ROWS).cast("int").alias("y"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(21)), lambda t: F.slice(padded, t * 3 + 1, 3))
        ).alias("x", "p"),
    )
    grey = lambda i: F.floor((F.col("p")[i].cast("double") + 1) * 127.5).cast("int")
    return rows.select(*_ID, grey(0).alias("r"), grey(1).alias("g"), grey(2).alias("b"))


def _three(df: DataFrame, channels, integer: bool = False) -> DataFrame:
    """Channel columns to rows (c, v)."""
    values = F.array(*[(c if integer else _r6(c)) for c in channels])
    return df.select(*_ID, F.posexplode(values).alias("c", "v"))


def _unpivot(relation: str, *parts: str, integer: bool = False) -> str:
    wrap = (lambda p: p) if integer else (lambda p: f"round({p}, 6) + 0.0")
    return " UNION ALL ".join(f"SELECT image_id, y, x, {i} AS c, {wrap(p)} AS v FROM {relation}" for i, p in enumerate(parts))


_GREY = "SELECT image_id, y, x, 0 AS c, ((1254097 * r + 2462056 * g + 478151 * b) >> 22)::int AS v FROM rgbw"


@query("greyscale", _GREY)
def _(spark, sf):
    return pixels_of(O.greyscale(fx.vector_tiles(spark, sf, "rgb")))


@query("greyscale_pixels", _GREY)
def _(spark, sf):
    return _wide(spark, sf).select(*_ID, F.lit(0).alias("c"), C.greyscale(F.col("r"), F.col("g"), F.col("b")).alias("v"))


_FLAT = "SELECT image_id, y, x, c, v FROM rgb WHERE c < 1"


@query("flatten", _FLAT)
def _(spark, sf):
    return pixels_of(O.flatten(fx.vector_tiles(spark, sf, "rgb"), 1))


@query("flatten_pixels", _FLAT)
def _(spark, sf):
    return fx.vector_pixels(spark, sf, "rgb").where("c < 1").select(*_ID, "c", "v")


_TRI = "SELECT image_id, y, x, c.c, v FROM (SELECT image_id, y, x, v FROM vec8), (SELECT unnest([0, 1, 2]) AS c) c"


@query("triplicate", _TRI)
def _(spark, sf):
    return pixels_of(O.triplicate(fx.vector_tiles(spark, sf, "grey")))


@query("triplicate_pixels", _TRI)
def _(spark, sf):
    return fx.vector_pixels(spark, sf, "grey").select(*_ID, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"), "v")


_MATRIX = [[0.393, 0.769, 0.189], [0.349, 0.0, 1.0], [0.272, 0.534], [0.0, 0.0, 0.0, 5.0]]
_TWIST = _unpivot(
    "(SELECT image_id, y, x, r / 255.0::double AS r, g / 255.0::double AS g, b / 255.0::double AS b FROM rgbw)",
    "0.393::double * r + 0.769::double * g + 0.189::double * b",
    "0.349::double * r + b",
    "0.272::double * r + 0.534::double * g",
    "0 * r",
)


@query("twist", _TWIST)
def _(spark, sf):
    return pixels_of(O.twist(_units(spark, sf, "rgb"), _MATRIX), digits=6)


@query("twist_pixels", _TWIST)
def _(spark, sf):
    channels = [F.col(c) / 255.0 for c in "rgb"]
    return _three(_wide(spark, sf), C.twist(channels, _MATRIX))


_LX, _LY, _LZ = light_vector(230, 35)
_SHADE = f"""SELECT image_id, y, x, 0 AS c, round(CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0 ELSE least(greatest(0.5::double *
    ((1 - 2 * (r / 255.0::double)) * {_LX!r}::double + (1 - 2 * (g / 255.0::double)) * {_LY!r}::double
     + (1 - 2 * (b / 255.0::double)) * {_LZ!r}::double), 0), 1) END, 6) + 0.0 AS v FROM rgbw"""


@query("hillshade", _SHADE)
def _(spark, sf):
    return pixels_of(O.hillshade(_units(spark, sf, "rgb"), 230, 35), digits=6)


@query("hillshade_pixels", _SHADE)
def _(spark, sf):
    shade = C.hillshade(*[F.col(c) / 255.0 for c in "rgb"], 230, 35)
    return _wide(spark, sf).select(*_ID, F.lit(0).alias("c"), _r6(shade).alias("v"))


def _colormap_sql(name: str) -> str:
    value = "unit"
    if name == "HOT":
        parts = ["least(greatest(3 * v, 0), 1)", "least(greatest(3 * v - 1, 0), 1)", "least(greatest(3 * v - 2, 0), 1)"]
    elif name == "COLD":
        parts = ["least(greatest(3 * v - 2, 0), 1)", "least(greatest(3 * v - 1, 0), 1)", "least(greatest(3 * v, 0), 1)"]
    elif name == "JET":
        parts = [
            "CASE WHEN v < 0.375 THEN 0 WHEN v < 0.625 THEN 4 * v - 1.5 WHEN v < 0.875 THEN 1 WHEN v < 1 THEN 4.5 - 4 * v ELSE 0.5 END",
            "CASE WHEN v < 0.125 THEN 0 WHEN v < 0.375 THEN 4 * v - 0.5 WHEN v < 0.625 THEN 1 WHEN v < 0.875 THEN 3.5 - 4 * v ELSE 0 END",
            "CASE WHEN v < 0.125 THEN 4 * v + 0.5 WHEN v < 0.375 THEN 1 WHEN v < 0.625 THEN 2.5 - 4 * v ELSE 0 END",
        ]
    else:
        parts = ["v" if n == name else "0 * v" for n in ("RED", "GREEN", "BLUE")]
    return f"WITH {_UNIT} " + _unpivot(value, *parts)


for _name in K.COLORMAPS:

    @query(f"colormap_{_name.lower()}", _colormap_sql(_name))
    def _(spark, sf, name=_name):
        return pixels_of(O.colormap(_units(spark, sf), name), digits=6)

    @query(f"colormap_{_name.lower()}_pixels", _colormap_sql(_name))
    def _(spark, sf, name=_name):
        return _three(_unit_pixels(spark, sf), C.colormap(F.col("v"), name))


def _lab_sql(light: str, a: str, b: str, relation: str) -> str:
    rows = []
    for mx, my, mz in K.XYZ_TO_RGB:
        rows.append(f"greatest(xx * {mx!r}::double + yy * {my!r}::double + zz * {mz!r}::double, 0)")
    cube = lambda t: f"CASE WHEN {t} < 0.2069 THEN ({t} - 0.13793) / 7.787 ELSE pow({t}, 3) END"
    curve = lambda t: f"least(CASE WHEN {t} <= 0.0031308 THEN {t} * 12.92 ELSE 1.055 * pow({t}, 1.0::double / 2.4) - 0.055 END, 1)"
    return f"""WITH lab AS (SELECT image_id, y, x, {light} AS ll, {a} AS aa, {b} AS bb FROM {relation}),
      f AS (SELECT *, CASE WHEN ll < 8 THEN 7.787::double * (ll / 903.3::double) + 16.0::double / 116 ELSE (ll + 16) / 116.0::double END AS fy FROM lab),
      g AS (SELECT *, aa / 500.0::double + fy AS fx, fy - bb / 200.0::double AS fz FROM f),
      xyz AS (SELECT image_id, y, x, 95.0470::double * ({cube('fx')}) / 100 AS xx,
        CASE WHEN ll < 8 THEN ll * 100.0::double / 903.3::double ELSE 100.0::double * pow(fy, 3) END / 100 AS yy,
        108.8827::double * ({cube('fz')}) / 100 AS zz FROM g),
      lin AS (SELECT image_id, y, x, {rows[0]} AS r, {rows[1]} AS g, {rows[2]} AS b FROM xyz)
      {_unpivot('lin', curve('r'), curve('g'), curve('b'))}"""


_LAB8 = _lab_sql(
    "r / 2.55::double", "(CASE WHEN g > 127 THEN g - 256 ELSE g END)::double", "(CASE WHEN b > 127 THEN b - 256 ELSE b END)::double", "rgbw"
)


@query("lab_to_srgb", _LAB8)
def _(spark, sf):
    return pixels_of(O.lab_to_srgb(fx.vector_tiles(spark, sf, "rgb")), digits=6)


@query("lab_to_srgb_pixels", _LAB8)
def _(spark, sf):
    lab = C.lab_unpack(F.col("r"), F.col("g"), F.col("b"), 8)
    return _three(_wide(spark, sf), C.lab_to_srgb(*lab))


_UNPACK = "SELECT image_id, y, x, 0 AS c, round(r / 2.55::double, 6) AS v FROM rgbw UNION ALL SELECT image_id, y, x, 1, CASE WHEN g > 127 THEN g - 256 ELSE g END FROM rgbw UNION ALL SELECT image_id, y, x, 2, CASE WHEN b > 127 THEN b - 256 ELSE b END FROM rgbw"


@query("lab_unpack", _UNPACK)
def _(spark, sf):
    from tessella.functions import pixelops

    return pixels_of(O.apply(fx.vector_tiles(spark, sf, "rgb"), pixelops.lab_unpack), digits=6)


@query("lab_unpack_pixels", _UNPACK)
def _(spark, sf):
    return _three(_wide(spark, sf), C.lab_unpack(F.col("r"), F.col("g"), F.col("b"), 8))


def _to_lab_sql() -> str:
    unit = lambda c: f"(CASE WHEN {c} / 255.0::double <= 0.04045 THEN {c} / 255.0::double / 12.92 ELSE pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) END)"
    f = lambda t: f"CASE WHEN {t} > 0.008856452 THEN pow({t}, 1.0::double / 3) ELSE 7.787037037::double * {t} + 0.137931034 END"
    axes = []
    for (mr, mg, mb), white in zip(K.RGB_TO_XYZ, (K.D65_X, K.D65_Y, K.D65_Z)):
        axes.append(f"100 * (r * {mr!r}::double + g * {mg!r}::double + b * {mb!r}::double) / {white!r}::double")
    return f"""WITH lin AS (SELECT image_id, y, x, {unit('r')} AS r, {unit('g')} AS g, {unit('b')} AS b FROM rgbw),
      xyz AS (SELECT image_id, y, x, {axes[0]} AS xx, {axes[1]} AS yy, {axes[2]} AS zz FROM lin),
      f AS (SELECT image_id, y, x, {f('xx')} AS fx, {f('yy')} AS fy, {f('zz')} AS fz FROM xyz)
      {_unpivot('f', '116 * fy - 16', '500 * (fx - fy)', '200 * (fy - fz)')}"""


@query("srgb_to_lab", _to_lab_sql())
def _(spark, sf):
    return pixels_of(O.srgb_to_lab(_units(spark, sf, "rgb")), digits=6)


@query("srgb_to_lab_pixels", _to_lab_sql())
def _(spark, sf):
    return _three(_wide(spark, sf), C.srgb_to_lab(*[F.col(c) / 255.0 for c in "rgb"]))


@query("unpack_samples", """SELECT bits, inverted, min(w) AS lo, max(w) AS hi, sum(w)::bigint AS total, count(*) AS n FROM (
      SELECT bits, inverted, CASE WHEN inverted THEN (CASE WHEN bits < 8 THEN 255 ELSE 65535 END) - w ELSE w END AS w FROM (
        SELECT bits, inverted, CASE bits WHEN 1 THEN s * 255 WHEN 2 THEN s * 85 ELSE
          (s << ((CASE WHEN bits < 8 THEN 8 ELSE 16 END) - bits)) | (s >> (2 * bits - (CASE WHEN bits < 8 THEN 8 ELSE 16 END))) END AS w
        FROM (SELECT bits, inverted, (v % (1 << bits))::int AS s FROM ord, (SELECT unnest([1, 2, 4, 6, 10, 12, 14]) AS bits), (SELECT unnest([false, true]) AS inverted))))
    GROUP BY ALL""")
def _(spark, sf):
    """Packed tiles of every depth, made from the order image, widened and summed, all in one pass over the table."""
    import numpy as np

    from tessella.operators.tiles import map_blocks, tiles_to_pixels

    depths = F.explode(F.array(*[F.lit(b) for b in (1, 2, 4, 6, 10, 12, 14)]))

    def pack(block, row):
        flags = (block.reshape(block.shape[0], -1, 1) >> np.arange(row["bits"] - 1, -1, -1, dtype=np.uint16)) & 1
        return np.packbits(flags.reshape(block.shape[0], -1).astype(np.uint8), axis=1)[..., None]

    packed = map_blocks(fx.order_tiles(spark, sf).withColumn("bits", depths), pack, using=("bits",))
    packed = packed.withColumns({"bpc": F.col("bits"), "width": F.least(F.lit(32), F.lit(128) - F.col("tx") * 32)})
    both = packed.withColumn("inverted", F.explode(F.array(F.lit(False), F.lit(True))))
    wide = tiles_to_pixels(O.unpack_samples(both, F.col("inverted")), 32, 32, keys=("bits", "inverted"))
    v = F.col("v").cast("long")
    return wide.groupBy("bits", "inverted").agg(F.min(v).cast("int").alias("lo"), F.max(v).cast("int").alias("hi"), F.sum(v).alias("total"), F.count("*").alias("n"))


@query("unpack_samples_pixels", """SELECT image_id, y, x, c, ((v % 64) << 2) | ((v % 64) >> 4) AS six, 65535 - (((v % 4096) << 4) | ((v % 4096) >> 8)) AS twelve
    FROM (SELECT 0::bigint AS image_id, (o_orderkey // 128)::int AS y, (o_orderkey % 128)::int AS x, 0 AS c, (floor(o_totalprice * 100)::bigint % 65536)::int AS v FROM orders)""")
def _(spark, sf):
    v = F.col("v")
    return fx.order_pixels(spark, sf).select(
        *_ID, "c", C.unpack_sample(v % 64, 6).alias("six"), C.unpack_sample(v % 4096, 12, min_is_white=True).alias("twelve")
    )


@query("default_range", """SELECT image_id, CASE WHEN bpc = 32 AND sample_type = 'FIXEDPOINT' THEN 4294967295.0::double WHEN bpc = 32 THEN 1 WHEN bpc = 12 THEN 4095 WHEN bpc > 8 THEN 65535 ELSE 255 END AS hi, 0.0::double AS lo FROM img""")
def _(spark, sf):
    images = fx.catalogue(spark, sf)
    return images.select("image_id", O.default_range(F.col("bpc"), F.col("sample_type")).alias("hi"), F.lit(0.0).alias("lo"))


@query("apply_minmax", """SELECT image_id, c, CASE WHEN image_id % 4 = 0 OR image_id % 4 = c + 1 THEN 10.0::double ELSE 0 END AS lo,
      CASE WHEN image_id % 4 = 0 OR image_id % 4 = c + 1 THEN 200.0::double ELSE 255 END AS hi
    FROM (SELECT image_id, unnest(range(0, channels))::int AS c FROM img)""")
def _(spark, sf):
    """Every image with an override for all channels ('-') or for one that may not exist."""
    images = fx.catalogue(spark, sf)
    channel = F.when(F.col("image_id") % 4 == 0, "-").otherwise((F.col("image_id") % 4 - 1).cast("string"))
    lo, hi = O.apply_minmax(
        F.array_repeat(F.lit(0.0), F.col("channels")), F.array_repeat(F.lit(255.0), F.col("channels")), channel, F.lit(10.0), F.lit(200.0)
    )
    pairs = images.select("image_id", F.posexplode(F.arrays_zip(lo.alias("lo"), hi.alias("hi"))).alias("c", "p"))
    return pairs.select("image_id", "c", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))


@query("sql_functions", f"""WITH {_UNIT} SELECT image_id, y, x, round(pow(greatest(v, 0), 2.2::double), 6) AS gamma, round(1 - v, 6) AS inverted,
    floor(least(greatest(v * 255 * 1.3::double, 0), 255))::int AS contrast, y // 16 * 4 + x // 16 AS tile FROM unit""")
def _(spark, sf):
    """The same through registered SQL functions."""
    from tessella.functions.registry import register_functions

    register_functions(spark)
    return _unit_pixels(spark, sf).select(
        *_ID,
        F.expr("round(tile_gamma(v, 2.2D), 6)").alias("gamma"),
        F.expr("round(tile_invert(v), 6)").alias("inverted"),
        F.expr("tile_contrast(v, 1.3D)").alias("contrast"),
        F.expr("tile_number(x, y, 16, 16, 4)").alias("tile"),
    )


@query("tile_cover_function", """SELECT image_id, tx, ty, (ty * 4 + tx)::int AS tile FROM (SELECT image_id, tx, unnest(range(image_id % 7 * 5 // 16, (least(image_id % 7 * 5 + 20, h) + 15) // 16))::int AS ty
    FROM (SELECT image_id, h, unnest(range(image_id % 9 * 4 // 16, (least(image_id % 9 * 4 + 30, 64) + 15) // 16))::int AS tx FROM vec_size))""")
def _(spark, sf):
    from tessella.functions.registry import register_functions

    register_functions(spark)
    fx.vector_heights(spark, sf).createOrReplaceTempView("tessella_heights")
    return spark.sql(
        """SELECT image_id, t.tx, t.ty, t.tile FROM tessella_heights,
           LATERAL tile_cover(64, img_h, 16, 16, cast(image_id % 9 * 4 AS int), cast(image_id % 7 * 5 AS int), 30, 20) AS t"""
    )
