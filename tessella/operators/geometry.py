"""View geometry: Column functions over one request joined to its image header.

An image carries its pyramid as a short array (at most 32 entries), so the level of a request is
chosen inside the row: no explode, no window and no shuffle beyond the join with the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.constants import MAX_SIZE
from tessella.functions.kernels import leading_integer, leading_number, matched_number

# Smallest float32 step above 1; keeps floor() from falling short of a whole number.
EPSILON = 1.1920929e-07


def int_(v: Column) -> Column:
    return v.cast("int")


def bit_length(n: Column) -> Column:
    """Binary digits of a whole number: the count of halvings until it is 0."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def pyramid(width: Column, height: Column, tile_w: Column, tile_h: Column, rule: str = "floor") -> Column:
    """Levels from full size (native 0) down to one tile; ``floor`` or ``ceil`` halving."""

    def size(full: Column, k: Column) -> Column:
        whole = full if rule == "floor" else -full
        shifted = F.call_function("shiftright", whole, k)
        return shifted if rule == "floor" else -shifted

    def halvings(full: Column, tile: Column) -> Column:
        whole, part = (full, tile + 1) if rule == "floor" else (full - 1, tile)
        return bit_length(F.floor(whole / part))

    last = F.greatest(halvings(width, tile_w), halvings(height, tile_h))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(
            (last - k).alias("level"),
            k.alias("native_level"),
            size(width, k).alias("width"),
            size(height, k).alias("height"),
            tile_w.cast("int").alias("tile_w"),
            tile_h.cast("int").alias("tile_h"),
            int_(F.ceil(size(width, k) / tile_w)).alias("ntx"),
            int_(F.ceil(size(height, k) / tile_h)).alias("nty"),
        ),
    )


def with_pyramid(images: DataFrame, tile_w: int = 256, tile_h: int = 256, rule: str = "floor") -> DataFrame:
    return images.withColumn("levels", pyramid(F.col("width"), F.col("height"), F.lit(tile_w), F.lit(tile_h), rule))


def level_geometry(images: DataFrame) -> DataFrame:
    """``levels`` table of images that carry a pyramid."""
    return images.select("image_id", F.inline("levels"))


def clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def clamp_region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Viewport struct in 0..1; an incomplete or empty region means the whole image."""
    good = x.isNotNull() & y.isNotNull() & (w > 0) & (h > 0)
    parts = [F.when(good, clip01(v)).otherwise(d).alias(n) for v, d, n in ((x, 0.0, "x"), (y, 0.0, "y"), (w, 1.0, "w"), (h, 1.0, "h"))]
    return F.struct(*parts)


def viewport_set(view: Column) -> Column:
    return (view["w"] < 1) | (view["h"] < 1) | (view["x"] > 0) | (view["y"] > 0)


def with_request_size(df: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """Output size size_w, size_h of rows with wid, hei, view_*, width, height, maintain_aspect.

    Missing sides are filled in by aspect, both together are the full size, two sides with the aspect
    kept are a box to fit in, and the limit is applied last.
    """
    c = F.col
    wid, hei, ratio = c("wid"), c("hei"), c("_ratio")
    step = df.withColumns({"_vw": c("view_w") * c("width"), "_vh": c("view_h") * c("height")})
    step = step.withColumns({"_ratio": c("_vw") / c("_vh"), "_fit_h": (wid / c("_vw")) > (hei / c("_vh"))})
    both = (wid != 0) & (hei != 0) & c("maintain_aspect")
    step = step.withColumns(
        {
            "_w": F.when((wid == 0) & (hei != 0), F.round(hei * ratio))
            .when((wid == 0) & (hei == 0), c("width"))
            .when(both & c("_fit_h"), F.round(hei * ratio))
            .otherwise(wid),
            "_h": F.when((hei == 0) & (wid != 0), F.round(wid / ratio))
            .when((wid == 0) & (hei == 0), c("height"))
            .when(both & ~c("_fit_h"), F.round(wid / ratio))
            .otherwise(hei),
        }
    )
    w, h = c("_w"), c("_h")
    if max_size > 0:
        over = (w > max_size) | (h > max_size)
        w, h = (
            F.when(over & (w >= h), max_size).when(over, F.round(max_size * ratio)).otherwise(w),
            F.when(over & (h >= w), max_size).when(over, F.round(max_size / ratio)).otherwise(h),
        )
    return step.withColumns({"size_w": int_(w), "size_h": int_(h)}).drop("_vw", "_vh", "_ratio", "_fit_h", "_w", "_h")


def choose_level(levels: Column, wid: Column, hei: Column, size: Column, view: Column, width: Column, height: Column) -> Column:
    """Native index of the smallest level that serves the request; 0 when none does."""

    def scaled(full: Column, part: Column, level_size: Column, native: Column) -> Column:
        return F.when(part == 1, level_size).otherwise(F.floor(full * part / F.pow(F.lit(2.0), native) + EPSILON))

    def serves(lv: Column) -> Column:
        sw = scaled(width, view["w"], lv["width"], lv["native_level"])
        sh = scaled(height, view["h"], lv["height"], lv["native_level"])
        return (
            (sw <= lv["width"] + 1)
            & (sh <= lv["height"] + 1)
            & ((wid == 0) | (sw >= size["w"]))
            & ((hei == 0) | (sh >= size["h"]))
        )

    good = F.filter(levels, serves)
    return F.coalesce(F.array_max(F.transform(good, lambda lv: lv["native_level"])), F.lit(0))


def view_scale(wid: Column, hei: Column, level_w: Column, level_h: Column) -> Column:
    """How far the request shrinks the level, at most 1."""
    lw, lh = F.greatest(level_w, F.lit(1)), F.greatest(level_h, F.lit(1))  # thin images have empty levels
    rw = F.when((wid == 0) & (hei > 0), F.floor(lw * hei / lh)).otherwise(wid)
    rh = F.when((hei == 0) & (wid > 0), F.floor(lh * wid / lw)).otherwise(hei)
    scale = F.least(rw / lw, rh / lh)
    return F.when((scale <= 0) | (scale > 1), 1.0).otherwise(scale)


def limit_level(level: Column, level_w: Column, level_h: Column, view: Column, scale: Column, max_size: int = MAX_SIZE) -> Column:
    """Step to smaller levels (0 is the smallest) until the output fits ``max_size``."""
    dimension = F.floor(F.greatest(level_w * view["w"], level_h * view["h"]) * scale)
    halvings = bit_length(F.floor(dimension / (max_size + 1)))
    return F.greatest(level - halvings, F.lit(0))


def view_pixels(view: Column, native: Column, width: Column, height: Column, level_w: Column, level_h: Column, min_size: int = 1) -> Column:
    """Viewport in pixels of the level: (left, top, width, height), cut at the border."""
    factor = F.pow(F.lit(2.0), native)

    def axis(full: Column, start: Column, part: Column, limit: Column) -> tuple[Column, Column]:
        left = F.least(F.round(full * start / factor), limit)
        size = F.round(part * (full / factor))
        cut = F.when(size + left > limit, limit - left).otherwise(size)
        return int_(left), int_(F.greatest(cut, F.lit(min_size)))

    left, w = axis(width, view["x"], view["w"], level_w)
    top, h = axis(height, view["y"], view["h"], level_h)
    return F.struct(left.alias("left"), top.alias("top"), w.alias("width"), h.alias("height"))


def prevent_upscaling(size: Column, level_w: Column, level_h: Column, allow: Column, min_size: int = 1) -> Column:
    def side(v: Column, limit: Column) -> Column:
        out = F.when(allow, v).otherwise(F.least(v, limit))
        return int_(F.when(out == 0, min_size).otherwise(out))

    return F.struct(side(size["w"], level_w).alias("w"), side(size["h"], level_h).alias("h"))


def is_pure_tile(pixels: Column, wid: Column, hei: Column, width: Column, height: Column, level: Column) -> Column:
    """The request is exactly one tile of the level (edge tiles included)."""

    def side(start: Column, full: Column, size: Column, tile: Column) -> Column:
        return F.when((full % tile > 0) & (start == size - size % tile), size % tile).otherwise(tile)

    tw, th = level["tile_w"], level["tile_h"]
    vw = side(pixels["left"], width, level["width"], tw)
    vh = side(pixels["top"], height, level["height"], th)
    return (
        (pixels["left"] % tw == 0)
        & (pixels["top"] % th == 0)
        & (wid == vw)
        & (hei == vh)
        & (pixels["width"] == vw)
        & (pixels["height"] == vh)
    )


def fields(name: str, keys: str) -> dict[str, Column]:
    """Flat columns ``<name>_<key>`` as a mapping, usable where a struct column is."""
    return {k: F.col(f"{name}_{k}") for k in keys.split()}


def spread(df: DataFrame, name: str, struct: Column, keys: str) -> DataFrame:
    """Add the fields of a struct expression as flat columns ``<name>_<key>``."""
    return df.withColumns({f"{name}_{k}": struct[k] for k in keys.split()})


def plan_views(requests: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """Level, pixel window and output size of requests joined to images with ``levels``.

    Needs wid, hei, rx, ry, rw, rh, maintain_aspect, allow_upscaling, width, height, levels.
    Adds view_*, size_*, lv_* (the level), pixels_* and out_* as flat columns.  They are flat, not
    structs, so that every step is computed once and not again for each use of one of its fields.
    """
    c = F.col
    view, size = fields("view", "x y w h"), fields("size", "w h")
    planned = spread(requests, "view", clamp_region(c("rx"), c("ry"), c("rw"), c("rh")), "x y w h")
    planned = with_request_size(planned, max_size).withColumn(
        "first_native", choose_level(c("levels"), c("wid"), c("hei"), size, view, c("width"), c("height"))
    )
    first = F.get("levels", c("first_native"))
    planned = planned.withColumns({f"first_{k}": first[k] for k in ("level", "width", "height")})
    scale = view_scale(c("wid"), c("hei"), c("first_width"), c("first_height"))
    planned = planned.withColumn(
        "_level", limit_level(c("first_level"), c("first_width"), c("first_height"), view, scale, max_size)
    )
    keys = "level native_level width height tile_w tile_h ntx nty"
    planned = spread(planned, "lv", F.get("levels", F.size("levels") - 1 - c("_level")), keys)
    pixels = view_pixels(view, c("lv_native_level"), c("width"), c("height"), c("lv_width"), c("lv_height"))
    planned = spread(planned, "pixels", pixels, "left top width height")
    out = prevent_upscaling(size, c("lv_width"), c("lv_height"), c("allow_upscaling"))
    return spread(planned, "out", out, "w h").drop("_level", "first_level", "first_width", "first_height")


# --- pipeline predicates --------------------------------------------------------------------------


def needs_float(contrast: Column, gamma: Column, *flags: Column) -> Column:
    """The floating-point stage is needed: contrast or gamma set, or any of the given flags."""
    out = (contrast != 1.0) | (gamma != 1.0)
    for flag in flags:
        out = out | flag
    return out


def needs_histogram(equalize: Column, colorspace: Column, contrast: Column) -> Column:
    return equalize | (colorspace == "BINARY") | (contrast == -1)


def needs_raw(bpc: Column, channels: Column, image_space: Column, wanted_space: Column, floating: Column, equalize: Column, rot: Column, flip: Column, watermark: Column) -> Column:
    """Raw samples are needed, so an encoded tile cannot be passed on as it is."""
    recolor = wanted_space.isin("GREYSCALE", "BINARY") & (channels == 3) & (bpc == 8)
    return (
        (bpc > 8) | (image_space == "CIELAB") | (channels == 2) | (channels > 3) | recolor
        | floating | equalize | (rot != 0) | (flip != 0) | watermark
    )


# --- request grammars as columns ------------------------------------------------------------------


def with_iiif_region(df: DataFrame, text: str = "region", width: str = "width", height: str = "height") -> DataFrame:
    """Parse region texts; adds region_x, region_y, region_w, region_h, region_error.

    Bad rows keep a reason instead of failing the job.  Steps are separate columns, so a part that
    several results need is computed once.
    """
    c = F.col
    t = F.lower(c(text))
    step = df.withColumns({"_t": t, "_pct": t.startswith("pct:")})
    step = step.withColumn("_p", F.filter(F.split(F.regexp_replace("_t", "^pct:", ""), ","), lambda p: p != ""))
    over = [F.when(c("_pct"), 100.0).otherwise(c(d)) for d in (width, height, width, height)]
    step = step.withColumns({f"_{k}": leading_number(F.get("_p", F.lit(i))) / over[i] for i, k in enumerate("xywh")})
    step = step.withColumns(
        {
            "_w": F.when(c("_x") + c("_w") > 1, 1 - c("_x")).otherwise(c("_w")),
            "_h": F.when(c("_y") + c("_h") > 1, 1 - c("_y")).otherwise(c("_h")),
            "_sw": F.when(c(width) > c(height), c(height) / c(width)).otherwise(1.0),
            "_sh": F.when(c(height) > c(width), c(width) / c(height)).otherwise(1.0),
        }
    )
    full, square = c("_t") == "full", c("_t") == "square"
    step = step.withColumn("_bad", (F.size("_p") != 4) | (c("_w") <= 0) | (c("_h") <= 0))

    def pick(a: float, b: Column, v: Column) -> Column:
        return F.when(full, a).when(square, b).when(~c("_bad"), clip01(v))

    found = {
        "region_x": pick(0.0, (1 - c("_sw")) / 2, c("_x")),
        "region_y": pick(0.0, (1 - c("_sh")) / 2, c("_y")),
        "region_w": pick(1.0, c("_sw"), c("_w")),
        "region_h": pick(1.0, c("_sh"), c("_h")),
        "region_error": F.when(~full & ~square & c("_bad"), "incorrect region"),
    }
    # out of an array of one struct: a filter on the results stays above, else the optimiser puts the whole parse, every step
    # repeated for each use, into the filter and into the condition of a join below
    return step.select(*[n for n in df.columns if n not in found], F.inline(F.array(F.struct(*[v.alias(k) for k, v in found.items()]))))


def with_iiif_size(df: DataFrame, text: str = "size", version: int = 3, max_size: int = MAX_SIZE) -> DataFrame:
    """Parse size texts of rows with region_* columns.

    Adds size_w, size_h, size_maintain_aspect, size_allow_upscaling, size_error.
    """
    c = F.col
    raw = F.lower(c(text))
    step = df.withColumns(
        {
            "_t": F.regexp_replace(raw, r"^\^", "") if version >= 3 else raw,
            "_up": raw.startswith("^") if version >= 3 else F.lit(True),
            "_rw": c("region_w") * c("width"),
            "_rh": c("region_h") * c("height"),
        }
    )
    step = step.withColumns({"_b": F.regexp_replace("_t", "^!", ""), "_ratio": c("_rw") / c("_rh")})
    step = step.withColumns(
        {
            "_pct": matched_number(c("_t"), r"^pct:\s*([+-]?\d*\.?\d+)"),
            "_head": matched_number(c("_b"), r"^(\d+)[^,]*,"),
            "_tail": matched_number(c("_b"), r"^[^,]*,(\d+)"),
        }
    )
    full, is_pct, bang = c("_t").isin("full", "max"), c("_t").startswith("pct:"), c("_t").startswith("!")
    only_h, only_w = c("_b").startswith(","), c("_b").endswith(",") & ~c("_b").startswith(",")
    fw, fh, ratio = F.floor("_rw"), F.floor("_rh"), c("_ratio")
    step = step.withColumns(
        {
            "_w": F.when(full, fw).when(is_pct, F.round(fw * c("_pct") / 100)).when(only_h, F.round(c("_tail") * ratio)).otherwise(c("_head")),
            "_h": F.when(full, fh).when(is_pct, F.round(fh * c("_pct") / 100)).when(only_w, F.round(c("_head") / ratio)).otherwise(c("_tail")),
            "size_maintain_aspect": full | is_pct | bang | only_h | only_w,
            "size_allow_upscaling": c("_up"),
        }
    )
    w, h, aspect = c("_w"), c("_h"), c("size_maintain_aspect")
    step = step.withColumns(
        {
            "size_error": F.when(~full & ~is_pct & ~c("_b").contains(","), "no comma found")
            .when(w.isNull() | h.isNull() | (w <= 0) | (h <= 0), "invalid size")
            .when(F.lit(version >= 3) & ~c("_up") & ((w > F.round("_rw")) | (h > F.round("_rh"))), "upscaling needs ^"),
            "_over": (w > max_size) | (h > max_size),
        }
    )
    over, good = c("_over"), c("size_error").isNull()
    lw = F.when(over & (ratio > 1), max_size).when(over & aspect, F.round(max_size * ratio)).when(over, max_size).otherwise(w)
    lh = F.when(over & (ratio <= 1), max_size).when(over & aspect, F.round(max_size / ratio)).when(over, max_size).otherwise(h)
    step = step.withColumns({"size_w": F.when(good, int_(lw)), "size_h": F.when(good, int_(lh))})
    return step.drop("_t", "_up", "_rw", "_rh", "_b", "_ratio", "_pct", "_head", "_tail", "_w", "_h", "_over")


def iiif_rotation(text: Column) -> Column:
    """Rotation text to (rot, flip, error); a mirrored half turn is a vertical flip."""
    mirror = text.startswith("!")
    angle = F.regexp_extract(F.regexp_replace(text, "^!", ""), r"^\s*([+-]?\d+\.?\d*|[+-]?\.\d+)", 1).try_cast("double")
    good = F.coalesce(angle.isin(0.0, 90.0, 180.0, 270.0, 360.0), F.lit(False))
    vertical = mirror & (angle == 180)
    return F.struct(
        F.when(good, F.when(vertical, 0).otherwise(int_(angle))).alias("rot"),
        F.when(good, F.when(vertical, 2).when(mirror, 1).otherwise(0)).alias("flip"),
        F.when(angle.isNull(), "invalid rotation").when(~good, "unsupported rotation").alias("error"),
    )


def iiif_quality_format(text: Column) -> Column:
    """Quality.format to (quality, format, colorspace, contrast, inverted, equalize, gamma, error)."""
    t = F.regexp_replace(F.lower(text), r"\?.*$", "")
    dotted = t.contains(".")
    ext = F.when(dotted, F.regexp_extract(t, r"\.([^.]*)$", 1)).otherwise("jpg")
    quality = F.when(dotted, F.regexp_extract(t, r"^(.*)\.[^.]*$", 1)).otherwise(t)
    fmt = F.when(ext == "jpg", "JPEG").when(ext.isin("png", "webp", "avif"), F.upper(ext))
    grey = quality.isin("grey", "gray")
    known = grey | quality.isin("native", "color", "default", "bitonal", "stretch", "negative", "equalization", "log")
    return F.struct(
        quality.alias("quality"),
        fmt.alias("format"),
        F.when(grey, "GREYSCALE").when(quality == "bitonal", "BINARY").alias("colorspace"),
        F.when(quality == "stretch", -1.0).otherwise(1.0).alias("contrast"),
        (quality == "negative").alias("inverted"),
        (quality == "equalization").alias("equalize"),
        F.when(quality == "log", -1.0).otherwise(1.0).alias("gamma"),
        F.when(fmt.isNull(), "unsupported output format").when(~known, "unsupported quality").alias("error"),
    )


def deepzoom_levels(width: Column, height: Column) -> Column:
    return int_(F.ceil(F.log2(F.greatest(width, height).cast("double"))))


def deepzoom_tile(r: Column, x: Column, y: Column, levels: Column, width: Column, height: Column) -> Column:
    """(level, tile) of a Deep Zoom tile address."""
    n = F.size(levels)
    level = F.least(F.greatest(r - (deepzoom_levels(width, height) - n) - 1, F.lit(0)), n - 1)
    return F.struct(int_(level).alias("level"), int_(y * F.get(levels, n - 1 - level)["ntx"] + x).alias("tile"))


def zoomify_discard(levels: Column) -> Column:
    """Levels smaller than a tile that Zoomify does not show."""
    small = F.size(F.filter(levels, lambda v: (v["width"] < v["tile_w"]) & (v["height"] < v["tile_w"])))
    return F.greatest(small - 1, F.lit(0))


def zoomify_tile(r: Column, x: Column, y: Column, levels: Column) -> Column:
    level = r + zoomify_discard(levels)
    return F.struct(int_(level).alias("level"), int_(y * F.get(levels, F.size(levels) - 1 - level)["ntx"] + x).alias("tile"))


def rotated_tile(tile: Column, rot: Column, ntx: Column, nty: Column) -> Column:
    """Source tile behind tile number ``tile`` of the turned image."""
    turn = rot % 360
    col, row = tile % nty, F.floor(tile / nty)
    return int_(
        F.when(turn == 180, ntx * nty - tile - 1)
        .when(turn == 90, (nty - 1 - col) * ntx + row)
        .when(turn == 270, col * ntx + (ntx - 1 - row))
        .otherwise(tile)
    )


def validate_tile(level: Column, tile: Column, levels: Column) -> Column:
    """Reason why (level, tile) cannot be served, or null."""
    found = F.get(levels, F.size(levels) - 1 - level)
    return (
        F.when((level < 0) | (level >= F.size(levels)) | (tile < 0), "invalid resolution or tile number")
        .when(tile >= found["ntx"] * found["nty"], "tile outside of level")
    )


def validate_point(x: Column, y: Column, tile_width: Column, tile_height: Column) -> Column:
    inside = (x >= 0) & (y >= 0) & (x < tile_width) & (y < tile_height)
    return F.when(~inside, "coordinates outside of tile")


def validate_line(level: Column, x1: Column, y1: Column, x2: Column, y2: Column, levels: Column) -> Column:
    found = F.get(levels, F.size(levels) - 1 - level)
    bad = F.least(x1, x2, y1, y2) < 0
    far = (F.greatest(x1, x2) >= found["width"]) | (F.greatest(y1, y2) >= found["height"])
    return F.when((level < 0) | (level >= F.size(levels)), "invalid resolution").when(bad | far, "invalid coordinates")
