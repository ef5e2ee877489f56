"""Metadata queries over the image catalogue: narrow projections, no shuffle.

Images carry ``levels`` (see geometry.pyramid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import json_escape, nine_digits
from tessella.functions.constants import MAX_SIZE
from tessella.operators.geometry import deepzoom_levels, int_

c = F.col


def pair(a: Column, b: Column) -> Column:
    return F.concat_ws(" ", a.cast("string"), b.cast("string"))


def max_size(rot: Column) -> Column:
    turned = rot % 180 == 90
    return F.when(turned, pair(c("height"), c("width"))).otherwise(pair(c("width"), c("height")))


def resolution_number() -> Column:
    return F.size("levels")


def tile_size(level: Column | None = None) -> Column:
    """Tile size of the full level, or of a given level (0 is the smallest)."""
    found = F.get("levels", F.lit(0) if level is None else F.size("levels") - 1 - level)
    return pair(found["tile_w"], found["tile_h"])


def bits_per_channel() -> Column:
    return c("bpc")


def views(angles: Column) -> Column:
    return F.concat_ws(" ", F.transform(F.array_sort(angles), lambda a: a.cast("string")))


def min_max_sample_values(lo: Column, hi: Column) -> Column:
    pairs = F.transform(F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda p: F.concat_ws(" ", nine_digits(p["lo"]), nine_digits(p["hi"])))
    return F.concat_ws(" ", pairs)


def resolutions() -> Column:
    """Level sizes, smallest first."""
    ordered = F.array_sort(F.transform("levels", lambda v: F.struct(v["level"], v["width"], v["height"])))
    return F.concat_ws(",", F.transform(ordered, lambda v: pair(v["width"], v["height"])))


def colorspace() -> Column:
    lab, grey = c("colorspace") == "CIELAB", c("colorspace") == "GREYSCALE"
    code = F.when(lab, 4).when(grey, 1).otherwise(3)
    planes = F.when(grey, "1 0").otherwise("3 0 1 2")
    calibrated = F.when(lab, 1).otherwise(0)
    return F.format_string("Colorspace,0-%d,0:%d 0 %d %s", F.size("levels") - 1, calibrated, code, planes)


def pixels_per_metre(dpi: Column) -> Column:
    d = dpi.cast("double")
    return F.when(c("dpi_units") == 2, d * 100).when(c("dpi_units") == 1, d / 0.0254).otherwise(d)


def dpi() -> Column:
    known = (c("dpi_x") != 0) & (c("dpi_y") != 0)
    return F.when(known, F.format_string("%.6f %.6f", pixels_per_metre(c("dpi_x")), pixels_per_metre(c("dpi_y"))))


def metadata_field(name: str) -> Column:
    return F.nullif(F.try_element_at(c("metadata"), F.lit(name)), F.lit(""))


def metadata_json() -> Column:
    """All non-empty fields but the embedded profiles, in name order."""
    shown = F.map_filter("metadata", lambda k, v: (F.length(v) > 0) & ~k.isin("icc", "xmp"))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(shown))))


def stack_json(stack: Column) -> Column:
    items = F.transform(
        stack,
        lambda s, i: F.concat(
            F.lit('{"id":'), i.cast("string"), F.lit(',"name":"'), json_escape(s["name"]),
            F.lit('","scale":'), nine_digits(s["scale"]), F.lit("}"),
        ),
    )
    return F.when(F.size(stack) > 0, F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]")))


def stack_rows(images: DataFrame) -> DataFrame:
    exploded = images.select("image_id", F.posexplode("stack").alias("id", "s"))
    return exploded.select("image_id", "id", F.col("s.name").alias("name"), F.col("s.scale").alias("scale"))


def basic_info(images: DataFrame, rot: Column | None = None) -> DataFrame:
    return images.select(
        "image_id",
        max_size(F.lit(0) if rot is None else rot).alias("max_size"),
        resolution_number().alias("resolution_number"),
        colorspace().alias("colorspace"),
    )


SUMMARY_FIELDS = ["rights", "description", "creator", "date", "software"]


def summary_info(images: DataFrame) -> DataFrame:
    return images.select("image_id", *[metadata_field(f).alias(f) for f in SUMMARY_FIELDS])


def fill_rights(metadata: Column, default: str) -> Column:
    """The collection's rights text for images without a rights entry of their own."""
    return F.when(F.map_contains_key(metadata, "rights"), metadata).otherwise(
        F.map_concat(metadata, F.create_map(F.lit("rights"), F.lit(default)))
    )


def deepzoom_manifest(ext: str = "jpg") -> Column:
    """The manifest of a tile set whose files end in ``ext``."""
    return F.format_string(
        '<Image xmlns="http://schemas.microsoft.com/deepzoom/2008" TileSize="%d" Overlap="0" Format="%s">'
        '<Size Width="%d" Height="%d"/></Image>',
        F.get("levels", F.lit(0))["tile_w"], F.lit(ext), c("width"), c("height"),
    )


def zoomify_tiles() -> Column:
    """One plus the tiles of every level that is not smaller than a tile."""
    tile = F.get("levels", F.lit(0))["tile_w"]
    shown = F.filter("levels", lambda v: ~((v["width"] < tile) & (v["height"] < tile)))
    counts = F.transform(shown, lambda v: F.ceil(v["width"] / tile).cast("long") * F.ceil(v["height"] / tile).cast("long"))
    return F.aggregate(counts, F.lit(1).cast("long"), lambda a, n: a + n)


def zoomify_manifest() -> Column:
    return F.format_string(
        '<IMAGE_PROPERTIES WIDTH="%d" HEIGHT="%d" NUMTILES="%d" NUMIMAGES="1" VERSION="1.8" TILESIZE="%d"/>',
        c("width"), c("height"), zoomify_tiles(), F.get("levels", F.lit(0))["tile_w"],
    )


def iiif_info(base: str, version: int = 3, max_px: int = MAX_SIZE, rights: Column | None = None) -> Column:
    """The image information document.  The full size is not among the listed sizes."""
    ordered = F.array_sort(F.transform("levels", lambda v: F.struct(v["level"].alias("l"), v["width"].alias("width"), v["height"].alias("height"))))
    n = F.size("levels")
    listed = F.slice(ordered, 1, F.greatest(n - 1, F.lit(1)))
    sizes = F.transform(listed, lambda v: F.struct(v["width"].alias("width"), v["height"].alias("height")))
    factors = F.transform(
        F.array_sort(F.transform("levels", lambda v: F.struct(v["native_level"], v["width"].alias("w")))),
        lambda v: int_(F.floor(c("width") / F.greatest(v["w"], F.lit(1)))),
    )
    full = F.get("levels", F.lit(0))
    tiles = F.array(F.struct(full["tile_w"].alias("width"), full["tile_h"].alias("height"), factors.alias("scaleFactors")))
    qualities = F.concat(
        F.when(c("channels") >= 3, F.array(F.lit("color"))).otherwise(F.array().cast("array<string>")),
        F.array(*[F.lit(q) for q in ("gray", "bitonal", "negative", "stretch", "equalization", "log")]),
    )
    identity = F.concat(F.lit(base), c("path"))
    rights = metadata_field("rights") if rights is None else rights
    scale = F.when(
        c("dpi_x") > 0,
        F.array(
            F.struct(
                F.lit("http://iiif.io/api/annex/services/physdim/1/context.json").alias("@context"),
                F.lit("http://iiif.io/api/annex/services/physdim").alias("profile"),
                F.round(1.0 / c("dpi_x").cast("double"), 9).alias("physicalScale"),
                F.when(c("dpi_units") == 1, "in").otherwise("cm").alias("physicalUnits"),
            )
        ),
    )
    head = [
        F.lit(f"http://iiif.io/api/image/{version}/context.json").alias("@context"),
        F.lit("http://iiif.io/api/image").alias("protocol"),
        c("width").alias("width"),
        c("height").alias("height"),
        sizes.alias("sizes"),
        tiles.alias("tiles"),
    ]
    if version >= 3:
        body = [
            identity.alias("id"),
            F.lit("ImageService3").alias("type"),
            F.lit("level2").alias("profile"),
            F.lit(max_px).alias("maxWidth"),
            F.lit(max_px).alias("maxHeight"),
            qualities.alias("extraQualities"),
            F.array(F.lit("tif")).alias("extraFormats"),
            F.array(*[F.lit(x) for x in ("regionByPct", "sizeByPct", "sizeByConfinedWh", "sizeUpscaling", "rotationBy90s", "mirroring")]).alias("extraFeatures"),
            rights.alias("rights"),
        ]
    else:
        options = F.struct(
            F.array(*[F.lit(x) for x in ("jpg", "png", "tif")]).alias("formats"),
            F.concat(F.array(F.lit("native")), qualities).alias("qualities"),
            F.array(*[F.lit(x) for x in ("regionByPct", "regionSquare", "max", "sizeByConfinedWh", "sizeByForcedWh", "sizeByWh", "sizeAboveFull", "rotationBy90s", "mirroring")]).alias("supports"),
            F.lit(max_px).alias("maxWidth"),
            F.lit(max_px).alias("maxHeight"),
        )
        profile = F.array(
            F.to_json(F.struct(F.lit(f"http://iiif.io/api/image/{version}/level2.json").alias("v"))), F.to_json(options)
        )
        body = [identity.alias("@id"), profile.alias("profile"), rights.alias("license")]
    return F.to_json(F.struct(*head, *body, scale.alias("service")))


def dpi_for_level(level: Column) -> tuple[Column, Column]:
    """Output resolution of a level: header value times level size over full size."""
    return (
        c("dpi_x").cast("double") * level["width"] / c("width"),
        c("dpi_y").cast("double") * level["height"] / c("height"),
    )


def embed_icc(icc_bytes: Column, max_icc: int, cmapped: Column, shaded: Column, twisted: Column, space: Column) -> Column:
    """Whether an output keeps the colour profile: -1 always, 0 never, else if smaller."""
    changed = cmapped | shaded | twisted | F.coalesce(space == "GREYSCALE", F.lit(False))
    allowed = F.lit(max_icc == -1) | (icc_bytes < max_icc)
    return F.coalesce(F.lit(max_icc != 0) & ~changed & (icc_bytes > 0) & allowed, F.lit(False))


def embed_xmp(xmp_bytes: Column, is_region: Column) -> Column:
    """XMP and EXIF go with region exports only."""
    return F.coalesce(is_region & (xmp_bytes > 0), F.lit(False))


# --- sequences of files ---------------------------------------------------------------------------

SEQUENCE = r"^(.*)_pyr_(\d{3,})_(\d{3})\.([^./]+)$"


def discover_sequences(files: DataFrame, path: str = "path") -> DataFrame:
    """(stem, suffix, h_views, v_views) of file sequences ``<stem>_pyr_HHH_VVV.<suffix>``.

    Horizontal views are the files at 90 vertically, vertical views those at 0 horizontally; a
    sequence needs exactly one suffix on its first file.  Paths are reduced to distinct angles before
    they are gathered.
    """
    p = c(path)
    parts = files.select(
        F.regexp_extract(p, SEQUENCE, 1).alias("stem"),
        F.regexp_extract(p, SEQUENCE, 2).try_cast("int").alias("h"),
        F.regexp_extract(p, SEQUENCE, 3).try_cast("int").alias("v"),
        F.regexp_extract(p, SEQUENCE, 4).alias("suffix"),
    ).where("stem <> ''")
    needed = parts.where("h = 0 OR v = 90").distinct()
    first = needed.where("h = 0 AND v = 90").groupBy("stem").agg(F.count("*").alias("n"), F.min("suffix").alias("suffix"))
    named = needed.join(first.where("n = 1").drop("n"), ["stem", "suffix"])
    return named.groupBy("stem", "suffix").agg(
        F.array_sort(F.collect_set(F.when(c("v") == 90, c("h")))).alias("h_views"),
        F.array_sort(F.collect_set(F.when(c("h") == 0, c("v")))).alias("v_views"),
    )


def sequence_path(stem: Column, h: Column, v: Column, suffix: Column, pattern: str = "_pyr_") -> Column:
    return F.concat(stem, F.lit(pattern), F.format_string("%03d_%03d.", h, v), suffix)


def joined(*parts) -> Column:
    """Text parts and numbers put together; cheaper per row than a format string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def deepzoom_folder(level: Column, width: Column, height: Column, num_levels: Column) -> Column:
    """What follows the image's path in the Deep Zoom paths of a level's tiles."""
    return joined("_files/", int_(level + deepzoom_levels(width, height) - num_levels + 1), "/")


def deepzoom_path(level: Column, tx: Column, ty: Column, width: Column, height: Column, num_levels: Column, ext: str = "png", folder: Column | None = None) -> Column:
    """``folder`` is the level's `deepzoom_folder`, where it is at hand."""
    folder = deepzoom_folder(level, width, height, num_levels) if folder is None else folder
    return joined(c("path"), folder, tx, "_", ty, f".{ext}")


def zoomify_level(level: Column, discard: Column) -> Column:
    """What names the level in the Zoomify paths of its tiles."""
    return joined("/", int_(level - discard), "-")


def zoomify_path(level: Column, tx: Column, ty: Column, discard: Column, number: Column | None = None, ext: str = "png", shown: Column | None = None) -> Column:
    """``number`` is the tile's place among the tiles of all shown levels, smallest level first; 256 are in a group.
    ``shown`` is the level's `zoomify_level`, where it is at hand."""
    group = F.lit(0) if number is None else F.floor(number / 256)
    return joined(c("path"), "/TileGroup", group, zoomify_level(level, discard) if shown is None else shown, tx, "-", ty, f".{ext}")


def iiif_steps(level) -> tuple[Column, Column]:
    """Width and height of a level's tiles in pixels of the full size."""
    step = F.pow(F.lit(2.0), level["native_level"]).cast("long")
    return level["tile_w"] * step, level["tile_h"] * step


def iiif_inner(level, ext: str = "png") -> Column:
    """What follows the place of a tile that the image's border does not cut."""
    across, down = iiif_steps(level)
    return joined(",", across, ",", down, "/", level["tile_w"], f",/0/default.{ext}")


def iiif_path(level, tx: Column, ty: Column, ext: str = "png", steps: tuple[Column, Column] | None = None, inner: Column | None = None) -> Column:
    """Region/size/rotation/quality address of one tile of a level of ``levels``; ``steps`` and ``inner`` are the level's
    `iiif_steps` and `iiif_inner`, where they are at hand."""
    across, down = steps or iiif_steps(level)
    x, y = tx * across, ty * down
    w, h = F.least(across, c("width") - x), F.least(down, c("height") - y)
    out_w = F.least(level["tile_w"], level["width"] - tx * level["tile_w"])
    rest = joined(",", w, ",", h, "/", out_w, f",/0/default.{ext}")
    if inner is not None:
        rest = F.when((w == across) & (h == down) & (out_w == level["tile_w"]), inner).otherwise(rest)
    return joined(c("path"), "/", x, ",", y, rest)
