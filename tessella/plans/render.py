"""Batch rendering of region and tile requests.

The order of steps is fixed: statistics, region, CIELAB to sRGB, then either the floating-point stage
(normalise, shade, twist, gamma or log, invert, colour map, convolve, contrast) or a shift to 8 bit,
then resize, band reduction, grey, binary, equalise, flip, turn, watermark.

A batch is split only where the plan differs: requests for one whole stored tile with nothing done to it take its
bytes as they are; requests with a kernel need an exchange of borders; all others do their pixel work on the source
tiles before the one shuffle to output tiles.  Histograms are made for images that a request needs them for.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import pixelops as P
from tessella.operators import color, stats
from tessella.operators.cover import completeness, get_region, join_wanted, prune_tiles, region_cells
from tessella.operators.geometry import rotated_tile
from tessella.operators.tiles import GEOMETRY, convolve_block, filter_windows, map_blocks, padded
from tessella.operators.watermark import stamp
from tessella.schema import FIXED, TILE_KEY
from tessella.session import join_side_table, kept_once

c = F.col

# Per-request processing columns with their defaults.
OPS: dict[str, Column | None] = {
    "contrast": "cast(1 as double)",
    "gamma": "cast(1 as double)",
    "inverted": "false",
    "cmap": "cast(null as string)",
    "shade": "cast(null as array<int>)",
    "matrix": "cast(null as array<array<double>>)",
    "kernel": "cast(null as array<double>)",
    "colorspace": "cast(null as string)",
    "equalize": "false",
    "flip": "0",
    "rot": "0",
    "minmax_channel": "cast(null as string)",
    "minmax_lo": "cast(null as double)",
    "minmax_hi": "cast(null as double)",
    "format": "'JPEG'",
}
# Per-image columns the stages read.  The histogram itself is only needed to equalise the output.
IMAGE = ["lo", "hi", "image_space", "bin_lo", "bin_hi", "threshold"]
_FLOAT_OPS = ("contrast", "gamma", "inverted", "cmap", "shade", "matrix", "kernel", "minmax_channel")
_USE = (*OPS, *IMAGE)


def with_defaults(requests: DataFrame) -> DataFrame:
    return requests.withColumns({k: F.expr(v) for k, v in OPS.items() if k not in requests.columns})


def needs_float(r: dict) -> bool:
    return (
        r["contrast"] != 1.0 or r["gamma"] != 1.0 or r["inverted"]
        or any(r[k] is not None for k in ("cmap", "shade", "matrix", "kernel", "minmax_channel"))
    )


def before_kernel(block: np.ndarray, r: dict) -> np.ndarray:
    """CIELAB conversion and the floating-point steps up to the colour map."""
    lo, hi = r["lo"], r["hi"]
    if r["image_space"] == "CIELAB":
        block = P.lab_to_srgb(P.lab_unpack(block))
        lo, hi = [0.0], [1.0]
    if block.dtype.kind != "f" and not needs_float(r):
        return P.scale_to_8bit(block)
    if r["contrast"] == -1:
        shift = block.dtype.itemsize * 8 - 8 if block.dtype.kind == "u" else 0
        lo, hi = [float(r["bin_lo"] << shift)], [float(r["bin_hi"] << shift)]
    block = P.normalize(block, lo, hi)
    if r["shade"] is not None:
        block = P.hillshade(block, *r["shade"])
    if r["matrix"] is not None:
        block = P.twist(block, r["matrix"])
    if r["gamma"] == -1:
        block = P.log_transform(block)
    elif r["gamma"] != 1.0:
        block = P.gamma(block, r["gamma"])
    if r["inverted"]:
        block = P.invert(block)
    if r["cmap"] is not None:
        block = P.colormap(block, r["cmap"])
    return block


def to_8bit(block: np.ndarray, r: dict) -> np.ndarray:
    return block if block.dtype == np.uint8 else P.contrast(block, 1.0 if r["contrast"] == -1 else r["contrast"])


def pixel_stage(block: np.ndarray, r: dict) -> np.ndarray:
    return to_8bit(before_kernel(block, r), r)


def _kernel(r: dict) -> np.ndarray:
    side = int(round(len(r["kernel"]) ** 0.5))
    return np.array(r["kernel"], float).reshape(side, side)


def after_resize(block: np.ndarray, r: dict) -> np.ndarray:
    """Band reduction, grey, binary and equalisation of 8-bit output."""
    block = P.flatten(block, P.output_bands(block.shape[2], r["format"]))
    if r["colorspace"] == "GREYSCALE" and r["image_space"] == "sRGB":
        block = P.greyscale(block)
    if r["colorspace"] == "BINARY" and r["image_space"] != "BINARY":
        block = P.binary(block, r["threshold"])
    if r["equalize"]:
        block = P.lookup(block, P.equalize_lookup(r["hist"], r["out_w"] * r["out_h"]))
    return block


def image_statistics(tiles: DataFrame, ranges: DataFrame, spaces: DataFrame, scope: str = "thumbnail") -> DataFrame:
    """(image_id, lo, hi, image_space, hist, bin_lo, bin_hi, threshold).

    ``scope='thumbnail'`` counts the first tile of the smallest level, ``'full'`` every tile given.
    """
    seen = tiles.where("level = 0 AND tile = 0 AND h_seq = 0") if scope == "thumbnail" else tiles
    hist = stats.histogram(join_side_table(seen, ranges, ["image_id"], "inner", spread_by=["tile"]), lo="lo", hi="hi")
    hist = kept_once(hist)  # 256 rows per image, used twice
    used = hist.groupBy("image_id").agg(F.min("bin").alias("bin_lo"), F.max("bin").alias("bin_hi"))
    derived = stats.histogram_arrays(hist).join(stats.otsu_threshold(hist), "image_id").join(used, "image_id")
    return ranges.join(spaces, "image_id").join(derived, "image_id", "left")


def statistics_for(requests: DataFrame, tiles: DataFrame, ranges: DataFrame, spaces: DataFrame, scope: str = "thumbnail") -> DataFrame:
    """`image_statistics`, with histograms only of images that a request equalises, stretches or makes binary; the others
    have nulls.  A batch without such requests counts nothing."""
    asks = c("equalize") | (c("contrast") == -1) | F.coalesce(c("colorspace") == "BINARY", F.lit(False))
    ids = kept_once(with_defaults(requests).where(asks).select("image_id").distinct())
    plain = ranges.join(spaces, "image_id")
    if ids.isEmpty():
        return plain.withColumns({"hist": F.lit(None).cast("array<long>"), "bin_lo": F.lit(None).cast("int"), "bin_hi": F.lit(None).cast("int"), "threshold": F.lit(None).cast("int")})
    wanted = join_side_table(tiles, ids, ["image_id"], "inner", spread_by=["tile"])
    counted = image_statistics(wanted, ranges.join(ids, "image_id", "left_semi"), spaces, scope)
    return counted.unionByName(plain.join(ids, "image_id", "left_anti"), allowMissingColumns=True)


def is_plain_tile(tile: int) -> Column:
    """Whether a prepared request is one whole stored tile with nothing done to it (see geometry.is_pure_tile)."""
    edge = lambda start, size: F.least(F.lit(tile), size - start)
    place = (c("src_x") % tile == 0) & (c("src_y") % tile == 0) & (c("src_w") == edge(c("src_x"), c("lv_width"))) & (c("src_h") == edge(c("src_y"), c("lv_height")))
    same = (c("dst_w") == c("src_w")) & (c("dst_h") == c("src_h")) & ~c("flip_x") & ~c("flip_y") & ~c("transpose")
    still = (c("contrast") == 1) & (c("gamma") == 1) & ~c("inverted") & ~c("equalize")
    unset = [c(k).isNull() for k in ("cmap", "shade", "matrix", "kernel", "minmax_channel", "colorspace")]
    return F.coalesce(reduce(Column.__and__, [place, same, still, *unset]), F.lit(False))


def _plain_tiles(work: DataFrame, tiles: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Renderings of `is_plain_tile` requests: 8-bit grey or RGB tiles go through as they are stored, their bytes are not
    looked at; others (deeper samples, CIELAB, alpha) take the pixel steps, but are not moved."""
    ntx = F.ceil(c("lv_width") / tile)
    wanted = work.withColumns({"tx": F.expr(f"int(src_x div {tile})"), "ty": F.expr(f"int(src_y div {tile})")})
    wanted = wanted.withColumn("tile", (c("ty") * ntx + c("tx")).cast("int"))
    found = join_wanted(wanted, tiles, keys).withColumns({"out_w": c("dst_w"), "out_h": c("dst_h"), "tile": F.lit(0), "tx": F.lit(0), "ty": F.lit(0)})
    shown = [*keys, "out_w", "out_h", "tx", "ty", "tile", "width", "height", "channels", "bpc", "sample_type", "data", "format"]
    stored = (c("bpc") == 8) & (c("sample_type") == FIXED) & c("channels").isin(1, 3) & F.coalesce(c("image_space") != "CIELAB", F.lit(True))
    steps = lambda block, row: after_resize(pixel_stage(block, row), row)
    moved = map_blocks(found.where(~stored), steps, using=(*_USE, "hist", "out_w", "out_h"))
    return found.where(stored).select(*shown).unionByName(moved.select(*shown))


def with_ranges(work: DataFrame) -> DataFrame:
    """Requests with statistics; the range of a request with MINMAX replaces the image's.  A channel that the image
    does not have changes nothing.  Only requests that equalise keep the histogram, 256 numbers a row."""
    number = c("minmax_channel").try_cast("int")
    known = (c("minmax_channel") == "-") | ((number >= 0) & (number < F.size("lo")))
    work = work.withColumn("minmax_channel", F.when(known, c("minmax_channel")))
    lo, hi = color.apply_minmax(c("lo"), c("hi"), c("minmax_channel"), c("minmax_lo"), c("minmax_hi"))
    asked = c("minmax_channel").isNotNull()
    work = work.withColumn("hist", F.when(c("equalize"), c("hist")))
    return work.withColumns({"lo": F.when(asked, lo).otherwise(c("lo")), "hi": F.when(asked, hi).otherwise(c("hi"))})


def render_key(requests: DataFrame) -> Column:
    """Digest of everything that decides the output, so equal requests are rendered once."""
    parts = ["image_id", "h_seq", "v_seq", "level", "src_x", "src_y", "src_w", "src_h", "dst_w", "dst_h", *OPS]
    return F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def prepare(requests: DataFrame) -> DataFrame:
    """Geometry columns and render key of planned views (see geometry.plan_views).

    The narrow result is written down, because it is read twice: for the distinct renderings and to serve
    them.  That also keeps its many derived columns out of the optimiser's constraint inference.
    """
    turned = c("rot") % 180 == 90
    r = with_defaults(requests).withColumns(
        {
            "h_seq": c("h_seq") if "h_seq" in requests.columns else F.lit(0),
            "v_seq": c("v_seq") if "v_seq" in requests.columns else F.lit(90),
            "level": c("lv_level"),
            "ntx": c("lv_ntx"),
            "nty": c("lv_nty"),
            "src_x": c("pixels_left"),
            "src_y": c("pixels_top"),
            "src_w": c("pixels_width"),
            "src_h": c("pixels_height"),
            "dst_w": c("out_w"),
            "dst_h": c("out_h"),
        }
    ).drop("out_w", "out_h")
    # A flip comes before the turn; both together are mirrored axes plus a transposition.
    mirror_x = c("flip") == 1
    mirror_y = c("flip") == 2
    turn = c("rot") % 360
    r = r.withColumns(
        {
            "flip_x": mirror_x.cast("int").bitwiseXOR(turn.isin(180, 270).cast("int")) == 1,
            "flip_y": mirror_y.cast("int").bitwiseXOR(turn.isin(90, 180).cast("int")) == 1,
            "transpose": turned,
            "step": F.lit(None).cast("int"),
        }
    )
    return kept_once(r.withColumn("render_key", render_key(r)).drop("levels"))


def render_regions(requests: DataFrame, tiles: DataFrame, statistics: DataFrame, tile: int, out_tile: int, mode: str = "bilinear", mark: np.ndarray | None = None, probability: float = 1.0) -> DataFrame:
    """Output tiles of every distinct request: render_key, out_w, out_h, tile, tx, ty, ..., data.

    ``requests`` come from `prepare`; join its render_key with the result to serve each request.
    """
    keys = ["render_key"]
    sizes = [n for n in ("lv_width", "lv_height") if n in requests.columns]
    needed = [*keys, "image_id", "h_seq", "v_seq", "level", "ntx", "nty", *GEOMETRY, *OPS, *sizes]
    distinct = requests.select(*needed).dropDuplicates(keys)
    whole = is_plain_tile(tile) if sizes and mark is None and tile <= out_tile else F.lit(False)
    plain_tiles = distinct.where(whole)
    distinct = distinct.where(~whole)
    # written down, as both branches and the last join read it
    work = kept_once(with_ranges(join_side_table(distinct, statistics, ["image_id"], "left", spread_by=["render_key"])))
    carried = [*keys, *OPS, *IMAGE, "hist"]
    plain = work.where("kernel IS NULL")
    out = get_region(plain, tiles, keys, tile, tile, out_tile, mode, pixel_stage, _USE)

    special = work.where("kernel IS NOT NULL")
    cells = region_cells(special, tile, tile).select(*keys, *TILE_KEY, "tx", "ty", "src_x", "src_y", "src_w", "src_h")

    def convolve(block: np.ndarray, r: dict) -> np.ndarray:
        kernel = _kernel(r)
        inner = 2 - kernel.shape[0] // 2
        block = block[inner : block.shape[0] - inner, inner : block.shape[1] - inner]
        return to_8bit(convolve_block(block.astype(float), kernel), r)

    out = out.unionByName(filter_windows(join_wanted(cells, tiles, keys), special, keys, tile, tile, out_tile, 2, convolve, mode, before_kernel, _USE))

    finished = join_side_table(out, work.select(*carried, "image_id"), keys, "inner", spread_by=["tx", "ty"])
    done = map_blocks(finished, after_resize, using=("format", "colorspace", "equalize", "image_space", "threshold", "hist", "out_w", "out_h"))
    if mark is not None:
        shared = tiles.sparkSession.sparkContext.broadcast(mark)
        done = map_blocks(
            done,
            lambda b, r: stamp(b, shared.value, r["tx"] * out_tile, r["ty"] * out_tile, r["out_w"], r["out_h"], 2 * tile, r["image_id"], probability),
            using=("tx", "ty", "out_w", "out_h", "image_id"),
        )
    done = done.drop(*[k for k in carried if k not in (*keys, "format")], "image_id")
    if plain_tiles.isEmpty():
        return done
    whole_work = with_ranges(join_side_table(plain_tiles, statistics, ["image_id"], "left", spread_by=["render_key"]))
    return done.unionByName(_plain_tiles(whole_work, tiles, keys, tile).select(*done.columns))


def render_all(requests: DataFrame, tiles: DataFrame, statistics: DataFrame, tile: int, out_tile: int, **how) -> DataFrame:
    """`render_regions`, and of every request at least a row: wanted and found tiles, complete, error.

    A request of which nothing can be rendered has a row without data.
    """
    rendered = render_regions(requests.where("ntx IS NOT NULL"), tiles, statistics, tile, out_tile, **how)
    places = ["render_key", "image_id", "h_seq", "v_seq", "level", "ntx", "nty", *GEOMETRY]
    report = completeness(requests.select(*places).dropDuplicates(["render_key"]), tiles, ["render_key"], tile, tile)
    shown = rendered.join(report.where("found > 0"), "render_key")
    return shown.unionByName(report.where("found = 0"), allowMissingColumns=True)


def tile_key(requests: DataFrame) -> Column:
    """Digest of a tile request, in the same way."""
    parts = ["image_id", "h_seq", "v_seq", "level", "tile", *OPS]
    return F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def render_tiles(requests: DataFrame, tiles: DataFrame, statistics: DataFrame, levels: DataFrame, mark: np.ndarray | None = None, probability: float = 1.0) -> DataFrame:
    """One output per (image, h_seq, v_seq, level, tile) request; every step stays inside the tile.

    ``tile`` is a number in the grid of the turned image; the stored tile behind it follows from the level's ntx and
    nty in ``levels``.  Equal requests are rendered once; the rows carry ``render_key`` (see ``tile_key``).  A request for
    an unknown level, a tile beyond the grid or a tile that is not stored has a row with ``error`` and no data.
    """
    shared = mark if mark is None else tiles.sparkSession.sparkContext.broadcast(mark)
    key = ["image_id", "h_seq", "v_seq", "level", "tile"]
    r = with_defaults(requests)
    r = r.withColumn("render_key", tile_key(r))
    distinct = r.select("render_key", *key, *OPS).dropDuplicates(["render_key"])
    grid = join_side_table(distinct, levels.select("image_id", "level", "ntx", "nty"), ["image_id", "level"], "left", spread_by=["render_key"])
    inside = (c("tile") >= 0) & (c("tile") < c("ntx") * c("nty"))
    error = F.when(c("ntx").isNull(), "level not found").when(~inside, "tile not in the grid")
    grid = grid.withColumn("error", error).withColumn("tile", F.when(inside, rotated_tile(c("tile"), c("rot"), c("ntx"), c("nty"))).otherwise(c("tile")))
    placed = kept_once(grid.withColumns({"tx": F.expr("int(tile % ntx)"), "ty": F.expr("int(tile div ntx)")}).drop("ntx", "nty"))
    work = with_ranges(join_side_table(placed, statistics, ["image_id"], "left", spread_by=["render_key"]))
    good = work.where("error IS NULL").drop("error")
    joined = join_wanted(good, tiles, ["render_key"])
    # keys without tile data tell what is not stored
    absent = placed.where("error IS NULL").join(prune_tiles(tiles, placed).select(*key), key, "left_anti")
    lost = placed.where("error IS NOT NULL").unionByName(absent.withColumn("error", F.lit("tile not found"))).select("render_key", *key, "error")

    def run(block: np.ndarray, row: dict) -> np.ndarray:
        block = before_kernel(block, row)
        if row["kernel"] is not None:
            kernel = _kernel(row)
            block = convolve_block(padded(block.astype(float), None, kernel.shape[0] // 2), kernel)
        block = to_8bit(block, row)
        row["out_h"], row["out_w"] = block.shape[:2]
        block = P.turn(after_resize(block, row), row["flip"], row["rot"])
        if mark is not None:
            side = max(block.shape[:2])
            block = stamp(block, shared.value, 0, 0, block.shape[1], block.shape[0], side, row["image_id"] * 1_000_003 + row["tile"], probability)
        return block

    done = map_blocks(joined, run, using=(*_USE, "hist", "image_id", "tile"), drop=tuple(k for k in (*OPS, *IMAGE, "hist") if k != "format"))
    return done.withColumn("error", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)


def serve(requests: DataFrame, rendered: DataFrame) -> DataFrame:
    """Each request with the output tiles of its render key."""
    return requests.join(rendered, "render_key")
