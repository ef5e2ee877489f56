"""Tile form: how blocks are mapped, cut, moved and put together.

Every operator here handles one tile, or the pieces of one output tile, per step.  Nothing holds a
whole image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.samples import dtype_of, to_block, to_bytes, type_of
from tessella.schema import FLOATING, PLANE_KEY, TILE_KEY

BlockFn = Callable[[np.ndarray, dict], np.ndarray]

_SHAPE = ("width", "height", "channels", "bpc", "sample_type", "data")


def _ddl(schema: T.StructType, drop: tuple[str, ...] = ()) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in drop)


#: Rows of an Arrow batch are worked on in runs of about so many bytes.
INPUT_BYTES = 2 << 20


def runs(batches: Iterator[pa.RecordBatch], limit: int = INPUT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of about ``limit`` bytes, so that what Python holds beside a batch does not grow with its
    rows; results are handed on run by run."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def listed(column: pa.Array) -> list:
    """The values of a column as Python ones; whole numbers and booleans without nulls go by NumPy, which makes them much faster."""
    if column.null_count == len(column):
        return [None] * len(column)
    plain = pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if plain and not column.null_count else column.to_pylist()


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, as ``to_pylist`` gives them."""
    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*map(listed, batch.columns)))


def block_of(row: dict) -> np.ndarray:
    return to_block(row["data"], row["height"], row["width"], row["channels"], row["bpc"], row["sample_type"])


def map_blocks(tiles: DataFrame, fn: BlockFn, using: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """Replace every tile's block by ``fn(block, row)``; ``row`` holds the columns in ``using``.

    One Arrow pass, no shuffle.  Columns other than the block description pass through untouched.
    """
    fields = [f for f in tiles.schema if f.name not in drop]
    names = [f.name for f in fields]
    read = [*_SHAPE, *[u for u in using if u not in _SHAPE]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            rows = batch.select(read).to_pylist()
            out = {k: [] for k in _SHAPE}
            for row in rows:
                block = fn(block_of(row), row)
                bpc, kind = type_of(block)
                for key, value in zip(
                    _SHAPE, (block.shape[1], block.shape[0], block.shape[2], bpc, kind, to_bytes(block))
                ):
                    out[key].append(value)
            columns = []
            for name in names:
                source = batch.column(batch.schema.get_field_index(name))
                columns.append(pa.array(out[name], source.type) if name in out else source)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return tiles.mapInArrow(run, T.StructType(fields))


#: Pixel rows are handed on in batches of about so many, made of several tiles where tiles are small.
PIXELS = 1 << 17


def tiles_to_pixels(tiles: DataFrame, tile_w: int, tile_h: int, keys: tuple[str, ...] = tuple(PLANE_KEY)) -> DataFrame:
    """Pixel view of a tile table: one row per sample.  Narrow; for joins with SQL and for checks.

    Tiles of one shape are unfolded together.
    """
    key_types = {f.name: f.dataType.simpleString() for f in tiles.schema}
    schema = ", ".join(f"{k} {key_types[k]}" for k in keys) + ", y int, x int, c int, v double"
    source = tiles.select(*keys, "tx", "ty", *_SHAPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            value = {n: listed(batch.column(batch.schema.get_field_index(n))) for n in ("tx", "ty", *_SHAPE)}
            alike: dict[tuple, list[int]] = {}
            for i, shape in enumerate(zip(*(value[n] for n in _SHAPE[:-1]))):
                alike.setdefault(shape, []).append(i)
            for (w, h, c, bpc, kind), index in alike.items():
                step = max(1, PIXELS // max(h * w * c, 1))
                for lo in range(0, len(index), step):
                    yield made(batch, value, index[lo : lo + step], (h, w, c), dtype_of(bpc, kind))

    def made(batch: pa.RecordBatch, value: dict[str, list], index: list[int], shape: tuple[int, ...], dtype: np.dtype) -> pa.RecordBatch:
        """The samples of some tiles of one shape."""
        size, n = int(np.prod(shape)), len(index)
        data = [value["data"][i] for i in index]
        if any(len(d) != size * dtype.itemsize for d in data):
            raise ValueError(f"a tile of {shape} {dtype} samples has other bytes")
        whole = pa.array(np.repeat(index, size))
        columns = [batch.column(k).take(whole) for k in range(len(keys))]
        y, x, c = np.indices(shape, dtype=np.int32).reshape(3, -1)
        for at, tile, name in ((y, tile_h, "ty"), (x, tile_w, "tx")):
            start = pa.array([value[name][i] * tile for i in index], pa.int32()).to_numpy()
            columns.append(pa.array((start[:, None] + at).reshape(-1)))
        columns += [pa.array(np.tile(c, n)), pa.array(np.frombuffer(b"".join(data), dtype).astype(np.float64))]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "y", "x", "c", "v"])

    return source.mapInArrow(run, schema)


def pixels_to_tiles(
    pixels: DataFrame,
    tile_w: int,
    tile_h: int,
    width: Column,
    height: Column,
    channels: int,
    bpc: int,
    sample_type: str,
) -> DataFrame:
    """Gather pixel rows into tiles; absent samples are 0.  Groups are at most one tile large."""
    tx, ty = F.expr(f"x div {tile_w}").cast("int"), F.expr(f"y div {tile_h}").cast("int")
    place = ((F.col("y") % tile_h) * tile_w + F.col("x") % tile_w) * channels + F.col("c")
    grouped = (
        pixels.withColumns({"_w": width.cast("int"), "_h": height.cast("int"), "tx": tx, "ty": ty})
        .groupBy(*PLANE_KEY, "tx", "ty", "_w", "_h")
        .agg(F.collect_list(F.struct(place.cast("int").alias("p"), F.col("v").cast("double").alias("v"))).alias("s"))
        .select(
            *PLANE_KEY,
            (F.col("ty") * F.ceil(F.col("_w") / tile_w) + F.col("tx")).cast("int").alias("tile"),
            "tx",
            "ty",
            F.least(F.lit(tile_w), F.col("_w") - F.col("tx") * tile_w).cast("int").alias("width"),
            F.least(F.lit(tile_h), F.col("_h") - F.col("ty") * tile_h).cast("int").alias("height"),
            "s",
        )
    )
    dtype = dtype_of(bpc, sample_type)
    keep = [*TILE_KEY, "tx", "ty", "width", "height"]
    schema = _ddl(grouped.select(*keep).schema) + ", channels int, bpc int, sample_type string, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            lists = batch.column(batch.schema.get_field_index("s"))
            offsets = lists.offsets.to_numpy()
            place_all = lists.values.field(0).to_numpy()
            value_all = lists.values.field(1).to_numpy()
            widths = batch.column(batch.schema.get_field_index("width")).to_numpy()
            heights = batch.column(batch.schema.get_field_index("height")).to_numpy()
            blocks = []
            for i in range(batch.num_rows):
                lo, hi = offsets[i], offsets[i + 1]
                full = np.zeros(tile_w * tile_h * channels, dtype)
                full[place_all[lo:hi]] = value_all[lo:hi].astype(dtype)
                full = full.reshape(tile_h, tile_w, channels)
                blocks.append(to_bytes(full[: heights[i], : widths[i]]))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(k)) for k in keep],
                    pa.array([channels] * n, pa.int32()),
                    pa.array([bpc] * n, pa.int32()),
                    pa.array([sample_type] * n),
                    pa.array(blocks, pa.binary()),
                ],
                names=[*keep, "channels", "bpc", "sample_type", "data"],
            )

    return grouped.mapInArrow(run, schema)


# --- moving samples to an output grid ------------------------------------------------------------

# Geometry columns that `regrid` reads beside the tile itself.
#   src_x, src_y, src_w, src_h : source window in pixels of the tile's level
#   dst_w, dst_h               : size the window is mapped to, before rotation
#   flip_x, flip_y, transpose  : applied after the mapping
#   step                       : exact pixel step (virtual levels); null for window ratios
GEOMETRY = ["src_x", "src_y", "src_w", "src_h", "dst_w", "dst_h", "flip_x", "flip_y", "transpose", "step"]


def axis_taps(start: int, stop: int, win: int, length: int, size: int, step: int | None, linear: bool):
    """Which output positions of one axis read source positions ``start..stop``.

    Returns (output index, source index, weight).  Integer arithmetic, so positions are exact.
    """
    if step:
        first = -(-max(start - win, 0) // step)
        last = min((stop - 1 - win) // step, size - 1)
        out = np.arange(first, last + 1, dtype=np.int64)
        return out, out * step + win, np.ones(len(out))
    lo, hi = max(start - win, 0), min(stop - win, length)
    if hi <= lo:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0)
    first = max((max(lo - 1, 0) * size) // length - 1, 0)
    last = min((hi * size) // length + 1, size - 1)
    out = np.arange(first, last + 1, dtype=np.int64)
    base, rest = np.divmod(out * length, size)
    if not linear:
        keep = (base >= lo) & (base < hi)
        return out[keep], base[keep] + win, np.ones(int(keep.sum()))
    frac = rest / size
    nxt = np.minimum(base + 1, length - 1)
    outs = np.concatenate([out, out])
    taps = np.concatenate([base, nxt])
    weights = np.concatenate([1.0 - frac, frac])
    keep = (taps >= lo) & (taps < hi) & (weights > 0)
    return outs[keep], taps[keep] + win, weights[keep]


def _axis_matrix(out: np.ndarray, tap: np.ndarray, weight: np.ndarray, origin: int, cells: int):
    """Distinct output positions and the dense (positions x source cells) weights of one tile axis."""
    positions, inverse = np.unique(out, return_inverse=True)
    matrix = np.zeros((len(positions), cells))
    np.add.at(matrix, (inverse, tap - origin), weight)
    return positions, matrix


def _window(block: np.ndarray, row: dict, x0: int, y0: int) -> tuple[np.ndarray, int, int]:
    """The part of a tile that lies in the row's source window, and where it starts."""
    h, w, _ = block.shape
    left, top = max(row["src_x"] - x0, 0), max(row["src_y"] - y0, 0)
    right, bottom = min(row["src_x"] + row["src_w"] - x0, w), min(row["src_y"] + row["src_h"] - y0, h)
    return block[top : max(bottom, top), left : max(right, left)], x0 + left, y0 + top


def axis_cuts(start: int, cells: int, win: int, length: int, flip: bool, out: int) -> list[tuple[int, int, slice]]:
    """One axis of a window that keeps its size: (output tile, place in it, source cells) of every output tile
    that the source cells ``start..start + cells`` touch.  What `axis_taps` gives there, without a position per sample."""
    lo, hi = max(start - win, 0), min(start + cells - win, length)
    first, last = (length - hi, length - lo) if flip else (lo, hi)
    cuts = []
    for t in range(first // out, (last - 1) // out + 1) if first < last else ():
        a, b = max(first, t * out), min(last, (t + 1) * out)
        base = length - b if flip else a
        cuts.append((t, a - t * out, slice(base + win - start, base + b - a + win - start)))
    return cuts


def _pieces(row: dict, block: np.ndarray, x0: int, y0: int, out_w: int, out_h: int, linear: bool):
    """Cut a source block that starts at (x0, y0) into (out_tx, out_ty, oy, ox, block) for the output grid."""
    h, w, _ = block.shape
    if not linear and not row["step"] and row["dst_w"] == row["src_w"] and row["dst_h"] == row["src_h"]:
        across, down = (out_h, out_w) if row["transpose"] else (out_w, out_h)
        cuts_x = axis_cuts(x0, w, row["src_x"], row["src_w"], row["flip_x"], across)
        for ty, oy, rows in axis_cuts(y0, h, row["src_y"], row["src_h"], row["flip_y"], down):
            for tx, ox, cols in cuts_x:
                part = block[rows, cols]
                part = part[:, ::-1] if row["flip_x"] else part
                part = part[::-1] if row["flip_y"] else part
                yield (ty, tx, ox, oy, part.transpose(1, 0, 2)) if row["transpose"] else (tx, ty, oy, ox, part)
        return
    ox, sx, wx = axis_taps(x0, x0 + w, row["src_x"], row["src_w"], row["dst_w"], row["step"], linear)
    oy, sy, wy = axis_taps(y0, y0 + h, row["src_y"], row["src_h"], row["dst_h"], row["step"], linear)
    if not len(ox) or not len(oy):
        return
    if linear:
        ox, mx = _axis_matrix(ox, sx, wx, x0, w)
        oy, my = _axis_matrix(oy, sy, wy, y0, h)
        part = np.einsum("yh,hwc,xw->yxc", my, block.astype(np.float64), mx, optimize=True)
    else:
        part = block[np.ix_(sy - y0, sx - x0)]
    if row["flip_x"]:
        ox, part = (row["dst_w"] - 1 - ox)[::-1], part[:, ::-1]
    if row["flip_y"]:
        oy, part = (row["dst_h"] - 1 - oy)[::-1], part[::-1]
    if row["transpose"]:
        ox, oy, part = oy, ox, part.transpose(1, 0, 2)
    for ty in range(int(oy[0]) // out_h, int(oy[-1]) // out_h + 1):
        rows = slice(*np.searchsorted(oy, (ty * out_h, (ty + 1) * out_h)))
        for tx in range(int(ox[0]) // out_w, int(ox[-1]) // out_w + 1):
            cols = slice(*np.searchsorted(ox, (tx * out_w, (tx + 1) * out_w)))
            if rows.stop > rows.start and cols.stop > cols.start:
                yield tx, ty, int(oy[rows][0]) - ty * out_h, int(ox[cols][0]) - tx * out_w, part[rows, cols]


#: Output batches are handed on at this size, whatever an enlargement makes of its input.
OUTPUT_BYTES = 32 << 20
_PIECE = "out_w int, out_h int, tx int, ty int, oy int, ox int, ph int, pw int, channels int, bpc int, sample_type string, data binary"


def regrid(
    tiles: DataFrame,
    keys: list[str],
    tile_w: int,
    tile_h: int,
    out_tile_w: int,
    out_tile_h: int,
    mode: str = "nearest",
    before: BlockFn | None = None,
    using: tuple[str, ...] = (),
    each: str | None = None,
    blocks: Callable[[dict], Iterable[tuple[np.ndarray, int, int]]] | None = None,
) -> DataFrame:
    """Move samples to an output grid: crop, resize, flip, turn and re-tile in one step.

    ``tiles`` carries the GEOMETRY columns; rows with the same ``keys`` belong to one output image.
    A source tile is reduced where it lies to the samples (or partial weighted sums) it adds to each
    output tile, so the shuffle moves output-sized data.  A group is one output tile.

    ``each`` names an array of structs; a source tile, read and decoded once, is moved once for every entry, whose fields
    take the place of keys and geometry (the levels of a pyramid, say).

    ``blocks`` makes the blocks of a row, with the pixel each starts at, of rows that are no tiles; they are read from the
    columns in ``using``.
    """
    own = [] if blocks else ["tx", "ty", *_SHAPE]
    blocks = blocks or (lambda row: [(block_of(row), row["tx"] * tile_w, row["ty"] * tile_h)])
    linear = mode == "bilinear"
    changed = [f.name for f in tiles.schema[each].dataType.elementType if f.name in keys] if each else []
    names = [*keys, "out_w", "out_h", "tx", "ty", "oy", "ox", "ph", "pw", "channels", "bpc", "sample_type", "data"]
    schema = _ddl(tiles.select(*keys).schema) + ", " + _PIECE
    read = [*dict.fromkeys([*keys, *own, *GEOMETRY, *using, *([each] if each else [])])]
    source = tiles.select(*read)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"sample_type": pa.string(), "data": pa.binary()}

        def made(batch: pa.RecordBatch, taken: list[int], pieces: list[tuple]) -> pa.RecordBatch:
            index, cells = pa.array(taken, pa.int64()), dict(zip(made_names, zip(*pieces) if pieces else [[]] * len(made_names)))
            columns = []
            for k in keys:
                own = batch.column(batch.schema.get_field_index(k))
                columns.append(pa.array(cells[f"key {k}"], own.type) if k in changed else own.take(index))
            columns += [pa.array(cells[k], types.get(k, pa.int32())) for k in names[len(keys) :]]
            return pa.RecordBatch.from_arrays(columns, names=names)

        made_names = [f"key {k}" for k in changed] + names[len(keys) :]
        for batch in runs(batches):
            taken, pieces, size = [], [], 0
            moves = ((i, *cut, row, change) for i, row in enumerate(rows_of(batch)) for cut in blocks(row) for change in (row[each] if each else [None]))
            for i, block, x0, y0, row, change in moves:
                row = {**row, **change} if change else row
                if before is not None:
                    if row["step"] is None:
                        block, x0, y0 = _window(block, row, x0, y0)
                    if not block.size:
                        continue
                    block = before(block, row)
                w, h = row["dst_w"], row["dst_h"]
                if row["transpose"]:
                    w, h = h, w
                for tx, ty, oy, ox, part in _pieces(row, block, x0, y0, out_tile_w, out_tile_h, linear):
                    bpc, kind = type_of(part)
                    taken.append(i)
                    place = (w, h, tx, ty, oy, ox, part.shape[0], part.shape[1], part.shape[2], bpc, kind, to_bytes(part))
                    pieces.append((*[row[k] for k in changed], *place) if changed else place)
                    size += part.nbytes
                    if size > OUTPUT_BYTES:
                        yield made(batch, taken, pieces)
                        taken, pieces, size = [], [], 0
            yield made(batch, taken, pieces)

    pieces = source.mapInArrow(scatter, schema)
    return assemble(pieces, keys, out_tile_w, out_tile_h, add=linear)


def assemble(pieces: DataFrame, keys: list[str], tile_w: int, tile_h: int, add: bool) -> DataFrame:
    """Put the pieces of each output tile together (paste, or add partial sums and cut to 8 bit)."""
    group = [*keys, "out_w", "out_h", "tx", "ty", "channels", "bpc", "sample_type"]
    gathered = pieces.groupBy(*group).agg(F.collect_list(F.struct("oy", "ox", "ph", "pw", "data")).alias("parts"))
    shaped = gathered.withColumns(
        {
            "tile": (F.col("ty") * F.ceil(F.col("out_w") / tile_w) + F.col("tx")).cast("int"),
            "width": F.least(F.lit(tile_w), F.col("out_w") - F.col("tx") * tile_w).cast("int"),
            "height": F.least(F.lit(tile_h), F.col("out_h") - F.col("ty") * tile_h).cast("int"),
            "data": F.lit(None).cast("binary"),
        }
    )
    fields = [f for f in shaped.schema if f.name != "parts"]
    names = [f.name for f in fields]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            blocks = []
            lists = batch.column(batch.schema.get_field_index("parts"))
            ends = lists.offsets.to_numpy()
            cells = zip(*map(listed, lists.values.slice(ends[0], ends[-1] - ends[0]).flatten()))
            own = batch.select(["height", "width", "channels", "bpc", "sample_type"])
            for count, (height, width, channels, bpc, kind) in zip(np.diff(ends).tolist(), zip(*map(listed, own.columns))):
                dtype = dtype_of(bpc, kind)
                block = np.zeros((height, width, channels), dtype)
                for oy, ox, ph, pw, data in islice(cells, count):
                    part = np.frombuffer(data, dtype).reshape(ph, pw, channels)
                    area = block[oy : oy + ph, ox : ox + pw]
                    if add:
                        area += part
                    else:
                        area[:] = part
                if add:
                    # The small term absorbs the order in which the partial sums arrive.
                    block = np.floor(block + 1e-6).clip(0, 255).astype(np.uint8)
                blocks.append(to_bytes(block))
            n = batch.num_rows
            done = {"data": pa.array(blocks, pa.binary())}
            if add:
                done["bpc"] = pa.array([8] * n, pa.int32())
                done["sample_type"] = pa.array(["FIXEDPOINT"] * n)
            yield pa.RecordBatch.from_arrays(
                [done.get(k, batch.column(batch.schema.get_field_index(k))) for k in names], names=names
            )

    return shaped.mapInArrow(gather, T.StructType(fields))


def whole_image(width: Column, height: Column) -> dict[str, Column]:
    """GEOMETRY columns that keep an image as it is."""
    zero, no = F.lit(0), F.lit(False)
    return {
        "src_x": zero,
        "src_y": zero,
        "src_w": width.cast("int"),
        "src_h": height.cast("int"),
        "dst_w": width.cast("int"),
        "dst_h": height.cast("int"),
        "flip_x": no,
        "flip_y": no,
        "transpose": no,
        "step": F.lit(None).cast("int"),
    }


# --- neighbourhoods ------------------------------------------------------------------------------


def with_halo(tiles: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Give each tile the border strips of its up to 8 neighbours, as an array column ``halo``.

    A group has at most 8 strips.  The tiles are read twice and joined to their strips; `map_neighbourhoods` reads them
    once, for functions that do not need further columns joined in between.
    """
    sent = tiles.select(*keys, "tx", "ty", *_SHAPE)
    cut_schema = _ddl(tiles.select(*keys).schema) + ", tx int, ty int, dx int, dy int, sh int, sw int, strip binary"
    names = [*keys, "tx", "ty", "dx", "dy", "sh", "sw", "strip"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = {-1: slice(0, radius), 0: slice(None), 1: slice(-radius, None)}
        for batch in runs(batches):
            out = {k: [] for k in names[len(keys) :]}
            index = []
            for i, row in enumerate(batch.to_pylist()):
                block = block_of(row)
                for dy, rows in pick.items():
                    for dx, cols in pick.items():
                        if dx or dy:
                            part = block[rows, cols]
                            values = (row["tx"] + dx, row["ty"] + dy, -dx, -dy, part.shape[0], part.shape[1])
                            index.append(i)
                            for key, value in zip(out, (*values, to_bytes(part))):
                                out[key].append(value)
            columns = [batch.column(i).take(pa.array(index, pa.int64())) for i in range(len(keys))]
            columns += [pa.array(v, pa.binary() if k == "strip" else pa.int32()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    strips = sent.mapInArrow(cut, cut_schema)
    halo = strips.groupBy(*keys, "tx", "ty").agg(F.collect_list(F.struct("dx", "dy", "sh", "sw", "strip")).alias("halo"))
    return tiles.join(halo.hint("shuffle_hash"), [*keys, "tx", "ty"], "left")


def padded(block: np.ndarray, halo: list[dict] | None, radius: int) -> np.ndarray:
    """The block with ``radius`` more samples on each side: neighbours, else the edge repeated."""
    channels = block.shape[2]
    return extended(block, {(p["dx"], p["dy"]): np.frombuffer(p["strip"], block.dtype).reshape(p["sh"], p["sw"], channels) for p in halo or []}, radius)


def extended(block: np.ndarray, near: dict[tuple[int, int], np.ndarray], radius: int) -> np.ndarray:
    """The block with ``radius`` more samples on each side, from the strips ``near`` by direction.

    Where the grid has a hole the nearest samples are repeated: an edge without neighbour takes the block's own, a corner
    without neighbour the strip beside it; a corner strip counts only where both strips beside it are there.
    """
    h, w, channels = block.shape
    left, right = (near[dx, 0].shape[1] if (dx, 0) in near else 0 for dx in (-1, 1))
    top, bottom = (near[0, dy].shape[0] if (0, dy) in near else 0 for dy in (-1, 1))
    canvas = np.empty((top + h + bottom, left + w + right, channels), block.dtype)
    rows = {-1: slice(0, top), 0: slice(top, top + h), 1: slice(top + h, None)}
    cols = {-1: slice(0, left), 0: slice(left, left + w), 1: slice(left + w, None)}
    canvas[rows[0], cols[0]] = block
    for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        if (dx, dy) in near:
            canvas[rows[dy], cols[dx]] = near[dx, dy]
    for dx, dy in ((-1, -1), (1, -1), (-1, 1), (1, 1)):
        if (dx, 0) in near and (0, dy) in near:
            beside = near[0, dy][:, :1] if dx < 0 else near[0, dy][:, -1:]
            canvas[rows[dy], cols[dx]] = near.get((dx, dy), beside)
    missing = ((radius - top, radius - bottom), (radius - left, radius - right), (0, 0))
    return np.pad(canvas, missing, mode="edge")


# Tiles on a side of a block of the grid: what one group of the neighbourhood operators holds.
BLOCK_SIDE = 4


def block_place(side: int = BLOCK_SIDE) -> dict[str, Column]:
    """Columns ``bx``, ``by``: the block of the grid that a tile lies in."""
    return {"bx": F.floor(F.col("tx") / side).cast("int"), "by": F.floor(F.col("ty") / side).cast("int")}


def _facing(block: np.ndarray, dx: int, dy: int, radius: int) -> np.ndarray:
    """What a neighbour in direction (dx, dy) shows to a tile: its samples within ``radius`` of the common border."""
    pick = {-1: slice(-radius, None), 0: slice(None), 1: slice(0, radius)}
    return block[pick[dy], pick[dx]]


def rim_strips(tiles: DataFrame, radius: int, keys: list[str], side: int = BLOCK_SIDE, with_tiles: bool = False) -> DataFrame:
    """Border strips that tiles give to tiles of other blocks, as rows in tile form.

    ``tx``, ``ty`` are the receiver's, ``dx``, ``dy`` the direction in which the strip lies from it.  ``with_tiles`` passes
    the tiles themselves as well, with null directions and all their columns, so that they are read once.
    """
    source = tiles if with_tiles else tiles.select(*keys, "tx", "ty", *_SHAPE).where(
        " OR ".join(f"{k} % {side} IN (0, {side - 1})" for k in ("tx", "ty"))
    )
    fields = [*source.schema, T.StructField("dx", T.IntegerType()), T.StructField("dy", T.IntegerType())]
    made = ["tx", "ty", "width", "height", "data", "dx", "dy"]
    kept = {*keys, "channels", "bpc", "sample_type"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            if with_tiles:
                none = pa.nulls(batch.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, none, none], names=[f.name for f in fields])
            out, index = {k: [] for k in made}, []
            for i, row in enumerate(batch.select(["tx", "ty", *_SHAPE]).to_pylist()):
                block, x, y = block_of(row), row["tx"], row["ty"]
                for dx, dy in ((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy):
                    to_x, to_y = x + dx, y + dy
                    if min(to_x, to_y) < 0 or (to_x // side, to_y // side) == (x // side, y // side):
                        continue
                    strip = _facing(block, -dx, -dy, radius)
                    index.append(i)
                    for key, value in zip(made, (to_x, to_y, strip.shape[1], strip.shape[0], to_bytes(strip), -dx, -dy), strict=True):
                        out[key].append(value)
            taken, columns = pa.array(index, pa.int64()), []
            for f in fields:
                at = batch.schema.get_field_index(f.name)
                if f.name in out:
                    columns.append(pa.array(out[f.name], batch.column(at).type if at >= 0 else pa.int32()))
                else:
                    columns.append(batch.column(at).take(taken) if f.name in kept else pa.nulls(len(index), batch.column(at).type))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    return source.mapInArrow(cut, nullable).withColumns(block_place(side))


def _solve(tiles: pa.Table, strips: pa.Table, names: list[str], fn: BlockFn, radius: int, using: tuple[str, ...]) -> pa.Table:
    """The tiles of one block of the grid, each block of samples replaced by ``fn(extended block, row)``."""
    read = [*dict.fromkeys(["tx", "ty", *_SHAPE, *using])]
    rows = tiles.select(read).to_pylist()
    at = {(r["tx"], r["ty"]): block_of(r) for r in rows}
    across: dict = {}
    for s in strips.select(["tx", "ty", "dx", "dy", *_SHAPE]).to_pylist():
        across.setdefault((s["tx"], s["ty"]), {})[s["dx"], s["dy"]] = _facing(block_of(s), s["dx"], s["dy"], radius)
    out = {k: [] for k in _SHAPE}
    for row in rows:
        x, y = row["tx"], row["ty"]
        near = dict(across.get((x, y), {}))
        for dx, dy in ((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy):
            if (x + dx, y + dy) in at:
                near[dx, dy] = _facing(at[x + dx, y + dy], dx, dy, radius)
        block = fn(extended(block_of(row), near, radius), row)
        bpc, kind = type_of(block)
        for key, value in zip(_SHAPE, (block.shape[1], block.shape[0], block.shape[2], bpc, kind, to_bytes(block)), strict=True):
            out[key].append(value)
    return pa.table([pa.array(out[n], tiles[n].type) if n in out else tiles[n] for n in names], names=names)


def map_neighbourhoods(
    tiles: DataFrame, radius: int, fn: BlockFn, keys: list[str] | None = None, using: tuple[str, ...] = (), side: int = BLOCK_SIDE
) -> DataFrame:
    """Replace every tile's block by ``fn(block with radius more samples on each side, row)``.

    Tiles are dealt by blocks of ``side`` x ``side`` of the grid, so a tile is read and moved once and only strips of a
    block's rim are copied.  A group is one block, however large the image.  A tile that is there twice keeps both rows.
    """
    keys, names = keys or PLANE_KEY, tiles.columns

    def solve(group: pa.Table) -> pa.Table:
        own = pa.compute.is_null(group["dx"])
        return _solve(group.filter(own), group.filter(pa.compute.invert(own)), names, fn, radius, using)

    moved = rim_strips(tiles, radius, keys, side, with_tiles=True)
    return moved.groupBy(*keys, "bx", "by").applyInArrow(solve, tiles.schema)


def map_stored_neighbourhoods(spark: SparkSession, table: str, radius: int, fn: BlockFn, using: tuple[str, ...] = ()) -> DataFrame:
    """`map_neighbourhoods` over a table of `sinks.save_block_table`: its tiles are read once and stay in their buckets,
    the strips that cross blocks come from the table beside it."""
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    reach = int(properties.get("tessella.reach", -1))
    if radius > reach:
        raise ValueError(f"{table} holds strips of {reach} samples, {radius} are needed")
    tiles, rims = spark.table(table), spark.table(f"{table}_rims")
    key = [*PLANE_KEY, "bx", "by"]
    names = [n for n in tiles.columns if n not in ("bx", "by")]

    def solve(own: pa.Table, strips: pa.Table) -> pa.Table:
        return _solve(own, strips, names, fn, radius, using)

    return tiles.groupBy(*key).cogroup(rims.groupBy(*key)).applyInArrow(solve, tiles.select(*names).schema)


# --- neighbourhoods inside windows ---------------------------------------------------------------

#: Samples on a side of a block that `filter_windows` works on, about; whole output tiles.
WINDOW_BLOCK = 128


def _reach(at: int, size: int, side: int, ring: int) -> range:
    """Blocks of one axis that cells ``at..at + size`` lie in, or are within ``ring`` of."""
    return range(max((at - ring) // side, 0), (at + size - 1 + ring) // side + 1)


def _covered(parts: list[dict], height: int, width: int, y0: int, x0: int, side: int, radius: int, before: BlockFn, row: dict) -> list[np.ndarray]:
    """What ``before`` makes of the pieces of one block and its rim, put together; 0 where there is none.

    One array for each kind of samples that comes out, which is one unless a store mixes them.
    """
    raw: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for p in parts:
        top, left = max(p["y"], -radius), max(p["x"], -radius)
        bottom, right = min(p["y"] + p["h"], side + radius), min(p["x"] + p["w"], side + radius)
        if bottom <= top or right <= left:
            continue
        kind = (p["channels"], p["bpc"], p["sample_type"])
        if kind not in raw:
            raw[kind] = np.zeros((height, width, p["channels"]), dtype_of(*kind[1:])), np.zeros((height, width), bool)
        place = slice(top - y0, bottom - y0), slice(left - x0, right - x0)
        raw[kind][0][place] = to_block(p["data"], bottom - top, right - left, *kind)
        raw[kind][1][place] = True
    made: dict[tuple, np.ndarray] = {}
    for samples, there in raw.values():
        done = before(samples, row)
        if not there.all():
            done = np.where(there[..., None], done, np.zeros((), done.dtype))
        kind = (done.shape[2], done.dtype)
        made[kind] = np.where(there[..., None], done, made[kind]) if kind in made else done
    return [*made.values()]


def filter_windows(
    tiles: DataFrame, windows: DataFrame, keys: list[str], tile_w: int, tile_h: int, out_tile: int, radius: int, fn: BlockFn,
    mode: str = "nearest", before: BlockFn | None = None, using: tuple[str, ...] = (),
) -> DataFrame:
    """Cut windows, replace their samples by ``fn(block with radius more samples on each side, row)``, and move the result
    to an output grid as `regrid` does.

    ``tiles`` are source tiles with ``keys`` and the window (src_x, src_y, src_w, src_h) they are wanted for; ``windows`` has
    keys, GEOMETRY and the columns in ``using``, and a row for each window.  A window is dealt out by blocks; a source tile
    gives each block the samples, as they are stored, of the block and of ``radius`` around it, so they are moved once.
    ``before`` works on single samples.  Neighbours do not reach beyond the window, whose edges are repeated, as are those
    beside an output-sized tile of the window without any sample.
    """
    side = max(1, WINDOW_BLOCK // out_tile) * out_tile
    fields = _ddl(tiles.select(*keys).schema)
    names = [*keys, "bx", "by", "y", "x", "h", "w", "channels", "bpc", "sample_type", "data"]
    place = ["src_x", "src_y", "src_w", "src_h"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"sample_type": pa.string(), "data": pa.binary()}
        for batch in runs(batches):
            index, out = [], []
            for i, row in enumerate(rows_of(batch.select(["tx", "ty", *place, *_SHAPE]))):
                block, x, y = _window(block_of(row), row, row["tx"] * tile_w, row["ty"] * tile_h)
                h, w, channels = block.shape
                if not block.size:
                    continue
                x, y = x - row["src_x"], y - row["src_y"]
                for by in _reach(y, h, side, out_tile if row["src_h"] > side else 0):
                    for bx in _reach(x, w, side, out_tile if row["src_w"] > side else 0):
                        if by * side < row["src_h"] and bx * side < row["src_w"]:
                            top, left = by * side - radius - y, bx * side - radius - x
                            part = block[max(top, 0) : max(top + side + 2 * radius, 0), max(left, 0) : max(left + side + 2 * radius, 0)]
                            index.append(i)
                            out.append((bx, by, y - by * side, x - bx * side, h, w, channels, row["bpc"], row["sample_type"], to_bytes(part)))
            columns = [batch.column(batch.schema.get_field_index(k)).take(pa.array(index, pa.int64())) for k in keys]
            columns += [pa.array(v, types.get(k, pa.int32())) for k, v in zip(names[len(keys) :], zip(*out) if out else [[]] * 10)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def blocks(row: dict) -> Iterator[tuple[np.ndarray, int, int]]:
        at_x, at_y = row["bx"] * side, row["by"] * side
        w, h = min(side, row["src_w"] - at_x), min(side, row["src_h"] - at_y)
        x0, y0 = -min(radius, at_x), -min(radius, at_y)
        right, bottom = min(w + radius, row["src_w"] - at_x), min(h + radius, row["src_h"] - at_y)
        # tiles of the output's size in and around the block that have a sample
        there = {(tx, ty) for p in row["parts"]
                 for ty in range(p["y"] // out_tile, (p["y"] + p["h"] - 1) // out_tile + 1)
                 for tx in range(p["x"] // out_tile, (p["x"] + p["w"] - 1) // out_tile + 1)}
        inside = [(tx, ty) for ty in range(-(-h // out_tile)) for tx in range(-(-w // out_tile))]
        around = {(tx, ty) for tx in range(-1 if x0 else 0, -(-right // out_tile)) for ty in range(-1 if y0 else 0, -(-bottom // out_tile))}
        for canvas in _covered(row["parts"], bottom - y0, right - x0, y0, x0, side, radius, before or (lambda b, r: b), row):
            if around <= there:
                rim = ((radius + y0, radius + h - bottom), (radius + x0, radius + w - right), (0, 0))
                yield fn(np.pad(canvas, rim, mode="edge"), row), at_x, at_y
                continue
            tile = lambda tx, ty: canvas[max(ty * out_tile - y0, 0) : max((ty + 1) * out_tile - y0, 0), max(tx * out_tile - x0, 0) : max((tx + 1) * out_tile - x0, 0)]
            for tx, ty in inside:
                if (tx, ty) in there:
                    near = {(dx, dy): _facing(tile(tx + dx, ty + dy), dx, dy, radius) for dx in (-1, 0, 1) for dy in (-1, 0, 1)
                            if (dx or dy) and (tx + dx, ty + dy) in there & around}
                    yield fn(extended(tile(tx, ty), near, radius), row), at_x + tx * out_tile, at_y + ty * out_tile

    pieces = tiles.select(*keys, "tx", "ty", *place, *_SHAPE).mapInArrow(cut, f"{fields}, {_CUT}")
    gathered = pieces.groupBy(*keys, "bx", "by").agg(F.collect_list(F.struct(*names[len(keys) + 2 :])).alias("parts"))
    heads = windows.select(*dict.fromkeys([*keys, *GEOMETRY, *using]))
    for n, size in (("by", "src_h"), ("bx", "src_w")):
        heads = heads.withColumn(n, F.explode(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / side).cast("int"))))
    joined = gathered.join(heads.hint("shuffle_hash"), [*keys, "bx", "by"])
    joined = joined.withColumns({"src_x": F.lit(0), "src_y": F.lit(0)})  # blocks start at pixels of the window
    return regrid(joined, keys, out_tile, out_tile, out_tile, out_tile, mode, using=("bx", "by", "parts", *using), blocks=blocks)


_CUT = "bx int, by int, y int, x int, h int, w int, channels int, bpc int, sample_type string, data binary"


def convolve_block(extended: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Weighted sum over the kernel window, divided by the kernel sum when that is positive."""
    side = kernel.shape[0]
    h, w = extended.shape[0] - side + 1, extended.shape[1] - side + 1
    total = np.zeros((h, w, extended.shape[2]))
    for dy in range(side):
        for dx in range(side):
            if kernel[dy, dx] != 0:
                total += kernel[dy, dx] * extended[dy : dy + h, dx : dx + w]
    weight = kernel.sum()
    return total / weight if weight > 0 else total


def _square(kernel: list[float]) -> tuple[np.ndarray, int]:
    side = int(round(len(kernel) ** 0.5))
    return np.array(kernel, float).reshape(side, side), side // 2


def convolve(tiles: DataFrame, kernel: list[float], scope: str = "image", keys: list[str] | None = None) -> DataFrame:
    """Square odd kernel over float tiles.  ``scope='tile'`` repeats tile edges, as single-tile jobs do."""
    matrix, radius = _square(kernel)
    if scope == "tile" or radius == 0:
        return map_blocks(tiles, lambda b, r: convolve_block(padded(b.astype(float), None, radius), matrix))
    return map_neighbourhoods(tiles, radius, lambda b, r: convolve_block(b.astype(float), matrix), keys)


def convolve_table(spark: SparkSession, table: str, kernel: list[float]) -> DataFrame:
    """`convolve` over a table of `sinks.save_block_table`, whose tiles are not shuffled."""
    matrix, radius = _square(kernel)
    return map_stored_neighbourhoods(spark, table, radius, lambda b, r: convolve_block(b.astype(float), matrix))


def is_float(tile_type: Column) -> Column:
    return tile_type == FLOATING
