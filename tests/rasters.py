"""Small random rasters as tile tables, and back."""

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.samples import to_block, type_of


def tiles(spark, image, tile, image_id=1):
    h, w, channels = image.shape
    bpc, kind = type_of(image)
    ntx = -(-w // tile)
    rows = []
    for ty in range(-(-h // tile)):
        for tx in range(ntx):
            part = np.ascontiguousarray(image[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile])
            rows.append((image_id, 0, 90, 0, ty * ntx + tx, tx, ty, part.shape[1], part.shape[0], channels, bpc, kind, bytearray(part.tobytes()), w, h))
    schema = (
        "image_id long, h_seq int, v_seq int, level int, tile int, tx int, ty int, width int, height int, channels int, bpc int, "
        "sample_type string, data binary, img_w int, img_h int"
    )
    return spark.createDataFrame(rows, schema)


def image(df, tile):
    parts = df.select("tx", "ty", "width", "height", "channels", "bpc", "sample_type", "data").collect()
    w = max(p.tx * tile + p.width for p in parts)
    h = max(p.ty * tile + p.height for p in parts)
    out = None
    for p in parts:
        block = to_block(bytes(p.data), p.height, p.width, p.channels, p.bpc, p.sample_type)
        if out is None:
            out = np.zeros((h, w, p.channels), block.dtype)
        out[p.ty * tile : p.ty * tile + p.height, p.tx * tile : p.tx * tile + p.width] = block
    assert sum(p.width * p.height for p in parts) == w * h
    return out


def random_image(seed, h, w, channels=1, kind="u1"):
    rng = np.random.default_rng(seed)
    if kind == "f8":
        return rng.random((h, w, channels))
    return rng.integers(0, 256 if kind == "u1" else 65536, (h, w, channels)).astype(kind)
