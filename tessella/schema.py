"""Table schemas as DDL text.

``image_id`` is a surrogate LONG; the file path stays a column of ``images``.
"""

from __future__ import annotations


IMAGES = (
    "image_id LONG, path STRING, format STRING, mtime TIMESTAMP, width INT, height INT, "
    "num_levels INT, channels INT, bpc INT, sample_type STRING, colorspace STRING, "
    "min ARRAY<FLOAT>, max ARRAY<FLOAT>, dpi_x FLOAT, dpi_y FLOAT, dpi_units INT, "
    "h_views ARRAY<INT>, v_views ARRAY<INT>, stack ARRAY<STRUCT<name: STRING, scale: FLOAT>>, "
    "metadata MAP<STRING, STRING>, icc BINARY, xmp BINARY, exif BINARY"
)

LEVELS = (
    "image_id LONG, level INT, native_level INT, width INT, height INT, "
    "tile_w INT, tile_h INT, ntx INT, nty INT"
)

TILES = (
    "image_id LONG, h_seq INT, v_seq INT, level INT, tile INT, tx INT, ty INT, width INT, height INT, "
    "channels INT, bpc INT, sample_type STRING, encoding STRING, quality INT, mtime TIMESTAMP, data BINARY"
)

PIXELS = (
    "image_id LONG, h_seq INT, v_seq INT, level INT, y INT, x INT, c INT, v DOUBLE"
)

PLANE_KEY = ["image_id", "h_seq", "v_seq", "level"]
TILE_KEY = [*PLANE_KEY, "tile"]
VERSION_KEY = [*TILE_KEY, "encoding", "quality"]

FIXED, FLOATING = "FIXEDPOINT", "FLOATINGPOINT"
