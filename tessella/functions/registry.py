"""SQL functions of this library.

The scalar ones are SQL-defined, so Catalyst inlines them into the calling query.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = {
    "tile_normalize": ("v DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE", "(v - lo) * CASE WHEN abs(hi - lo) > 1e-30 THEN 1 / (hi - lo) ELSE 1e30 END"),
    "tile_gamma": ("v DOUBLE, g DOUBLE", "DOUBLE", "CASE WHEN g = 1 THEN v ELSE pow(greatest(v, 0D), g) END"),
    "tile_log": ("v DOUBLE", "DOUBLE", "ln(1 + 255 * v) / ln(256D)"),
    "tile_invert": ("v DOUBLE", "DOUBLE", "1 - v"),
    "tile_contrast": ("v DOUBLE, k DOUBLE", "INT", "cast(floor(least(greatest(v * 255 * k, 0D), 255D)) AS INT)"),
    "tile_grey": ("r INT, g INT, b INT", "INT", "shiftright(1254097 * r + 2462056 * g + 478151 * b, 22)"),
    "tile_binary": ("v INT, t INT", "INT", "CASE WHEN v < t THEN 0 ELSE 255 END"),
    "tile_number": ("x INT, y INT, tile_w INT, tile_h INT, ntx INT", "INT", "cast(y div tile_h * ntx + x div tile_w AS INT)"),
}


# Table function: tiles of a w x h level that the region (x, y, rw, rh) touches.
COVER = """CREATE OR REPLACE TEMPORARY FUNCTION tile_cover(w INT, h INT, tw INT, th INT, x INT, y INT, rw INT, rh INT)
    RETURNS TABLE(tx INT, ty INT, tile INT)
    RETURN SELECT a.tx, b.ty, cast(b.ty * ceil(w / tw) + a.tx AS INT)
      FROM explode(filter(sequence(0, cast(ceil(w / tw) AS INT)), i -> i >= x div tw AND i < ceil(least(x + rw, w) / tw))) AS a(tx),
           explode(filter(sequence(0, cast(ceil(h / th) AS INT)), i -> i >= y div th AND i < ceil(least(y + rh, h) / th))) AS b(ty)"""


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.sql(COVER)
    return [*SCALARS, "tile_cover"]
