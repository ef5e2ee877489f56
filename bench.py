"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads.
Each query is run to a sink that takes every row; sessions are warmed up by one small query first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessella import fixtures as fx
from tessella.session import build_session
from tessella.suite import load
from tessella.suite.registry import QUERIES

HEADLINE = [
    "histogram", "histogram_texts", "histogram_deep", "otsu_threshold", "binary_white_pixels", "equalize", "contrast_stretch",
    "gamma", "gamma_pixels", "normalize", "greyscale", "twist", "colormap_jet", "lab_to_srgb", "hillshade",
    "resize_nearest_100x90", "resize_bilinear_100x90", "convolve_gaussian", "convolve_pixels", "build_pyramid", "build_pyramid_large",
    "retile_texts", "rotate_90", "choose_level", "tile_cover", "tile_demand", "spectrum", "profile", "spectral_cube",
    "render_regions", "render_tiles", "log_commands", "log_to_requests", "latest_tile", "scan_tiff_16bit", "export_collection",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    load()
    names = sys.argv[1:] or HEADLINE
    QUERIES["histogram"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds, rates = {}, {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    vectors = fx.table(spark, folder, "embeddings").count() * 64
    texts = fx.table(spark, folder, "documents").selectExpr("sum(octet_length(encode(text, 'UTF-8'))) AS n").first()["n"]
    pixels = {"histogram": vectors, "gamma": vectors, "convolve_gaussian": vectors, "resize_bilinear_100x90": vectors, "histogram_texts": texts, "retile_texts": texts}
    rates = {k: round(n / seconds[k]) for k, n in pixels.items() if k in seconds}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "pixels_per_second": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
