"""Neighbourhood operators on pixel rows, for tables that are not kept as tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def convolve_pixels(pixels: DataFrame, sizes: DataFrame, kernel: list[float]) -> DataFrame:
    """Square odd kernel over pixel rows (image_id, y, x, c, v) of images sized img_w x img_h.

    No self join: a sample is sent with its weight to each output place that reads it (edges repeat,
    so a border sample serves several places of the window) and the sums combine before the shuffle.
    """
    side = int(round(len(kernel) ** 0.5))
    half, total = side // 2, float(sum(kernel))
    weights = F.array(*[F.struct(F.lit(i % side - half).alias("dx"), F.lit(i // side - half).alias("dy"), F.lit(float(w)).alias("k")) for i, w in enumerate(kernel) if w])
    sized = pixels.join(sizes, "image_id")
    taps = sized.withColumn("t", F.explode(weights)).select("*", "t.dx", "t.dy", "t.k").drop("t")

    def reach(at, d, size):
        """Output positions whose tap ``d`` reads this sample: one, or a run for a border sample."""
        first = F.when(at == 0, 0).otherwise(F.greatest(at - d, F.lit(0)))
        last = F.when(at == size - 1, size - 1).otherwise(F.least(at - d, size - 1))
        return F.when(first <= last, F.sequence(first, last))

    sent = taps.withColumn("oy", F.explode(reach(c("y"), c("dy"), c("img_h")))).withColumn("ox", F.explode(reach(c("x"), c("dx"), c("img_w"))))
    out = sent.groupBy("image_id", c("oy").alias("y"), c("ox").alias("x"), "c").agg(F.sum(c("k") * c("v")).alias("v"))
    return out.withColumn("v", c("v") / total) if total > 0 else out
