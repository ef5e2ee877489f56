"""Rasters, catalogues and request tables derived from the star-schema tables.

Each one is a plain projection of whole tables, so work on it grows with the tables.  The matching
DuckDB forms are in ``suite/oracle.py``.

* vectors  : embeddings as 64 wide images of 50 rows (float or 8 bit), one image per 50 vectors
* colour   : the same as 22 wide RGB images (the 66th and 65th sample of a row are 0)
* orders   : one 16-bit image, 128 wide, as high as the table is long
* texts    : each document's UTF-8 bytes as a 64 wide 8-bit image
* bands    : embeddings as one 25 wide image with 64 spectral bands
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.tiles import pixels_to_tiles
from tessella.schema import FIXED, FLOATING

TILE = 16
VECTOR_ROWS = 50
ORDERS_WIDTH = 128
ORDERS_TILE = 32
TEXT_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A source table.  One that comes as fewer splits than there are cores (a single row group, say) is
    dealt out once, because the work per row is what costs here; a table of many splits is left alone.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(slots) if spread and df.rdd.getNumPartitions() * 2 <= slots else df


def _plane(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.lit(v) for c, v in (("h_seq", 0), ("v_seq", 90), ("level", 0)) if c not in df.columns}
    )


def _height(spark: SparkSession, sf_dir: str, name: str, column: str, per_row: int) -> DataFrame:
    """One row with the image height, for use as a scalar; the maximum comes from a column-pruned scan."""
    top = table(spark, sf_dir, name, spread=False).agg(F.max(column).alias("m"))
    return top.select((F.expr(f"m div {per_row}") + 1).cast("int").alias("img_h"))


def vector_pixels(spark: SparkSession, sf_dir: str, kind: str = "float") -> DataFrame:
    """Pixel rows of the vector images: kind 'float', 'grey' or 'rgb'."""
    base = table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {VECTOR_ROWS}").alias("image_id"),
        (F.col("vec_id") % VECTOR_ROWS).cast("int").alias("y"),
        F.posexplode(
            F.concat("embedding", F.expr("array(float(-1), float(-1))")) if kind == "rgb" else "embedding"
        ).alias("x", "v"),
    )
    v = F.col("v").cast("double")
    grey = F.floor((v + 1) * 127.5).cast("int")
    if kind == "rgb":
        base = base.select("image_id", "y", F.expr("cast(x div 3 as int)").alias("x"), (F.col("x") % 3).alias("c"), grey.alias("v"))
    else:
        base = base.select("image_id", "y", "x", F.lit(0).alias("c"), (v if kind == "float" else grey).alias("v"))
    return _plane(base)


def vector_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, img_h: rows of each vector image (the last one may be shorter)."""
    ids = table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {VECTOR_ROWS}").alias("image_id"), (F.col("vec_id") % VECTOR_ROWS).alias("y")
    )
    return ids.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("img_h"))


def vector_tiles(spark: SparkSession, sf_dir: str, kind: str = "float", tile: int = TILE) -> DataFrame:
    """Tile form of the vector images.  Vectors are cut and grouped as arrays, not as pixels."""
    per_tile = tile * (3 if kind == "rgb" else 1)
    channels, width = (3, 22) if kind == "rgb" else (1, 64)
    wide = F.concat("embedding", F.expr("array(float(-1), float(-1))")) if kind == "rgb" else F.col("embedding")
    strips = table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {VECTOR_ROWS}").alias("image_id"),
        (F.col("vec_id") % VECTOR_ROWS).cast("int").alias("y"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(-(-width // tile) - 1)), lambda t: F.slice(wide, t * per_tile + 1, per_tile)
            )
        ).alias("tx", "s"),
    )
    ntx = -(-width // tile)
    rows = (
        _plane(strips)
        .withColumn("ty", F.expr(f"cast(y div {tile} as int)"))
        .groupBy("image_id", "h_seq", "v_seq", "level", "tx", "ty")
        .agg(F.array_sort(F.collect_list(F.struct("y", "s"))).alias("r"))
        .select(
            "image_id", "h_seq", "v_seq", "level",
            (F.col("ty") * ntx + F.col("tx")).alias("tile"), "tx", "ty",
            (F.size(F.col("r")[0]["s"]) / channels).cast("int").alias("width"),
            F.size("r").alias("height"),
            F.lit(channels).alias("channels"),
            F.flatten(F.transform("r", lambda r: r["s"])).alias("s"),
        )
    )
    return _array_tiles(rows, "float" if kind == "float" else "grey")


def _array_tiles(rows: DataFrame, kind: str) -> DataFrame:
    """Turn the sample array ``s`` of float vectors into tile bytes."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    bpc, sample_type = (32, FLOATING) if kind == "float" else (8, FIXED)
    keep = [f for f in rows.schema if f.name != "s"]
    out = T.StructType(
        [*keep, T.StructField("bpc", T.IntegerType()), T.StructField("sample_type", T.StringType()), T.StructField("data", T.BinaryType())]
    )
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("s"))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            if kind != "float":
                values = np.floor((values.astype(np.float64) + 1) * 127.5).astype(np.uint8)
            data = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            n = batch.num_rows
            columns = [batch.column(batch.schema.get_field_index(k)) for k in names]
            columns += [pa.array([bpc] * n, pa.int32()), pa.array([sample_type] * n), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "bpc", "sample_type", "data"])

    return rows.mapInArrow(run, out)


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit pixels of the one large image; only samples that exist."""
    return _plane(
        table(spark, sf_dir, "orders").select(
            F.lit(0).cast("long").alias("image_id"),
            F.expr(f"cast(o_orderkey div {ORDERS_WIDTH} as int)").alias("y"),
            (F.col("o_orderkey") % ORDERS_WIDTH).cast("int").alias("x"),
            F.lit(0).alias("c"),
            (F.floor(F.col("o_totalprice") * 100).cast("long") % 65536).cast("int").alias("v"),
        )
    )


def order_tiles(spark: SparkSession, sf_dir: str, tile: int = ORDERS_TILE) -> DataFrame:
    height = _height(spark, sf_dir, "orders", "o_orderkey", ORDERS_WIDTH)
    pixels = order_pixels(spark, sf_dir).withColumn("img_h", height.scalar())
    return pixels_to_tiles(pixels, tile, tile, F.lit(ORDERS_WIDTH), F.col("img_h"), 1, 16, FIXED)


def band_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(
        table(spark, sf_dir, "embeddings").select(
            F.lit(0).cast("long").alias("image_id"),
            F.expr("cast(vec_id div 25 as int)").alias("y"),
            (F.col("vec_id") % 25).cast("int").alias("x"),
            F.lit(0).alias("c"),
            F.posexplode("embedding").alias("h_seq", "v"),
        )
    ).withColumn("v", F.col("v").cast("double"))


def band_tiles(spark: SparkSession, sf_dir: str, tile: int = 8) -> DataFrame:
    height = _height(spark, sf_dir, "embeddings", "vec_id", 25)
    pixels = band_pixels(spark, sf_dir).withColumn("img_h", height.scalar())
    return pixels_to_tiles(pixels, tile, tile, F.lit(25), F.col("img_h"), 1, 32, FLOATING)


def text_tiles(spark: SparkSession, sf_dir: str, tile: int = TEXT_WIDTH) -> DataFrame:
    """Whole documents as 8-bit tiles, cut from the UTF-8 bytes inside the JVM."""
    area = TEXT_WIDTH * tile
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("b")
    )
    docs = docs.withColumn("img_h", F.ceil(F.octet_length("b") / TEXT_WIDTH).cast("int")).where("img_h > 0")
    cut = docs.select(
        "image_id", "img_h", "b", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("img_h") / tile) - 1).cast("int"))).alias("ty")
    )
    height = F.least(F.lit(tile), F.col("img_h") - F.col("ty") * tile).cast("int")
    return _plane(cut).select(
        "image_id", "h_seq", "v_seq", "level", F.col("ty").alias("tile"), F.lit(0).alias("tx"), "ty",
        F.lit(TEXT_WIDTH).alias("width"), height.alias("height"), F.lit(1).alias("channels"),
        F.lit(8).alias("bpc"), F.lit(FIXED).alias("sample_type"),
        F.rpad(F.substring(F.col("b"), F.col("ty") * area + 1, F.lit(area)), height * TEXT_WIDTH, F.lit(bytearray(b"\0"))).alias("data"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image headers: one per order, with sizes, depths and metadata taken from its columns."""
    k = F.col("o_orderkey")
    bpc = F.element_at(F.array(*map(F.lit, (8, 12, 16, 32, 8))), (k % 5 + 1).cast("int"))
    channels = F.element_at(F.array(*map(F.lit, (3, 1, 4))), (k % 3 + 1).cast("int"))
    floating = (bpc == 32) & (k % 2 == 0)
    return table(spark, sf_dir, "orders").select(
        k.alias("image_id"),
        F.format_string("/img/%d/%s.tif", F.col("o_custkey"), k.cast("string")).alias("path"),
        F.lit("TIFF").alias("format"),
        F.col("o_orderdate").alias("mtime"),
        (F.floor("o_totalprice").cast("long") % 9000 + 1).cast("int").alias("width"),
        ((F.col("o_custkey") * 37 + k * 11) % 7000 + 1).cast("int").alias("height"),
        channels.alias("channels"),
        bpc.alias("bpc"),
        F.when(floating, FLOATING).otherwise(FIXED).alias("sample_type"),
        F.when(channels == 1, "GREYSCALE").when(k % 7 == 0, "CIELAB").otherwise("sRGB").alias("colorspace"),
        F.when(k % 4 == 0, 0.0).otherwise(72.0 + k % 5 * 57).cast("float").alias("dpi_x"),
        F.when(k % 4 == 0, 0.0).otherwise(72.0 + k % 3 * 57).cast("float").alias("dpi_y"),
        (k % 3).cast("int").alias("dpi_units"),
        F.create_map(
            F.lit("rights"), F.when(k % 2 == 0, F.concat(F.lit("(c) "), "o_orderpriority")).otherwise(""),
            F.lit("title"), F.concat(F.lit("order "), k.cast("string")),
            F.lit("creator"), F.col("o_orderstatus"),
        ).alias("metadata"),
        F.when(k % 3 == 1, F.encode("o_orderpriority", "UTF-8")).alias("icc"),
    )


def view_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewport requests: one per line item, on the image of its order."""
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_discount") * 8).alias("rx"),
        (F.col("l_tax") * 9).alias("ry"),
        (q / 40.0).alias("rw"),
        (F.col("l_partkey") % 64 / 50.0).alias("rh"),
        F.when(q % 3 == 0, 0).otherwise(F.col("l_partkey") % 900 + 1).cast("int").alias("wid"),
        F.when(q % 4 == 0, 0).otherwise(F.col("l_suppkey") * 13 % 700 + 1).cast("int").alias("hei"),
        (q % 4 * 90).alias("rot"),
        (q % 5 == 0).alias("maintain_aspect"),
        (q % 2 == 0).alias("allow_upscaling"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: one query string per event."""
    e, u = F.col("event_id"), F.col("user_id")

    def pick(modulus: int, *choices: str):
        chain = F.lit(choices[-1])
        for i, choice in reversed(list(enumerate(choices[:-1]))):
            chain = F.when(e % modulus == i, choice).otherwise(chain)
        return chain

    q = F.concat(
        F.lit("FIF=/img/"), (u % 10).cast("string"), F.lit(".tif&WID="), (8 + e % 56).cast("string"),
        F.lit("&rgn="), (e % 5).cast("string"), F.lit("e-1,0,0.5,0.5"),
        pick(7, "&ROT=90", "&ROT=!180", "&HEI=12px", "&HEI=20&hei=30", ""),
        pick(6, "&CNT=1.5", "&CNT=stretch", "&CNT=EQ", "&GAM=2.2", "&GAM=log", ""),
        pick(11, "&INV=1", "&CMP=JET", "&SHD=45,30", "&CTW=%5B1,0,0;0,1,0;0,0,1%5D", "&CNV=[sobel]", "&COL=gray",
             "&MINMAX=0:5,200", "&SDS=3,90", "&QLT=80", "&MINMAX=-:1e1,2.5e2&FOO=1&=x&BAR=", "&SPECTRA=0,0,1,2"),
        F.lit("&CVT="), F.when(e % 2 == 0, "png").otherwise("tiff"),
    )
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", q.alias("q"))
