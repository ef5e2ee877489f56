"""Session defaults and the few settings the operators read."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Side tables up to this many rows and bytes (of their rows as text) are broadcast; above either they are joined by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Up to so many times these rows and bytes come from repeating a side table per salt.
SALTED = 8
# Bytes that go to a Python worker in one Arrow batch, about, where `bound_batches` is used.
BATCH_BYTES = 4 << 20


def build_session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; sizes are left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    A folder of our own is made only when the setting is absent and the session is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = os.path.join(tempfile.gettempdir(), f"tessella-{spark.sparkContext.applicationId}")
    os.makedirs(path, exist_ok=True)
    return path


def kept_once(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later steps neither repeat it nor depend on an executor
    that may be gone.  Sessions of `build_session` remove the files when the frame is no longer used."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def join_side_table(
    tiles: DataFrame,
    side: DataFrame,
    on: list[str],
    how: str = "left",
    spread_by: list[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
    spread: int = 32,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a small per-image table to a large tile or request table.

    The side table is written down once and measured; nothing stays in the executors' memory.  Up to ``max_rows`` rows and ``max_bytes`` bytes it is broadcast, so the
    large side does not move.  Above, both sides are hashed on ``on``; the plan's own size estimate, which a compressed file or an
    explode can make far too small, is not asked.  While a few times ``max_rows`` and ``max_bytes`` hold it, the side is repeated per salt
    taken from ``spread_by`` (tile position, say), at most ``spread`` times; a larger one is moved once, and an image holding
    many of the tiles is left to the skew rule of adaptive execution.  The large rows are never repeated.
    """
    side = kept_once(side)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{n}`") for n in side.columns])))
    rows, size = side.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return tiles.join(F.broadcast(side), on, how)
    copies = min(spread, SALTED * max_rows // max(rows, 1), SALTED * max_bytes // max(size, 1))
    if not spread_by or copies < 2:
        return tiles.join(side.hint("merge"), on, how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    keyed = tiles.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(copies)).cast("int"))
    return keyed.join(salted.hint("merge"), [*on, "_salt"], how).drop("_salt")


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], how: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a table of unknown size that is not worth writing down: broadcast if it has up to ``max_rows`` rows and
    ``max_bytes`` bytes (of its rows as JSON text), else both sides are hashed.

    Only the first ``max_rows`` + 1 rows are counted, and measured only if there are no more.
    """
    if table.select(on[0]).limit(max_rows + 1).count() > max_rows:
        return rows.join(table.hint("merge"), on, how)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{n}`") for n in table.columns])))
    size = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return rows.join(F.broadcast(table) if size <= max_bytes else table.hint("merge"), on, how)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches unless the session has a bound of its own.

    Rows of whole texts are several kilobytes, so 10,000 of them, the bound that Spark has besides 64 MB, are tens of
    megabytes that the executor and its Python workers hold several times.  Rows and results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, for sessions on machines where it is not installed."""
    import shutil

    context = spark.sparkContext
    if any(f.endswith("/tessella.zip") for f in context.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tessella-package-")
    archive = shutil.make_archive(os.path.join(folder, "tessella"), "zip", root, "tessella")
    context.addPyFile(archive)
