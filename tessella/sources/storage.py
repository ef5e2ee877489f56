"""Opening files from tasks."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote

from pyarrow import fs


# Names that Spark's connectors use for stores that Arrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "viewfs": "hdfs"}


def qualified(spark, path: str) -> str:
    """The path with its scheme, as Spark resolves it; to be asked on the driver before a path goes to tasks."""
    if "://" in path or path.startswith("file:"):
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a URI as Spark writes it (file:/x, hdfs://, s3://) or a plain path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    scheme, mark, rest = path.partition("://")
    if mark:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.LocalFileSystem(), path


def open_path(path: str):
    where, name = locate(path)
    return where.open_input_file(name)


def write_path(path: str, data: bytes) -> None:
    """Write under a hidden name, then move: a task that is run again leaves whole files only."""
    import uuid

    where, name = locate(path)
    folder, leaf = posixpath.split(name)
    where.create_dir(folder, recursive=True)
    draft = posixpath.join(folder, f".{leaf}.{uuid.uuid4().hex}")
    with where.open_output_stream(draft) as out:
        out.write(data)
    where.move(draft, name)
