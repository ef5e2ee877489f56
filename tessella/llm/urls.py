"""URL filters: a trie over reversed host labels, then path segments; the longest matching entry decides.

A rule is a host and a path, written ``host/path``.  It fits its host and all subdomains if the url's path starts
with the rule's.  The longest rule (characters of host and path) wins, a block entry before an equally long allow entry.
Rules are a short list that somebody writes; their size is checked, and a list above ``MAX_RULE_BYTES`` is matched by
an equi-join on (host suffix, path folder) instead of the broadcast trie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import LOWER, UPPER

MAX_RULE_BYTES = 32 << 20
Rule = tuple[str, str]  # "host/path" and "allow" or "block"


def host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))


class Trie:
    """Nodes are dicts from a host label, or from a path segment after the host, to nodes."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = _Node()
        for rule, verdict in rules:
            name, slash, rest = rule.partition("/")
            node = self.root
            for label in reversed(name.split(".")):
                node = node.hosts.setdefault(label, _Node())
            *whole, last = (slash + rest).split("/")
            for segment in whole:
                node = node.paths.setdefault(segment, _Node())
            old = node.ends.get(last)
            node.ends[last] = (rule, "block" if old and old[1] == "block" else verdict)

    def match(self, name: str, where: str) -> tuple[str | None, str | None]:
        best: tuple[int, int, str, str] | None = None
        segments = where.split("/")
        node = self.root
        for label in reversed(name.split(".")):
            node = node.hosts.get(label)
            if node is None:
                break
            at = node
            for segment in segments:
                for part, (rule, verdict) in at.ends.items():
                    if segment.startswith(part):
                        best = max(best or (-1,), (len(rule), verdict == "block", rule, verdict))
                at = at.paths.get(segment)
                if at is None:
                    break
        return (best[2], best[3]) if best else (None, None)


class _Node:
    __slots__ = ("ends", "hosts", "paths")

    def __init__(self) -> None:
        self.hosts: dict[str, _Node] = {}
        self.paths: dict[str, _Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}

    def __getstate__(self):
        return self.hosts, self.paths, self.ends

    def __setstate__(self, state) -> None:
        self.hosts, self.paths, self.ends = state


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (the rule's, else ``default``).

    Columns of ``pages`` with these four names are replaced.  Each row is judged by itself: ties, repeated rows and
    an empty table need no care, a null url has an empty host and path and gets the default.
    """
    rows = pages.withColumns({"host": host(url), "path": path(url)}).drop("rule", "verdict")
    if sum(len(r) + 16 for r, _ in rules) > max_rule_bytes:
        return _judge_by_join(rows, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            found = [trie.match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            arrays = [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "rule", "verdict"])

    return rows.mapInArrow(look, T.StructType([*rows.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def _judge_by_join(rows: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """For rule lists too large for a trie in every task: candidates of a url are its host suffixes times the folders
    of its path that are as deep as some rule's."""
    flat = []
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        folder = (slash + rest)[: (slash + rest).rfind("/") + 1]
        flat.append((name, folder, (slash + rest)[len(folder) :], rule, verdict))
    listed = rows.sparkSession.createDataFrame(flat, "_h string, _d string, _p string, _rule string, _verdict string")
    depths = sorted({d.count("/") for _, d, *_ in flat})
    asked = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_h")
    folders = [F.when(F.size(F.split("path", "/", -1)) > d, F.concat(F.substring_index("path", "/", d), F.lit("/"))) if d else F.lit("") for d in depths]
    wide = asked.select("host", "path", suffix).select("*", F.explode(F.array(*folders)).alias("_d"))
    hits = wide.join(listed, ["_h", "_d"]).where("startswith(path, concat(_d, _p))")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("_rule").alias("l"), (F.col("_verdict") == "block").alias("b"), "_rule", "_verdict")).alias("_best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*[rows[c] for c in rows.columns], F.col("_best._rule").alias("rule"), F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"))
