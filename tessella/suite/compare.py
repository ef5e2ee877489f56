"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import os
import time

import pandas as pd


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET memory_limit='8GB'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(frame: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame()
    for name in sorted(frame.columns):
        column = frame[name]
        if column.dtype.kind == "M":
            column = column.astype("datetime64[us]").astype(str)
        elif column.dtype.kind in "iub":
            column = column.astype(float)
        elif column.dtype.kind == "O":
            column = column.map(lambda v: v if v is None or isinstance(v, str) else str(v))
        out[name] = column
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    frame = fn(spark, sf_dir)
    got = frame.toPandas()
    spent = time.time() - start
    if sql is None:
        return len(got) > 0, f"{name}: {len(got)} rows, no SQL, {spent:.1f}s"
    start = time.time()
    want = con.execute(sql).df()
    note = f"{name}: {len(got)}/{len(want)} rows, {spent:.1f}s (SQL {time.time() - start:.1f}s)"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{note} columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return False, note
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    a, b = _norm(got), _norm(want)
    same = a.equals(b) or all(
        (a[c].astype(object).where(a[c].notna(), None) == b[c].astype(object).where(b[c].notna(), None)).where(
            ~(a[c].isna() & b[c].isna()), True
        ).all()
        for c in a.columns
    )
    if not same:
        bad = [c for c in a.columns if not (a[c].fillna(-9e99 if a[c].dtype.kind == "f" else "") == b[c].fillna(-9e99 if b[c].dtype.kind == "f" else "")).all()]
        row = next((i for c in bad for i in range(len(a)) if a[c][i] != b[c][i] and not (pd.isna(a[c][i]) and pd.isna(b[c][i]))), 0)
        note += f" differ in {bad}: {a.iloc[row].to_dict()} vs {b.iloc[row].to_dict()}"
    return bool(same), note + (f" types {types}" if types else "")


def main() -> int:
    import argparse

    from tessella.session import build_session
    from tessella.suite import load
    from tessella.suite.registry import ORACLE, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    load()
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(args.sf), []
    for name in [n for n in QUERIES if not args.names or any(p in n for p in args.names)]:
        try:
            good, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), args.sf)
        except Exception as error:  # noqa: BLE001 - a report over all queries
            good, note = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        if not good:
            failed.append(name)
        print("ok  " if good else "BAD ", note, flush=True)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    raise SystemExit(main())
