"""Run registered queries against their SQL in DuckDB: ``python tests/compare.py <sf dir> [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def bag(rows, columns) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when rows and column names agree, else what differs."""
    got_cols, got = bag([tuple(r) for r in spark_df.collect()], spark_df.columns)
    rel = con.sql(sql)
    want_cols, want = bag(rel.fetchall(), rel.columns)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got == want:
        return None
    extra, lacking = list((got - want).elements()), list((want - got).elements())
    return f"rows {sum(got.values())} vs {sum(want.values())}; only Spark {extra[:3]}; only SQL {lacking[:3]}"


def main() -> int:
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                status = "ok" if problem is None else f"MISMATCH {problem}"
            else:
                n = len(df.collect())
                status, problem = f"rows {n}", None if n else "empty"
        except Exception as e:  # noqa: BLE001
            status = problem = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        bad += problem is not None
        print(f"{name:36s} {time.time() - start:6.1f}s {status}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
