"""Run catalog queries in Spark and their SQL in DuckDB and compare every value."""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
        "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else (value if value != int(value) else float(int(value)))
    return value


def rows_of(rows, order) -> Counter:
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, build, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    df = build(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    want = con.execute(sql).fetchall()
    names = list(types)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    kinds = {c: (t, types[c]) for c, t in df.dtypes if SAME.get(t) != types[c]}
    if kinds:
        return f"types {kinds}"
    columns = sorted(names)
    a = rows_of(got, [df.columns.index(c) for c in columns])
    b = rows_of(want, [names.index(c) for c in columns])
    if a != b:
        left, right = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"{len(got)} vs {len(want)} rows, {sum((a - b).values())} differ\n  {columns}\n  spark {left}\n  duck  {right}"
    if not got:
        return "EMPTY"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    from tests.session import make_session

    from fleetlens.catalog.queries import ORACLE, QUERIES

    spark, con, bad = make_session(), connect(sf_dir), 0
    for name, build in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, build, ORACLE.get(name), sf_dir)
        except Exception:  # noqa: BLE001
            problem = traceback.format_exc(limit=-2)[-700:]
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
