"""Compare registered queries with their SQL: ``python tests/check_oracle.py <sf dir> [name prefix ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float) and v == int(v):
            return repr(int(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf: str, name: str, run, sql: str | None) -> str:
    start = time.time()
    got = run(spark, sf).toPandas()
    spark_time = time.time() - start
    if sql is None:
        return f"rows {len(got)} {spark_time:.1f}s"
    start = time.time()
    want = con.sql(sql).df()
    took = f"{spark_time:.1f}s/{time.time() - start:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return f"ok {len(a)} {took}"
    only_got, only_want = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"FAIL {len(a)} vs {len(b)} {took}\n   spark {str(only_got[:2])[:900]}\n   sql   {str(only_want[:2])[:900]}"


def main() -> None:
    from tests.conftest import session
    from verification.queries import ORACLE, QUERIES

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf)
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            print(name, compare(spark, con, sf, name, run, ORACLE.get(name)), flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", type(e).__name__, str(e)[:700], flush=True)


if __name__ == "__main__":
    main()
