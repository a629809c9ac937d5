"""Runs registered queries against their SQL in DuckDB."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, run, text: str, sf_dir: str) -> str | None:
    """NULL when both sides agree, otherwise what differs first."""
    df = run(spark, sf_dir)
    rows = df.collect()
    result = con.sql(text)
    expected = result.fetchall()
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} != {sorted(result.columns)}"
    mine, theirs = canonical(df.columns, rows), canonical(result.columns, expected)
    if mine == theirs:
        return None if rows else "both empty"
    return f"{len(rows)} vs {len(expected)} rows; only here {list((mine - theirs))[:2]}; only there {list((theirs - mine))[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    session, con, texts = local_session("8"), oracle(sf), oracle_sql()
    for name, run in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            problem = compare(session, con, run, texts[name], sf) if name in texts else f"rows {run(session, sf).count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__} {str(error)[:600]}"
        print(f"{name:28s} {time.time() - began:6.1f}s {problem or 'ok'}", flush=True)
