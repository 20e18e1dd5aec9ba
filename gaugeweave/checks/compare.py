"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when columns, types by family, row count and all values agree."""
    cur = con.execute(sql)
    sql_cols = [d[0] for d in cur.description]
    sql_types = {d[0]: str(d[1]) for d in cur.description}
    sql_rows = cur.fetchall()
    cols = list(spark_df.columns)
    if sorted(cols) != sorted(sql_cols):
        return [f"columns {sorted(set(cols) ^ set(sql_cols))}"]
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    issues = [
        f"type {c}: {t} / {sql_types[c]}" for c, t in spark_df.dtypes if names.get(t, t).upper() != sql_types[c].upper()
    ]
    rows = [tuple(r) for r in spark_df.collect()]
    left, right = canonical(rows, cols), canonical(sql_rows, sql_cols)
    if len(left) != len(right):
        issues.append(f"rows {len(left)} / {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        issues.append(f"columns in order {sorted(cols)}")
        issues += [f"only spark {x}" for x in sorted(a - b)[:3]] + [f"only sql {x}" for x in sorted(b - a)[:3]]
        if a == b:
            issues.append("row multiplicities differ")
    return issues


def main(sf_dir: str, names: list[str]) -> int:
    from gaugeweave.checks.registry import oracle_sql, queries
    from gaugeweave.session import local_session

    spark, con = local_session(), connect(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, query in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                issues = differences(df, con, oracles[name])
                n = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
            else:
                n, issues = df.count(), []
        except Exception as e:  # noqa: BLE001 - a report of all failures is wanted
            n, issues = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(issues)
        print(f"{'FAIL' if issues else 'ok  '} {name} rows={n} {time.time() - began:.1f}s"
              f"{'' if name in oracles else ' (no sql)'}", flush=True)
        for i in issues:
            print("     ", i[:1500])
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
