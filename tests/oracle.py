"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _text(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v != 0 else 0.0)
    return repr(v)


def compare(df, con, sql: str) -> str | None:
    """None if both sides agree, otherwise what differs."""
    names = sorted(df.columns)
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(described) != names:
        return f"columns {names} against {sorted(described)}"
    kinds = dict(df.dtypes)
    odd = {c: (kinds[c], described[c]) for c in names if TYPES.get(kinds[c]) != described[c]}
    quoted = ", ".join(f'"{c}"' for c in names)
    theirs = [tuple(r) for r in con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()]
    ours = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    a = sorted(tuple(map(_text, r)) for r in ours)
    b = sorted(tuple(map(_text, r)) for r in theirs)
    if a != b:
        first = next((x, y) for x, y in zip(a, b) if x != y)
        count = len(set(a) ^ set(b)) // 2
        return f"{count} of {len(a)} rows differ, columns {names}, first {first[0]} against {first[1]}"
    return f"types {odd}" if odd else None


def main(argv):
    from areapanel.catalog import CATALOG
    from areapanel.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(CATALOG)
    spark, con = local_session(os.environ.get("ORACLE_CPUS", "8")), connect(sf)
    bad, slow = [], []
    for name in wanted:
        q = CATALOG[name]
        start = time.time()
        try:
            df = q.run(spark, sf)
            problem = compare(df, con, q.sql) if q.sql else (None if df.collect() else "no rows")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:400]}"
        took = time.time() - start
        slow.append((took, name))
        if problem:
            bad.append(name)
            print(f"BAD {name} ({took:.1f}s): {problem[:700]}", flush=True)
    print(f"{len(wanted) - len(bad)} of {len(wanted)} agree; bad: {bad}")
    print("slowest:", [f"{n} {t:.1f}" for t, n in sorted(slow, reverse=True)[:15]], "total", round(sum(t for t, _ in slow)))


if __name__ == "__main__":
    main(sys.argv[1:])
