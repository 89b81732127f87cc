"""Run queries and their oracles side by side.

    python tests/compare.py sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    got = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} vs oracle {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows vs oracle {len(want)}"
    for a, b in zip(_sorted(got), _sorted(want)):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{names}: {a} vs oracle {b}"
    return None


def types_differ(df, con, sql: str) -> str | None:
    alike = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    }
    have = {f.name: alike.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {n: (have[n], want.get(n)) for n in have if have[n] != want.get(n)}
    return f"types {wrong}" if wrong else None


def main() -> int:
    from postlake.plans.registry import load_all
    from postlake.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"{DATA}/{sf}"
    spark = local_session(cores="8")
    registered = load_all()
    bad = 0
    for name, q in registered.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = q(spark, sf_dir)
            if q.oracle is None:
                print(f"rows {name} {df.count()} {time.time() - start:.1f}s", flush=True)
                continue
            con = oracle_connection(sf_dir)
            message = compare(df, con, q.oracle) or types_differ(df, con, q.oracle)
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        took = time.time() - start
        if message:
            bad += 1
            print(f"DIFF {name} {took:.1f}s {message[:900]}", flush=True)
        else:
            print(f"ok   {name} {took:.1f}s", flush=True)
    print(f"{bad} differ", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
