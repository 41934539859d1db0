"""Run registered queries and their SQL side by side: python tools/compare.py [sf] [name prefix ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v: object) -> str:
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return str(v)
    return str(v)


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


KIND = {
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "HUGE", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str",
    "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts", "SMALLINT": "int",
    "bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool", "date": "date",
    "timestamp": "ts", "timestamp_ntz": "ts",
}


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} rows {t1 - t0:.2f}s"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    t2 = time.time()
    info = f"{len(got)} rows spark {t1 - t0:.2f}s duckdb {t2 - t1:.2f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    for c, ty in df.dtypes:
        a, b = KIND.get(ty, ty), KIND.get(types[c], types[c])
        if a != b:
            return False, f"type of {c}: {ty} vs {types[c]} ({info})"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{info} / {len(want)}: only spark {sorted(sa - sb)[:3]} only duckdb {sorted(sb - sa)[:3]}"
    return True, info + ("" if got else " EMPTY")


def main() -> int:
    from quillmeter.plans.catalog import ORACLES, QUERIES
    from quillmeter.session import local_session

    sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, msg = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(("ok  " if ok else "BAD ") + name, msg if len(msg) < 1500 else msg[:1500], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
