"""Compare every query with its SQL counterpart: ``python -m workload.verify [sf] [names…]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from workload.queries import ORACLES, QUERIES
from workload.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


# Type names of the two engines that count as the same.
SAME_TYPE = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def type_differences(frame, connection, sql: str) -> list[str]:
    theirs = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name}: {kind} / {theirs.get(name)}"
        for name, kind in frame.dtypes
        if SAME_TYPE.get(kind, kind) != theirs.get(name)
    ]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    connection = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            mine = [tuple(r) for r in frame.collect()]
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(mine)} rows, {took:.2f} s", flush=True)
                continue
            started = time.time()
            cursor = connection.execute(ORACLES[name])
            columns = [c[0] for c in cursor.description]
            theirs = cursor.fetchall()
            duck_took = time.time() - started
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
            continue
        a, b = rows_of(frame.columns, mine), rows_of(columns, theirs)
        same = sorted(frame.columns) == sorted(columns) and a == b
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(a)} / {len(b)} rows, {took:.2f} s, sql {duck_took:.2f} s", flush=True)
        for difference in type_differences(frame, connection, ORACLES[name]):
            bad += 1
            print("   type", difference)
        if not same:
            bad += 1
            print("   columns", sorted(frame.columns), sorted(columns))
            pairs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in pairs:
                print("   ", str(x)[:400], "\n   ", str(y)[:400])
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
