"""Runs queries against their SQL in DuckDB: python tests/check_oracle.py [--sf 0.01] [name ...]"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from litevidence.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(normal(row[i]) for i in order) for row in rows), key=repr
    )


def connect(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def oracle_result(db, sql: str):
    cursor = db.execute(sql)
    return as_rows([d[0] for d in cursor.description], cursor.fetchall())


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, db, bad = local_session(8), connect(sf_dir), 0
    sqls = oracle_sql()
    for name, build in queries().items():
        if name not in sqls or args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            got = as_rows(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            want = oracle_result(db, sqls[name])
            ok = got == want
            note = ""
            if not ok:
                have, need = set(got[1]), set(want[1])
                missing = [r for r in want[1] if r not in have][:2]
                extra = [r for r in got[1] if r not in need][:2]
                note = f"\n   cols {got[0]} / {want[0]}\n   missing {missing}\n   extra {extra}"
            print(f"{'ok  ' if ok else 'DIFF'} {name} {len(got[1])}/{len(want[1])} rows {took:.2f}s{note}", flush=True)
        except Exception as error:  # noqa: BLE001
            ok = False
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
        bad += not ok
    print("all equal" if not bad else f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
