"""Runs registered queries beside their SQL in DuckDB and reports differences.

    python compare.py [sf_dir] [name ...]
"""
from __future__ import annotations

import sys
import time

import duckdb

from reqlens.session import local_session
from registry import ORACLE, QUERIES, load_all

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    load_all()
    names = argv[1:] or list(QUERIES)
    spark = local_session("8", spark__sql__streaming__stateStore__providerClass=(
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got = rows_of(df.columns, df.collect())
        except Exception as e:
            print(f"ERROR {name}: {str(e)[:600]}", flush=True)
            bad += 1
            continue
        took = f"{time.time() - start:5.1f}s {len(got):6d} rows"
        if name not in ORACLE:
            print(f"rows  {name:26s} {took}", flush=True)
            continue
        try:
            cur = db.execute(ORACLE[name])
            columns = [d[0] for d in cur.description]
            want = rows_of(columns, cur.fetchall())
        except Exception as e:
            print(f"SQL   {name}: {str(e)[:600]}", flush=True)
            bad += 1
            continue
        if sorted(columns) == sorted(df.columns) and got == want:
            print(f"ok    {name:26s} {took}", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name} {took}, expected {len(want)}; columns {sorted(df.columns)} "
              f"{sorted(columns)}", flush=True)
        apart = [(g, w) for g, w in zip(got, want) if g != w][:3]
        for g, w in apart:
            print("   got ", str(g)[:300], "\n   want", str(w)[:300], flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
