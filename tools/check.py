"""Run registered queries next to their SQL and compare the results.

    python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time
import traceback

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import logging

logging.disable(logging.CRITICAL)

from memlake import build_session  # noqa: E402
from memlake.catalog import oracle_sql, queries  # noqa: E402


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "as_integer_ratio"):
        return round(float(value), 6)
    return str(value)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--skip-sql", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", {
        "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8",
        "spark.log.level": "OFF", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for path in sorted(pathlib.Path(args.sf).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    sql, failed = oracle_sql(), []
    for name, run in queries().items():
        if args.names and name not in args.names:
            continue
        try:
            begin = time.time()
            frame = run(spark, args.sf)
            columns = sorted(frame.columns)
            got = frame.select(columns).collect()
            took = time.time() - begin
            note = f"{len(got)} rows {took:.1f}s"
            if name in sql and not args.skip_sql:
                begin = time.time()
                cursor = db.execute(sql[name])
                names = [d[0] for d in cursor.description]
                order = sorted(range(len(names)), key=lambda i: names[i])
                want = [tuple(normal(r[i]) for i in order) for r in cursor.fetchall()]
                mine = [tuple(map(normal, r)) for r in got]
                note += f" sql {time.time() - begin:.1f}s"
                if sorted(names) != columns:
                    note += f" COLUMNS {sorted(names)} != {columns}"
                    failed.append(name)
                else:
                    key = lambda r: tuple((v is None, str(v)) for v in r)
                    mine.sort(key=key), want.sort(key=key)
                    if mine != want:
                        failed.append(name)
                        only = [r for r in mine if r not in set(want)][:2]
                        lack = [r for r in want if r not in set(mine)][:2]
                        note += f" DIFFERS spark={len(mine)} sql={len(want)}\n   + {str(only)[:600]}\n   - {str(lack)[:600]}"
                    else:
                        note += " ok"
            elif name not in sql:
                note += " (rows only)"
            print(f"{name}: {note}", flush=True)
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"{name}: FAILED {type(error).__name__} {str(error)[:500]}", flush=True)
            if "--trace" in sys.argv:
                traceback.print_exc()
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
