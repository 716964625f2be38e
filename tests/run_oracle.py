"""Run every registered query against its DuckDB oracle and report.

Usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402

from alertspark.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_spark("local[8]", 8)
    con = duck(sf)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in orc:
                problems, n = compare(df, con, orc[name])
            else:
                problems, n = [], df.count()
            status = "OK " if not problems else "BAD"
            if problems:
                bad += 1
            tag = "" if name in orc else " (rows only)"
            print(f"{status} {name:28s} rows={n:<7d} {time.time() - t:6.2f}s{tag} {'; '.join(problems)[:900]}",
                  flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            msg = "".join(traceback.format_exception_only(type(exc), exc)).strip().splitlines()[0]
            print(f"ERR {name:28s} {msg[:900]}", flush=True)
    print(f"done: {len(qs)} queries, {bad} failing")


if __name__ == "__main__":
    main()
