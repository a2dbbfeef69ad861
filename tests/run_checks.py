"""``python tests/run_checks.py [sf] [name ...]``: run queries against their SQL twins."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from check import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from shelfmark.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, connection = local_session("checks"), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, plan in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            df = plan(spark, sf_dir)
            problems = compare(df, connection, sql) if sql else []
            rows = "" if sql else f" rows={df.count()}"
        except Exception as error:  # noqa: BLE001
            problems, rows = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
            if names:
                traceback.print_exc()
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} {time.time() - start:.1f}s{rows}", *problems, sep="\n     " if problems else "", flush=True)
    print("failed:", bad)
