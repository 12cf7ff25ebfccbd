"""CLI: compare every catalog query with its DuckDB oracle.

    python tests/run_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_util import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tarmac.session import build_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        if name in sqls:
            res = compare(df, con, sqls[name])
        else:
            res = {"rows": df.count(), "match": None}
        res["sec"] = round(time.time() - t0, 2)
        if res.get("match") is False:
            bad += 1
        print(name, json.dumps(res, default=str)[:1500], flush=True)
    print("MISMATCHES", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
