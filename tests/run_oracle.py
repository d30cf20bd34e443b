"""Run every registered query at an sf dir and compare with its DuckDB oracle.

usage: python tests/run_oracle.py [sf_dir] [key ...]
"""
import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402
from quarry.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = build_session()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf)
    results = {}
    for k in (keys or sorted(qs)):
        t = time.time()
        try:
            df = qs[k](spark, sf)
            if k in os_:
                probs, n = compare(df, con, os_[k])
                status = "ok" if not probs else "FAIL"
            else:
                n = df.count()
                probs, status = [], "rows-only"
        except Exception as e:  # noqa: BLE001
            probs, status, n = [traceback.format_exc(limit=3)[-1500:]], "ERROR", -1
        results[k] = status
        print(f"{status:9s} {k:28s} rows={n} {time.time()-t:.1f}s", *probs, flush=True)
    bad = [k for k, v in results.items() if v in ("FAIL", "ERROR")]
    print(json.dumps({"total": len(results), "bad": bad}))
    spark.stop()


if __name__ == "__main__":
    main()
