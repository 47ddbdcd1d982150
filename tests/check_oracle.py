"""Command line check: ``python tests/check_oracle.py [sf] [name pattern]``."""

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_point  # noqa: E402
from oracle import compare, connect  # noqa: E402

from eventloom.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    oracles = entry_point.oracle_sql()
    for name, build in entry_point.queries().items():
        if not re.search(pattern, name):
            continue
        start = time.perf_counter()
        try:
            rows, problem = compare(build(spark, sf_dir), con, oracles[name])
        except Exception as error:  # report and go on with the next query
            rows, problem = 0, str(error)[:1500]
        taken = time.perf_counter() - start
        print(f"{'ok' if problem is None else 'MISMATCH'} {name} rows={rows} {taken:.2f}s {problem or ''}", flush=True)
        if problem or not rows:
            failed.append(name)
    print("BAD", failed)
