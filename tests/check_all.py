"""Compare every registered query with its SQL: python tests/check_all.py [sf] [name...]"""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from ledgerlake.session import local_session  # noqa: E402
from ledgerlake.suite import ORACLES, QUERIES  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = differences(QUERIES[name](spark, sf_dir), connection, ORACLES[name])
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", *problems)
    print(f"{len(names) - failed} of {len(names)} agree at sf{sf}")
