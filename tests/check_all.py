"""Compare every registered query with its oracle: python -m tests.check_all [sf_dir] [names]."""

import sys
import time

from kinweave.plans.catalog import QUERIES
from kinweave.plans.oracle import ORACLE
from kinweave.session import build_session
from tests.compare import connect, difference


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.perf_counter()
        try:
            diff = difference(spark, con, name, sf_dir, QUERIES[name], ORACLE[name])
        except Exception as error:
            diff = f"{name}: {type(error).__name__} {str(error)[:1500]}"
        failed += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {time.perf_counter() - start:6.2f}s {diff or name}")
    print(f"{failed} of {len(names)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main())
