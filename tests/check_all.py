"""Run every registered query against its oracle: python tests/check_all.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tests.oracle import compare, connect  # noqa: E402
from weirflow.plans.catalog import QUERIES  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or list(QUERIES):
        q = QUERIES[name]
        start = time.time()
        try:
            if q.oracle is None:
                count, why = q.plan(spark, sf_dir).count(), "no oracle"
            else:
                count, why = compare(spark, sf_dir, q, con)
        except Exception as error:  # noqa: BLE001
            count, why = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        good = why in ("", "no oracle")
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} rows={count} {time.time() - start:.1f}s {why}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
