"""Time, rows read and bytes shuffled of the headline queries: python tests/measure.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import bench  # noqa: E402


def stages(spark: SparkSession) -> dict[int, tuple[int, int]]:
    """Input records and shuffle bytes written, by stage."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    store = spark.sparkContext._jsc.sc().statusStore()
    seq = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    found = (seq.apply(i) for i in range(seq.size()))
    return {s.stageId(): (s.inputRecords(), s.shuffleWriteBytes()) for s in found}


def main(sf_dir: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    print("| Query | Seconds (median of 3) | Rows read | Shuffled MB |\n|---|---|---|---|")
    for name in names or bench.HEADLINE:
        bench.run(spark, name, sf_dir)
        before = set(stages(spark))
        times = sorted(bench.run(spark, name, sf_dir) for _ in range(3))
        time.sleep(0.3)  # the status store is filled by a listener
        new = [v for k, v in stages(spark).items() if k not in before]
        rows, moved = (sum(x) // 3 for x in zip(*new))
        print(f"| {name} | {times[1]:.2f} | {rows:,} | {moved / 1e6:.1f} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", sys.argv[2:])
