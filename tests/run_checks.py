"""python tests/run_checks.py FOLDER [NAME..]: compare queries with their SQL, with timings."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from spectrafold.session import configure  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = configure(
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, checks = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            verdict = (
                compare(df, con, checks[name]) if name in checks
                else f"no SQL, {len(df.collect())} rows"
            )
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(verdict) and not verdict.startswith("no SQL")
        print(f"{name:32s} {time.time() - start:6.2f}s  {verdict or 'equal'}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
