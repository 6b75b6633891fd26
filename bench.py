"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``RUNS`` times into a sink that takes
every row; the median counts. The key checks also run on generated keys of
3,000,000 rows, the row count of the reference's own benchmarks.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

RUNS = 3
ROWS = 3_000_000


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pactum.operators import keys
    from pactum.plans import catalogue
    from pactum.sources.footers import read_footers

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = tempfile.mkdtemp(prefix="pactum-bench-")
    generated = spark.range(ROWS).select(
        "id", F.format_string("CODE-%08d", "id").alias("code"), F.format_string("G%04d", F.col("id") % 1000).alias("part_a"), F.format_string("R%08d", "id").alias("part_b")
    )
    generated.write.mode("overwrite").parquet(f"{made}/keys")  # a file per core, so that all of them have rows
    path = f"{made}/keys"

    def unique(*columns: str):
        footers = read_footers(spark, path)
        return keys.duplicate_count(spark.read.parquet(path), [F.col(x) for x in columns], [keys.known_range(footers, x) for x in columns])

    def reference(column: str):
        child, parent = spark.read.parquet(path), spark.read.parquet(path)
        kind = parent.schema[column].dataType
        known = keys.known_range(read_footers(spark, path), column)
        return keys.orphan_count(child, F.col(column), kind, parent, F.col(column), kind, (known, known))

    q = catalogue.queries()
    runs = {
        "unique_int_3m": lambda: unique("id"), "unique_string_3m": lambda: unique("code"), "unique_composite_3m": lambda: unique("part_a", "part_b"),
        "foreign_key_int_3m": lambda: reference("id"), "foreign_key_string_3m": lambda: reference("code"),
    }
    for name in ("assertions_fused", "d02_unique_key", "d02_composite_key", "d05_fk_clean", "d04_enum_outside", "agg_all", "agg_mixed_grain", "expr_columns_regex", "profile_numeric", "profile_text", "validate_data"):
        runs[name] = lambda name=name: q[name](spark, sf_dir)
    times = {}
    for name, make in runs.items():
        taken = []
        for k in range(RUNS + 1):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            if k:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 4)
    spark.stop()
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
