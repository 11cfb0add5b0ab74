"""Headline timings: prints one JSON line with the seconds of each query."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from seatwise import fixtures
from seatwise.catalog import QUERIES

HEADLINE = [
    "recommend",
    "match_programs",
    "match_programs_split",
    "top_n",
    "last_round_programs",
    "last_round_history",
    "last_round_clean",
    "last_round_notebook",
    "program_history",
    "branch_tags",
    "home_state_advantage",
    "spread_profile",
    "reason_text",
    "college_groups",
    "choice_toggle",
    "choice_reorder",
    "linked_profiles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM side and the Python workers before the first timing
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    # the seat table that most queries share is built once and timed apart
    start = time.time()
    seats = fixtures.seats(spark, sf_dir)
    fixtures.seats = lambda *_: seats
    seconds = {"setup_seats": round(time.time() - start, 3)}
    # as are the raw rows, which the last-round queries read
    start = time.time()
    fixtures.raw_cutoffs(spark, sf_dir)
    seconds["setup_raw"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
