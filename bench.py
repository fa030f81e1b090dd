"""Times the headline queries: one JSON line with seconds by query, build throughput and index size.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 3: the median counts).
What is timed is code that has run before, the build on the small benchmark table.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

from lexispark import queries as q
from lexispark.operators import build_index
from lexispark.sources import open_index, save_index
from lexispark.sources.store import size_in_bytes

HEADLINE = (
    "search_term_common search_term_rare search_and2 search_and3 search_or3 search_or_pruned search_phrase2 search_phrase_repeated "
    "count_term count_and count_or count_phrase batch_search_topk term_stats"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, repeat = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPEAT", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = f"{tempfile.gettempdir()}/lexispark-bench-{uuid.uuid4().hex}"
    save_index(build_index(q.corpus(spark, sf_dir, "benchmark")), warm)  # compiles the code that is timed below
    shutil.rmtree(warm, ignore_errors=True)
    path = f"{tempfile.gettempdir()}/lexispark-bench-{uuid.uuid4().hex}"
    began = time.perf_counter()
    save_index(build_index(q.corpus(spark, sf_dir)), path)
    build = time.perf_counter() - began
    index = open_index(spark, path)
    docs = index.stats.first().n_docs
    seconds = {"index_build": round(build, 3)}
    for name in HEADLINE:
        q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # code is compiled, the index of the session is there
        times = []
        for _ in range(repeat):
            began = time.perf_counter()
            q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)
    began = time.perf_counter()
    open_index(spark, path)
    seconds["reopen_index"] = round(time.perf_counter() - began, 3)
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
                "docs_per_second_build": round(docs / build), "index_bytes": size_in_bytes(spark, path), "batch_queries_per_second": round(queries / seconds["batch_search_topk"], 1),
            }
        )
    )
    shutil.rmtree(path, ignore_errors=True)


if __name__ == "__main__":
    main()
