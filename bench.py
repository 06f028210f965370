"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from quillspark.plans import catalog

HEADLINE = ["text_metrics", "readability_bands", "words_by_lang", "html_escape", "tagfilter", "table_sum", "stats", "links_by_target", "toc_numbered", "validate_report", "task_items", "slides", "raw_documents", "to_html", "fmt", "event_windows"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    spark = builder.config("spark.sql.files.maxPartitionBytes", "4m").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda q: q(spark, sf).write.format("noop").mode("overwrite").save()
    run(catalog.QUERIES["text_metrics"])  # starts the JVM's and the workers' code
    run(catalog.QUERIES["stats"])
    took = {}
    for name in HEADLINE:
        began = time.time()
        run(catalog.QUERIES[name])
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
