"""Times the headline operators and prints one JSON line.

`BENCH_SF_DIR` names the data folder, `BENCH_CPUS` the cores. The inputs are written in
several files before the clock starts, as a landed table would be (the given tables are
one indivisible file each); a small run on the same code warms the JVM. Every timed
query starts from those files and shares nothing with the others.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.dirty import table  # noqa: E402
from tablewright import (  # noqa: E402
    clean_data, column_profile, dataset_profile, derive_features, kpi_table, run_pipeline, statistical_summary,
)
from tablewright.operators.analytics import all_breakdowns  # noqa: E402
from tablewright.operators.chartdata import correlation  # noqa: E402
from tablewright.operators.dedup import remove_duplicates  # noqa: E402
from tablewright.operators.impute import handle_missing  # noqa: E402
from tablewright.operators.outliers import detect_outliers  # noqa: E402
from tablewright.sources.staging import spread, stage  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_FOLDER = os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        # Longer methods are never compiled by the JVM, so Spark should not fuse into them.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed_queries(spark: SparkSession, folder: str) -> dict[str, Callable[[], object]]:
    sales = stage(table(spark, folder, "d_sales_twice"), "bench-sales")
    enriched = stage(derive_features(clean_data(sales).table)[0], "bench-enriched")
    lines = stage(spread(spark.read.parquet(f"{folder}/lineitem.parquet")), "bench-lines")
    documents = stage(spread(spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang", "source")), "bench-documents")
    gaps = stage(table(spark, folder, "d_gaps").select("event_id", "user_id", "reading"), "bench-gaps")

    return {
        "dataset_profile": lambda: dataset_profile(sales).collect(),
        "column_profile": lambda: column_profile(sales).collect(),
        "pipe_clean": lambda: consume(derive_features(clean_data(sales).table)[0]),
        "kpi_table": lambda: kpi_table(enriched).collect(),
        "stat_summary": lambda: statistical_summary(enriched).collect(),
        "stat_summary_lines": lambda: statistical_summary(lines).collect(),
        "agg_all": lambda: all_breakdowns(enriched).collect(),
        "ch_corr": lambda: correlation(lines).collect(),
        "out_iqr": lambda: detect_outliers(lines),
        "cl_dedup": lambda: consume(remove_duplicates(documents)),
        "imp_ffill": lambda: consume(handle_missing(gaps, numeric="forward_fill", order_by=["event_id"])[0]),
        "end_to_end": lambda: run_pipeline(sales).insights.collect(),
    }


def main() -> None:
    spark = session()
    if os.path.isdir(WARM_FOLDER):
        for run in timed_queries(spark, WARM_FOLDER).values():
            run()
    seconds = {}
    for name, run in timed_queries(spark, FOLDER).items():
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
