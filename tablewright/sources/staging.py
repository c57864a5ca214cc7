"""Tables written once to the shared folder so that later passes re-read columns, not lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PATH = "_tablewright_path"
# Spark's listeners hold what a finished query refers to for a moment.
SETTLE_SECONDS = 0.5
_METHOD_LIMIT, _COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a local one only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write as Parquet and read back: short lineage, columnar re-reads, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    names = df.columns
    # Positional names on disk: raw headers may hold characters Parquet rejects.
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.option("compression", compression).parquet(path)
    staged = spark.read.schema(
        df.toDF(*[f"c{i}" for i in range(len(names))]).schema
    ).parquet(path).toDF(*names)
    setattr(staged, _PATH, path)
    return staged


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps whose results are staged.

    Spark does so when the driver's JVM collects what referred to them, which a long job with a large
    heap may not come to before disks are full. For steps that shuffle as much as the input or more.
    """
    gc.collect()
    time.sleep(SETTLE_SECONDS)
    spark.sparkContext._jvm.System.gc()


def discard(*staged: DataFrame) -> None:
    """Deletes tables that `stage` has returned and nothing reads any more, wherever the shared folder is."""
    for df in staged:
        spark, path = df.sparkSession, getattr(df, _PATH)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Within, Spark generates no methods longer than the JVM compiles: text expressions of many columns else run interpreted."""
    before = spark.conf.get(_METHOD_LIMIT)
    if int(before) > _COMPILED_BYTES:
        spark.conf.set(_METHOD_LIMIT, _COMPILED_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_METHOD_LIMIT, before)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where the source splits into fewer parts than there are cores.

    Parsing text costs far more than moving it once. A large source has more splits than
    cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
