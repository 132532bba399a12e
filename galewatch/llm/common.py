"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, that a Python worker gets at once: long documents stay within a worker's memory. One text may be larger.
BATCH_ROWS, BATCH_BYTES = 128, 32_000_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds, for the Python stages planned in this session from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def rare_collections() -> None:
    """For workers that keep large caches without cycles: look for garbage cycles rarely."""
    gc.set_threshold(200_000, 50, 100)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where none is set, one below the warehouse, in local mode alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def settled(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a frame below shared_dir and read it again: lineage ends there, and lost executors cost no recomputation.

    The table is deleted when the application ends; results are lazy, so they may need it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/galewatch-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession):
    """Frames built and run inside drop their shuffles' files as soon as they have been collected or written.

    For results that aren't run a second time. The setting is put back at the end.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(name: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_numbers(values: list[int]) -> Column:
    """An array of whole numbers as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
