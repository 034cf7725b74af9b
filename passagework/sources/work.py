"""Work tables: what a job writes between its steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the one that the context was given; one of our own only if everything runs on this machine."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or "/tmp/checkpoints/passagework").rstrip("/")


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back: cuts the lineage, survives lost executors; gone when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.option("compression", "zstd").parquet(path)
    files.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
