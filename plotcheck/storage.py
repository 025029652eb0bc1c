"""Intermediate results that must outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; without one there is no place that all machines see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def materialize(df: DataFrame, label: str = "cut", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    ``replaces`` is a table of an earlier round that nothing reads any more; it is deleted once the new one is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    old = getattr(replaces, "written_at", None)
    if old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to a fixed number of tasks: adaptive execution joins partitions by their bytes, so that few bytes that take long would land in one task.

    Dealt by a hash of the keys, as a repartition by keys that the rows are dealt by already would be left out.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), F.xxhash64(*keys))
