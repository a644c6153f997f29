"""Tables in the folder that all machines share: what is read again is written once, so that all readers see the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master, where all of Spark is this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not getattr(sc, "_tidemark_staging", None):
            sc._tidemark_staging = tempfile.mkdtemp(prefix="spark-tidemark-")
        base = sc._tidemark_staging
    return base.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows as written to the shared folder; whoever owns the folder clears it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
