"""What the operators of this subpackage share: shipping code, staged tables, text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing that leaves all other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts, as a Java and RE2 character class: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"

_SHIPPED = "tidemark.shipped"


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of every executor, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidemark-")), "tidemark_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "tidemark")):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, top))
    sc.addPyFile(target)
    sc._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, from any store that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode, where all of Spark is this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not getattr(sc, "_tidemark_folder", None):
            sc._tidemark_folder = tempfile.mkdtemp(prefix="spark-tidemark-")
        base = sc._tidemark_folder
    return base.rstrip("/")


class Workspace:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs one task.

    ``stage`` writes a DataFrame and returns it as read back; ``drop`` deletes what is
    no longer needed.  What a returned DataFrame still reads stays until the
    application's owner clears the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path, w = self.path(name), df.write
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``stage`` as a table bucketed and sorted by a key: tables that meet by the key need no shuffle.

        What is grouped or joined by the key already is written as it lies, one file a bucket; ``repartition`` the rest by it.
        The table's name is in the database ``tidemark_work``, so what a job that dies leaves behind is found there.
        """
        self.spark.sql("CREATE DATABASE IF NOT EXISTS tidemark_work")
        path, n, name = self.path(name), int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"tidemark_work.t_{uuid.uuid4().hex}"
        df.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._tidemark_path, out._tidemark_table = path, name
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if getattr(df, "_tidemark_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {df._tidemark_table}")
            p = self.spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that clash with none of the frame's."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
