"""Tables that cut lineage: written once into the folder that driver and executors share.

An executor can be lost at any time, so nothing here is cached on executors alone. The shared
folder is ``spark.checkpoint.dir`` of the session; only where that is unset and all runs on one
machine (tests, a laptop) a folder of our own is used and announced to Spark.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder.
LOCAL_FALLBACK = "file:///tmp/checkpoints/foliospark"

_roots: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt to all cores where its files give fewer partitions than there are (a table in one row group).

    Tables of many files have more partitions than cores and are left as they are: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> str:
    """Sends this package to the workers of a cluster that does not have it installed, and returns the file sent.

    Only the driver writes it to a folder of its own; Spark hands it to the executors.
    """
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="foliospark-"), "foliospark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("foliospark", os.path.relpath(path, home)))
    spark.sparkContext.addPyFile(archive)
    return archive


class Scratch:
    """Named intermediate tables of one job below the shared folder."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        _roots.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read back: later plans start from the files."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Gives the space of tables that no later plan reads back."""
        for name in names:
            delete(self.spark, self.path(name))


def cleanup() -> None:
    """Deletes every scratch folder of this process; results that still read them end."""
    while _roots:
        spark, root = _roots.pop()
        try:
            delete(spark, root)
        except Exception:  # the JVM may be gone already
            continue


atexit.register(cleanup)
