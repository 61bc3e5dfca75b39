"""Tables that one step writes and the next reads, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """A path and the file system that it is on, of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives executors; options are the writer's.

    Tables are in a folder of the application. Those that a result is read from can't be forgotten before it is;
    the folder goes when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/siftwell-{spark.sparkContext.applicationId}"
    at, files = file_system(spark, folder)
    files.deleteOnExit(at)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of written() that no later step reads."""
    for df in tables:
        path = getattr(df, "written_path", None)
        if path:
            at, files = file_system(df.sparkSession, path)
            files.delete(at, True)
