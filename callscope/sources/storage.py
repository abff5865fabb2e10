"""Shared folders and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a session without one gets a folder of its own below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and later steps read only the columns they use."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the cluster's default file system gives it: tasks must not take one without a scheme for a local folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path, sorted; none if the path isn't there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(root) if s.isDirectory())


def files_below(spark: SparkSession, path: str, ending: str) -> list[str]:
    """Names of the files in a folder that end so, sorted."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return sorted(s.getPath().getName() for s in found if s.getPath().getName().endswith(ending))


def finished(spark: SparkSession, path: str) -> bool:
    """True if a Spark job wrote this folder to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def kept_name(spark: SparkSession, folder: str) -> str:
    """A name that is drawn once and then kept in a folder, so that all who share the folder share the name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder, "_name")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        out = system.create(place, False)
        out.writeBytes(uuid.uuid4().hex)
        out.close()
    read = system.open(place)
    try:
        return read.readLine()
    finally:
        read.close()


def file_system(path: str):
    """File system and path for a task: local paths, and what Arrow knows (HDFS, S3)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
