"""Tables in the folder that driver and executors share; they end the lineage of iterative programs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only in local sessions without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/kinforge"
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once into the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(url: str):
    """pyarrow file system and path of a URL (local paths too); works on executors."""
    from pyarrow import fs

    if "://" in url or url.startswith("file:"):
        url = "file://" + url[5:] if url.startswith("file:/") and not url.startswith("file://") else url
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), url
