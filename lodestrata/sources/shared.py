"""The folder that the driver and all executors share, for what is written between two steps."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a URI that Spark knows, and the path in it."""
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset (tests on one machine) a
    temporary folder is made and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.conf.get("spark.lodestrata.shared", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
            spark.conf.set("spark.lodestrata.shared", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lodestrata/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: what uses it sees the same rows and plans with their size."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
