"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="stranda-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Written as Parquet and read again: what comes before is computed once, however often the result is used.

    In a folder of the local file system the table goes when the driver ends.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if path.startswith(("/", "file:/")):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)
