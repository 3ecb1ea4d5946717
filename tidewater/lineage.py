"""Lineage cuts: tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints. A local session that names none gets one of this machine; elsewhere that is an error."""
    folder = spark.conf.get(SETTING, None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    return (folder or os.path.join(tempfile.gettempdir(), "tidewater")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table and read back: what is planned on it later doesn't compute it again and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tidewater/lineage-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() gave and nothing will read."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
