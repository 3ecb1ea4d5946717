"""Lineage cuts: tables written to the folder that driver and executors share, and how long they stay.

An operator frees a table as soon as what was made of it stands as a table itself. What its result still reads stays; owned()
says which tables these are, and release() deletes them once the result has been written.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: With it, the shuffle files of a query go when the query ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only for a local session that names none, a folder of this machine."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(own, exist_ok=True)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tidewater/{name}-{uuid.uuid4().hex}"
    if (paths := _owner.get()) is not None:
        paths.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: later plans start from files that survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before else spark.conf.unset(FREE_SHUFFLES)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables at paths; later reads of frames that depend on them fail."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(*tables: DataFrame | None) -> None:
    """Delete tables that cut() gave, when nothing that is still to be computed reads them."""
    for df in tables:
        if df is not None and (path := df.__dict__.pop("_stored_at", None)):
            release(df.sparkSession, [path])
            if path in (paths := _owner.get() or []):
                paths.remove(path)


@contextmanager
def owned() -> Iterator[list[str]]:
    """The paths of the tables that are written inside and not freed there."""
    paths: list[str] = []
    token = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(token)
        if (outer := _owner.get()) is not None:
            outer.extend(paths)


def read_by(df: DataFrame) -> set[str]:
    """Paths of the files and folders that df's plan scans."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(k).toString() for k in range(roots.size())}
    return out
