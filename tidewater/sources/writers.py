"""Sinks."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", single_file: bool = False) -> None:
    """Delimited text; single_file gathers all rows in one task and suits small results only."""
    (df.coalesce(1) if single_file else df).write.mode(mode).csv(path, sep=sep)


def write_key_values(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text lines of the columns, the first parted from the others by a tab, those by commas."""
    first, *rest = df.columns
    line = F.concat_ws("\t", F.col(first).cast("string"), F.concat_ws(",", *[F.col(c).cast("string") for c in rest]))
    df.select(line.alias("value")).write.mode(mode).text(path)


def show(df: DataFrame, n: int = 20) -> None:
    """The first n rows, as a table."""
    df.show(n, truncate=False)


def print_rows(df: DataFrame) -> None:
    """All rows, one a line, a partition at a time."""
    for row in df.toLocalIterator():
        print("(" + ",".join(str(x) for x in row) + ")")


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None, driver: str | None = None, batch: int = 10_000) -> dict[str, str]:
    named = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver, "batchsize": str(batch)}
    return {k: v for k, v in named.items() if v is not None}


def append_jdbc(df: DataFrame, url: str, table: str, connections: int = 8, **options: str) -> None:
    """Append through at most so many connections at once."""
    df.coalesce(connections).write.format("jdbc").mode("append").options(**jdbc_options(url, table, **options)).save()


#: Columns of a staging table: a row's partition, and the attempt of the task that wrote it.
PART, ATTEMPT = "tw_part", "tw_attempt"


def stage_jdbc(df: DataFrame, url: str, staging: str, connections: int = 8, **options: str) -> None:
    """Append df to a staging table, each row with its partition and the attempt that writes it. A task writes in one transaction, so an attempt is there
    whole or not at all; one that was lost after it is there beside the next."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        for batch in batches:
            marks = [pa.array([n] * len(batch), pa.int64()) for n in (context.partitionId(), context.taskAttemptId())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, PART, ATTEMPT])

    schema = StructType([*df.schema.fields, StructField(PART, LongType()), StructField(ATTEMPT, LongType())])
    df.coalesce(connections).mapInArrow(marked, schema).write.format("jdbc").mode("append").options(**jdbc_options(url, staging, **options)).save()


def move_staged(df: DataFrame, url: str, table: str, staging: str, user: str | None = None, password: str | None = None, driver: str | None = None, **_: str) -> int:
    """Rows of each partition's last attempt go from staging to table, and staging is dropped, in one transaction. Gives the number of rows."""
    jvm = df.sparkSession.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for k, v in (("user", user), ("password", password)):
        if v is not None:
            settings.setProperty(k, v)
    if driver:
        jvm.java.lang.Class.forName(driver)
    names = ", ".join(f'"{c}"' for c in df.columns)
    last = f'SELECT "{PART}", max("{ATTEMPT}") AS "{ATTEMPT}" FROM {staging} GROUP BY "{PART}"'
    joined = f'{staging} s JOIN ({last}) l ON s."{PART}" = l."{PART}" AND s."{ATTEMPT}" = l."{ATTEMPT}"'
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        moved = statement.executeUpdate(f"INSERT INTO {table} ({names}) SELECT {', '.join(f's.{n}' for n in names.split(', '))} FROM {joined}")
        statement.executeUpdate(f"DROP TABLE {staging}")
        connection.commit()
        return moved
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def append_jdbc_once(df: DataFrame, url: str, table: str, connections: int = 8, **options: str) -> int:
    """Append to a table that is there, each row once however often tasks are tried again: nothing is in the table before all rows are
    staged. Gives the number of rows."""
    staging = f"tw_staging_{uuid4().hex[:16]}"
    stage_jdbc(df, url, staging, connections, **options)
    return move_staged(df, url, table, staging, **options)
