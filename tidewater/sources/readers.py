"""Typed readers: every source states its schema and what happens to malformed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODES = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "null": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str | list[str], schema: str, malformed: str = "fail", sep: str = ",", **options: str) -> DataFrame:
    """Delimited text by position; malformed is 'fail', 'skip' or 'null'."""
    return spark.read.options(**options).csv(path, schema=schema, sep=sep, mode=MODES[malformed])


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One record a line, in column value."""
    return spark.read.text(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str | list[str], schema: str, malformed: str = "null") -> DataFrame:
    return spark.read.json(path, schema=schema, mode=MODES[malformed])


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of the files under path, by the reader's own listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop))


def ship_code(spark: SparkSession, *paths: str) -> None:
    """Make Python files or archives importable on the executors."""
    for p in paths:
        spark.sparkContext.addPyFile(p)
