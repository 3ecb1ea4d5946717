"""Tables that are bucketed for joins, and Hadoop's binary files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tidewater.lineage import shared_folder

BYTES, TEXT = "org.apache.hadoop.io.BytesWritable", "org.apache.hadoop.io.Text"
FORMAT = "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat"
#: Stands in a record's value where its key is null, which Hadoop's types can't say.
NO_KEY = "_no_key"


def bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "errorifexists") -> DataFrame:
    """df as a table of the session's catalog, dealt by keys to so many buckets and sorted in them. Joins and groupings by keys of tables
    of equally many buckets need no exchange. The files are in the shared folder."""
    spark = df.sparkSession
    # one task writes a bucket, so a bucket is one file
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_folder(spark)}/tables/{table}").saveAsTable(table)
    return spark.table(table)


def write_sequence(df: DataFrame, path: str, key: str) -> None:
    """df as Hadoop's SequenceFile: the key column's bytes, and the other columns as a JSON text. Not for Spark Connect: records go through
    an RDD, as Spark has no other writer of this format."""
    rest = [c for c in df.columns if c != key]
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest], F.when(F.col(f"`{key}`").isNull(), True).alias(NO_KEY)))
    pairs = df.select(F.coalesce(F.col(f"`{key}`").cast("string").cast("binary") if dict(df.dtypes)[key] != "binary" else F.col(f"`{key}`"), F.lit(b"")).alias("k"), value.alias("v"))
    pairs.rdd.map(lambda r: (bytearray(r["k"]), r["v"])).saveAsNewAPIHadoopFile(path, FORMAT, keyClass=BYTES, valueClass=TEXT)


def read_sequence(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Columns of schema from files that write_sequence() gave. Values that aren't of their type are null."""
    whole: StructType = _parse_datatype_string(schema)
    kind = whole[key].dataType.simpleString()
    rest = StructType([f for f in whole if f.name != key])
    value = StructType.fromJson(json.loads(rest.json())).add(NO_KEY, "boolean")
    rows = spark.createDataFrame(spark.sparkContext.sequenceFile(path, BYTES, TEXT).map(lambda r: (bytes(r[0]), r[1])), "k binary, v string")
    rows = rows.select("k", F.from_json("v", value).alias("v"))
    own = F.col("k") if kind == "binary" else F.col("k").cast("string").try_cast(kind)
    columns = {f.name: F.col("v")[f.name] for f in rest} | {key: F.when(F.coalesce(F.col("v")[NO_KEY], F.lit(False)), None).otherwise(own)}
    return rows.select(*[columns[f.name].alias(f.name) for f in whole])
