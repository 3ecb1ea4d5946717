"""Bucketed tables, a metastore, JDBC appends that survive retries, Hadoop's binary files, shipped code."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.oracle import by_duckdb, by_spark
from tidewater.operators import joins
from tidewater.plans.queries import ORACLE
from tidewater.sources import readers, tables, writers

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def test_bucketed_sides_need_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        users = readers.read_table(spark, FOLDER, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        users = tables.bucketed(users, "t_users", ["l_suppkey"], 4, "overwrite")
        tx = tables.bucketed(readers.read_table(spark, FOLDER, "lineitem").select("l_partkey", "l_suppkey"), "t_tx", ["l_suppkey"], 4, "overwrite")
        pairs = joins.product_locations(tx, users, "l_suppkey", "l_partkey", "s_nationkey")
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert by_spark(joins.location_counts(tx, users, "l_suppkey", "l_partkey", "s_nationkey", "label")) == by_duckdb(FOLDER, ORACLE["w08_left_join_label"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("t_users", "t_tx"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_bucketed_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 2), (None, 3)], "k int, v int")
    try:
        t = tables.bucketed(df, "t_nulls", ["k"], 3, "overwrite")
        assert sorted(map(str, t.collect())) == sorted(map(str, df.collect()))
        assert tables.bucketed(df.where("false"), "t_none", ["k"], 3, "overwrite").count() == 0
    finally:
        for t in ("t_nulls", "t_none"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


HIVE = """
import sys
from tidewater.session import session
from tidewater.sources.tables import bucketed
at = sys.argv[2]
conf = {"spark.sql.warehouse.dir": at + "/warehouse", "spark.checkpoint.dir": at + "/shared", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
        "spark.hadoop.javax.jdo.option.ConnectionURL": "jdbc:derby:;databaseName=" + at + "/metastore;create=true", "spark.driver.extraJavaOptions": "-Dderby.system.home=" + at}
spark = session("local[2]", hive=True, **conf)
if sys.argv[1] == "write":
    bucketed(spark.range(50).selectExpr("id % 7 AS k", "id AS v"), "kept", ["k"], 3)
else:
    print("SAID", spark.table("kept").count(), spark.sql("SELECT sum(v) FROM kept WHERE k = 3").first()[0], spark.conf.get("spark.sql.catalogImplementation"))
spark.stop()
"""


def test_tables_stay_in_the_metastore(tmp_path):
    said = ""
    for step in ("write", "read"):
        env = os.environ | {"PYTHONPATH": str(ROOT)}
        env.pop("PYSPARK_GATEWAY_PORT", None)
        run = subprocess.run([sys.executable, "-c", HIVE, step, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=240)
        assert run.returncode == 0, run.stderr[-2000:]
        said = run.stdout
    assert f"SAID 50 {sum(x for x in range(50) if x % 7 == 3)} hive" in said


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture
def derby(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([], "id bigint, name string").write.format("jdbc").options(url=url, dbtable="kept", driver=DERBY).save()
    return url


def read(spark, url):
    return sorted((r["id"], r["name"] or "") for r in spark.read.format("jdbc").options(url=url, dbtable="kept", driver=DERBY).load().collect())


def test_appended_once(spark, derby):
    df = spark.range(40).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name")).repartition(3)
    want = sorted((i, f"n{i}" if i % 5 else "") for i in range(40))
    assert writers.append_jdbc_once(df, derby, "kept", driver=DERBY) == 40 and read(spark, derby) == want
    # repeated rows are rows
    assert writers.append_jdbc_once(df.union(df), derby, "kept", driver=DERBY) == 80 and read(spark, derby) == sorted(want * 3)
    assert writers.append_jdbc_once(df.where("false"), derby, "kept", driver=DERBY) == 0 and len(read(spark, derby)) == 120


def test_attempts_lost_after_their_commit_leave_no_rows(spark, derby):
    df = spark.range(30).select("id", F.lit("x").alias("name")).repartition(4)
    # every task's first attempt is there, and so is its second
    for _ in range(2):
        writers.stage_jdbc(df, derby, "staged", driver=DERBY)
    assert writers.move_staged(df, derby, "kept", "staged", driver=DERBY) == 30
    assert read(spark, derby) == [(i, "x") for i in range(30)]


def test_nothing_is_moved_when_the_move_fails(spark, derby):
    df = spark.range(5).select("id", F.lit("x").alias("name"))
    writers.stage_jdbc(df, derby, "staged2", driver=DERBY)
    with pytest.raises(Exception, match="(?i)nowhere"):
        writers.move_staged(df, derby, "nowhere", "staged2", driver=DERBY)
    assert read(spark, derby) == [] and writers.move_staged(df, derby, "kept", "staged2", driver=DERBY) == 5


SCHEMA = "k binary, n bigint, name string, at timestamp, raw binary, own struct<a:int,b:array<string>>"


def test_sequence_files_round_trip(spark, tmp_path):
    rows = [(b"\x00\xff\x01", 1, "é", None, b"\x00\x01", (1, ["x", None])), (None, None, None, None, None, None), (b"", 2, "", None, b"", (None, [])), (b"k", 1 << 62, "a\nb\t\"", None, None, None), (b"k", 1 << 62, "a\nb\t\"", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.when(F.col("n").isNotNull(), F.timestamp_millis(F.col("n") % 1_000_000_000)))
    path = str(tmp_path / "seq")
    tables.write_sequence(df.repartition(2), path, "k")
    df.write.parquet(str(tmp_path / "pq"))
    plain = lambda d: sorted(str(r.asDict(True)) for r in d.collect())
    assert plain(tables.read_sequence(spark, path, "k", SCHEMA)) == plain(spark.read.schema(SCHEMA).parquet(str(tmp_path / "pq")))


@pytest.mark.parametrize("kind", ["string", "bigint", "double"])
def test_sequence_files_of_typed_keys(spark, tmp_path, kind):
    df = spark.createDataFrame([("1", 1), (None, 2), ("25", None)], "k string, v int").withColumn("k", F.col("k").cast(kind))
    tables.write_sequence(df, str(tmp_path / "s"), "k")
    back = tables.read_sequence(spark, str(tmp_path / "s"), "k", f"k {kind}, v int")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.dtypes == df.dtypes
    tables.write_sequence(df.where("false"), str(tmp_path / "none"), "k")
    assert tables.read_sequence(spark, str(tmp_path / "none"), "k", f"k {kind}, v int").count() == 0


def test_shipped_code_is_importable_in_tasks(spark, tmp_path):
    (tmp_path / "tw_shipped.py").write_text("def twice(x):\n    return 2 * x\n")
    readers.ship_code(spark, str(tmp_path / "tw_shipped.py"))

    def run(batches):
        import pyarrow as pa
        import tw_shipped

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tw_shipped.twice(x) for x in b.column(0).to_pylist()])], names=["x"])

    assert sorted(r[0] for r in spark.range(4).mapInArrow(run, "x bigint").collect()) == [0, 2, 4, 6]
