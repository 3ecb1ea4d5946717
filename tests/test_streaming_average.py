"""The moving average as a state over a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators.sequences import moving_average
from tidewater.streaming import averages

SCHEMA = "symbol string, ts timestamp, id bigint, price double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def batch(spark, folder, name, rows):
    made = [(s, None if m is None else START + dt.timedelta(minutes=m), i, p) for s, m, i, p in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{name}")


def run(spark, folder, window):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    averages.run_to_end(averages.trailing_means(stream, "symbol", "ts", "id", "price", window, "60 minutes"), f"{folder}/out", f"{folder}/at")


def tuples(df):
    return sorted(((r["symbol"] or "", r["id"]), None if r["avg"] is None else round(r["avg"], 9)) for r in df.select("symbol", "id", "avg").collect())


@pytest.mark.parametrize("window", [1, 3])
def test_batches_out_of_order_and_a_restart_equal_the_table(spark, tmp_path, window):
    rng, folder = random.Random(window), str(tmp_path)
    rows = [(rng.choice(["A", "B", None]), m, i, rng.choice([None, rng.random()]) if i % 9 == 0 else rng.random()) for i, m in enumerate(rng.randrange(0, 55) for _ in range(90))]
    for k in range(2):
        batch(spark, folder, f"b{k}", rows[k::3])
    run(spark, folder, window)
    # a new query goes on from the checkpoint; a row far ahead moves the watermark beyond all others
    batch(spark, folder, "b2", rows[2::3])
    run(spark, folder, window)
    batch(spark, folder, "b3", [("Z", 10_000, 1000, 1.0), ("A", None, 1001, 1.0)])
    run(spark, folder, window)
    # what comes later than the watermark is left out
    batch(spark, folder, "b4", [("A", 1, 1002, 5.0), ("Z", 20_000, 1003, 3.0)])
    run(spark, folder, window)
    batch(spark, folder, "all", [])
    table = spark.createDataFrame([(s, START + dt.timedelta(minutes=m), i, p) for s, m, i, p in [*rows, ("Z", 10_000, 1000, 1.0)]], SCHEMA)
    assert tuples(spark.read.parquet(f"{folder}/out")) == tuples(moving_average(table, "symbol", ["ts", "id"], "price", window))


def test_repeated_rows_and_an_empty_stream(spark, tmp_path):
    folder = str(tmp_path)
    batch(spark, folder, "b0", [("A", 0, 1, 2.0), ("A", 0, 1, 2.0), ("A", 1, 2, 8.0), ("Z", 9999, 3, 0.0)])
    run(spark, folder, 2)
    got = [r["avg"] for r in spark.read.parquet(f"{folder}/out").orderBy("ts", "avg").collect()]
    assert got == [2.0, 2.0, 5.0]
    empty = str(tmp_path / "none")
    batch(spark, empty, "b0", [])
    run(spark, empty, 2)
    assert spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{empty}/out").where(F.col("id").isNotNull()).count() == 0


def test_window_must_hold_a_row(spark, tmp_path):
    batch(spark, str(tmp_path), "b0", [])
    with pytest.raises(ValueError, match="at least 1"):
        averages.trailing_means(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), "symbol", "ts", "id", "price", 0)
