"""Trailing means over streams: the last values of each series are kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.lineage import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrailingMean(StatefulProcessor):
    """Holds a series' rows until the watermark has passed them, then gives them in order, each with the mean of its value and those of
    the window - 1 rows before it. State is the waiting rows (those within the watermark's delay) and the last window - 1 values."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, tie bigint, value double")
        self.last = handle.getValueState("last", "kept array<double>, due bigint")

    def _last(self) -> tuple[list, int | None]:
        return tuple(self.last.get()) if self.last.exists() else ([], None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["us"], r["tie"], r["value"]) for r in rows]
        self.waiting.appendList(new)
        kept, due = self._last()
        # one timer a series, at its earliest waiting row
        first = min(us for us, *_ in new) // 1000
        if due is None or first < due:
            self.handle.registerTimer(first)
            self.last.update((list(kept), first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] // 1000 < passed), key=lambda r: r[:2])
        later = [r for r in rows if r[0] // 1000 >= passed]
        kept = list(self._last()[0])
        for us, tie, value in ready:
            kept = [*kept, value][-self.window :]
            own = [x for x in kept if x is not None]
            yield Row(series=key[0], us=us, tie=tie, value=value, avg=sum(own) / len(own) if own else None)
            kept = kept[-self.window + 1 :] if self.window > 1 else []
        due = min((us for us, *_ in later), default=None)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(due // 1000)
        else:
            self.waiting.clear()
        self.last.update((kept, None if due is None else due // 1000))

    def close(self) -> None:
        pass


def trailing_means(stream: DataFrame, series: str, time: str, tie: str, value: str, window: int = 3, late: str = "10 minutes") -> DataFrame:
    """series, time, tie, value, avg of each row that the watermark has passed: the mean of its value and those of the window - 1 rows before
    it by time and tie, which together must be unique in a series but for repeated rows. Rows later than `late` and rows without a time are left out; null values count in no mean; a null series
    is one."""
    if window < 1:
        raise ValueError("window must be at least 1")
    kind = dict(stream.dtypes)[series]
    rows = stream.where(F.col(time).isNotNull()).select("*", F.col(time).cast("timestamp").alias("_at")).withWatermark("_at", late)
    rows = rows.select(F.col(series).alias("series"), "_at", F.unix_micros("_at").alias("us"), F.col(tie).cast("bigint").alias("tie"), F.col(value).cast("double").alias("value"))
    out = rows.groupBy("series").transformWithState(statefulProcessor=TrailingMean(window), outputStructType=f"series {kind}, us bigint, tie bigint, value double, avg double", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("series").alias(series), F.timestamp_micros("us").alias(time), F.col("tie").alias(tie), F.col("value").alias(value), "avg")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_to_end(out: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there now to Parquet under path, going on from checkpoint."""
    with keyed_state(out.sparkSession):
        query = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def means_of(spark: SparkSession, source: str, schema, series: str, time: str, tie: str, value: str, window: int = 3, late: str = "0 seconds") -> DataFrame:
    """trailing_means() of the Parquet files of source as a stream, run to its end into the shared folder."""
    folder = f"{shared_folder(spark)}/tidewater/stream-{uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(source)
    out = trailing_means(stream, series, time, tie, value, window, late)
    run_to_end(out, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
