"""Neighbouring words, moving averages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.functions.scalars import clean_line, clean_token
from tidewater.lineage import cut


def relative_frequency(df: DataFrame, tokens: str, window: int = 2) -> DataFrame:
    """word, neighbor and rf: the share of a word's neighbours, at most window places away, that are the neighbor. Pairs are
    made in each row, a word with the one so many places behind it, and summed before they are exchanged; the sums count for
    both directions."""
    n = F.size(tokens)
    shifted = [F.arrays_zip(F.slice(tokens, F.lit(1), F.greatest(n - d, F.lit(0))).alias("word"), F.slice(tokens, F.lit(d + 1), F.greatest(n - d, F.lit(0))).alias("neighbor")) for d in range(1, window + 1)]
    ahead = df.where(n > 1).select(F.inline(F.concat(*shifted))).groupBy("word", "neighbor").agg(F.count("*").alias("n"))
    both = ahead.select(F.inline(F.array(F.struct("word", "neighbor", "n"), F.struct(F.col("neighbor").alias("word"), F.col("word").alias("neighbor"), "n"))))
    pairs = both.groupBy("word", "neighbor").agg(F.sum("n").alias("n"))
    # sums are partial and their join can be split: a hot word's neighbours meet in no single task
    totals = pairs.groupBy(F.col("word").alias("of")).agg(F.sum("n").alias("total"))
    return pairs.join(totals, F.col("word").eqNullSafe(F.col("of"))).select("word", "neighbor", (F.col("n") / F.col("total")).alias("rf"))


def clean_tokens(df: DataFrame, tokens: str) -> DataFrame:
    """df with tokens stripped of signs; what is empty then has no place."""
    return df.withColumn(tokens, F.array_remove(F.transform(tokens, clean_token), ""))


def clean_words(df: DataFrame, line: str, tokens: str = "tokens") -> DataFrame:
    """The words of lines that single spaces part, stripped of signs; the same as clean_tokens() of the split line."""
    return df.select(F.array_remove(F.split(clean_line(F.col(line)), " "), "").alias(tokens))


def moving_average(df: DataFrame, by: str, order: list[str], value: str, window: int = 3, out: str = "avg") -> DataFrame:
    """df with the mean of each row's value and the window - 1 before it; fewer at the start. order must be unique within by."""
    if window < 1:
        raise ValueError("window must be at least 1")
    trailing = Window.partitionBy(by).orderBy(*order).rowsBetween(-(window - 1), 0)
    return df.withColumn(out, F.avg(value).over(trailing))


def over_split_series(df: DataFrame, by: str, order: list[str], before: int, **outs: Callable[[WindowSpec], Column]) -> DataFrame:
    """df with columns outs, each a function of a window that holds a row and those up to `before` rows before it in its series. A series is
    cut where the ranges of a distributed sort are, and each of its parts gets the last rows of the parts before it (a halo), so
    many tasks work on one long series and none reads more than its range and `before` rows. Of each part at most that many rows are looked at again to find the
    halos. order must be unique within by; null series are one, null order comes first."""
    keys = [by, *order]
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(by, "_part").orderBy(*[F.desc(c) for c in order])
    tails = rows.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= before).drop("_k")
    # a series has at most so many rows here as it has parts, times before
    tails = tails.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    parts = tails.groupBy(by, "_part").agg((F.min("_at") - 1).alias("_seen"))
    wanted = parts.where("_seen > 0").select(F.col(by).alias("_by"), F.col("_part").alias("_to"), F.explode(F.sequence(F.greatest(F.col("_seen") - before + 1, F.lit(1)), F.col("_seen"))).alias("_wants"))
    halo = tails.join(wanted, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_wants")))
    halo = halo.select(*df.columns, F.col("_to").alias("_part"), F.lit(True).alias("_halo"))
    trailing = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(-before, 0)
    whole = rows.withColumn("_halo", F.lit(False)).union(halo) if before else rows.withColumn("_halo", F.lit(False))
    out = reduce(lambda d, x: d.withColumn(x[0], x[1](trailing)), outs.items(), whole)
    return out.where("NOT _halo").drop("_part", "_halo")


def split_moving_average(df: DataFrame, by: str, order: list[str], value: str, window: int = 3, out: str = "avg") -> DataFrame:
    """moving_average() for series too long for a task."""
    if window < 1:
        raise ValueError("window must be at least 1")
    return over_split_series(df, by, order, window - 1, **{out: lambda w: F.avg(value).over(w)})


def parse_prices(lines: DataFrame, column: str = "value") -> DataFrame:
    """symbol, date and price of lines with exactly three fields of which the date and the price can be read; others go."""
    f = F.split(F.regexp_replace(column, ",+$", ""), ",")
    rows = lines.where(F.size(f) == 3).select(f[0].alias("symbol"), F.try_to_timestamp(F.trim(f[1]), F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.trim(f[2]).try_cast("double").alias("price"))
    return rows.where("date IS NOT NULL AND price IS NOT NULL")
