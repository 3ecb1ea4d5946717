"""Top-N and secondary sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalars import natural_partition


def top_n(df: DataFrame, key: str, n: int, tie_break: list[str]) -> DataFrame:
    """The n largest distinct keys with one record each (the first by tie_break) and their rank. Records are thinned to one a
    key before the limit, which every task applies to its own rows first."""
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("*"), F.struct(*tie_break)).alias("r"))
    best = one.orderBy(F.desc(key)).limit(n)
    return best.select("r.*", F.row_number().over(Window.orderBy(F.desc(key))).cast("long").alias("rank"))


def top_n_rows(df: DataFrame, weight: str, n: int, tie_break: list[str]) -> DataFrame:
    """The n records of largest weight; of equal weights the first by tie_break. Every task keeps its own n before rows meet."""
    return df.where(F.col(weight).isNotNull()).orderBy(F.desc(weight), *tie_break).limit(n)


def top_n_keys(df: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """key and total of the n largest sums of value by key; of equal sums the smallest keys."""
    sums = df.groupBy(key).agg(F.sum(value.cast("long")).alias("total"))
    return sums.orderBy(F.desc("total"), key).limit(n)


def top_n_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """All records of the n largest distinct keys, with the key's rank. The keys are found first (n rows), so no window goes
    over all records."""
    best = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.desc(key)).limit(n)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(key))).cast("long"))
    return df.join(F.broadcast(ranked), key)


def top_n_sums(df: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """total, keys (sorted) and rank of the n largest distinct sums of value by key."""
    sums = df.groupBy(key).agg(F.sum(value.cast("long")).alias("total"))
    best = top_n_groups(sums, "total", n)
    return best.groupBy("total", "rank").agg(F.sort_array(F.collect_list(key)).alias("keys"))


def secondary_sort(df: DataFrame, key: str | list[str], value: str, total: bool = False, partitions: int | None = None) -> DataFrame:
    """Rows with each key's rows together, by key and then value, both downward; total also sorts the keys of all partitions."""
    keys = [key] if isinstance(key, str) else key
    order = [F.desc(k) for k in keys] + [F.desc(value)]
    if total:
        return df.orderBy(*order)
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*order)


def by_natural_key(df: DataFrame, key: str, partitions: int, *order: str) -> DataFrame:
    """Rows in the partition that natural_partition() names for their key, sorted there by the key and then order."""
    return df.repartitionById(partitions, natural_partition(F.col(key).cast("string"), partitions)).sortWithinPartitions(key, *order)


def joined_values(df: DataFrame, key: list[str], value: Column, text: Column, closing: str = ",") -> DataFrame:
    """key parts joined, and the values of each key as text, largest first, each with a closing sign."""
    pairs = F.sort_array(F.collect_list(F.struct(value.alias("v"), text.alias("t"))), asc=False)
    out = df.groupBy(F.concat(*key).alias("key")).agg(pairs.alias("p"))
    return out.select("key", F.concat(F.array_join(F.transform("p", lambda x: x["t"]), closing), F.lit(closing)).alias("values"))


def multi_sort(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)
