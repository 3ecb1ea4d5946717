"""Itemsets and association rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import RANKS, ROW_ITEMS, combination_at, combination_count, every_subset, subsets
from tidewater.lineage import cut, drop


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    return df.groupBy(basket).agg(F.array_sort(F.collect_set(F.trim(F.col(item).cast("string")))).alias("items"))


def supports(df: DataFrame, items: str, size: int) -> DataFrame:
    """itemset and support: baskets that hold each set of `size` items. Sets are made in each row and counted before they are
    exchanged."""
    return df.select(F.explode(subsets(F.col(items), size)).alias("itemset")).groupBy("itemset").agg(F.count("*").alias("support"))


def ranked_combinations(df: DataFrame, items: str, size: int, block: int = RANKS) -> DataFrame:
    """df with rank and combination, for each combination of `size` of the distinct items of a row that has an array, in sorted order. A combination is computed from its
    number; numbers are dealt out in blocks to all tasks, so a row's combinations never stand together."""
    own = df.withColumn(items, F.array_sort(F.array_distinct(F.array_compact(items))))
    count = combination_count(F.size(items), size)
    last = F.call_function("div", count - 1, F.lit(block)).cast("bigint")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.where(F.col(items).isNotNull() & (count > 0)).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition(parts)
    ranks = F.sequence(F.col("_block") * block, F.least((F.col("_block") + 1) * block, count) - 1)
    return dealt.withColumn("rank", F.explode(ranks)).drop("_block").withColumn("combination", combination_at(F.col(items), size, F.col("rank")))


def _small_sets(own: DataFrame, max_size: int | None) -> DataFrame:
    """itemset, support of all sets of own(items, n), made in each row. Rows are dealt out evenly, since a row's sets are many."""
    sets = every_subset(F.col("items"))
    sets = sets if max_size is None else F.filter(sets, lambda s: F.size(s) <= max_size)
    return own.select(F.explode(sets).alias("itemset"), "n").groupBy("itemset").agg(F.sum("n").alias("support"))


def _candidates(found: DataFrame, size: int) -> DataFrame:
    """s1, s2 of each two sets of `size` items that only differ in their last one, all of whose joined set's subsets are in found."""
    x, y = found.alias("x"), found.alias("y")
    pairs = x.join(y, (F.col("x.pre") == F.col("y.pre")) & (F.col("x.last") < F.col("y.last")))
    pairs = pairs.select(F.col("x.sid").alias("s1"), F.col("y.sid").alias("s2"), F.concat("x.itemset", F.array("y.last")).alias("all"))
    # without one of the last two items it is one of the pair
    each = pairs.select("s1", "s2", "all", F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("j"))
    less = F.concat(F.slice("all", F.lit(1), F.col("j") - 1), F.slice("all", F.col("j") + 1, F.lit(size + 1)))
    there = each.select("s1", "s2", less.alias("itemset")).join(found.select("itemset"), "itemset", "left_semi")
    return there.groupBy("s1", "s2").agg(F.count("*").alias("k")).where(F.col("k") == size - 1).select("s1", "s2")


def _levels(own: DataFrame, max_size: int | None, min_support: int) -> DataFrame:
    """itemset, support of own(items, n), size by size. A row is a basket with one of its frequent sets; sets of a basket that only
    differ in their last item are joined to the next size, if all subsets are frequent. Rows are as many as baskets hold
    frequent sets, and no row or task holds a basket's sets together."""
    # the number is given before the items are spread out, so that a basket's items share it
    each = cut(own.withColumn("b", F.monotonically_increasing_id()).select("b", "n", F.explode("items").alias("last")))
    often = each.groupBy("last").agg(F.sum("n").alias("support")).where(F.col("support") >= min_support)
    found = cut(often.select(F.monotonically_increasing_id().alias("sid"), F.lit(-1).cast("bigint").alias("pre"), "last", F.array("last").alias("itemset"), "support"))
    held = cut(each.join(found, "last").select("b", "n", "sid", "pre", "last"))
    out, size = found.select("itemset", "support"), 1
    while (max_size is None or size < max_size) and not found.isEmpty():
        x, y = held.alias("x"), held.alias("y")
        pairs = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.pre") == F.col("y.pre")) & (F.col("x.last") < F.col("y.last")))
        pairs = pairs.select("x.b", "x.n", F.col("x.sid").alias("s1"), F.col("y.sid").alias("s2"))
        if size > 1 and min_support > 1:
            pairs = pairs.join(cut(_candidates(found, size)), ["s1", "s2"], "left_semi")
        often = pairs.groupBy("s1", "s2").agg(F.sum("n").alias("support")).where(F.col("support") >= min_support)
        often = often.join(found.select(F.col("sid").alias("s1"), "itemset"), "s1").join(found.select(F.col("sid").alias("s2"), "last"), "s2")
        found = cut(often.select(F.monotonically_increasing_id().alias("sid"), F.col("s1").alias("pre"), "s2", "last", F.concat("itemset", F.array("last")).alias("itemset"), "support"))
        next_sets = found.select("sid", F.col("pre").alias("s1"), "s2", "last")
        before, held = held, cut(pairs.join(next_sets, ["s1", "s2"]).select("b", "n", "sid", F.col("s1").alias("pre"), "last"))
        drop(before)
        out, size = out.union(found.select("itemset", "support")), size + 1
    drop(each, held)
    return out


def frequent_itemsets(df: DataFrame, items: str, max_size: int | None = None, min_support: int = 1) -> DataFrame:
    """itemset and support of sets of 1 to max_size items, of any size if that is None, which at least min_support baskets hold. Null items are
    none. With a bound on support, sets grow level by level. Without one every set of every basket is wanted, and those of baskets
    of at most ROW_ITEMS items are made in a row."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    own = df.select(F.array_sort(F.array_distinct(F.array_compact(items))).alias("items"))
    # equal baskets are worked on once; a stated number of partitions, since so few bytes would be gathered in few tasks
    own = own.repartition(int(parts), "items").groupBy("items").agg(F.count("*").alias("n"))
    if min_support > 1:
        return _levels(own, max_size, min_support)
    own = cut(own)
    large = own.where(F.size("items") > ROW_ITEMS)
    small = _small_sets(own.where(F.size("items") <= ROW_ITEMS), max_size)
    if large.isEmpty():
        return small
    return small.union(_levels(large, max_size, 1)).groupBy("itemset").agg(F.sum("support").alias("support"))


def association_rules(df: DataFrame, items: str, max_size: int | None = None, min_support: int = 1, min_confidence: float = 0.0) -> DataFrame:
    """antecedent, consequent and confidence of rules with one item as the consequent, from itemsets of 2 to max_size items (of any
    size if that is None)."""
    sets = frequent_itemsets(df, items, max_size, min_support)
    whole = sets.where(F.size("itemset") > 1).select("itemset", "support", F.explode("itemset").alias("consequent"))
    whole = whole.select(F.array_except("itemset", F.array("consequent")).alias("antecedent"), "consequent", F.col("support").alias("both"))
    # rows are sorted by a hash, which is cheaper than by arrays; equality is by both
    near = lambda rows: rows.withColumn("h", F.xxhash64("antecedent"))
    rules = near(whole).join(near(sets.select(F.col("itemset").alias("antecedent"), "support")), ["h", "antecedent"])
    rules = rules.select("antecedent", "consequent", (F.col("both") / F.col("support")).alias("confidence"))
    return rules.where(F.col("confidence") >= min_confidence)


def fp_growth_rules(df: DataFrame, items: str, min_support: float, min_confidence: float) -> DataFrame:
    """The same by parallel FP-growth, for sets of any size."""
    from pyspark.ml.fpm import FPGrowth

    return FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=min_confidence).fit(df).associationRules
