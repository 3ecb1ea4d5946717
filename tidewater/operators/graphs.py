"""Common friends and triangles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.scalars import split_white

#: Friends that the lists of a block hold together, about: the most and, where there are cores enough, the least.
BLOCK_MOST, BLOCK_LEAST = 3_500_000, 1 << 15
#: Parts of a tile's lists, so that a node's list is looked up among few.
DRAWERS = 1024
#: Parts in which a tile is worked off.
PARTS = 128


def adjacency_edges(lists: DataFrame, person: str = "person", friends: str = "friends") -> DataFrame:
    return lists.select(F.col(person).alias("src"), F.explode(F.array_distinct(friends)).alias("dst"))


def friend_lists(lines: DataFrame, column: str = "value", kind: str = "bigint") -> DataFrame:
    """person and friends from lines `person,f1 f2 f3`; a line without a comma has no friends."""
    f = F.split(F.col(column), ",", 2)
    friends = split_white(F.coalesce(F.get(f, F.lit(1)), F.lit("")))
    return lines.select(F.trim(f[0]).cast(kind).alias("person"), friends.cast(f"array<{kind}>").alias("friends"))


class _Tiles:
    """Nodes are dealt into blocks by hash, and a tile holds the lists of two blocks. The two ends of an edge meet in one tile, where
    their lists are compared; so lists go to as many tiles as their nodes have blocks of neighbours, and no wedge is exchanged."""

    def __init__(self, spark: SparkSession, size: int):
        cores = spark.sparkContext.defaultParallelism
        self.blocks = max(1, math.ceil(size / BLOCK_MOST), min(math.ceil(size / BLOCK_LEAST), math.ceil(math.sqrt(6 * cores))))

    def of(self, x: Column, y: Column) -> Column:
        a, b = (F.pmod(F.hash(c), F.lit(self.blocks)) for c in (x, y))
        return F.least(a, b) * self.blocks + F.greatest(a, b)

    def ends(self, lists: DataFrame, meets: Column, label: Column) -> DataFrame:
        """p, q, the list of p, its label and the list of q, null if there is none, for each q of p's list. lists: p and its list;
        meets: those that p has an edge with, in either direction; label: an expression of list, found once for a list and tile."""
        drawer = lambda c: F.pmod(F.xxhash64(c), F.lit(DRAWERS)).cast("int")
        at = F.array_distinct(F.transform(meets, lambda f: self.of(F.col("p"), f)))
        dealt = lists.select(F.explode(at).alias("tile"), "p", "list").repartition(2 * self.blocks * (self.blocks + 1), "tile")
        kept = F.collect_list(F.struct("p", F.col("list").alias("of_p"), label.alias("label")))
        drawers = dealt.groupBy("tile", drawer(F.col("p")).alias("drawer")).agg(F.collect_list("p").alias("ids"), kept.alias("kept"))
        tiles = drawers.groupBy("tile").agg(F.collect_list(F.struct("drawer", "ids", "kept")).alias("all"))
        place = F.transform(F.sequence(F.lit(0), F.lit(DRAWERS - 1)), lambda k: F.array_position(F.col("all.drawer"), k).cast("int") - 1)
        # a row's results wait in memory until it is done, so a tile is worked off in parts; the lambda keeps this explode out of generated code, which would hold all parts
        part = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.pmod(k + F.col("tile"), F.lit(PARTS)))
        tiles = tiles.select("tile", "all", place.alias("place")).select("*", F.explode(part).alias("part"))
        rows = tiles.select("*", F.explode("all").alias("own")).where(F.pmod("own.drawer", F.lit(PARTS)) == F.col("part"))
        rows = rows.select("tile", "all", "place", F.explode("own.kept").alias("own"))
        out = rows.select("tile", "all", "place", "own.*", F.explode("own.of_p").alias("q")).where(F.col("tile") == self.of(F.col("p"), F.col("q")))
        there = F.get("all", F.get("place", drawer(F.col("q"))))
        return out.select("p", "q", "of_p", "label", F.get(there["kept"], F.array_position(there["ids"], F.col("q")).cast("int") - 1)["of_p"].alias("of_q"))


def common_friends(directed: DataFrame, src: str = "src", dst: str = "dst", one_sided: str = "none", separator: str | None = None) -> DataFrame:
    """p, q and their common friends (sorted) for each pair of which one lists the other. A pair of which only one lists the other
    has none, or all friends of that one (one_sided='all'). Repeated rows count once. With a separator, common is text."""
    node, kind = directed.select(F.coalesce(src, dst)).dtypes[0][1], dict(directed.dtypes)[dst]
    tiles = _Tiles(directed.sparkSession, directed.count())
    known = directed.where(F.col(src).isNotNull()).select(F.col(src).cast(node).alias("p"), F.col(dst).cast(node).alias("f"))
    lists = known.groupBy("p").agg(F.sort_array(F.collect_set("f")).alias("list"))

    def told(c: Column) -> Column:
        c = c.cast(f"array<{kind}>")
        return c if separator is None else F.array_join(c.cast("array<string>"), separator)

    whole = told(F.col("list") if one_sided == "all" else F.array().cast(f"array<{node}>"))
    both = tiles.ends(lists, F.col("list"), whole).where("p != q")
    both = both.withColumn("mutual", F.coalesce(F.array_contains("of_q", F.col("p")), F.lit(False))).where("NOT (mutual AND p > q)")
    common = F.when(F.col("mutual"), told(F.array_intersect("of_p", "of_q"))).otherwise(F.col("label"))
    return both.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), common.alias("common"))


def triangles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """a < b < c of each triangle. Edges point from the node of lower degree to that of higher degree, so a hub has few edges of
    its own and lists stay short."""
    tiles = _Tiles(edges.sparkSession, edges.count())
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a < b")
    e = e.select(F.inline(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("f")), F.struct(F.col("b").alias("p"), F.col("a").alias("f")))))
    friends = e.groupBy("p").agg(F.collect_set("f").alias("f"))
    met = friends.select(F.explode("f").alias("p"), F.struct(F.size("f").alias("d"), F.col("p").alias("f")).alias("x")).groupBy("p").agg(F.collect_list("x").alias("x"))
    later = F.filter("x", lambda x: (x["d"] > F.size("x")) | ((x["d"] == F.size("x")) & (x["f"] > F.col("p"))))
    lists = met.select("p", F.col("x.f").alias("f"), later["f"].alias("list"))
    t = tiles.ends(lists, F.col("f"), F.lit(None)).select("p", "q", F.explode(F.array_intersect("of_p", "of_q")).alias("w"))
    low, high = F.least("p", "q"), F.greatest("p", "q")
    return t.select(F.least(low, "w").alias("a"), F.greatest(low, F.least(high, "w")).alias("b"), F.greatest(high, "w").alias("c"))
