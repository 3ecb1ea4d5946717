"""Item-to-item similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Items of a user that meet in one cell are of two blocks of about so many.
BLOCK = 256


def _cells(r: DataFrame, block: int) -> DataFrame:
    """r(u, i, r) with the cells that a row goes to. A user's items are dealt to blocks, one for each `block` items, and each two
    blocks are a cell; nearly all users have one block. The join with the counts and that of the cells can be split where a user is heavy."""
    many = r.groupBy("u").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = r.join(many, "u").withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return own.select("u", "i", "r", "own", other.alias("other")).select("u", "i", "r", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def item_similarity(ratings: DataFrame, user: str = "user", item: str = "item", rating: str = "rating", block: int = BLOCK) -> DataFrame:
    """item1 < item2, n (users who rated both), pearson, cosine and jaccard; null where a denominator is 0. A user's pairs are made cell by cell
    and summed in each task before they are exchanged."""
    r = ratings.select(F.col(user).alias("u"), F.col(item).alias("i"), F.col(rating).cast("long").alias("r"))
    x, y = _cells(r, block).alias("x"), _cells(r, block).alias("y")
    cell = (F.col("x.u") == F.col("y.u")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    # in a cell of two blocks only items of different ones meet
    both = x.join(y, cell & (F.col("x.i") < F.col("y.i")) & ((F.col("x.low") == F.col("x.high")) | (F.col("x.own") != F.col("y.own"))))
    a, b = F.col("x.r"), F.col("y.r")
    sums = both.groupBy(F.col("x.i").alias("item1"), F.col("y.i").alias("item2")).agg(
        F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")
    )
    # raters are counted with partial sums and join the pairs: an item that very many rate meets no single task
    raters = r.groupBy("i").agg(F.count("*").alias("raters"))
    sums = sums.join(raters.withColumnsRenamed({"i": "item1", "raters": "nx"}), "item1").join(raters.withColumnsRenamed({"i": "item2", "raters": "ny"}), "item2")
    n, sx, sy, sxx, syy, sxy = (F.col(c).cast("double") for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return sums.select(
        "item1", "item2", "n",
        F.try_divide(n * sxy - sx * sy, root(n * sxx - sx * sx) * root(n * syy - sy * sy)).alias("pearson"),
        F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy)).alias("cosine"),
        F.try_divide(n, (F.col("nx") + F.col("ny") - F.col("n")).cast("double")).alias("jaccard"),
    )
