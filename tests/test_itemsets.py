"""Itemsets level by level, against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import baskets


def frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "items array<string>").repartition(3)


def plain(rows, least, most=None):
    """By depth: a set is extended by later items while enough baskets hold it."""
    rows = [set(r or []) - {None} for r in rows]
    items = sorted(set().union(*rows))
    out = {}

    def grow(head, held, rest):
        for i, x in enumerate(rest):
            own = [r for r in held if x in r]
            if len(own) >= least:
                out[(*head, x)] = len(own)
                if most is None or len(head) + 1 < most:
                    grow((*head, x), own, rest[i + 1 :])

    grow((), rows, items)
    return out


def got(df):
    rows = df.collect()
    out = {tuple(r["itemset"]): r["support"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_large_baskets_with_a_bound_on_support(spark):
    rng = random.Random(1)
    items = [f"i{k:03d}" for k in range(230)]
    rows = [rng.sample(items, 200) for _ in range(3)] + [rng.sample(items, rng.randrange(1, 12)) for _ in range(120)] + [["i001", "i002", "i003", "i004", "i005"]] * 9
    want = plain(rows, 7)
    assert max(map(len, want)) >= 4
    assert got(baskets.frequent_itemsets(frame(spark, rows), "items", None, 7)) == want


@pytest.mark.parametrize("least", [1, 2, 4])
@pytest.mark.parametrize("most", [None, 2])
def test_nulls_ties_repeats_and_empty_baskets(spark, least, most):
    rng = random.Random(least)
    rows = [[rng.choice("abcdefg") for _ in range(rng.randrange(0, 7))] for _ in range(60)] + [None, [], [None], ["a", None, "a"], ["B", "a"], ["", "a"]]
    assert got(baskets.frequent_itemsets(frame(spark, rows), "items", most, least)) == plain(rows, least, most)


def test_baskets_beyond_a_row_without_a_bound_on_support(spark):
    rows = [[f"x{k:02d}" for k in range(40)], [f"x{k:02d}" for k in range(0, 40, 3)], ["x00", "x03", "z"], ["z"]]
    assert got(baskets.frequent_itemsets(frame(spark, rows), "items", 3)) == plain(rows, 1, 3)


def test_rules_from_levels(spark):
    rng = random.Random(3)
    rows = [rng.sample("abcdefgh", rng.randrange(1, 8)) for _ in range(80)]
    sets = plain(rows, 6)
    want = {(tuple(x for x in s if x != c), c): n / sets[tuple(x for x in s if x != c)] for s, n in sets.items() if len(s) > 1 for c in s}
    rules = baskets.association_rules(frame(spark, rows), "items", None, 6).collect()
    assert {(tuple(r["antecedent"]), r["consequent"]): r["confidence"] for r in rules} == want


def test_empty_table(spark):
    for least in (1, 2):
        assert baskets.association_rules(frame(spark, [["a"]]).where("false"), "items", None, least).count() == 0


def test_a_row_holds_so_many_subsets_only(spark):
    df = spark.range(1).select(F.expr("transform(sequence(1, 17), x -> cast(x as string))").alias("items"))
    with pytest.raises(Exception, match="more than 16 items"):
        df.select(scalars.every_subset(F.col("items"))).collect()
    own = df.select(F.slice("items", 1, 5).alias("items"))
    sets = own.select(F.explode(scalars.every_subset(F.col("items"))).alias("s")).collect()
    assert sorted(tuple(r["s"]) for r in sets) == sorted(c for k in range(1, 6) for c in combinations([str(x) for x in range(1, 6)], k))
