"""Long series, heavy users, natural keys and many combinations, against plain versions."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import baskets, ranking, sequences, similarity


def plain_means(rows, window):
    by, out = defaultdict(list), {}
    for symbol, at, key, value in rows:
        by[symbol].append((at is not None, at or 0, key, value))
    for symbol, own in by.items():
        own.sort()
        for i in range(len(own)):
            near = [v for *_, v in own[max(0, i - window + 1) : i + 1] if v is not None]
            out[symbol, own[i][2]] = sum(near) / len(near) if near else None
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 40])
def test_split_series_equal_plain_means(spark, window):
    rng = random.Random(window)
    rows = [("long", rng.randrange(200), i, rng.random()) for i in range(600)] + [(rng.choice(["a", "b", None]), rng.choice([None, 3, 4]), 1000 + i, rng.choice([None, 1.0, 2.5])) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, at int, key int, value double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    try:
        # with 40 rows before it and some 35 rows in a range, a halo comes from more than one range
        out = {(r["symbol"], r["key"]): r["avg"] for r in sequences.split_moving_average(df, "symbol", ["at", "key"], "value", window).collect()}
        want = plain_means(rows, window)
        assert out.keys() == want.keys() and all((x is None) == (want[k] is None) and (x is None or math.isclose(x, want[k])) for k, x in out.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sequences.split_moving_average(df.where("false"), "symbol", ["at", "key"], "value", window).count() == 0


def test_one_series_is_worked_on_by_many_tasks(spark):
    df = spark.range(4000).select(F.lit("s").alias("symbol"), F.col("id").alias("at"), F.col("id").cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = sequences.split_moving_average(df, "symbol", ["at"], "value").select("avg", F.spark_partition_id().alias("p")).collect()
        shares = list(Counter(r["p"] for r in out).values())
        assert len(shares) > 10 and max(shares) < 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_similarity(rows):
    by, raters, out = defaultdict(list), defaultdict(int), defaultdict(lambda: [0] * 6)
    for u, i, r in rows:
        raters[i] += 1
        by[u].append((i, r))
    for own in by.values():
        for (i, x), (j, y) in itertools.combinations(sorted(own), 2):
            for k, v in enumerate((1, x, y, x * x, y * y, x * y)):
                out[i, j][k] += v
    return {p: (n, n / (raters[p[0]] + raters[p[1]] - n), sxy / math.sqrt(sxx * syy)) for p, (n, sx, sy, sxx, syy, sxy) in out.items()}


@pytest.mark.parametrize("block", [256, 5])
def test_a_user_with_all_items(spark, block):
    rng = random.Random(block)
    items = [f"i{k}" for k in range(60)]
    rows = [("heavy", i, rng.randrange(1, 6)) for i in items] + [(f"u{k}", i, rng.randrange(1, 6)) for k in range(300) for i in rng.sample(items, rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "user string, item string, rating int")
    out = similarity.item_similarity(df, block=block).collect()
    want = plain_similarity(rows)
    assert len(out) == len(want)
    for r in out:
        n, jaccard, cosine = want[r["item1"], r["item2"]]
        assert r["n"] == n and math.isclose(r["jaccard"], jaccard) and math.isclose(r["cosine"], cosine)
    cells = similarity._cells(df.selectExpr("user AS u", "item AS i", "CAST(rating AS BIGINT) AS r"), block).groupBy("u", "low", "high").count()
    assert block > 60 or cells.agg(F.max("count")).first()[0] < 40
    assert similarity.item_similarity(df.where("false")).count() == 0


def plain_hash(text, start=1125899906842597):
    h = start
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (31 * h + int.from_bytes(data[i : i + 2], "big")) % (1 << 64)
    return h - (1 << 64) if h >= 1 << 63 else h


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_natural_keys(spark, ansi):
    keys = ["", "a", "ab", "Zürich", "中文", "𝔘😀x", "long " * 200, *(f"key-{i}" for i in range(200))]
    df = spark.createDataFrame([(k, i) for i, k in enumerate([*keys, None, "a", "a"])], "key string, n int")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        out = df.where("key IS NOT NULL").select("key", scalars.rolling_hash(F.col("key")).alias("h"), scalars.rolling_hash(F.col("key"), 0).alias("z")).collect()
        assert all(r["h"] == plain_hash(r["key"]) and r["z"] == plain_hash(r["key"], 0) for r in out) and min(r["h"] for r in out) < 0
        rows = ranking.by_natural_key(df, "key", 7, "n").select("key", "n", F.spark_partition_id().alias("p")).collect()
        assert len(rows) == len(keys) + 3
        for r in rows:
            h = 0 if r["key"] is None else plain_hash(r["key"])
            assert r["p"] == abs(math.fmod(h, 7) if abs(h) < 1 << 53 else abs(h) % 7)
        for p in range(7):
            own = [(r["key"] is not None, (r["key"] or "").encode(), r["n"]) for r in rows if r["p"] == p]
            assert own == sorted(own)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_all_combinations_of_five_of_forty(spark):
    df = spark.range(1).select(F.expr("transform(sequence(1, 40), x -> format_string('%02d', x))").alias("x"))
    out = baskets.ranked_combinations(df, "x", 5)
    got = out.select("rank", "combination").collect()
    want = list(itertools.combinations([f"{k:02d}" for k in range(1, 41)], 5))
    assert len(got) == len(want) == 658_008
    assert all(tuple(r["combination"]) == want[r["rank"]] for r in got)
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_combinations_of_small_rows(spark):
    rows = [(["c", "a", None, "b", "a"],), ([],), (None,), (["x"],), (["p", "q"],)]
    df = spark.createDataFrame(rows, "x array<string>")
    for size in (0, 1, 2, 3):
        got = sorted((tuple(r["x"]), r["rank"], tuple(r["combination"])) for r in baskets.ranked_combinations(df, "x", size, block=2).collect())
        own = [sorted(set(x or []) - {None}) for (x,) in rows if x is not None]
        assert got == sorted((tuple(x), i, c) for x in own for i, c in enumerate(itertools.combinations(x, size)))
    assert baskets.ranked_combinations(df.where("false"), "x", 2).count() == 0
