"""Nearest neighbours by pivots, against all pairs."""

import random

import numpy as np
import pytest

from tests.oracle import by_duckdb, by_spark
from tidewater.operators import classifiers, neighbours
from tidewater.plans.queries import ORACLE
from tidewater.sources.readers import read_table

FOLDER = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label string, vector array<float>").repartition(4)


def plain(queries, labelled, k):
    out = {}
    for q, _, v in queries:
        if v and np.isfinite(v).all():
            near = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(w).astype(float)) ** 2).sum())), s) for s, _, w in labelled if w and len(w) == len(v) and np.isfinite(w).all())
            out[q] = [s for _, s in near[:k]]
    return {q: x for q, x in out.items() if x}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q"], r["place"])):
        out.setdefault(r["q"], []).append(r["s"])
    return out


def clustered(rng, n, dims=8, clusters=12):
    centres = [[rng.gauss(0, 10) for _ in range(dims)] for _ in range(clusters)]
    return [(i, f"c{i % clusters}", [x + rng.gauss(0, 0.5) for x in centres[i % clusters]]) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("k", [1, 5])
def test_equals_all_pairs(spark, k, block):
    rows = clustered(random.Random(k), 300)
    df = frame(spark, rows)
    assert got(neighbours.k_nearest(df, df, k, "id", "id", "vector", "label", block=block)) == plain(rows, rows, k)


def test_copies_ties_nulls_and_lengths(spark):
    rng = random.Random(3)
    rows = [(i, "a", [1.0, 2.0]) for i in range(200)] + [(200 + i, "b", [float(rng.randrange(4)), float(rng.randrange(4))]) for i in range(150)]
    rows += [(400, "c", None), (401, "c", [float("nan"), 1.0]), (402, "c", [float("inf"), 1.0]), (403, "c", []), (404, "c", [1.0, 2.0, 3.0]), (405, None, [0.0, -0.0]), (406, "d", [5.0])]
    rng.shuffle(rows)
    df = frame(spark, rows)
    assert got(neighbours.k_nearest(df, df, 4, "id", "id", "vector", "label", block=16)) == plain(rows, rows, 4)
    few = rows[:3]
    assert got(neighbours.k_nearest(df, frame(spark, few), 4, "id", "id", "vector", "label")) == plain(rows, few, 4)


def test_empty_tables(spark):
    df = frame(spark, clustered(random.Random(4), 20))
    for q, s in ((df, df.where("false")), (df.where("false"), df)):
        assert neighbours.k_nearest(q, s, 3, "id", "id", "vector", "label").count() == 0
        assert classifiers.knn_classify(q, s, 3).count() == 0


def test_most_pairs_are_never_compared(spark):
    df = frame(spark, clustered(random.Random(5), 1500, dims=16))
    r = neighbours.compared_pairs(df, df, 5, "id", "id", "vector", "label").first()
    assert r["all_pairs"] == 1500 * 1500 and 0 < r["compared"] < r["all_pairs"] / 3
    plan = neighbours.k_nearest(df, df, 5, "id", "id", "vector", "label")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_all_rows_as_queries_equal_the_sql(spark):
    v = read_table(spark, FOLDER, "embeddings")
    out = classifiers.knn_classify(v, v, 5, "vec_id", "vec_id", "embedding").selectExpr("q", "CAST(label AS BIGINT) AS label")
    assert by_spark(out) == by_duckdb(FOLDER, ORACLE["w23_knn"].replace("WHERE vec_id % 50 = 0", ""))
