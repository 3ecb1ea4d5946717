import numpy as np
import pytest

from tests.oracle import by_duckdb, by_spark
from tidewater.operators.ranking import multi_sort
from tidewater.plans.queries import ORACLE, QUERIES
from tidewater.sources.readers import read_table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert by_spark(QUERIES[name](spark, FOLDER)) == by_duckdb(FOLDER, ORACLE[name])


def test_k_means_is_reproducible(spark):
    a, b = (QUERIES["w25_k_means"](spark, FOLDER).collect() for _ in range(2))
    assert a == b and len(a) == 3 and sum(r["size"] for r in a) > 0


def test_k_means_sizes_and_cost_follow_from_its_centres(spark):
    rows = QUERIES["w25_k_means"](spark, FOLDER).orderBy("cluster").collect()
    x = np.array([r["embedding"] for r in read_table(spark, FOLDER, "embeddings").select("embedding").collect()], float)
    far = ((x[:, None, :] - np.array([r["center"] for r in rows])[None]) ** 2).sum(2)
    assert np.bincount(far.argmin(1), minlength=len(rows)).tolist() == [r["size"] for r in rows]
    assert abs(far.min(1).sum() - rows[0]["cost"]) < 1e-6 * rows[0]["cost"]


def test_secondary_sort_is_sorted(spark):
    out = [(r["key"], r["value"]) for r in QUERIES["w06_secondary_sort"](spark, FOLDER).collect()]
    assert out == sorted(out, reverse=True)


def test_multi_sort_is_sorted(spark):
    out = [(r["ts"], r["value"], r["event_id"]) for r in multi_sort(read_table(spark, FOLDER, "events"), "ts", "value", "event_id").collect()]
    assert out == sorted(out)
