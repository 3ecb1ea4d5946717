"""Small inputs with results worked out by hand."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import baskets, classifiers, graphs, joins, ranking, sequences, similarity, trips
from tidewater.sources import readers, writers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_n(spark):
    df = frame(spark, [("c1", 12), ("c2", 30), ("c3", 7), ("c4", 30), ("c5", 25)], "r string, k int")
    assert [(r["r"], r["k"]) for r in ranking.top_n(df, "k", 2, ["r"]).orderBy("rank").collect()] == [("c2", 30), ("c5", 25)]
    assert {(r["r"], r["k"]) for r in ranking.top_n_groups(df, "k", 2).collect()} == {("c2", 30), ("c4", 30), ("c5", 25)}
    assert ranking.top_n(df.where("false"), "k", 2, ["r"]).count() == 0


def test_top_n_sums(spark):
    df = frame(spark, [("A", 3), ("B", 5), ("A", 4), ("C", 7), ("D", 5), ("B", 2)], "k string, f int")
    assert [(r["total"], r["keys"]) for r in ranking.top_n_sums(df, "k", F.col("f"), 2).orderBy("rank").collect()] == [(7, ["A", "B", "C"]), (5, ["D"])]


def test_secondary_sort(spark):
    df = frame(spark, [("2012", "1", 5), ("2012", "1", 45), ("2012", "2", 10)], "a string, b string, v int").withColumn("k", F.concat_ws("-", "a", "b"))
    assert [(r["k"], r["v"]) for r in ranking.secondary_sort(df, "k", "v", total=True).collect()] == [("2012-2", 10), ("2012-1", 45), ("2012-1", 5)]
    many = frame(spark, [(f"k{i % 11}", i * 7 % 13) for i in range(200)], "k string, v int")
    own = ranking.secondary_sort(many, "k", "v", partitions=3).select("k", "v", F.spark_partition_id().alias("n")).collect()
    assert len({r["n"] for r in own}) > 1 and len({(r["k"], r["n"]) for r in own}) == 11
    for n in {r["n"] for r in own}:
        rows = [(r["k"], r["v"]) for r in own if r["n"] == n]
        assert rows == sorted(rows, reverse=True)
    t = frame(spark, [("2012", "01", 5), ("2012", "01", 45), ("2012", "01", 35), ("2012", "02", 10)], "y string, m string, t int")
    assert tuples(ranking.joined_values(t, [F.col("y"), F.col("m")], F.col("t"), F.col("t").cast("string"))) == [("201201", "45,35,5,"), ("201202", "10,")]


@pytest.mark.parametrize(("missing", "expected"), [("label", [("p1", 2), ("p2", 1), ("p3", 2)]), ("ignore", [("p1", 2), ("p2", 0), ("p3", 1)]), ("drop", [("p1", 2), ("p3", 1)])])
def test_left_joins(spark, missing, expected):
    users = frame(spark, [("u1", "UT"), ("u2", "GA")], "u string, loc string")
    tx = frame(spark, [("p1", "u1"), ("p1", "u2"), ("p2", "u9"), ("p3", "u1"), ("p3", "u9")], "p string, u string")
    assert tuples(joins.location_counts(tx, users, "u", "p", "loc", missing)) == expected


def test_location_lists(spark):
    users = frame(spark, [("u1", "UT"), ("u2", "GA")], "u string, loc string")
    tx = frame(spark, [("p1", "u1"), ("p1", "u2"), ("p1", "u2"), ("p2", "u9")], "p string, u string")
    assert tuples(joins.location_lists(tx, users, "u", "p", "loc")) == [("p1", ["GA", "UT"]), ("p2", [])]


def test_top_n_rows_and_keys(spark):
    df = frame(spark, [("a", 1.5), ("b", 9.0), ("c", 9.0), ("d", None)], "r string, w double")
    assert [r["r"] for r in ranking.top_n_rows(df, "w", 2, ["r"]).collect()] == ["b", "c"]
    sums = frame(spark, [("A", 3), ("B", 5), ("A", 4), ("C", 7), ("B", 2)], "k string, f int")
    assert tuples(ranking.top_n_keys(sums, "k", F.col("f"), 2)) == [("A", 7), ("B", 7)]


def test_relative_frequency(spark):
    df = frame(spark, [(["a", "b", "a"],), (["x"],), ([],)], "t array<string>")
    assert tuples(sequences.relative_frequency(df, "t", 2)) == [("a", "a", 0.5), ("a", "b", 0.5), ("b", "a", 1.0)]
    dirty = frame(spark, [(["a-", "--", "b"],)], "t array<string>")
    assert tuples(sequences.relative_frequency(sequences.clean_tokens(dirty, "t"), "t", 1)) == [("a", "b", 1.0), ("b", "a", 1.0)]
    line = frame(spark, [("a- -- b  Ünï_c1\nd ,", )], "l string")
    assert sequences.clean_words(line, "l").first()[0] == sequences.clean_tokens(line.select(F.split("l", " ").alias("t")), "t").first()[0] == ["a", "b", "n_c1d"]


def test_moving_average(spark):
    lines = frame(spark, [(x,) for x in ("A,2020-01-03,30", "A,2020-01-01,10", "A,2020-01-04,40", "A,2020-01-02,20", "A,notadate,1", "", "A,2020-01-09")], "value string")
    out = sequences.moving_average(sequences.parse_prices(lines), "symbol", ["date"], "price", 3)
    assert [r["avg"] for r in out.orderBy("date").collect()] == [10, 15, 20, 30]
    with pytest.raises(ValueError, match="window"):
        sequences.moving_average(lines, "value", ["value"], "value", 0)


def test_baskets(spark):
    df = frame(spark, [(["a", "b"],), (["b", "a", "c"],), (["a"],)], "items array<string>")
    assert {(",".join(r[0]), r[1]) for r in baskets.frequent_itemsets(df, "items", 3).collect()} == {("a", 3), ("b", 2), ("c", 1), ("a,b", 2), ("a,c", 1), ("b,c", 1), ("a,b,c", 1)}
    assert tuples(baskets.frequent_itemsets(df, "items")) == tuples(baskets.frequent_itemsets(df, "items", 3))
    assert tuples(baskets.frequent_itemsets(df, "items", None, 2)) == [(["a"], 3), (["a", "b"], 2), (["b"], 2)]
    rules = {(",".join(r[0]), r[1], round(r[2], 4)) for r in baskets.association_rules(df, "items", 3).collect()}
    assert rules == {("a", "b", 0.6667), ("b", "a", 1), ("a", "c", 0.3333), ("c", "a", 1), ("b", "c", 0.5), ("c", "b", 1), ("a,b", "c", 0.5), ("a,c", "b", 1), ("b,c", "a", 1)}
    fp = {(",".join(sorted(r["antecedent"])), r["consequent"][0], round(r["confidence"], 4)) for r in baskets.fp_growth_rules(df, "items", 0.01, 0.0).collect()}
    assert fp == rules


def test_combinations(spark):
    df = frame(spark, [(["c", "a", "b", "a"],)], "x array<string>")
    assert df.select(scalars.all_subsets(F.col("x"), 3)).first()[0] == scalars.sorted_combinations(["c", "a", "b", "a"])
    assert len(scalars.sorted_combinations(list("abcde"), 2)) == 10
    assert scalars.sorted_combinations(["a"], 0) == [[]]


def test_common_friends(spark):
    lists = frame(spark, [(1, [2, 3, 4, 5]), (2, [1, 3, 4, 4]), (3, [1, 2]), (4, [1, 2])], "person bigint, friends array<bigint>")
    got = {(r["p"], r["q"]): r["common"] for r in graphs.common_friends(graphs.adjacency_edges(lists)).collect()}
    assert got == {(1, 2): [3, 4], (1, 3): [2], (1, 4): [2], (2, 3): [1], (2, 4): [1], (1, 5): []}


def test_one_sided_friends(spark):
    lines = frame(spark, [("1,2 3  4",), ("2,1 3",), ("3,",), ("5",)], "value string")
    lists = graphs.friend_lists(lines)
    assert tuples(lists) == [(1, [2, 3, 4]), (2, [1, 3]), (3, []), (5, [])]
    none, whole = ({(r["p"], r["q"]): r["common"] for r in graphs.common_friends(graphs.adjacency_edges(lists), one_sided=x).collect()} for x in ("none", "all"))
    assert none == {(1, 2): [3], (1, 3): [], (1, 4): [], (2, 3): []}
    assert whole == {(1, 2): [3], (1, 3): [2, 3, 4], (1, 4): [2, 3, 4], (2, 3): [1, 3]}


@pytest.mark.parametrize(("edges", "expected"), [([(1, 2), (2, 3), (1, 3), (3, 4), (2, 4), (3, 1), (2, 2)], [(1, 2, 3), (2, 3, 4)]), ([(0, 1), (0, 2), (1, 3), (2, 3)], [])])
def test_triangles(spark, edges, expected):
    assert tuples(graphs.triangles(frame(spark, edges, "src bigint, dst bigint"))) == expected


def shuffled_rows(node) -> int:
    """Rows that the exchanges of a plan wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(node.plan())
    below = node.children()
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_rows(below.apply(i)) for i in range(below.size()))


def dense(spark, mirrored: bool):
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60)]
    return frame(spark, pairs + [(b, a) for a, b in pairs if mirrored], "src bigint, dst bigint")


def test_triangles_exchange_no_wedges(spark):
    out = graphs.triangles(dense(spark, False))
    assert len(out.collect()) == 34220 and shuffled_rows(out._jdf.queryExecution().executedPlan()) < 1770


def test_common_friends_exchange_no_wedges(spark):
    out = graphs.common_friends(dense(spark, True))
    assert all(len(r["common"]) == 58 for r in out.collect()) and shuffled_rows(out._jdf.queryExecution().executedPlan()) < 1770


def test_one_sided_friends_exchange_no_pairs(spark):
    out = graphs.common_friends(dense(spark, False), one_sided="all", separator=" ")
    assert all(r["common"] == " ".join(map(str, range(r["p"] + 1, 60))) for r in out.collect())
    assert out.count() == 1770 and shuffled_rows(out._jdf.queryExecution().executedPlan()) < 1770


def test_graphs_of_many_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK_MOST", 60)
    monkeypatch.setattr(graphs, "DRAWERS", 3)
    draw = random.Random(5)
    rows = [(draw.randrange(40), draw.randrange(40)) for _ in range(500)] + [(3, None), (None, 4)]
    df, of = frame(spark, rows, "src int, dst bigint"), {}
    for a, b in rows:
        if a is not None:
            of.setdefault(a, set()).update({b} - {None})
    pairs = {(min(a, b), max(a, b)) for a in of for b in of[a] if a != b}
    both = lambda a, b: b in of.get(a, ()) and a in of.get(b, ())
    for one_sided in ("none", "all"):
        got = tuples(graphs.common_friends(df, one_sided=one_sided))
        whole = lambda a, b: of[a if b in of.get(a, ()) else b] if one_sided == "all" else ()  # noqa: E731, B023
        assert got == sorted((a, b, sorted(of[a] & of[b] if both(a, b) else whole(a, b))) for a, b in pairs)
    assert tuples(graphs.triangles(df)) == [t for t in itertools.combinations(range(40), 3) if pairs.issuperset(itertools.combinations(t, 2))]


def test_item_similarity(spark):
    r = frame(spark, [("u1", "A", 5), ("u1", "B", 3), ("u2", "A", 4), ("u2", "B", 2), ("u3", "A", 1), ("u3", "C", 1)], "user string, item string, rating int")
    got = {(x["item1"], x["item2"]): x for x in similarity.item_similarity(r).collect()}
    ab = got["A", "B"]
    assert ab["n"] == 2 and math.isclose(ab["pearson"], 1) and math.isclose(ab["cosine"], 23 / math.sqrt(533)) and math.isclose(ab["jaccard"], 2 / 3)
    assert got["A", "C"]["pearson"] is None


@pytest.mark.parametrize(("k", "label"), [(1, "B"), (2, "A"), (3, "A")])
def test_knn(spark, k, label):
    q = frame(spark, [("r1", [0.0, 0.0])], "id string, vector array<double>")
    s = frame(spark, [("s1", "A", [1.0, 0.0]), ("s2", "A", [0.0, 2.0]), ("s3", "B", [0.5, 0.0])], "id string, label string, vector array<double>")
    assert tuples(classifiers.knn_classify(q, s, k)) == [("r1", label)]


def test_naive_bayes(spark):
    table = frame(spark, [("sunny", "yes", 0.2), ("sunny", "no", 0.5), ("hot", "yes", 0.3), ("hot", "no", 0.4)], "attr string, label string, prob double")
    prior = frame(spark, [("yes", 0.6), ("no", 0.4)], "label string, prior double")
    records = frame(spark, [("sunny", "hot"), ("rain", "hot")], "a string, b string")
    got = {r["a"]: (r["best"], round(r["score"], 6)) for r in classifiers.naive_bayes(records, ["a", "b"], table, prior.select("label"), prior).collect()}
    assert got == {"sunny": ("no", 0.08), "rain": ("no", 0.0)}
    only = classifiers.naive_bayes(records, ["a", "b"], table, frame(spark, [("yes",)], "label string"), prior.where("false"))
    assert {round(r["score"], 6) for r in only.collect()} == {0.06, 0.0}


def test_k_means(spark):
    df = frame(spark, [([float(x), float(y)],) for x, y in ((0, 0), (0, 1), (10, 10), (10, 11), (20, 0), (20, 1))], "v array<double>")
    rows = classifiers.k_means_centers(df, "v", 3).collect()
    assert math.isclose(rows[0]["cost"], 1.5) and sorted(r["center"] for r in rows) == [[0, 0.5], [10, 10.5], [20, 0.5]]


def test_trips(spark):
    at = lambda x: f"2018-12-10 {x}"
    df = frame(spark, [("R1", at("05:30:00")), ("R1", at("05:30:01")), ("R1", at("08:59:59")), ("R2", at("09:00:00")), ("R2", at("07:00:00")), ("R3", "no time")], "r string, t string")
    lo, hi = at("05:30:00"), at("09:00:00")
    assert tuples(trips.origin_counts(df, "r", "t", lo, hi)) == [("R1", 2), ("R2", 1)]
    assert tuples(trips.origin_counts(df, "r", "t", lo, hi, closed="left")) == [("R1", 3), ("R2", 1)]
    assert tuples(trips.origin_counts(df, "r")) == [("R1", 3), ("R2", 2), ("R3", 1)]


def test_days(spark):
    df = spark.sql("SELECT DATE '2019-10-12' AS a, DATE '2019-10-01' AS b, DATE '2019-10-10' AS c")
    row = df.select(scalars.weekday(F.col("a")), scalars.date_text(F.col("a")), F.size(scalars.date_range(F.col("b"), F.col("c"))), scalars.date_range(F.col("c"), F.col("b"))).first()
    assert row[0] == 7 and row[1] == "2019/10/12 00:00:00 Sat" and row[2] == 10 and len(row[3]) == 1
    known = frame(spark, [("2019-10-12", 2)], "date string, type int").select(F.col("date").cast("date").alias("date"), "type")
    days = frame(spark, [("2019-10-12",), ("2019-10-13",), ("2019-10-14",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    assert sorted(r["day_type"] for r in trips.day_types(days, "d", known).collect()) == [-1, 0, 2, 3]


def test_jdbc_append(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    for _ in range(2):
        writers.append_jdbc(frame(spark, [(1, 2.5), (2, 3.5)], "k int, v double"), url, "trips", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = spark.read.format("jdbc").options(**writers.jdbc_options(url, "trips", driver="org.apache.derby.jdbc.EmbeddedDriver")).load()
    assert tuples(back) == [(1, 2.5), (1, 2.5), (2, 3.5), (2, 3.5)]


def test_console(spark, capsys):
    df = frame(spark, [("a", 1)], "k string, v int")
    writers.show(df)
    writers.print_rows(df)
    assert "(a,1)" in capsys.readouterr().out


def test_scalars(spark):
    at = spark.sql("SELECT TIMESTAMP '1970-01-02 00:00:01' AS t, DATE '1970-01-02' AS d, ' a  b\tc ' AS l")
    assert at.select(scalars.epoch_millis(F.col("t")), scalars.epoch_millis(F.col("d")), scalars.split_white(F.col("l"))).first()[:] == (86_401_000, 86_400_000, ["a", "b", "c"])
    df = frame(spark, [("a,b,,", '{"data":1}', "oops")], "l string, j string, bad string")
    assert df.select(scalars.split_fields(F.col("l")), scalars.json_int(F.col("j"), "data"), scalars.json_int(F.col("bad"), "data")).first()[:] == (["a", "b"], 1, -1)
    v = spark.sql("SELECT array(0D, 3D) AS a, array(4F, 0F) AS b, array(1D) AS c")
    assert v.select(scalars.euclidean(F.col("a"), F.col("b"))).first()[0] == 5
    assert math.isnan(v.select(scalars.euclidean(F.col("a"), F.col("c"))).first()[0])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,1\nb,x\nc,3\n")
    assert tuples(readers.read_csv(spark, str(tmp_path / "in.csv"), "k string, v int", "skip")) == [("a", 1), ("c", 3)]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(tmp_path / "in.csv"), "k string, v int").collect()
    assert readers.read_lines(spark, str(tmp_path / "in.csv")).count() == 3
    df = frame(spark, [("a", 1, 2)], "k string, v int, w int")
    writers.write_key_values(df, str(tmp_path / "kv"))
    assert readers.read_lines(spark, str(tmp_path / "kv")).first()[0] == "a\t1,2"
    writers.write_delimited(df, str(tmp_path / "tsv"), sep="\t", single_file=True)
    assert readers.read_lines(spark, str(tmp_path / "tsv")).first()[0] == "a\t1\t2"
    writers.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_parquet(df, str(tmp_path / "pq"))
    assert readers.path_exists(spark, str(tmp_path / "pq")) and not readers.path_exists(spark, str(tmp_path / "none"))
    assert readers.list_files(spark, str(tmp_path / "tsv")).count() >= 1
    assert writers.jdbc_options("jdbc:x", "t", user="u") == {"url": "jdbc:x", "dbtable": "t", "user": "u", "batchsize": "10000"}


def test_streaming_counts(spark, tmp_path):
    from tidewater.streaming import trips as streams

    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:01:00', 'x'), (TIMESTAMP '2024-01-01 00:02:00', 'x'), (TIMESTAMP '2024-01-01 02:00:00', 'y') AS t(ts, r)")
    rows.write.parquet(str(tmp_path / "in"))
    counted = streams.windowed_counts(streams.read_events(spark, str(tmp_path / "in"), rows.schema), "r", "ts")
    streams.start(counted, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    # the last window is open until later events come
    assert [(r["r"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("x", 2)]
