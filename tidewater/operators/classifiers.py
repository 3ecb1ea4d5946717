"""k nearest neighbours, naive Bayes, k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalars import euclidean
from tidewater.operators.neighbours import k_nearest


def knn_classify(queries: DataFrame, labelled: DataFrame, k: int, q_id: str = "id", s_id: str = "id", vector: str = "vector", label: str = "label") -> DataFrame:
    """q and the most frequent label of its k nearest, of equally frequent ones the smallest, for each query that has a neighbour."""
    votes = k_nearest(queries, labelled, k, q_id, s_id, vector, label).groupBy("q", "label").agg(F.count("*").alias("votes"))
    first = Window.partitionBy("q").orderBy(F.desc("votes"), "label")
    return votes.withColumn("place", F.row_number().over(first)).where("place = 1").select("q", "label")


def train_naive_bayes(df: DataFrame, attributes: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Tables (attr, label, prob) and (label, prior) from labelled rows, without smoothing."""
    total = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    pairs = df.select(F.col(label).alias("label"), F.explode(F.array(*attributes)).alias("attr")).groupBy("attr", "label").agg(F.count("*").alias("c"))
    table = pairs.join(total, "label").select("attr", "label", (F.col("c") / F.col("n")).alias("prob"))
    prior = total.select("label", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("prior"))
    return table, prior


def naive_bayes(records: DataFrame, attributes: list[str], table: DataFrame, classes: DataFrame, prior: DataFrame) -> DataFrame:
    """The attributes of each distinct record with its likeliest class: prior (1 where there is none) times the attributes'
    probabilities (0 where there is none); of equally likely ones the smallest. Records are thinned to distinct ones first."""
    rec = F.struct(*attributes).alias("rec")
    distinct = records.select(*attributes).distinct().select(rec, F.array(*attributes).alias("attrs"))
    known = classes.select("label").distinct().join(prior, "label", "left").select("label", F.coalesce("prior", F.lit(1.0)).alias("prior"))
    # a class that lacks one of a record's attributes has a score of 0: only those that have all of them are joined
    each = distinct.select("rec", F.size("attrs").alias("n"), F.explode("attrs").alias("attr")).join(table, "attr").join(known, "label")
    scores = each.groupBy("rec", "label").agg(F.first("n").alias("n"), F.count("*").alias("k"), (F.first("prior") * F.product(F.coalesce("prob", F.lit(0.0)))).alias("score"))
    best = scores.where("n = k AND score > 0").groupBy("rec").agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), "label")).alias("b"))
    none = known.agg(F.min("label").alias("least"))  # one row
    out = distinct.select("rec").alias("d").join(best.alias("s"), F.col("d.rec").eqNullSafe(F.col("s.rec")), "left").join(none, F.lit(True))
    return out.where("least IS NOT NULL").select("d.rec.*", F.coalesce("b.label", "least").alias("best"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def k_means(df: DataFrame, vector: str, k: int = 3, max_iter: int = 10, seed: int = 42):
    """A fitted model of k-means by the parallel start."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, maxIter=max_iter, seed=seed, initMode="k-means||").fit(rows)


def k_means_cost(df: DataFrame, vector: str, centers: list[list[float]]) -> float:
    """Sum over all rows of the squared distance to the nearest centre."""
    near = F.array_min(F.array(*[euclidean(F.col(vector), F.array(*[F.lit(float(x)) for x in c])) for c in centers]))
    return float(df.where(F.col(vector).isNotNull()).agg(F.sum(near * near)).first()[0] or 0.0)


def k_means_centers(df: DataFrame, vector: str, k: int = 3, max_iter: int = 10, seed: int = 42) -> DataFrame:
    """cluster, size, cost (of all clusters, by the final centres) and center."""
    model = k_means(df, vector, k, max_iter, seed)
    # the summary's cost is that of the centres before the last step
    cost = k_means_cost(df, vector, [[float(x) for x in c] for c in model.clusterCenters()])
    rows = [(i, int(n), cost, [float(x) for x in c]) for i, (n, c) in enumerate(zip(model.summary.clusterSizes, model.clusterCenters(), strict=True))]
    return df.sparkSession.createDataFrame(rows, "cluster int, size bigint, cost double, center array<double>")
