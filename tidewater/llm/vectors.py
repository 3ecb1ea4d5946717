"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors are one class. Classes are dealt to overlapping cluster shards: those of their nearest centroids, at least
OVERLAP and as many as it takes for the share SHARED of pairs at cosine exactly the threshold, made from sampled vectors, to
have a shard in common; closer pairs have one more often. A shard beyond CELL rows becomes cells of two blocks each, so that every pair of its rows still meets in a cell. In each cell a graph is
built whose lists are robustly pruned (a candidate is left out if it is closer, by ALPHA, to one already taken). The lists
that a class gets in its cells are united. Every class is then searched for in its cells: greedily from the cell's medoids
with a beam, and from what lies within range on, until nothing new lies within range. Links are verified in double
precision. A pair that meets in several cells is counted in one of them, so links are counted without a row for each.

The result is audited: ASKED sampled classes are compared with all classes of the table. While the share of links found,
over all links or as a mean over the classes that have links, is below AUDIT, the search runs again: with a doubled beam, and
from three doublings on against all of a cell, if links inside cells are missed (some classes of each cell are compared with
all of it), else with twice as many shards for each class. At the end of this stands one shard in which all pairs are
compared, so no result below AUDIT is returned.

Bounds: the centroids are fitted on at most SAMPLE vectors and there are at most MAX_SHARDS; only these are collected and
sent out, ASKED of them for the audit. All vectors are indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of each
length are compared with each other, one length after the other; a null vec_id never becomes a component's id while another is
there, and is kept where its component has no id; rows with equal vec_id are told apart by a number given when they are written;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components, local_roots
from ._store import cut, free

THRESHOLD = 0.9
OVERLAP = 3
SHARD = 768
CELL = 1536
SAMPLE = 8192
#: Centroids are no closer than this cosine.
APART = 0.75
MAX_SHARDS = 4096
DEGREE, CANDIDATES, RANDOM, ALPHA = 20, 40, 8, 1.2
BEAM, MEDOIDS, SLACK = 32, 4, 0.05
AUDITED, AUDIT = 16, 0.95
#: Sampled classes that are compared with all, and how many of them at once; the share of pairs at the threshold that shall meet.
ABREAST, ASKED, SHARED = 256, 2048, 0.97


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(finite & some, F.lit(False))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k unit centroids of unit rows x, by spherical k-means."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    # a dense group must not be shared out among many centroids, or its links would cross shards: of close ones the first stays
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < APART:
            kept.append(i)
    return c[kept]


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def overlap_needed(x: np.ndarray, centroids: np.ndarray, threshold: float) -> int:
    """How many nearest centroids a row needs for SHARED of the pairs (row of x, row at cosine threshold to it) to have one
    in common."""
    aside = np.random.default_rng(11).normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-9)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * aside
    ranks = [(-(v @ centroids.T)).argsort(1, kind="stable").argsort(1) for v in (x, y)]
    needed = np.sort(np.maximum(*ranks).min(1) + 1)
    return int(needed[min(len(needed) - 1, int(np.ceil(SHARED * len(needed))))])


def pruned_graph(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Robustly pruned lists of each row, filled up with -1: DEGREE own neighbours and as many that chose the row."""
    n = len(x)
    rng = np.random.default_rng(seed)
    own = np.full((n, DEGREE), -1, np.int64)
    near = min(CANDIDATES, n - 1)
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near < n - 1 else np.argsort(-sims, axis=1)[:, :near]
        cand = np.concatenate([cand, rng.integers(0, n, (len(rows), RANDOM))], axis=1)
        far = 1 - np.take_along_axis(sims, cand, 1)
        order = np.argsort(far, axis=1, kind="stable")
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        alive = cand != rows[:, None]
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        between = 1 - x[cand] @ x[cand].transpose(0, 2, 1)
        r = np.arange(len(rows))
        for k in range(DEGREE):
            pick = alive.argmax(1)
            some = alive[r, pick]
            own[rows[some], k] = cand[r, pick][some]
            alive &= ALPHA * between[r, pick] > far
            alive[r, pick] = False
            if not some.any():
                break
    src, dst = np.repeat(np.arange(n), DEGREE), own.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    return lists(np.concatenate([src, dst]), np.concatenate([dst, src]), n, 2 * DEGREE)


def lists(src: np.ndarray, dst: np.ndarray, n: int, most: int | None = None) -> np.ndarray:
    """Padded lists of n rows from pairs, first come first, each once, at most so many of a row."""
    _, first = np.unique(src * n + dst, return_index=True)
    first.sort()
    src, dst = src[first], dst[first]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    keep = rank < (most or len(src))
    out = np.full((n, int(rank[keep].max()) + 1 if keep.any() else 1), -1, np.int64)
    out[src[keep], rank[keep]] = dst[keep]
    return out


def range_search(x: np.ndarray, adjacent: np.ndarray, queries: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with rows of x whose cosine reaches threshold, as found by greedy search from medoids and expansion
    of what lies within range."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), bool)
    low = threshold - SLACK
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def look(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        seen[who, rows] = True
        s = np.concatenate([np.einsum("ij,ij->i", x[queries[who[i : i + 65536]]], x[rows[i : i + 65536]]) for i in range(0, len(who), 65536)] or [np.zeros(0)])
        close = s >= low
        if close.any():
            hits.append((who[close], rows[close], s[close]))
        return s

    step = -(-n // MEDOIDS)
    entries = np.unique([lo + (x[lo : lo + step] @ x[lo : lo + step].mean(0)).argmax() for lo in range(0, n, step)])
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -3.0)
    done = np.ones((q, beam), bool)
    k = min(len(entries), beam)
    who = np.repeat(np.arange(q), k)
    ids[:, :k] = entries[:k]
    sims[:, :k] = look(who, np.tile(entries[:k], q)).reshape(q, k)
    done[:, :k] = False
    active = np.arange(q)
    while len(active):
        pick = np.where(done[active], -4.0, sims[active]).argmax(1)
        active_rows = np.arange(len(active))
        node = ids[active, pick]
        done[active, pick] = True
        around = adjacent[node]
        new = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
        w, c = np.nonzero(new)
        s = np.full(around.shape, -3.0)
        s[w, c] = look(active[w], around[w, c])
        all_s = np.concatenate([sims[active], s], 1)
        all_i = np.concatenate([ids[active], np.where(new, around, -1)], 1)
        all_d = np.concatenate([done[active], ~new], 1)
        best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        r = active_rows[:, None]
        sims[active], ids[active], done[active] = all_s[r, best], all_i[r, best], all_d[r, best]
        active = active[~done[active].all(1)]
    at = 0
    while at < len(hits):
        who, rows, _ = hits[at]
        at += 1
        for i in range(0, len(who), 16384):
            around = adjacent[rows[i : i + 16384]]
            w, c = np.nonzero(around >= 0)
            a, b = who[i : i + 16384][w], around[w, c]
            fresh = np.flatnonzero(~seen[a, b])
            if len(fresh):
                pairs = np.unique(a[fresh] * n + b[fresh])
                look(pairs // n, pairs % n)
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, rows, s = (np.concatenate(v) for v in zip(*hits, strict=True))
    keep = (s >= threshold - 1e-6) & (queries[who] != rows)
    return queries[who[keep]], rows[keep]


def builder(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid")
    x = unit(pdf["v"])
    cids = pdf["cid"].to_numpy(np.int64)
    adjacent = pruned_graph(x) if len(x) > 1 else np.full((1, 1), -1)
    return pd.DataFrame({"cid": cids, "near": [cids[row[row >= 0]] for row in adjacent]})


def searcher(threshold: float, beam: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid").reset_index(drop=True)
        x, cids = unit(pdf["v"]), pdf["cid"].to_numpy(np.int64)
        copies, n = pdf["copies"].to_numpy(np.int64), len(pdf)
        src = np.repeat(np.arange(n), [len(v) for v in pdf["near"]])
        dst = np.concatenate([np.asarray(v, np.int64) for v in pdf["near"]]) if n else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(cids, dst), n - 1)
        here = cids[at] == dst
        src, dst = src[here], at[here]
        adjacent = lists(np.concatenate([src, dst]), np.concatenate([dst, src]), n)
        if beam:
            a, b = range_search(x, adjacent, np.arange(n), threshold, beam)
        else:
            near = [np.nonzero(x[i : i + 256] @ x.T >= threshold - 1e-6) for i in range(0, n, 256)]
            a, b = (np.concatenate(v) for v in zip(*[(p + 256 * i, q) for i, (p, q) in enumerate(near)], strict=True))
            a, b = a[a != b], b[a != b]
        key = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
        a, b = key // n, key % n
        exact = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        a, b = a[exact >= threshold], b[exact >= threshold]
        # the audit: some rows against all of the cell
        some = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(np.int64))
        truth = (x[some] @ x.T >= threshold).sum(1) - 1
        found = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        # of the shards that both rows have in common the smallest counts the pair; of its cells, the one of the two blocks, or the first
        shards = np.sort(np.stack(pdf["shards"].to_list()).astype(np.int64), 1)
        shard, i, j = (int(pdf[c].iloc[0]) for c in ("shard", "i", "j"))
        common = (shards[a][:, :, None] == shards[b][:, None, :]) & (shards[a][:, :, None] >= 0)
        least = np.where(common.any(2), shards[a], np.iinfo(np.int64).max).min(1)
        block = pdf["block"].to_numpy(np.int64)
        first = (i == j) | (i == 0) & ((block[a] == j) | (j == 1))  # the first cell of block b is (0, b), that of block 0 is (0, 1)
        within = np.where(block[a] == block[b], first, True)
        mine = (least == shard) & within
        links = np.bincount(a[mine], copies[b[mine]], n) + np.bincount(b[mine], copies[a[mine]], n)
        pairs = np.bincount(a[mine], minlength=n) + np.bincount(b[mine], minlength=n)
        roots = local_roots(n, a, b)
        return pd.DataFrame({"cid": cids, "links": links.astype(np.int64), "pairs": pairs.astype(np.int64), "root": cids[roots], "audit_true": np.bincount(some, truth, n).astype(np.int64), "audit_found": np.bincount(some, found[some], n).astype(np.int64)})

    return search


def all_pairs(classes: DataFrame, cids: np.ndarray, queries: np.ndarray, threshold: float) -> DataFrame:
    """cid and number of linked classes of the queries that have links, against all classes."""

    def count(batches):
        total = np.zeros(len(queries), np.int64)
        for pdf in batches:
            if len(pdf):
                x = unit(pdf["v"])
                for i in range(0, len(queries), ABREAST):
                    total[i : i + ABREAST] += (queries[i : i + ABREAST] @ x.T >= threshold).sum(1)
        yield pd.DataFrame({"cid": cids, "truth": total})

    counted = classes.select(F.col("v").cast("array<double>").alias("v")).mapInPandas(count, "cid bigint, truth bigint")
    return cut(counted.groupBy("cid").agg((F.sum("truth") - 1).alias("truth")).where("truth > 0"), "vector-truth")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Of the links in truth the share that was found: over all links, or the mean over the classes if that is less."""
    own = truth.join(found.groupBy("cid").agg(F.sum("pairs").alias("pairs")), "cid", "left").na.fill(0, ["pairs"])
    r = own.agg((F.sum("pairs") / F.sum("truth")).alias("all"), F.avg(F.col("pairs") / F.col("truth")).alias("mean")).first()
    return 1.0 if r["all"] is None else min(r["all"], r["mean"])


def graph(classes: DataFrame, centroids: np.ndarray, overlap: int) -> DataFrame:
    """Every class in each of its cells, with its united lists."""

    def nearest(batches):
        for pdf in batches:
            s = unit(pdf["v"]).astype(np.float32) @ centroids.T if len(pdf) else np.zeros((0, overlap))
            pdf["shards"] = list(np.argsort(-s, axis=1, kind="stable")[:, :overlap].astype(np.int32))
            yield pdf

    near = classes.select("cid", "copies", F.col("v").cast("array<double>").alias("v"))
    placed = cut(near.mapInPandas(nearest, "cid bigint, copies bigint, v array<double>, shards array<int>"), "vector-shards")
    # at most MAX_SHARDS rows
    counts = {r["shard"]: r["count"] for r in placed.select(F.explode("shards").alias("shard")).groupBy("shard").count().collect()}
    blocks = {k: -(-c // (CELL // 2)) if c > CELL else 1 for k, c in counts.items()}
    sizes = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    each = placed.withColumn("shard", F.explode("shards")).withColumn("blocks", sizes[F.col("shard")])
    each = each.withColumn("block", F.pmod(F.xxhash64("cid", "shard"), F.col("blocks").cast("long")).cast("int"))
    other = F.expr("IF(blocks = 1, array(0), filter(sequence(0, blocks - 1), x -> x != block))")
    cells = each.withColumn("other", F.explode(other)).select("cid", "copies", "v", "shards", "shard", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    adjacency = cells.select("cid", "v", "shard", "i", "j").groupBy("shard", "i", "j").applyInPandas(builder, "cid bigint, near array<bigint>")
    union = cut(adjacency.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")
    return cells.join(union, "cid")


def searched(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """cid, links (rows in other classes) and root of n classes of one length."""
    sampled = classes.select("cid", "v").orderBy(F.xxhash64("cid")).limit(SAMPLE).collect()
    sample = unit([r["v"] for r in sampled])
    centroids = fit_centroids(sample, min(MAX_SHARDS, max(1, -(-n * OVERLAP // SHARD)), max(1, len(sample) // 2))).astype(np.float32)
    overlap = min(max(OVERLAP, overlap_needed(sample[-ASKED:], centroids, threshold)), len(centroids))
    truth = all_pairs(classes, np.array([r["cid"] for r in sampled[:ASKED]]), sample[:ASKED], threshold)
    beam, linked = BEAM, None
    while True:
        if linked is None:
            linked = graph(classes, centroids, overlap)
        found = linked.groupBy("shard", "i", "j").applyInPandas(searcher(threshold, beam), "cid bigint, links bigint, pairs bigint, root bigint, audit_true bigint, audit_found bigint")
        found = cut(found, "vector-links")
        inside = found.agg(F.sum("audit_true").alias("t"), F.sum("audit_found").alias("f")).first()
        missed_inside = bool(inside["t"]) and inside["f"] < AUDIT * inside["t"]
        one = len(centroids) == 1
        if recall(found, truth) >= AUDIT and not missed_inside or one and not beam:
            break
        if beam and (missed_inside or one):
            beam = 2 * beam if beam < 4 * BEAM else 0
        else:
            overlap, linked = 2 * overlap, None
            if overlap >= len(centroids):
                centroids, overlap = centroids[:1], 1
        free(found)
    free(truth)
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    out = counted.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "links", F.coalesce("root", "cid").alias("root"))
    out = cut(out, "linked-classes")
    free(found, roots)
    return out


def links(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    rows = cut(table.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    digest = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    good = rows.where(usable(F.col("v"))).select("id", "row", "v", *digest)
    classes = good.groupBy("h1", "h2").agg(F.min("row").alias("cid"), F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("d", F.size("v")), "vector-classes")
    # a row for each length of which there are two classes
    lengths = classes.groupBy("d").count().where("count > 1").orderBy("d").collect()
    found = classes.select("cid", F.lit(0).cast("long").alias("links"), F.col("cid").alias("root")).where("false")
    for r in lengths:
        found = found.union(searched(classes.where(F.col("d") == r["d"]).drop("d"), r["count"], threshold))
    named = classes.select("h1", "h2", "cid", "least", "copies").join(found, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(heads, "root").select("h1", "h2", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("links"), "component")
    out = rows.join(good.select("row", "h1", "h2").join(named, ["h1", "h2"]), "row", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op10_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_pruned_graph": op10_pruned_graph}
ORACLE: dict[str, str] = {
    "op10_pruned_graph": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id)
SELECT id AS vec_id, (SELECT count(*) FROM e WHERE x = id) AS n_links, min(c) AS component_id, id = min(c) AS kept FROM r GROUP BY id"""
}
