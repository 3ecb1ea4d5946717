"""MinHash near-dedup by an inverted join of signature coordinates.

A document is the set of its distinct word shingles. Equal sets are one class. Each class has a signature of COORDINATES
MinHash values and is posted under (coordinate, value). Two classes with at least MATCHES equal coordinates have one in
common among the COORDINATES - MATCHES + 1 rarest of either, so each class is posted under its rarest only (prefix), and
its frequent ones are met when the equal coordinates of a pair are counted (skip). A pair of Jaccard similarity 0.8 reaches
MATCHES but for less than one in a million.

A list of postings may hold a large group of near copies, so its pairs aren't written out. The list's pivot, the class with
the most frequent coordinates, is met with each class that shares one of its lists; what reaches MATCHES is confirmed on the
full sets. Lists of one pivot make a cluster. Classes that are then in the pivot's component need no comparison with each
other; those that aren't ("odd" ones) are compared, in tiles, with all of the cluster that is in other components. No
comparison that could join two components is left out.

Both comparisons go by tiles: some classes' texts on either side, of which a task makes the sets, counts all intersections
at once and returns a spanning forest of the links. A tile is bounded in rows and bytes, its texts are sent to it once, and no
row is made for a pair. The work of odd classes grows with their number times the size of their cluster.

Defined results: null text counts as empty; documents without words have n_shingles 0 and link with nothing; a null doc_id
never becomes a component's id while another is there; equal rows are in one component and both kept by `kept`, one of
them by deduplicated(); an empty table gives an empty result; extra columns are ignored, or kept by deduplicated(). Very long texts
are worked on whole, each by itself, in memory some 20 times their size. Shingles are compared by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import SLICE_BYTES, map_rows
from ._graph import components, local_roots
from ._store import cut, free
from .segmentation import mixed

COORDINATES, MATCHES = 64, 34
PERCENT = 80
#: Rows of a tile's side at least and at most, parts that a cluster has before its tiles grow, and bytes of a side. Small tiles deal a
#: cluster out evenly.
TILE, MOST, PARTS, TILE_BYTES = 96, 1024, 64, 8 << 20
#: Shingles that are counted at once.
COLUMNS = 4096
#: Words of a shingle where no contract says otherwise.
SHINGLE = 5

SEED = 41
_rng = np.random.default_rng(41)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
FLIP = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text's begin. Each distinct word is hashed once, by a
    function that isn't linear in its bytes."""
    # bytes lower A to Z only, and part at the contract's white space
    own = [t.lower().split() for t in texts]
    known = {w: xxhash.xxh3_64_intdigest(w, SEED) for w in set(chain.from_iterable(own))}
    edges = np.cumsum([0, *map(len, own)])
    return np.fromiter(map(known.__getitem__, chain.from_iterable(own)), np.uint64, edges[-1]), edges


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of n words; of its whole word sequence if that is shorter."""
    words, edges = hashed_words(texts)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled += words[k : len(words) - n + 1 + k] * PLACE[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The 32-bit MinHash values of each non-empty set, a row each."""
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        values = ((every ^ FLIP[k]) * MULTIPLY[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(values, at)
    return out.view(np.int32)


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def signed(docs: DataFrame, words: int) -> DataFrame:
    """row, id, k1, k2 of every row of docs(row, id, k1, k2, text), its number of shingles n, their digest's halves d1 and d2 and
    the signature sig; null where there is no shingle."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(cols: dict) -> dict:
        sets = shingle_sets(cols["text"], words)
        full = [i for i, s in enumerate(sets) if len(s)]
        sigs: list = [None] * len(sets)
        digests: list = [(None, None)] * len(sets)
        if full:
            for i, sig in zip(full, signatures([sets[i] for i in full]), strict=True):
                sigs[i] = sig
                digests[i] = tuple(np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64).tolist())
        return {k: cols[k] for k in ("row", "id", "k1", "k2")} | {"n": [len(s) for s in sets], "d1": [d[0] for d in digests], "d2": [d[1] for d in digests], "sig": sigs}

    return map_rows(docs, run, f"row bigint, id {kind}, k1 bigint, k2 bigint, n bigint, d1 bigint, d2 bigint, sig array<int>")


def shared_counts(mine: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each set of mine has in common with each of others."""
    sets = [*mine, *others]
    out = np.zeros((len(mine), len(others)), np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    both = np.zeros((2, len(values)), bool)
    both[(row >= len(mine)).astype(int), place] = True
    both = both.all(0)
    keep = np.flatnonzero(both[place])
    row, place = row[keep], (np.cumsum(both) - 1)[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for lo in range(0, int(both.sum()), COLUMNS):
        a, b = np.searchsorted(place, [lo, lo + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[a:b], place[a:b] - lo] = 1
        out += (x[: len(mine)] @ x[len(mine) :].T).astype(np.int64)
    return out


def comparer(words: int):
    """Of a tile (side, label, text) edges between labels that tie together what has links across its two sides."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode() for t in pdf["text"]]
        edges = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // SLICE_BYTES)) + 1
        sets = [s for part in np.split(np.arange(len(texts)), edges) for s in shingle_sets([texts[i] for i in part], words)]
        side, label = pdf["side"].to_numpy(), pdf["label"].to_numpy(np.int64)
        mine, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        size = np.array([len(s) for s in sets], np.int64)
        both = shared_counts([sets[i] for i in mine], [sets[i] for i in others])
        link = both * 100 >= PERCENT * (size[mine][:, None] + size[others][None, :] - both)
        x, y = np.nonzero(link & (label[mine][:, None] != label[others][None, :]))
        names, ends = np.unique(np.concatenate([label[mine[x]], label[others[y]]]), return_inverse=True)
        root = local_roots(len(names), ends[: len(x)], ends[len(x) :])
        tied = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"u": names[tied], "v": names[root[tied]]})

    return compare


def compared(sides: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Edges (u, v) between labels from the tiles of sides(pivot, i, j, side, cid, label); texts: cid and text."""
    full = sides.join(texts, "cid").select("pivot", "i", "j", "side", "label", "text")
    return full.groupBy("pivot", "i", "j").applyInPandas(comparer(words), "u bigint, v bigint")


def parts_of(rows: str, size: str) -> Column:
    """In how many parts so many rows with so many bytes are dealt."""
    tile = F.least(F.lit(MOST), F.greatest(F.lit(TILE), F.ceil(F.col(rows) / PARTS)))
    return F.greatest(F.ceil(F.col(rows) / tile), F.ceil(F.col(size) / TILE_BYTES)).cast("int")


def up_to(n: Column | str) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.col(n) if isinstance(n, str) else n) - 1))


def met_with_pivots(pairs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides of the tiles in which each cid of pairs(cid, pivot) meets its pivot, and the table of each pivot's tiles that they
    read: a table, as the rows of a hot pivot can't be split in a join with an aggregate."""
    n = pairs.join(sizes, "cid").groupBy("pivot").agg(F.count("*").alias("m"), F.sum("bytes").alias("b")).select("pivot", parts_of("m", "b").alias("nj"))
    n = cut(n, "tiles-with-pivots")
    part = F.pmod(F.xxhash64("cid"), F.col("nj").cast("long")).cast("int").alias("j")
    others = pairs.join(n, "pivot").select("pivot", F.lit(0).alias("i"), part, F.lit(1).alias("side"), "cid", F.col("cid").alias("label"))
    own = n.select("pivot", F.lit(0).alias("i"), up_to("nj").alias("j"), F.lit(0).alias("side"), F.col("pivot").alias("cid"), F.col("pivot").alias("label"))
    return own.union(others), n


def met_with_all(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides of the tiles in which odd classes meet all of their clusters, and the table of each pivot's tiles that they read.
    marked: pivot, cid, label, odd, bytes."""
    sum_if = lambda c: F.sum(F.when(F.col("odd"), c).otherwise(0).cast("long"))
    n = marked.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("bytes").alias("b"), sum_if(F.lit(1)).alias("om"), sum_if(F.col("bytes")).alias("ob")).where("om > 0")
    n = n.select("pivot", parts_of("m", "b").alias("nj"), parts_of("om", "ob").alias("ni"))
    n = cut(n, "tiles-with-all")
    every = marked.join(n, "pivot")
    part = lambda c: F.pmod(F.xxhash64("cid"), F.col(c).cast("long")).cast("int")
    odd = every.where("odd").select("pivot", part("ni").alias("i"), up_to("nj").alias("j"), F.lit(0).alias("side"), "cid", "label")
    return odd.union(every.select("pivot", up_to("ni").alias("i"), part("nj").alias("j"), F.lit(1).alias("side"), "cid", "label")), n


def candidates(classes: DataFrame) -> DataFrame | None:
    """pivot and cid of all classes that share a list of postings with a pivot; None if there is none."""
    # a coordinate-value pair as one number: the coordinate above the 32 bits of the value
    tokens = classes.select("cid", F.posexplode("sig").alias("k", "value")).select("cid", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("tok"))
    shared = cut(tokens.groupBy("tok").agg(F.count("*").alias("freq")).where("freq > 1"), "frequent-coordinates")
    held = tokens.join(shared, "tok").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("freq", "tok"))).alias("held"), F.sum("freq").alias("score"))
    held = held.where(F.size("held") >= MATCHES)
    posts = cut(held.select("cid", "score", F.explode(F.expr(f"transform(slice(held, 1, size(held) - {MATCHES - 1}), x -> x.tok)")).alias("tok")), "postings")
    free(shared)
    lists = posts.groupBy("tok").agg(F.max(F.struct(F.col("score"), (-F.col("cid")).alias("c"))).alias("p"), F.count("*").alias("m")).where("m > 1")
    # a table, as a join with an aggregate can't be split where a coordinate is hot
    lists = cut(lists.select("tok", (-F.col("p.c")).alias("pivot")), "lists")
    pairs = cut(posts.select("tok", "cid").join(lists, "tok").where("cid != pivot").select("pivot", "cid").distinct(), "pairs-with-pivots")
    free(posts, lists)
    return None if pairs.isEmpty() else pairs


def class_roots(classes: DataFrame, docs: DataFrame, words: int) -> DataFrame | None:
    """node and root of all classes (cid, k1, k2, sig) that link with another; docs: k1, k2, text."""
    pairs = candidates(classes)
    if pairs is None:
        return None
    needed = pairs.select("cid").union(pairs.select("pivot")).distinct()
    wanted = classes.join(needed, "cid", "left_semi").select("cid", "k1", "k2")
    # a text may stand in a great many rows: one is taken of each task's, then one of all
    texts = docs.join(wanted, ["k1", "k2"]).groupBy("cid").agg(F.first("text").alias("text"))
    texts = cut(texts, "candidate-texts")
    sizes = texts.select("cid", F.octet_length("text").cast("long").alias("bytes"))
    sig = classes.select("cid", "sig")
    both = pairs.join(sig, "cid").join(sig.select(F.col("cid").alias("pivot"), F.col("sig").alias("other")), "pivot")
    equal = F.aggregate(F.zip_with("sig", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    matched = cut(both.where(equal >= MATCHES).select("pivot", "cid"), "matched-pairs")
    sides, tiles = met_with_pivots(matched, sizes)
    links = cut(compared(sides, texts, words), "links")
    free(matched, tiles)
    roots = components(links)
    named = lambda df, of, to: df.join(roots.select(F.col("node").alias(of), F.col("root").alias(to)), of, "left").withColumn(to, F.coalesce(to, of))
    every = pairs.union(pairs.select("pivot", F.col("pivot").alias("cid")).distinct())
    marked = named(named(every, "cid", "label"), "pivot", "own").withColumn("odd", F.col("label") != F.col("own"))
    marked = cut(marked.join(sizes, "cid").select("pivot", "cid", "label", "odd", "bytes"), "marked")
    sides, tiles = met_with_all(marked)
    more = cut(compared(sides, texts, words), "more-links")
    free(pairs, texts, marked, tiles)
    if more.isEmpty():
        free(links, more)
        return roots
    # labels are roots already: only what they tie together is new
    second = components(more)
    over = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    out = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = cut(out.union(second.join(roots, "node", "left_anti").select("node", "root")), "roots")
    free(links, more, roots, second)
    return out


def grouped(docs: DataFrame, words: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """For each row its key as id, k1 and k2 (of its text), n_shingles, component (smallest key of what it links with, step by step)
    and head (true for one row of each component, and where there is no shingle)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col(f"`{key}`").alias("id"), *text_key(F.col("text")), text.alias("text"))
    marks = cut(signed(plain.withColumn("row", F.monotonically_increasing_id()), words), "signatures")
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "k1", "k2")).alias("head")
    classes = marks.where("n > 0").groupBy("d1", "d2").agg(head, F.first("sig").alias("sig"))
    classes = cut(classes.select("d1", "d2", F.col("head.row").alias("cid"), "head.k1", "head.k2", "head", "sig"), "classes")
    roots = class_roots(classes, plain.select("k1", "k2", "text"), words)
    named = classes.select("d1", "d2", "cid", "head")
    if roots is not None:
        named = named.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        named = named.join(named.groupBy("root").agg(F.min("head").alias("least")), "root").select("d1", "d2", "least")
    else:
        named = named.select("d1", "d2", F.col("head").alias("least"))
    component = F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id"))
    out = marks.select("row", "id", "k1", "k2", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    out = out.select("id", "k1", "k2", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("row") == F.col("least.row"), F.lit(True)).alias("head"))
    out = cut(out, "near-duplicates")
    free(marks, classes, roots)
    return out


def deduplicated(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """docs with one row of each component; documents without words all stay. Of rows with equal text and doc_id one stays."""
    keep = grouped(docs, words).where("head AND n_shingles > 0").select(F.col("id").alias("_id"), F.col("k1").alias("_1"), F.col("k2").alias("_2"))
    blank = F.length(F.translate(F.coalesce(F.col("text"), F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), blank.alias("blank"), F.col("doc_id").alias("id"), *text_key(F.col("text")))
    mine = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & F.col("id").eqNullSafe(F.col("_id"))
    first = rows.where(~F.col("blank")).join(keep, mine, "left_semi").dropDuplicates(["k1", "k2", "id"])
    return first.select("doc.*").union(rows.where("blank").select("doc.*"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE: dict[str, str] = {
    "op2_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id)
SELECT id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id, id = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id"""
}
