"""Spelling variant grouping: a trie self-join with active-node sets over the words of a corpus.

Words are counted in each task and summed. A pair of words with one edit between them has lengths m and m or m + 1, and
either shares its first m // 2 code points or its last m - m // 2. So every word goes to two kinds of tries for each of
the m that fit it: one of the words with its beginning (the edit lies behind), one of those with its end (the edit lies before).
Each is a partition of the vocabulary's trie below a fixed prefix, or of the trie of that which stands before a fixed suffix.
A partition of more than `limit` words is cut again: the places where the edit may lie are halved, and what is fixed grows.
With one free place left, a partition has at most 58 + 58 * 58 words, so none grows with the corpus. In a partition the set of active
nodes, those at most one edit from the node, goes down the trie with the node, and terminal nodes at distance one are
pairs. A pair belongs to the partition in which the first place where its words differ is free, so it comes out once.

Every pair counts: none is dropped for the number of neighbours. Neighbours are summed with partial aggregation, forms are
followed to their ends by pointer doubling, in joins whose skewed sides can be split.

Defined results: null text has no words, a null key counts as an empty string in the damage; of neighbours of equal count the
smallest in code-point order is the form; repeated rows count as often as they stand; an empty table gives an empty result; extra
columns are ignored; very long texts are searched match by match, and words have any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut, free

#: Words have so many code points and occurrences at least; a form is so many times as frequent as its variant.
LEAST, OFTEN, FACTOR = 6, 5, 5
#: Words of a partition of the trie, at most.
LIMIT = 4096
#: Distinct words that a task holds before it hands them on, and code points of long ones among them.
HELD, HELD_LONG = 200_000, 1 << 24
#: Texts beyond so many bytes are searched match by match.
LONG = 1 << 20


def struck(key: bytes, run: str, divisor: int) -> str:
    """run without the code point that the checksum of `key:run` picks, where divisor divides the checksum."""
    h = crc32(run.encode(), crc32(key))
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", least: int = LEAST, often: int = OFTEN, damage: int | None = None) -> DataFrame:
    """word, n of the runs of letters (A to Z lower-cased) of at least `least` code points that stand at least `often` times.
    damage: one run in so many loses a code point first, for tests of what finds it again."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = Counter(), 0
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                data = text.as_py()
                if not data:
                    continue
                # bytes lower only A to Z
                said = data.lower().decode("utf-8", "replace")
                own = Counter(runs.findall(said) if len(data) < LONG else (m[0] for m in runs.finditer(said)))
                if damage:
                    name = f"{'' if (v := k.as_py()) is None else v}:".encode()
                    for w, n in own.items():
                        w = struck(name, w, damage)
                        if len(w) >= least:
                            held[w] += n
                else:
                    held.update(own)
                long += sum(len(w) for w in own if len(w) > 64)
                if len(held) > HELD or long > HELD_LONG:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
                    held, long = Counter(), 0
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    parts = docs.select(F.col(f"`{key}`"), "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _end(word: Column) -> Column:
    """Where the free places of word end: before the m - b code points that are fixed behind."""
    return F.char_length(word) - (F.col("m") - F.col("b"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, with the first and the second half of its free places a to b."""
    middle = F.expr("(a + b) div 2").cast("int")
    ranges = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    return rows.select("word", "n", "m", F.inline(ranges))


def _keyed(rows: DataFrame) -> DataFrame:
    word = F.col("word")
    return rows.withColumn("fixed", F.concat(F.substring(word, F.lit(1), F.col("a")), F.substring(word, _end(word) + 1, F.col("m"))))


PARTITION = ["m", "a", "b", "fixed"]


def partitions(words: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """word, n and the partitions (m, a, b, fixed) of the trie that the word is in, for pairs of lengths m and m or m + 1 that differ
    first at one of the places a to b."""
    size = F.char_length("word")
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= least)
    whole = words.select("word", "n", F.explode(lengths).alias("m")).select("*", F.lit(0).alias("a"), F.col("m").alias("b"))
    now, out, cuts = _keyed(_halved(whole)), None, []
    while True:
        large = now.where("b - a > 1").groupBy(*PARTITION).agg(F.count("*").alias("k")).where(F.col("k") > limit).drop("k")
        large = cut(large, "large-tries")
        cuts.append(large)
        if large.isEmpty():
            break
        done = now.join(large, PARTITION, "left_anti").select(*now.columns)
        out = done if out is None else out.union(done)
        now = _keyed(_halved(now.join(large, PARTITION, "left_semi").select(*now.columns)))
    return now if out is None else out.union(now)


class Node:
    __slots__ = ("down", "row")

    def __init__(self):
        self.down: dict[str, Node] = {}
        self.row = -1


def near_pairs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Both orders of each pair of different texts with one edit between them. A node's active nodes are itself, at distance
    0, and those at distance 1; a child's come from its parent's: the parent (one code point inserted), the child's siblings (one replaced),
    its children (one deleted), and what the child's code point leads to from nodes at distance 1."""
    root = Node()
    for i, text in enumerate(texts):
        node = root
        for c in text:
            if (below := node.down.get(c)) is None:
                below = node.down[c] = Node()
            node = below
        node.row = i
    todo = [(root, set(root.down.values()))]
    while todo:
        node, active = todo.pop()
        if node.row >= 0:
            for v in active:
                if v.row >= 0:
                    yield node.row, v.row
        for c, below in node.down.items():
            own = {node, *node.down.values(), *below.down.values()}
            for v in active:
                if (w := v.down.get(c)) is not None:
                    own.add(w)
            own.discard(below)
            todo.append((below, own))


def common_start(x: str, y: str) -> int:
    n = 0
    for a, b in zip(x, y, strict=False):
        if a != b:
            break
        n += 1
    return n


def neighbours(words: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """word, near, near_n in both orders for each pair of words(word, n), distinct words, with one edit between them."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        out: list[tuple[str, str, int]] = []

        def joined() -> None:
            if len(group) < 2:
                return
            m, a, b, fixed = at
            tail = m - b
            middles = [w[a : len(w) - tail] for w, _ in group]
            for i, j in near_pairs(middles):
                # two words of m + 1 meet where their length is m
                if min(len(group[i][0]), len(group[j][0])) == m and (b == m or common_start(middles[i], middles[j]) < b - a):
                    out.append((group[i][0], *group[j]))

        def said() -> pa.RecordBatch:
            got = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else ([], [], []), schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(got, schema=schema)

        for batch in batches:
            for w, n, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    joined()
                    group, at = [], key
                    if len(out) > 10_000:
                        yield said()
                group.append((w, n))
        joined()
        yield said()

    dealt = partitions(words, least, limit).repartition(*PARTITION).sortWithinPartitions(*PARTITION)
    return dealt.select("word", "n", *PARTITION).mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): where the chain of forms from each word ends. Chains have no circles, since a form is more
    frequent than its word; each round doubles the way."""
    now = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        ends = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        old, now = now, cut(now.drop("moved").join(ends, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        free(old)
    return now.drop("moved")


def variants(words: DataFrame, factor: int = FACTOR, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n)."""
    words = cut(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = neighbours(words, least, limit).groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.less") >= F.lit(factor) * F.col("n")
    near = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    near = cut(near, "near-words")
    free(words)
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents after the contract's damage, with their forms."""
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=199))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE: dict[str, str] = {}
