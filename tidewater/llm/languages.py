"""Language identification by error-correcting output codes.

Texts become hashed n-grams of one to three code points: letters lower-cased, all else one space. Every language has a codeword
of bits, and for each bit a binary naive Bayes classifier over n-grams tells the languages with a one there from those
with a zero; languages weigh the same, however many texts they have. A text's evidence on a bit is its n-grams' mean log odds
times the root of their number. Decoding takes the codeword of least loss, ln(1 + exp(-evidence * bit)) summed over bits with
each language's weights, which are the shares of its learned texts that the bit's classifier gets right.
A text whose two best codewords are close in loss is flagged as ambiguous.

Fitting counts n-grams in all labelled texts: each task holds counts of at most TABLES languages before it hands them on, sums are
partial, log odds are computed where the sums are. Only the model comes to the driver and goes to all tasks: BUCKETS rows of a
float for each bit, 2 MB for four languages and at most 21 MB: of more than LANGUAGES different labels, those with most
n-grams are learned. That bound, and no sample, limits the fit.

Codes: up to six languages have every split into two sides as a bit; more have ten bits for each doubling, the best of 64 random
codes (fixed seed) by least distance.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text where nothing was learned; a single learned
language is predicted with score 1; of equal losses the first language in code-point order is taken; null labels and rows without text teach
nothing; repeated rows count as often as they stand; an empty table gives an empty result; extra columns are ignored. Very
long texts are worked on in pieces of PIECE code points, and n-grams across a cut don't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut, free

BUCKETS = 1 << 16
ORDERS = 3
LANGUAGES = 256
#: Languages whose counts a task holds at once (half a MB each).
TABLES = 64
PIECE = 1 << 18
#: Added to each count; log odds stay within so much.
PSEUDO, MOST = 0.5, 4.0
#: Losses closer than this are ambiguous.
CLOSE = math.log(3.0)
#: N-grams that are looked up at once.
LOOKED = 1 << 16
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters, by Python's table."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code(n: int) -> np.ndarray:
    """The codewords of n languages, a row of -1 and 1 each."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        bits = np.array([[(k >> i) & 1 for k in range(1, 1 << (n - 1))] for i in range(n)])
        return np.where(bits, 1, -1).astype(np.int8)
    rng, width = np.random.default_rng(20240607), math.ceil(10 * math.log2(n))
    best, most = None, -1
    for _ in range(64):
        c = rng.choice(np.array([-1, 1], np.int8), (n, width))
        # a bit that all languages share tells nothing
        c[0, (c == c[0]).all(0)] *= -1
        apart = (width - c.astype(np.int32) @ c.T.astype(np.int32)) // 2
        least = int(apart[~np.eye(n, dtype=bool)].min())
        if least > most:
            best, most = c, least
    return best


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners (indices of texts) and code points of texts, piece by piece: letters lower-cased, a space for each run of other signs, and a
    zero before each text."""
    known = letters()
    for i, text in enumerate(texts):
        said = text.decode("utf-8", "replace").replace("\0", " ").lower()
        for a in range(0, len(said), PIECE):
            x = np.frombuffer(said[a : a + PIECE].encode("utf-32-le", "replace"), np.uint32)
            x = np.where(known[x], x, np.uint32(32))
            gap = x == 32
            gap[1:] &= gap[:-1]
            gap[:1] = False
            yield i, x[~gap]


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners (indices of texts) and buckets of the n-grams of texts, some pieces at a time. N-grams don't reach from one piece into the
    next, and a lone space is none."""

    def of(owners: list[int], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        stop = np.zeros(1, np.uint32)
        x = np.concatenate([y for p in parts for y in (p, stop)]).astype(np.uint64)
        who = np.repeat(np.array(owners, np.int64), [len(p) + 1 for p in parts])
        ids, whose = [], []
        h, fine = np.zeros(len(x), np.uint64), np.ones(len(x), bool)
        for k in range(min(ORDERS, len(x))):
            n = len(x) - k
            h = h[:n] + x[k:] * FACTORS[k]
            fine = fine[:n] & (x[k:] != 0)
            good = fine & (x != 32) if k == 0 else fine
            ids.append((((h + np.uint64(k)) * FACTORS[0]) >> np.uint64(48))[good].astype(np.int64))
            whose.append(who[:n][good])
        return np.concatenate(whose), np.concatenate(ids)

    owners, parts, size = [], [], 0
    for i, p in pieces(texts):
        owners.append(i)
        parts.append(p)
        size += len(p)
        if size >= PIECE:
            yield of(owners, parts)
            owners, parts, size = [], [], 0
    if parts:
        yield of(owners, parts)


def _counted(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n of labelled(lang, text)."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def said() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], schema=schema)
            held.clear()

        for batch in batches:
            for langs, texts in _slices(batch):
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                for who, ids in grams(texts):
                    owner = number[who]
                    for k, name in enumerate(names):
                        if name not in held:
                            if len(held) >= TABLES:
                                yield from said()
                            held[name] = np.zeros(BUCKETS, np.int64)
                        held[name] += np.bincount(ids[owner == k], minlength=BUCKETS)
        yield from said()

    return labelled.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """The first column's values and the texts of the second, as bytes, of some rows at a time."""
    first, texts, size = [], [], 0
    for a, t in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
        first.append(a.as_py())
        texts.append(t.as_py() or b"")
        size += len(texts[-1])
        if size >= most:
            yield first, texts
            first, texts, size = [], [], 0
    if first:
        yield first, texts


@dataclass
class Model:
    """languages in code-point order, their codewords, log odds by bucket and bit, weights by language and bit."""

    languages: list[str]
    words: np.ndarray
    odds: Broadcast
    weights: np.ndarray


def evidence(texts: list[bytes], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The evidence of each text on each bit, and the number of its n-grams."""
    sums, n = np.zeros((len(texts), odds.shape[1])), np.zeros(len(texts), np.int64)
    for who, ids in grams(texts):
        n += np.bincount(who, minlength=len(texts))
        for a in range(0, len(ids), LOOKED):
            own = who[a : a + LOOKED]
            # n-grams of a text stand in up to ORDERS runs
            at = np.flatnonzero(np.diff(own, prepend=-1))
            np.add.at(sums, own[at], np.add.reduceat(odds[ids[a : a + LOOKED]], at, axis=0, dtype=np.float64))
    return sums / np.sqrt(np.maximum(n, 1))[:, None], n


def losses(found: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each text (row of found) and language."""
    return np.stack([(np.logaddexp(0, -found * w) * v).sum(1) for w, v in zip(words, weights, strict=True)], 1) if len(words) else np.zeros((len(found), 0))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = cut(_counted(rows), "language-grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    names = sorted(totals)
    words = code(len(names))
    size = np.array([totals[x] for x in names], float)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, zero = words == 1, words == -1
        for batch in batches:
            out = []
            for own in batch.column(1):
                n = np.zeros(len(names))
                for x in own.as_py():
                    if x["lang"] in totals:
                        n[names.index(x["lang"])] = x["n"]
                p = (n + PSEUDO) / (size + PSEUDO * BUCKETS)
                out.append(np.clip(np.log((p @ one / one.sum(0)) / (p @ zero / zero.sum(0))), -MOST, MOST).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["bucket", "odds"])

    # a bucket has a row for each language at most
    by_bucket = counts.groupBy("bucket").agg(F.collect_list(F.struct("lang", "n")).alias("own"))
    odds = np.zeros((BUCKETS, words.shape[1]), np.float32)
    if words.shape[1]:
        for r in by_bucket.mapInArrow(weigh, "bucket int, odds binary").collect():
            odds[r["bucket"]] = np.frombuffer(bytes(r["odds"]), np.float32)
    free(counts)
    sent = spark.sparkContext.broadcast(odds)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, seen = np.zeros(words.shape), np.zeros(len(names), np.int64)
        for batch in batches:
            for langs, texts in _slices(batch):
                found, n = evidence(texts, sent.value)
                number = np.array([names.index(x) if x in totals else -1 for x in langs])
                good = (n > 0) & (number >= 0)
                np.add.at(seen, number[good], 1)
                np.add.at(hits, number[good], found[good] * words[number[good]] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(seen), pa.array([x.astype(np.int64).tolist() for x in hits], pa.list_(pa.int64()))], names=["k", "seen", "hits"])

    weights = np.ones(words.shape)
    if words.shape[1]:
        shares = rows.mapInArrow(right, "k int, seen bigint, hits array<bigint>").select("k", "seen", F.posexplode("hits").alias("bit", "hits"))
        for r in shares.groupBy("k", "bit").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits")).collect():
            # one hit and one miss more: no weight is 0
            weights[r["k"], r["bit"]] = (r["hits"] + 1) / (r["seen"] + 2)
        weights /= weights.sum(1, keepdims=True)
    return Model(names, words, sent, weights)


SAID = "lang_pred string, score double, ambiguous boolean, runner_up string, n_grams bigint"


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the language of least loss, its score (its share of exp(-loss) over all languages), whether the next one is close, that one, and
    the number of n-grams."""
    names, words, odds, weights = model.languages, model.words, model.odds, model.weights
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _slices(batch):
                found, n = evidence(texts, odds.value)
                out = []
                for k, loss in zip(n, losses(found, words, weights), strict=True):
                    if not k or not names:
                        out.append(("und", 0.0, False, None, int(k)))
                        continue
                    order = np.argsort(loss, kind="stable")
                    share = np.exp(loss[order[0]] - loss)
                    second = names[order[1]] if len(names) > 1 else None
                    close = len(names) > 1 and loss[order[1]] - loss[order[0]] < CLOSE
                    out.append((names[order[0]], float(1 / share.sum()), bool(close), second, int(k)))
                said = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *[pa.array(x, t) for x, t in zip(said, (pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.int64()), strict=True)]], names=[key, "lang_pred", "score", "ambiguous", "runner_up", "n_grams"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, {SAID}")


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous", "runner_up")


QUERIES = {"op12_language_id": op12_language_id}
ORACLE: dict[str, str] = {}
