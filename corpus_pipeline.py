"""The corpus pipeline: quality rules, MinHash near-dedup, suffix-array dedup, secret scans, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import neardup, packing, quality, secrets, suffixes
from tidewater.llm._store import cut, free, owned, read_by, release

#: Repeated passages are cut out from so many bytes on: fewer than nearly all passages of over 50 words have.
PASSAGE = suffixes.Size(length=200, gram=100)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that results of stages still read, by the folder that a pipeline works on.
_held: dict[str, list[str]] = {}


def released(stage: Stage) -> Stage:
    """stage, which first deletes the tables that the stage before it has left: its docs are that one's rows, written and read
    again. Tables that docs read all the same stay."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = read_by(docs)
        old = _held.pop(sf_dir, [])
        still = [p for p in old if any(r.rstrip("/").endswith(p.split("://")[-1].rstrip("/")) for r in read)]
        if not still:
            release(spark, old)
            old = []
        with owned() as paths:
            out = stage(spark, docs, sf_dir)
        _held[sf_dir] = [*old, *paths]
        return out

    return run_stage


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


@released
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    return quality.keep_good(docs)


@released
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies of each other (shingles of five words, similarity 0.8), one stays."""
    return neardup.deduplicated(docs)


@released
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand elsewhere too are cut out of the texts."""
    return counted(suffixes.without_repeats(docs, PASSAGE))


@released
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return counted(secrets.redacted(docs))


@released
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, its token ids and its place in a sequence."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: EM, signatures, suffix hashes and packing can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with owned() as paths:
            out = stage(spark, docs, sf_dir)
            docs = cut(out, name.replace(" ", "-"))
        release(spark, paths[:-1])
        _held.pop(sf_dir, None)
        free(before)
        before = docs
    return docs
