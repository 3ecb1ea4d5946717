"""run() against a plain composition of brute-force stages."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_spans
from tidewater.llm import packing, quality, secrets


def kept_bytes(rows, n):
    where = Counter()
    for _, t in rows:
        b = t.encode()
        where.update(b[i : i + n] for i in range(len(b) - n + 1))
    for i, t in rows:
        b = t.encode()
        covered = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if where[b[k : k + n]] > 1:
                covered[k : k + n] = True
        yield i, np.frombuffer(b, np.uint8)[~covered].tobytes().decode(errors="ignore")


def masked(t):
    out, at = [], 0
    for a, _, b in brute_spans(t):
        if a >= at:
            out += [t[at:a], secrets.MASK]
        at = max(at, b)
    return "".join(out) + t[at:]


def test_run(spark, docs, rows, tmp_path):
    path = tmp_path / "documents.parquet"
    # words of letters, as the rules like them
    lettered = docs.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    lettered.where("text IS NULL OR length(text) < 20000").write.parquet(str(path))
    table = spark.read.parquet(str(path))
    good = [(r["row"]["doc_id"], r["row"]["text"]) for r in quality.judged(table, ["doc_id", "text"]).where("kept").collect()]
    assert 20 < len(good) < table.count()
    _, root = brute_components(good, 5)
    one = {}
    for (i, t), c in zip(good, root, strict=True):
        if c is None or i == c:
            one[i] = t
    assert len(one) == len(set(root))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    expected = Counter()
    for i, t in kept_bytes(list(one.items()), corpus_pipeline.PASSAGE.length):
        ids = [*tokenizer.encode(masked(t), add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), packing.CAPACITY):
            expected[i, k // packing.CAPACITY, tuple(ids[k : k + packing.CAPACITY])] += 1
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["piece"], tuple(r["ids"])) for r in out.collect()) == expected


def test_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), "").columns == docs.columns
