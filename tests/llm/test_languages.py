"""Language identification: held-out accuracy, and parts against plain versions."""

import math
import random
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from tidewater.llm import languages as g

SCHEMA = "doc_id bigint, text string, lang string, score string, bucket int, n int, row struct<a:int>, lang_pred string"
SYLLABLES = {"xa": "ba be bi bo", "xb": "ka ke ki ko", "xc": "ta te ti to", "xd": "ma me mi mo", "xe": "sa se si so", "xf": "la le li lo", "xg": "na ne ni no", "xh": "ra re ri ro"}


def made(rng, languages, n):
    rows = []
    for i in range(n):
        lang = rng.choice(languages)
        parts = SYLLABLES[lang].split() + ["ha", "ja"]
        rows.append((i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(4, 60))), lang))
    return rows


def framed(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, (1,), "p") for r in rows], SCHEMA).repartition(3)


def run(spark, docs):
    model = g.fit(docs.where(~g.held_out(g.F.col("doc_id"))))
    return {r["doc_id"]: r for r in g.predict(docs, model).collect()}


@pytest.mark.parametrize("n", [2, 4, 8])
def test_held_out_texts_are_told_apart(spark, n):
    rows = made(random.Random(n), sorted(SYLLABLES)[:n], 400)
    found = run(spark, framed(spark, rows))
    held = [r for r in rows if crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 60
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_labels_of_held_out_texts_teach_nothing(spark):
    rows = made(random.Random(1), ["xa", "xb"], 120)
    other = [(i, t, "zz" if crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = run(spark, framed(spark, rows)), run(spark, framed(spark, other))
    assert a == b


def test_defined_results(spark):
    rows = made(random.Random(2), ["xa", "xb"], 60)
    odd = [(1001, None, "xa"), (1002, "", "xb"), (1003, " 123 !? \n", "xa"), (1004, "中文", None), (None, "baba bibo", None), (1005, "ba", "xb"), (1006, "baba " * 90 + "kiko " * 90, None)]
    found = run(spark, framed(spark, rows + odd))
    assert [(found[i]["lang_pred"], found[i]["score"], found[i]["n_grams"]) for i in (1001, 1002, 1003)] == [("und", 0.0, 0)] * 3
    assert found[None]["lang_pred"] == "xa" and found[1004]["lang_pred"] in ("xa", "xb")
    # half of each is closer to the border than a text of one
    assert found[1006]["score"] < min(found[i]["score"] for i, t, _ in rows if len(t) > 200)


def test_nothing_or_one_language_learned(spark):
    rows = made(random.Random(3), ["xa"], 30)
    assert {(r["lang_pred"], r["score"], r["ambiguous"]) for r in run(spark, framed(spark, rows)).values()} == {("xa", 1.0, False)}
    none = run(spark, framed(spark, [(i, t, None) for i, t, _ in rows]))
    assert {(r["lang_pred"], r["score"]) for r in none.values()} == {("und", 0.0)}
    model = g.fit(framed(spark, rows).where("false"))
    assert g.predict(framed(spark, rows).where("false"), model).count() == 0


def test_a_long_text_is_read_whole(spark):
    rows = made(random.Random(4), ["xa", "xb"], 60)
    text = "123 " * 200_000 + "baba bibo " * 20_000
    found = run(spark, framed(spark, [*rows, (5000, text, None)]))
    assert found[5000]["lang_pred"] == "xa" and found[5000]["n_grams"] > 500_000


def plain_grams(text):
    said = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in said:
        said = said.replace("  ", " ")
    return Counter(said[i : i + k] for k in (1, 2, 3) for i in range(len(said) - k + 1) if said[i : i + k] != " ")


def test_grams_equal_plain_ones():
    texts = ["Hello, World 12 x", "", "é", "--", "ÀÉ a\0b", "zz"]
    n, kinds = Counter(), {}
    for who, ids in g.grams([t.encode() for t in texts]):
        for i in set(who.tolist()):
            own = Counter(ids[who == i].tolist())
            n[i] += sum(own.values())
            kinds[i] = len(own)
    for i, t in enumerate(texts):
        want = plain_grams(t.replace("\0", " "))
        assert n[i] == sum(want.values())
        assert kinds.get(i, 0) == len(want)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 256])
def test_codewords_are_far_apart(n):
    words = g.code(n).astype(int)
    assert (abs(words) == 1).all() and (abs(words.sum(0)) < n).all()
    apart = min(int((a != b).sum()) for a, b in combinations(words, 2))
    assert apart >= (2 ** (n - 2) if n <= 6 else 2.5 * math.log2(n))
    # so many wrong bits are put right
    rng = np.random.default_rng(n)
    for k, w in enumerate(words):
        found = w.astype(float)
        found[rng.choice(len(w), (apart - 1) // 2, replace=False)] *= -1
        assert g.losses(found[None], words, np.ones(words.shape))[0].argmin() == k


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in g.op12_language_id(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert sorted(out) == sorted(r["doc_id"] for r in docs)
    held = [r for r in docs if out[r["doc_id"]]["held_out"]]
    assert all(out[r["doc_id"]]["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs)
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)
