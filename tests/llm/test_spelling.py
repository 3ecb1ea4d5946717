"""Spelling variants against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import pytest

from tidewater.llm import spelling as s


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_counts(rows, damage=199):
    letter = lambda c: "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"
    n = Counter()
    for key, text in rows:
        for run in "".join(c if letter(c) else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain_variants(counts, factor=5):
    near = defaultdict(list)
    # words that share none of the strings with one code point struck out or kept can't be near
    by = defaultdict(set)
    for w in counts:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[k].add(w)
    for group in by.values():
        for x, y in combinations(sorted(group), 2):
            if one_edit(x, y) and y not in near[x]:
                near[x].append(y)
                near[y].append(x)
    form = {}
    for w, k in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * k else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), k, len(near[w]), counts.get(form[w])) for w, k in counts.items()}


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def vocabulary(rng, n=250):
    """Words, words near them, chains of ever rarer variants, one crowded beginning and one crowded end."""
    letters = "abcdeéüÿ"
    counts = {}
    for _ in range(n):
        w = "".join(rng.choice(letters[:4]) for _ in range(rng.choice([6, 6, 7, 8, 12])))
        counts[w] = rng.randrange(5, 400)
        for k in (60, 10, 2):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            if len(w) >= 6:
                counts[w] = max(5, rng.choice([k, counts.get(w, k)]))
    for i in range(120):
        tail = "".join(rng.choice("xyz") for _ in range(5))
        counts["common" + tail] = counts[tail + "common"] = rng.choice([5, 5, 30])
    return counts


@pytest.mark.parametrize("limit", [4096, 20, 1])
def test_pairs_equal_brute_force(spark, limit):
    counts = vocabulary(random.Random(limit))
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert got(s.variants(words, limit=limit)) == plain_variants(counts)


def test_near_pairs_by_trie():
    rng = random.Random(9)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(90)})
    found = list(s.near_pairs(texts))
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if one_edit(x, y)}


def test_chain_to_its_root(spark):
    counts = {"abcdefgh": 5, "abcdefghi": 25, "abcdefghij": 125, "abcdefghijk": 625, "abcdefghijkl": 3125, "abcdefghijklm": 3126}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    out = got(s.variants(words))
    assert out == plain_variants(counts) and out["abcdefgh"][1] == "abcdefghijkl" and out["abcdefghijkl"][0] is None


def test_ties_go_to_the_smallest(spark):
    counts = {"abcdef": 5, "abcdeg": 30, "abcdea": 30, "ébcdef": 30}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got(s.variants(words))["abcdef"] == ("abcdea", "abcdea", 5, 3, 30)


SCHEMA = "doc_id bigint, text string, word string, n string, near string, row struct<a:int>, m int, fixed string"


def framed(spark, rows):
    return spark.createDataFrame([(*r, "w", "n", "x", (1,), 1, "f") for r in rows], SCHEMA).repartition(3)


def test_counts_equal_brute_force(spark, rows):
    rng = random.Random(11)
    words = ["Überfluss", "überfluss", "nation", "NATION", "natiön", "señores", "x" * 300, "short", "Élèves", "ÉLÈVES"]
    own = [*rows, *((i, " ".join(rng.choice(words) + rng.choice(["", ",", "1"]) for _ in range(60))) for i in range(1000, 1200)), (None, "nations " * 9)]
    own += [(1, "nation " * 30)] * 2
    for damage in (199, 3, None):
        out = {r["word"]: r["n"] for r in s.word_counts(framed(spark, own), damage=damage).collect()}
        assert out == plain_counts(own, damage)


def test_a_long_text_is_counted_whole(spark):
    text = ("station " * 200_000) + "y" * 500_000 + " last words" * 6
    out = {r["word"]: r["n"] for r in s.word_counts(framed(spark, [(1, text)]), often=1).collect()}
    assert out == {"station": 200_000, "y" * 500_000: 1}


def test_empty(spark):
    nothing = framed(spark, [(1, None), (2, ""), (3, "a b c 123 longish")])
    assert s.variants(s.word_counts(nothing)).count() == 0
    assert s.variants(s.word_counts(nothing.where("false"))).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(s.op11_spelling_variants(spark, folder)) == plain_variants(plain_counts(rows))
