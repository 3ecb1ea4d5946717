"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of the vote patterns (at
most 3 ** rules rows, whatever the input) estimates each rule's accuracy and the share of good documents; a document's
verdict is the posterior probability that it is good. The fit runs as one SQL expression over the pattern table.

It starts from the rules' majority, so that the classes can't trade places, and each rate has a Beta prior with a stated mean
that counts as much as PSEUDO_VOTES votes: none becomes 0 or 1, and with more documents estimates follow the data alone.

Defined results: null text counts as empty (no words, base_failed); doc_id may be null or repeat, each row is judged by
itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut

SPACE = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ROUNDS = 100
#: Means of the priors of what a rule passes of good documents and finds of bad ones, and the votes that they count as.
PASSES_GOOD, FINDS_BAD, PSEUDO_VOTES = 0.95, 0.5, 20.0
THRESHOLD = 0.5


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(words: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more among words."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        return let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) > WINDOW, let(let(hashes, windows), count)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, words: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for the rules, n_letters and n_lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote on a row with the measures in struct m."""
    c = lambda x: F.col(f"m.{x}")
    per_word = lambda x: F.try_divide(c(x), c("n_words"))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    symbols = F.try_divide(c("n_symbols"), c("word_chars"))
    letters, dups, repeats = F.try_divide(c("n_letters"), c("word_chars")), F.try_divide(c("n_dup_lines"), c("n_lines")), per_word("n_repeat_words")
    return {
        "length": vote(c("n_words") >= 25, c("n_words") < MIN_WORDS),
        "word_length": vote(per_word("word_chars").between(2.5, 12), (per_word("word_chars") < 2) | (per_word("word_chars") > 20)),
        "symbols": vote(per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.3),
        "letters": vote(letters >= 0.85, letters < 0.5),
        "symbol_share": vote(symbols <= 0.01, symbols > 0.05),
        "lines": vote(dups <= 0.1, dups > 0.3),
        "repeats": vote(repeats <= 0.05, repeats * 100 > MAX_REPEAT_PERCENT),
    }


def fit(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> list[float]:
    """What EM over the counts of vote patterns estimates, as weights for log odds: first that of the share of good rows, then
    for each rule that of a vote for good and that of a vote for bad."""
    n = len(names)
    patterns = voted.groupBy(*names).count()
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.array(*[F.col(x) for x in names]).alias("v"), F.col("count").cast("double").alias("c")))).alias("p"))
    odds = " + ".join(f"CASE x.v[{j}] WHEN 1 THEN w[{2 * j + 1}] WHEN -1 THEN w[{2 * j + 2}] ELSE 0D END" for j in range(n))
    expect = f"transform(p, x -> named_struct('v', x.v, 'g', x.c / (1D + exp(-(w[0] + {odds}))), 'c', x.c))"
    total = lambda value: f"aggregate(e, 0D, (s, x) -> s + {value})"
    share = f"({total('x.g')} + 1D) / ({total('x.c')} + 2D)"
    rate = lambda hits, votes, mean: f"({hits} + {mean * PSEUDO_VOTES}D) / ({votes} + {PSEUDO_VOTES}D)"
    rates = []
    for j in range(n):
        rates.append(rate(total(f"IF(x.v[{j}] = 1, x.g, 0D)"), total(f"IF(x.v[{j}] = 0, 0D, x.g)"), PASSES_GOOD))
        rates.append(rate(total(f"IF(x.v[{j}] = -1, x.c - x.g, 0D)"), total(f"IF(x.v[{j}] = 0, 0D, x.c - x.g)"), FINDS_BAD))
    weights = ", ".join(f"ln(t[{2 * j + 1}] / (1D - t[{2 * j + 2}])), ln((1D - t[{2 * j + 1}]) / t[{2 * j + 2}])" for j in range(n))
    to_weights = lambda rates: f"transform(array(array({rates})), t -> array(ln(t[0] / (1D - t[0])), {weights}))[0]"
    step = to_weights(", ".join([share, *rates]))
    # at first each row is as good as the share of its votes for good
    majority = " + ".join(f"x.v[{j}]" for j in range(n))
    voting = " + ".join(f"abs(x.v[{j}])" for j in range(n))
    start = f"transform(p, x -> named_struct('v', x.v, 'g', x.c * IF({voting} = 0, 0.5D, 0.5D + 0.5D * ({majority}) / ({voting})), 'c', x.c))"
    start = f"transform(array({start}), e -> {step})[0]"
    fitted = one.selectExpr(f"aggregate(sequence(1, {rounds}), {start}, (w, k) -> transform(array({expect}), e -> {step})[0]) AS w")
    return list(fitted.first()["w"])


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """For each row a struct `row` of the columns in carry, the measures m, failed, quality (the posterior probability that it
    is good) and kept. The measures are written once, since the fit reads every row's votes before any verdict is given."""
    names = list(votes())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text.alias("text"), words_of(text).alias("words"))
    rows = rows.select("row", measures(F.col("text"), F.col("words")).alias("m"))
    failed = (F.col("m.n_words") < MIN_WORDS) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * MAX_REPEAT_PERCENT)
    rows = cut(rows.select("*", failed.alias("failed")).withColumns(votes()), "quality-votes")
    w = fit(rows, names)
    odds = F.lit(w[0])
    for j, name in enumerate(names):
        odds = odds + F.when(F.col(name) == 1, w[2 * j + 1]).when(F.col(name) == -1, w[2 * j + 2]).otherwise(0.0)
    rows = rows.withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    return rows.withColumn("kept", ~F.col("failed") & (F.col("quality") >= THRESHOLD))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return judged(docs, docs.columns).where("kept").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("row.doc_id", *[f"m.{c}" for c in base], F.col("failed").alias("base_failed"), "kept", "quality")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE: dict[str, str] = {}
