"""Secret scans with multipart credential linking.

Every text is searched for strong findings (assign, access, hex), which are always reported, and for weak candidates:
identifiers (user: named accounts, mail addresses), secrets (key) and endpoints (host: URLs, named hosts, IPv4 addresses). A weak candidate is reported only if a complementary part stands
within SCOPE code points of it in the same text: an identifier or an endpoint beside a secret, a secret beside either.
Strong findings count as parts too (access as an identifier, assign and hex as secrets). The parts are joined by
intervals: equality of text and grid cell of SCOPE code points, then the distance. A cell holds few parts, as parts have
a least length, so the join grows with the number of parts. Equal texts are joined once, and rows of which no part can be
linked take no part in any join.

Texts are scanned once, in the rows they stand in; positions come from the lengths of what stands between matches. Keys have any
length from 32 signs on; parts of mail addresses have at most 64 and 63 signs, as mail itself allows.

Defined results: null text counts as empty; rows with null or repeated doc_id are told apart by their text, and equal
rows each get the same findings; an empty table gives an empty result; extra columns are ignored, or kept by redacted(). Very long
texts are scanned whole; findings that begin at the same place are listed by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut
from .quality import let

# The base patterns, and the least length of what is reported.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts.
USER = r"""(?i)\b(?:user(?:name)?|login|account(?:_?id)?|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+(?!=)"
HOST = r"""(?i)\b(?:[a-z][a-z0-9+.-]{1,10}://[^\s"'<>]{4,}|(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9][a-z0-9.-]{3,}(?::\d{2,5})?)|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::\d{2,5})?(?![0-9.]*[0-9])"""

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "user", "key", "host")
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "user": USER, "key": KEY, "host": HOST}
#: Which role each kind plays, and the roles that a weak kind needs beside it.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "key": "secret", "host": "host"}
NEEDS = {"user": ["secret"], "key": ["id", "host"], "host": ["secret"]}
SCOPE = 300
BLOCK = 256
MASK = "[REDACTED]"


def running_sum(x: Column) -> Column:
    """Inclusive running sums of an array of longs, by blocks, so that long arrays take no quadratic time."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    blocks = lambda d: F.transform(F.sequence(F.lit(0), ((F.size(d) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(d, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda b: F.transform(b, lambda v, i: total(F.slice(b, F.lit(1), i)))
    return let(x, lambda d: let(let(blocks(d), before), lambda p: F.transform(d, lambda v, i: p[(i / BLOCK).cast("int")] + total(F.slice(d, i - i % BLOCK + 1, i % BLOCK + 1)))))


def spans(text: Column, kind: str) -> Column:
    """Array of (start, end) of the leftmost non-overlapping matches of a kind, in code points."""
    pattern = PATTERNS[kind]
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    found = lambda: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(both: Column) -> Column:
        gaps = F.transform(F.slice(both["gap"], F.lit(1), F.size(both["len"])), lambda g, i: g + F.when(i > 0, F.get(both["len"], i - 1)).otherwise(F.lit(0).cast("long")))
        return F.transform(F.arrays_zip(running_sum(gaps).alias("s"), both["len"].alias("n")), lambda z: F.struct(z["s"].alias("start"), (z["s"] + z["n"]).alias("end")))

    at = let(F.struct(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(found()).alias("len")), located)
    if kind == "assign":
        values = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)))
        at = let(F.struct(at.alias("at"), values.alias("v")), lambda b: F.filter(b["at"], lambda x, i: F.get(b["v"], i) >= ASSIGN_VALUE))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(text.rlike(pattern), at).otherwise(nothing)


def parts_of(text: Column) -> Column:
    """Array of (start, kind number, end) of all findings and candidates."""

    def tagged(k: int, kind: str) -> Column:
        return F.transform(spans(text, kind), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    return F.concat(*[tagged(k, kind) for k, kind in enumerate(KINDS)])


def said(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scanned(docs: DataFrame, carry: list[str]) -> DataFrame:
    """For each row a struct `row` of the columns in carry, and found: the base spans and the linked weak ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.struct(F.xxhash64(text, F.lit(1)), F.xxhash64(F.lit(2), text), F.length(text)).alias("key"), text.alias("text"))
    rows = cut(rows.select("row", "key", parts_of(F.col("text")).alias("parts")), "secret-parts")
    role = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    has = lambda r: F.exists("parts", lambda x: role[x["kind"]] == r)
    may_link = F.exists("parts", lambda x: x["kind"] >= len(BASE_KINDS)) & has("secret") & (has("id") | has("host"))
    linkable = rows.where(may_link)
    # equal texts have the same parts: each is joined once
    parts = linkable.groupBy("key").agg(F.first("parts").alias("parts")).select("key", F.inline("parts")).withColumn("role", role[F.col("kind")])
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / SCOPE), F.floor(hi / SCOPE)))
    weak = parts.where(F.col("kind") >= len(BASE_KINDS)).select("key", "start", "kind", "end", cells(F.col("start") - SCOPE, F.col("end") + SCOPE).alias("cell"))
    needs = F.element_at(F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(KINDS.index(k)), F.array(*[F.lit(r) for r in v]))]), F.col("w.kind"))
    other = parts.select("key", "start", "end", "role", cells(F.col("start"), F.col("end")).alias("cell"))
    near = (F.col("o.start") <= F.col("w.end") + SCOPE) & (F.col("w.start") <= F.col("o.end") + SCOPE)
    linked = weak.alias("w").join(other.alias("o"), (F.col("w.key") == F.col("o.key")) & (F.col("w.cell") == F.col("o.cell")) & near & F.array_contains(needs, F.col("o.role")), "left_semi")
    linked = cut(linked.groupBy("key", "start", "kind", "end").count().groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked")), "linked-parts")
    base = F.filter("parts", lambda x: x["kind"] < len(BASE_KINDS))
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    # a plain table on either side: the rows of a text that stands very often can be split
    out = linkable.join(linked, "key", "left").select("row", base.alias("base"), F.concat(base, F.coalesce("linked", nothing)).alias("found"))
    return rows.where(~may_link).select("row", base.alias("base"), base.alias("found")).union(out)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every finding in text replaced by MASK (overlapping findings by one)."""
    out = scanned(docs, docs.columns).select("row", F.array_sort("found").alias("f"))
    step = """aggregate(f, named_struct('to', 0L, 'keep', cast(array() AS array<struct<a:bigint,b:bigint>>)), (s, x) -> named_struct(
        'to', greatest(s.to, x.end), 'keep', IF(x.start >= s.to, array_append(s.keep, named_struct('a', s.to, 'b', x.start)), s.keep)))"""
    text = f"""IF(size(f) = 0, row.text, transform(array({step}), s -> concat(
        array_join(transform(s.keep, k -> substring(row.text, cast(k.a + 1 AS int), cast(k.b - k.a AS int))), '{MASK}'),
        '{MASK}', substring(row.text, cast(s.to + 1 AS int))))[0])"""
    return out.select(F.col("row").withField("text", F.expr(text)).alias("row")).select("row.*")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select("row.doc_id", *[count(k) for k in BASE_KINDS], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE: dict[str, str] = {}
