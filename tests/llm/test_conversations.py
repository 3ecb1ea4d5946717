"""Conversation repair against a search over all edits."""

import hashlib
import random
from collections import defaultdict
from heapq import heappop, heappush
from zlib import crc32

import pytest

from tidewater.llm import conversations as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, begun string, digest string, n int, audit string, row struct<a:int>"
BLANK = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(x for x in text if x not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def cheapest(rows, faults):
    """The cheapest edits and what they give, by a search over all edit sequences in order of (cost, audit)."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, state, out = heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for t, name in (("u", "user"), ("a", "assistant")):
            if t in after:
                heappush(heap, (cost + 5, audit + "I", i, t, (*out, f"{name}:")))
        if i < len(rows):
            role, text = rows[i][2:]
            heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] and role[:1] in after:
                    heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for t, name in (("u", "user"), ("a", "assistant")):
                    if t in after:
                        heappush(heap, (cost + 1 + more, audit + "R", i + 1, t, (*out, f"{name}:{text}")))


def plain(rows, damage=True):
    own = plain_damage(rows) if damage else [(k, t, *(" " if x is None else x for x in r)) for k, t, *r in rows]
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]] = []
    for r in own:
        groups[r[0]].append(r)
    out = {}
    for conv, g in groups.items():
        g.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in g:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for _, t, *_ in g if t is not None}
        illegal = sum((a[2][:1], b[2][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(g, g[1:]))
        cost, audit, lines = cheapest(g, faults)
        said = "\n".join(lines)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def made(rng, n):
    rows = []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "U", "a", "u", "s"]
    for conv in [*range(n), None]:
        for i in range(rng.choice([1, 2, 3, 4, 5, 8, 13])):
            turn = rng.choice([i, i, i, i, i + 3, None, 2])
            text = rng.choice(["Hello there.", "What?", "cut off", "", " \t", "\x0b", " ", None, "yes! ", "no.\n", f"line {rng.randrange(9)}.\nmore!"])
            rows.append((conv, turn, rng.choice(roles), text))
    return rows


def framed(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", (1,)) for r in rows], SCHEMA).repartition(3)


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rows = made(random.Random(seed), 150)
    own = c.damaged(framed(spark, rows))
    assert got(c.digests(own, c.reports(own))) == plain(rows)


def test_segments_of_any_size_give_the_same(spark):
    rows = [(k, i, r, t) for (k, i, r, t) in made(random.Random(3), 40)]
    rng = random.Random(4)
    rows += [(99, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"Say {i}."])) for i in range(300)]
    own = c.as_they_are(framed(spark, rows))
    want = plain(rows, damage=False)
    assert got(c.digests(own, c.reports(own))) == want
    assert got(c.digests(own, c.reports(own, rows_at_once=3))) == want


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"Say {i}."])) for i in range(2000)] + [(8, 0, "user", "Hi.")] * 50
    own = c.as_they_are(framed(spark, rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = c.judged(own)
        assert c.parsed(turns).where("conv_id = 7").count() > 2
        assert got(c.digests(own, c.reports(own))) == plain(rows, damage=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_follow_the_grammar(spark):
    rows = made(random.Random(6), 60)
    own = c.as_they_are(framed(spark, rows))
    by = defaultdict(list)
    for r in c.repaired(own).orderBy("conv_id", "place").collect():
        by[r["conv_id"]].append(r)
    assert by
    for own_rows in by.values():
        assert [r["place"] for r in own_rows] == list(range(len(own_rows)))
        assert __import__("re").fullmatch("s?(ua)+", "".join(r["role"][0] for r in own_rows))
        assert all(r["text"] == "" for r in own_rows if r["edit"] == "I")


def test_hand_worked(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi?"), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "Yes."), (2, 1, "user", "So?"), (3, None, None, None), (4, 5, "user", "cut")]
    own = c.as_they_are(framed(spark, rows))
    found = got(c.digests(own, c.reports(own)))
    assert found[1][:7] == (1, 0, 0, 0, 1, 2, "DKK")
    # renaming both is as cheap as deleting one and is not: D costs 2 and leaves one row without its partner
    assert found[2][5:7] == (2, "RR")
    assert found[3] == (0, 1, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())
    assert found[4][3:7] == (1, 0, 2, "D")


def test_a_long_text_and_very_many_copies(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "Yes.")] + [(2, 0, "user", "Hi.")] * 3000
    own = c.as_they_are(framed(spark, rows))
    found = got(c.digests(own, c.reports(own)))
    assert found[1][5:7] == (0, "KK") and found[2][2:7] == (2999, 0, 2999, 6000, "D" * 3000)


def test_empty(spark):
    own = c.damaged(framed(spark, [(1, 1, "user", "x")]).where("false"))
    assert c.digests(own, c.reports(own)).count() == 0 and c.repaired(own).count() == 0


def test_query(spark):
    df = c.op13_conversation_repair(spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == plain(rows)
