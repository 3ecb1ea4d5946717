"""Conversation structure repair by error-correcting Earley parsing.

The grammar of roles is left-linear, so that all chart items of a conversation begin at its first row and a chart set holds one item for each
production:

    start  ->              (nothing)         system -> start s
    user   -> start u | system u | pairs u   pairs  -> user a       accepted: start, pairs

Error productions with weights: a row may be deleted, a row may stand for user or assistant whatever its role is, and user or
assistant may be inserted. A chart set is predicted and completed (with insertions, until nothing gets cheaper), then a
row is scanned into the next one. Items retain the least (cost, audit). An audit isn't copied from set to set: an item keeps
the rank of its audit among those of its set and what was appended, and the chart is read backwards once it is complete. So
a row costs the same wherever it stands.

No conversation has to fit a task: rows are sorted over all tasks (by ranges, which cut large conversations), and each
task parses what it has of a conversation, at most SEGMENT rows at a time, from every nonterminal that the rows before it may
have completed. The segments' outcomes are composed in order, which gives the items that the whole chart would hold. Equal
rows of a turn are one row with a count; a text seen earlier is found by a join on its digest, whose skewed sides can be split. Texts are
exchanged once, at the end, where they are streamed past the audit in order; a digest of the whole conversation needs
them in one task, but one row at a time. An audit is one value, as long as its conversation has rows.

Defined results: null roles and texts are one space, null conversation keys are one conversation, rows without a turn come first. Rows of
the same turn go by role, then by the SHA-256 of the text. Repeated rows are duplicates. Very long texts are read once for
their digest and once for the result. An empty table gives an empty result; extra columns are ignored. Gaps beyond the
largest long are that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut

#: Nonterminals, in the order of the numbers that stand for them.
STATES = ("start", "system", "user", "pairs")
#: Productions: head, the nonterminal before the terminal, the terminal.
GRAMMAR = [("system", "start", "s"), ("user", "start", "u"), ("user", "system", "u"), ("user", "pairs", "u"), ("pairs", "user", "a")]
ACCEPTED = ("start", "pairs")
#: What an inserted or renamed row may be.
NAMES = {"u": "user", "a": "assistant"}
RENAME, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Rows that are parsed in one go.
SEGMENT = 1 << 16
#: Signs that count as blank.
BLANK = " \t\n\x0b\x0c\r"

_STEPS = {x: [(STATES.index(h), t) for h, left, t in GRAMMAR if left == x] for x in STATES}
STEPS = [_STEPS[x] for x in STATES]
ENDS = [STATES.index(x) for x in ACCEPTED]


class Chart:
    """The chart of a run of rows, from one nonterminal on. items: for each nonterminal that is complete its cost, the rank of its audit
    where the last row ended, and the insertions since."""

    def __init__(self, begun: int):
        self.items: dict[int, tuple[int, int, str]] = {begun: (0, 0, "")}
        # for each row, by rank: the rank before it, and the letters since
        self.back: list[list[tuple[int, str]]] = []
        self.predict()

    def predict(self) -> None:
        """Completes what insertions complete: more expensive items are reached from cheaper ones, so the cheapest settle first."""
        todo, settled = dict(self.items), {}
        while todo:
            x = min(todo, key=todo.__getitem__)
            cost, base, since = settled[x] = todo.pop(x)
            for head, t in STEPS[x]:
                if t in NAMES and head not in settled:
                    new = (cost + INSERT, base, since + "I")
                    if head not in todo or new < todo[head]:
                        todo[head] = new
        self.items = settled

    def scan(self, initial: str, short: bool) -> None:
        """A row that may stay."""
        best: dict[int, tuple[int, int, str]] = {}
        more = CUT_SHORT * short
        for x, (cost, base, since) in self.items.items():
            reached = [(x, cost + DELETE, "D")]
            for head, t in STEPS[x]:
                if t == initial:
                    reached.append((head, cost + more, "K"))
                elif t in NAMES:
                    reached.append((head, cost + RENAME + more, "R"))
            for head, c, letter in reached:
                new = (c, base, since + letter)
                if head not in best or new < best[head]:
                    best[head] = new
        self._next(best)

    def strike(self, n: int) -> None:
        """n rows that must go. An insertion before them reads later in order than one behind."""
        if n:
            kept = {x: v for x, v in self.items.items() if not v[2]}
            self._next({x: (cost + DELETE * n, base, "D" * n) for x, (cost, base, _) in kept.items()})

    def _next(self, best: dict[int, tuple[int, int, str]]) -> None:
        # no audit begins with another one of the same set, so ranks and letters give their order
        order = sorted(best, key=lambda x: best[x][1:])
        self.back.append([best[x][1:] for x in order])
        self.items = {x: (best[x][0], rank, "") for rank, x in enumerate(order)}
        self.predict()

    def read(self) -> list[tuple[int, int, str]]:
        """Nonterminal, cost and audit of each complete item."""
        out = []
        for x, (cost, rank, since) in self.items.items():
            parts = [since]
            for at in reversed(self.back):
                rank, letters = at[rank]
                parts.append(letters)
            out.append((x, cost, "".join(reversed(parts))))
        return out


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
KEY = "conv_id"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (how often the row stands, 0 if it is dropped) of each row, after the contract's damage."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(one(KEY), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return rows.select(KEY, "turn", F.when(h == 4, F.lit("user")).otherwise(one("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def as_they_are(rows: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(KEY, "turn", one("role").alias("role"), one("text").alias("text"), F.lit(1).alias("copies"))


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


ORDER = [KEY, "turn", "role", "digest"]


def judged(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn, with their number n, whether they are blank, stand for a text seen in an earlier turn, or are cut
    short."""
    bare = F.btrim("text", F.lit(BLANK))
    seen = rows.select(KEY, "turn", "role", _digest().alias("digest"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("short"), "copies")
    seen = cut(seen.groupBy(KEY, "turn", "role", "digest", "blank", "short").agg(F.sum("copies").alias("n")), "turns")
    first = seen.where("n > 0 AND NOT blank").groupBy(KEY, "role", "digest").agg(F.count("*").alias("k"), F.min(F.struct("turn")).alias("first")).where("k > 1")
    first = first.select(F.col(KEY).alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col(KEY).eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return seen.join(first, same, "left").select(*ORDER, "n", "blank", again.alias("again"), "short")


OUTCOME = pa.struct([("begun", pa.int32()), ("ended", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
PARSED = [("segment", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("outcomes", pa.list_(OUTCOME))]
PARSED_SQL = f"segment bigint, low bigint, high bigint, turns bigint, first string, last string, {', '.join(f'{c} bigint' for c in COUNTS)}, outcomes array<struct<begun:int,ended:int,cost:bigint,audit:string>>"


class Segment:
    """Consecutive rows of a conversation, and what is to be known of them."""

    def __init__(self, conv: object, number: int, begins: bool):
        self.conv, self.number, self.rows = conv, number, 0
        self.low = self.high = self.first = self.last = None
        self.turns = 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.charts = {x: Chart(x) for x in ([0] if begins else range(len(STATES)))}

    def add(self, turn: int | None, role: str, n: int, blank: bool, again: bool, short: bool) -> None:
        if not n:
            return
        self.rows += 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial, c = role[:1], self.counts
        if self.last is not None:
            c["illegal"] += (self.last, initial) not in LEGAL
        else:
            self.first = initial
        c["illegal"] += n - 1
        self.last = initial
        stays = not (blank or again)
        c["blank"] += n * blank
        c["duplicate"] += (n - stays) * (not blank)
        c["truncated"] += stays and short
        for chart in self.charts.values():
            if stays:
                chart.scan(initial, short)
            chart.strike(n - stays)

    def row(self) -> tuple:
        outcomes = [{"begun": b, "ended": e, "cost": c, "audit": a} for b, chart in self.charts.items() for e, c, a in chart.read()]
        return (self.conv, self.number, self.low, self.high, self.turns, self.first, self.last, *self.counts.values(), outcomes)


def _batched(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 1000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(fields)
    held: list[tuple] = []

    def said() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    weight = 0
    for r in rows:
        held.append(r)
        weight += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= size or weight > 1 << 24:
            yield said()
            held, weight = [], 0
    yield said()


def parsed(turns: DataFrame, rows_at_once: int = SEGMENT) -> DataFrame:
    """A row for each segment of a conversation."""
    kind = turns.schema[KEY].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def segments() -> Iterator[tuple]:
            now, n = None, number
            for batch in batches:
                for conv, turn, role, *said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now is None or conv != now.conv or now.rows >= rows_at_once:
                        if now is not None:
                            yield now.row()
                        # the rows before a task's first conversation may be in another task, all others begin here
                        now, n = Segment(conv, n, now is not None and conv != now.conv), n + 1
                    now.add(turn, role, *said)
            if now is not None:
                yield now.row()

        yield from _batched(segments(), [(KEY, pa_kind), *PARSED], 200)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(kind)
    dealt = turns.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(KEY, "turn", "role", "n", "blank", "again", "short")
    return dealt.mapInArrow(run, f"{KEY} {kind.simpleString()}, {PARSED_SQL}")


def composed(segments: list[dict]) -> tuple:
    """gaps, the counts, cost and audit of a conversation's segments."""
    best = {0: (0, "")}
    counts = dict.fromkeys(COUNTS, 0)
    low = high = last = None
    turns = 0
    for s in segments:
        for c in COUNTS:
            counts[c] += s[c]
        if s["first"] is not None:
            counts["illegal"] += last is not None and (last, s["first"]) not in LEGAL
            last = s["last"]
        if s["low"] is not None:
            turns += s["turns"] - (s["low"] == high)
            low, high = s["low"] if low is None else low, s["high"]
        new: dict[int, tuple[int, str]] = {}
        for o in s["outcomes"]:
            if o["begun"] in best:
                cost, audit = best[o["begun"]]
                got = (cost + o["cost"], audit + o["audit"])
                if o["ended"] not in new or got < new[o["ended"]]:
                    new[o["ended"]] = got
        best = new
    cost, audit = min(best[x] for x in ENDS if x in best)
    return (min(high - low + 1 - turns, (1 << 63) - 1) if turns else 0, *counts.values(), cost, audit)


REPORT = [("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string())]
REPORT_SQL = ", ".join(f"{n} {'string' if n == 'audit' else 'bigint'}" for n, _ in REPORT)


def reports(rows: DataFrame, rows_at_once: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of rows (conv_id, turn, role, text, copies)."""
    segments = parsed(judged(rows), rows_at_once)
    kind = rows.schema[KEY].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            own: list[dict] = []
            for batch in batches:
                for s in batch.to_pylist():
                    if own and s[KEY] != own[0][KEY]:
                        yield own[0][KEY], *composed(own)
                        own = []
                    own.append(s)
            if own:
                yield own[0][KEY], *composed(own)

        yield from _batched(each(), [(KEY, pa_kind), *REPORT])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(kind)
    # segments are few: as many as there are tasks and blocks that a conversation's rows are in
    dealt = segments.repartition(KEY).sortWithinPartitions(KEY, "segment")
    return dealt.mapInArrow(run, f"{KEY} {kind.simpleString()}, {REPORT_SQL}")


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found and rows, each conversation's report before its rows, in order."""
    none = [F.lit(None).cast(found.schema[n].dataType).alias(n) for n, _ in REPORT]
    heads = found.select(KEY, F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), F.lit(0).alias("copies"), *[n for n, _ in REPORT])
    own = rows.where("copies > 0").select(KEY, F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text", "copies", *none)
    return heads.union(own).repartition(KEY).sortWithinPartitions(KEY, "kind", "turn", "role", "digest").drop("kind", "turn", "digest")


class Walk:
    """An audit read beside the rows: gives edit, role and text of each row that comes out."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        # what is complete follows from the letters: an odd number of rows stay only behind a system row
        self.state = 0

    def _to(self, initial: str) -> None:
        self.state = next(h for h, t in STEPS[self.state] if t == initial)

    def _free(self) -> str:
        """The name that the grammar has for a row that is inserted or renamed."""
        initial = next(t for _, t in STEPS[self.state] if t in NAMES)
        self._to(initial)
        return NAMES[initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._free(), ""

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(copies):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self._to(role[:1])
                yield letter, role, text
            elif letter == "R":
                yield letter, self._free(), text


def _walked(batches: Iterator[pa.RecordBatch], begin: Callable, say: Callable, end: Callable) -> Iterator[tuple]:
    """What begin(report), say(edit, role, text) and end() give, conversation by conversation."""
    walk = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["audit"] is not None:
                if walk is not None:
                    for x in walk.inserted():
                        yield from say(*x)
                    yield from end()
                walk = Walk(r["audit"])
                begin(r)
            else:
                for x in walk.row(r["role"], r["text"], r["copies"]):
                    yield from say(*x)
    if walk is not None:
        for x in walk.inserted():
            yield from say(*x)
        yield from end()


def repaired(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of every row of the repaired conversations. rows have copies, as damaged() and
    as_they_are() give them."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[KEY].dataType
    pa_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = {}

        def begin(r: dict) -> None:
            now.update(conv=r[KEY], place=-1)

        def say(edit: str, role: str, text: str) -> Iterator[tuple]:
            now["place"] += 1
            yield now["conv"], now["place"], edit, role, text

        yield from _batched(_walked(batches, begin, say, lambda: ()), [(KEY, pa_kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    return _beside(rows, found if found is not None else reports(rows)).mapInArrow(run, f"{KEY} {kind.simpleString()}, place bigint, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256, of the repaired rows as role:text, joined by line ends."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[KEY].dataType
    pa_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = {}

        def begin(r: dict) -> None:
            now.update(report=[r[KEY], *(r[n] for n, _ in REPORT)], sha=hashlib.sha256(), some=False)

        def say(edit: str, role: str, text: str) -> tuple:
            now["sha"].update(("\n" * now["some"] + f"{role}:{text}").encode("utf-8", "replace"))
            now["some"] = True
            return ()

        def end() -> Iterator[tuple]:
            yield *now["report"], now["sha"].hexdigest()

        yield from _batched(_walked(batches, begin, say, end), [(KEY, pa_kind), *REPORT, ("repaired_sha256", pa.string())])

    return _beside(rows, found).mapInArrow(run, f"{KEY} {kind.simpleString()}, {REPORT_SQL}, repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the contract's damage: its faults, and the cheapest repair."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digests(rows, reports(rows))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE: dict[str, str] = {}
