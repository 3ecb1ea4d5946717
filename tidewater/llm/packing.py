"""Best-fit packing by sums of squares.

Documents become token ids, long ones are cut into pieces of at most CAPACITY, and pieces are placed, largest first, where
the sum over all gaps of the squared number of open bins with that gap becomes smallest (ties: the smallest gap that
remains). A gap of 0 is closed and not counted.

Pieces are dealt to groups of about GROUP pieces by a hash of their row; bins that a group could not fill are opened again
and packed with those of other groups, level after level, in fewer groups of at most about WIDEST x GROUP pieces, so a task's
work is bounded whatever the input. It ends with one group, or when groups are as large as they may be and a level leaves more
than STALLED of what it opened: bins then stay as they are. Only row number and length go through the levels.

Defined results: null text counts as empty and gives one piece, the closing id; rows are packed one by one, whether their
doc_id is null, repeated or not; an empty table gives an empty result; extra columns are ignored. pack() takes any rows that
have none of the columns _n, _g, _length, _full, sequence_id and offset.

Words are encoded one by one and kept in a bounded cache where the vocabulary's tokens don't cross white space; runs of letters
and of signs that are new are merged by its model's rules, many at once, where that gives what its tokenizer gives. Both are tried
on samples when it is loaded; for other vocabularies texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import map_rows, ragged
from ._store import cut

CAPACITY = 2048
CLOSING_ID = 0
GROUP = 4096
WIDEST, STALLED = 4, 0.75
CACHE = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SIGNS, LETTERS = r"([!-&(-/:-@\[-`{-~]*)", r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)"

#: A word to a line: a run of letters that lower-casing and composing leave one by one as they are, between signs that make
#: one token run, or else the whole word. Apostrophes, digits and <| split otherwise, so words that have them take the
#: tokenizer's own way.
LINES = re.compile(f"^(?:{SIGNS}{LETTERS}{SIGNS}|(.+))$", re.MULTILINE)


#: What tells how a vocabulary encodes.
SAMPLES = ("One two, über  Straße\nx --- (Wörd) it", "The END of été! ... a")


def byte_signs() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b if b in visible else 256 + hidden.index(b)) for b in range(256)]


class Merges:
    """A byte-level BPE model without options, for many runs at once: in each round the first of the likeliest pairs of every
    run is merged, which is the order of the model."""

    NEVER = np.iinfo(np.int64).max

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.n, signs = max(vocab.values()) + 1, byte_signs()
        self.open, self.last = (np.array([vocab[x + end] for x in signs], np.int64) for end in ("", suffix))
        rank = {vocab[a] * (self.n + 1) + vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.pairs = np.array(sorted(rank), np.int64)
        self.rank = np.array([rank[x] for x in self.pairs.tolist()], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    @staticmethod
    def fits(model: dict) -> bool:
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        return plain and bool(model["merges"]) and all(x + end in model["vocab"] for x in byte_signs() for end in ("", model.get("end_of_word_suffix") or ""))

    def ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of runs, none of them empty or with a line break, and their number in each."""
        raw = np.frombuffer("\n".join([*runs, ""]).encode(), np.uint8)
        breaks = np.flatnonzero(raw == 10)
        ends = breaks - np.arange(len(breaks))
        n = int(ends[-1])
        raw = raw[raw != 10]
        ids = np.append(self.open[raw], self.n)  # the one behind all is in no pair
        ids[ends - 1] = self.last[raw[ends - 1]]
        starts = np.concatenate([[0], ends[:-1]])
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[starts] = n, -1
        gone = np.zeros(n, bool)

        def rated(at: np.ndarray) -> np.ndarray:
            """Rank and place of the pairs that begin there."""
            pair = ids[at] * (self.n + 1) + ids[after[at]]
            k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            return np.where(self.pairs[k] == pair, (self.rank[k] << 32) + at, self.NEVER)

        best, going = rated(np.arange(n)), starts
        while True:
            first = np.minimum.reduceat(best, going)
            going, first = going[first < self.NEVER], first[first < self.NEVER]
            if not len(first):
                return ids[:n][~gone], np.add.reduceat(~gone, starts, dtype=np.int64)
            at = first & 0xFFFFFFFF
            second = after[at]
            ids[at], gone[second], best[second] = self.made[first >> 32], True, self.NEVER
            after[at] = after[second]
            before[after[at]] = at
            back = before[at]
            touched = np.concatenate([at, back[back >= 0]])
            best[touched] = rated(touched)


class WordIds(defaultdict):
    """Word (bytes) to its number; the ids of word n are flat[first[n]:first[n + 1]]. Runs of letters and of signs are numbered
    likewise; words that aren't made of such runs stand among them as tuples."""

    #: Longer runs than this go to the tokenizer's model one by one.
    LONG = 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        whole = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.by_word = all(whole(x) == [i for w in x.split() for i in whole(w)] for x in SAMPLES)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.by_run = self.by_word and Merges.fits(model)
        if self.by_run:
            self.merges = Merges(model)
            runs = [x for t in SAMPLES for w in t.split() for x in LINES.findall(w)[0][:3] if x]
            self.by_run = all(self.merges.ids([x.lower()])[0].tolist() == self.alone(x.lower()) == whole(x) for x in runs)
        self.reset()
        self.reset_runs()

    def reset(self) -> None:
        self.clear()
        self.default_factory = count().__next__
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def reset_runs(self) -> None:
        """Run 0 is the empty one."""
        self.runs = defaultdict(count(1).__next__, {"": 0})
        self.run_flat, self.run_first = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def alone(self, run: str) -> list[int]:
        """Ids of a run from the model itself."""
        return [t.id for t in self.model.tokenize("".join([self.signs[b] for b in run.encode()]))]

    def learn_runs(self, runs: list) -> None:
        """Ids of the newest runs: many at once, long ones and whole words each by itself."""
        many = np.array([type(x) is str and len(x) <= self.LONG for x in runs], bool)
        lengths = np.zeros(len(runs), np.int64)
        rest = [self.alone(x) if type(x) is str else self.tokenizer.encode(x[0], add_special_tokens=False).ids for x, m in zip(runs, many.tolist(), strict=True) if not m]
        lengths[~many] = [len(x) for x in rest]
        flat = np.fromiter(chain.from_iterable(rest), np.int64)
        if many.any():
            ids, lengths[many] = self.merges.ids([x for x, m in zip(runs, many.tolist(), strict=True) if m])
            of_many = np.repeat(many, lengths)
            both = np.zeros(len(of_many), np.int64)
            both[of_many], both[~of_many] = ids, flat
            flat = both
        self.run_flat = np.concatenate([self.run_flat, flat.astype(np.uint32)])
        self.run_first = np.concatenate([self.run_first, self.run_first[-1] + np.cumsum(lengths)])

    def learn(self, words: list[bytes]) -> None:
        """Ids of the newest words."""
        if len(self.runs) > 2 * CACHE:
            self.reset_runs()
        known, n = len(self.runs), len(words)
        if self.by_run:
            text = b"\n".join(words).decode()
            lines = LINES.findall(text)
            if "<|" in text:
                lines = [("", "", "", w) if "<|" in w else x for x, w in zip(lines, text.split("\n"), strict=True)]
            before, letters, behind, odd = zip(*lines, strict=True)
            low = "\n".join(letters).lower().split("\n")
            run = np.fromiter(map(self.runs.__getitem__, chain(before, low, behind)), np.int64, 3 * n).reshape(3, n)
            for i in [i for i, x in enumerate(odd) if x]:
                run[1, i] = self.runs[(odd[i],)]
        else:
            run = np.fromiter((self.runs[(w.decode(),)] for w in words), np.int64, n).reshape(1, n)
        if len(self.runs) > known:
            self.learn_runs(list(islice(reversed(self.runs), len(self.runs) - known))[::-1])
        starts = self.run_first[run]
        lengths = self.run_first[run + 1] - starts
        self.flat = np.concatenate([self.flat, self.run_flat[ragged(starts.T.ravel(), lengths.T.ravel())]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths.sum(0))])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and where each text ends."""
        if not self.by_word:
            ids = [self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
            return np.array(list(chain.from_iterable(ids)), np.uint32), np.cumsum([len(x) for x in ids])
        if len(self) > CACHE:
            self.reset()
        known = len(self)
        words = [t.split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if len(self) > known:
            self.learn(list(islice(reversed(self), len(self) - known))[::-1])
        starts = self.first[at]
        lengths = self.first[at + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return self.flat[ragged(starts, lengths)], ends


_encoders: dict[str, WordIds] = {}


def pieces(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row of docs."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def cut_up(cols: dict) -> dict:
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        ids, ends = _encoders[path].encode(cols["text"])
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        a = 0
        for doc, b in zip(cols["doc_id"], ends.tolist(), strict=True):
            own = np.append(ids[a:b], np.uint32(CLOSING_ID)).astype("<u4")
            a = b
            for k, s in enumerate(range(0, len(own), CAPACITY)):
                piece = own[s : s + CAPACITY]
                for name, value in (("doc_id", doc), ("piece", k), ("start", s), ("length", len(piece)), ("ids_crc32", zlib.crc32(piece.tobytes()))):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(piece.astype(np.int32))
        return out

    return map_rows(docs.select("doc_id", "text"), cut_up, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each size, and the gap that each bin is left with; sizes are placed largest first."""
    open_bins = np.zeros(capacity + 1, np.int64)
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    never = np.iinfo(np.int64).max
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        after = open_bins[: capacity - s + 1]  # of gap g - s, for each gap g from s on
        before = open_bins[s:]
        change = np.where(before > 0, 2 * (after - before) + 2, never)
        if before[0]:
            change[0] = 1 - 2 * before[0]
        k = int(change.argmin())
        fresh = 2 * int(open_bins[capacity - s]) + 1 if s < capacity else 0
        if change[k] <= fresh:
            gap = s + k
            b = at_gap[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap - s
        if gap > s:
            open_bins[gap - s] += 1
            at_gap[gap - s].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def packed_tight(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sum_of_squares, and again over what stands in bins that aren't full, as long as that takes fewer bins."""
    bins, offsets, gaps = sum_of_squares(sizes, capacity)
    while True:
        again = np.flatnonzero(gaps[bins] > 0)
        old = np.unique(bins[again])
        if not len(again):
            return bins, offsets, gaps
        b, o, g = sum_of_squares(sizes[again], capacity)
        if len(g) > len(old) or len(g) == len(old) and (g == 0).sum() == 0:
            return bins, offsets, gaps
        bins[again], offsets[again] = b + len(gaps), o
        gaps = np.concatenate([gaps, g])


def placer(level: int, capacity: int):
    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n", kind="stable").reset_index(drop=True)
        bins, offsets, gaps = packed_tight(pdf["_length"].to_numpy(np.int64), capacity)
        out = pdf.drop(columns="_g")
        # numbered densely: fewer than the group's pieces, so that ids don't run into the next group's
        out["sequence_id"] = (np.int64(level) << 56) + (np.int64(key[0]) << 20) + np.unique(bins, return_inverse=True)[1]
        out["offset"] = offsets
        out["_full"] = gaps[bins] == 0
        return out

    return place


def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """rows with sequence_id and offset: every row is placed once."""
    rows = cut(rows.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    left = rows.select("_n", F.col(length).cast("long").alias("_length"))
    done = None
    n = left.count()
    level, groups = 0, max(1, -(-n // group))
    while True:
        dealt = left.withColumn("_g", F.pmod(F.xxhash64("_n", F.lit(level)), F.lit(groups).cast("long")))
        types = "_n bigint, _length bigint, sequence_id bigint, offset bigint, _full boolean"
        placed = cut(dealt.groupBy("_g").applyInPandas(placer(level, capacity), types), f"packed-{level}")
        opened, n = n, placed.where("NOT _full").count()
        fewer = max(1, min(groups // 2, -(-n // (group // 16))), -(-n // (WIDEST * group)))
        last = groups == 1 or fewer >= groups and n > STALLED * opened
        closed = (placed if last else placed.where("_full")).select("_n", "sequence_id", "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return rows.join(done, "_n").drop("_n")
        left = placed.where("NOT _full").select("_n", "_length")
        level, groups = level + 1, fewer


def packed(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Every piece of docs with its ids and its place: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    return pack(pieces(docs, vocabulary, with_ids))


def op3_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


QUERIES = {"op3_pack_sum_of_squares": op3_pack_sum_of_squares}
ORACLE: dict[str, str] = {}
