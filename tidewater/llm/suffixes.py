"""Suffix-array dedup: bytes under strings of `length` bytes that start twice or more, found by hash-compared suffix sort.

Every string of `length` bytes has an anchor, its gram (of `gram` bytes) with the smallest hash (winnowing), at the same place
in equal strings; neighbouring strings share anchors, so a text has about one for 70 bytes. Anchors that occur once are done with.
An anchor's context is all of the strings that it stands for. Contexts that occur twice as a whole are covered; of these,
and of all others, one each goes on to be compared with the other contexts of the same anchor:

* in a task, the suffixes that start at the anchors are sorted by mergesort; two suffixes are compared in a logarithmic
  number of steps, by binary search for their common extension over prefix polynomial hashes. Within an anchor's run of the
  order, the common extensions of neighbours give those of all members; to the left they are searched for alike. A pair that
  shares `length` bytes around the anchor is verified byte by byte, against collisions;
* an anchor with more than LIMIT different contexts (the edge of a passage that a great many texts share) would be a hot
  group. Its strings are settled by counting hashes with partial aggregation, which needs no task to hold the group: first in
  cells of CELL strings (nothing in a cell is repeated unless what all of its strings share is; all of it is if the cell as a
  whole is), then one by one, by 128-bit hashes, in cells that this leaves open.

Tasks of the sort hold about BLOCK bytes of contexts, so their number follows the input. Hot anchors meet nowhere in one task:
counts are aggregated partially, and joins are between plain tables, so that a skewed side can be split.

Passages are looked for beside that, by words: of each string of PASSAGE + 1 words (ASCII letters in lower case, white space as
it may be) that stands in another text too, a text has an anchor of ANCHOR words that the other has as well. n_repeats counts
them. Nothing is removed for a passage that is shorter than `length` bytes.

Defined results: null text counts as empty; texts below `length` bytes lose nothing; very long texts are anchored in pieces of
PIECE bytes, which changes no result; rows are told apart by doc_id and text, so equal rows are repeats of each other and lose
all they have from `length` bytes on; an empty table gives an empty result; extra columns are ignored, or kept by
without_repeats().
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import map_rows, ragged
from ._store import cut, free
from .neardup import BASE, BYTE, INVERSE, PLACE, hashed_words, powers
from .segmentation import mixed

#: Bytes of a string that is removed where it stands twice, and of its anchor.
LENGTH, GRAM = 400, 256
#: Words that a passage has more than, and of its anchor.
PASSAGE, ANCHOR = 50, 26
LIMIT = 64
CELL = 16
BLOCK = 16 << 20
PIECE = 4 << 20
PLACE_BITS = np.uint64(28)
SECOND = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Size:
    length: int = LENGTH
    gram: int = GRAM

    @property
    def starts(self) -> int:
        """Strings that hold a gram."""
        return self.length - self.gram + 1


def prefix_sums(data: np.ndarray, table: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial sums of data, and the powers that move a difference of two to the place 0."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * powers(BASE, n), out=sums[1:], dtype=np.uint64)
    return sums, powers(INVERSE, n + 1)


def least_in_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of each window of so many hashes the place of the smallest; of equal ones (in their upper bits) the first."""
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    low = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    return (low & mask).astype(np.int64)


def anchors(texts: list[bytes], size: Size = Size()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts put together: each anchor's text, place, first and last start of its strings (all places in the text), hash,
    and the hash of its context."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < size.length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums, down = prefix_sums(data)
    grams = mixed((sums[size.gram :] - sums[: -size.gram]) * down[: len(data) - size.gram + 1])
    at = least_in_windows(grams, size.starts)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    valid = np.flatnonzero(np.arange(len(at)) + size.length <= ends[text_of])
    at, text_of = at[valid], text_of[valid]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(text_of) != 0)]))
    closes = np.concatenate([opens[1:], [len(at)]]) - 1
    first, last, place, text_of = valid[opens], valid[closes], at[opens], text_of[opens]
    context = mixed((sums[last + size.length] - sums[first]) * down[first] + (last - first).astype(np.uint64)) ^ (place - first).astype(np.uint64)
    base = (ends - sizes)[text_of]
    return text_of, place - base, first - base, last - base, grams[place].view(np.int64), context.view(np.int64)


def in_pieces(texts: list[bytes], size: Size) -> tuple[np.ndarray, ...]:
    """anchors() of texts, of which long ones are taken in pieces that overlap by all but one byte of a string."""
    cuts = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - size.length + 1), PIECE)]
    if len(cuts) == len(texts):
        return anchors(texts, size)
    found = []
    for i, a in cuts:
        _, p, lo, hi, h, f = anchors([texts[i][a : a + PIECE + size.length - 1]], size)
        found.append((np.full(len(p), i), p + a, lo + a, hi + a, h, f))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def passage_anchors(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the distinct hashes of the strings of ANCHOR words that are smallest in a string of PASSAGE + 1 words."""
    words, edges = hashed_words(texts)
    width = PASSAGE + 1 - ANCHOR + 1
    if len(words) <= PASSAGE:
        return [np.zeros(0, np.int64) for _ in texts]
    rolled = np.zeros(len(words) - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        rolled += words[k : len(words) - ANCHOR + 1 + k] * PLACE[k]
    rolled = mixed(rolled)
    at = least_in_windows(rolled, width)
    return [np.unique(rolled[np.unique(at[a : max(a, b - PASSAGE)])]).view(np.int64) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


class Extensions:
    """Common extensions of places in strings that stand one after the other in data, each string's hashes starting anew."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        own = ragged(np.zeros(len(sizes), np.int64), sizes)
        longest = int(sizes.max(initial=0))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[self.data] * powers(BASE, longest + 1)[own], dtype=np.uint64)])
        self.down = powers(INVERSE, longest + 1)

    def hashed(self, string: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the n bytes from a on, a counted from the string's start."""
        at = self.start[string] + a
        return (self.sums[at + n] - self.sums[at]) * self.down[a]

    def common(self, s: np.ndarray, a: np.ndarray, t: np.ndarray, b: np.ndarray, most: np.ndarray, left: bool = False) -> np.ndarray:
        """How many bytes from a on (before a, if left) of strings s equal those from b on of strings t, at most so many: by
        binary search."""
        lo, hi = np.zeros(len(s), np.int64), most.astype(np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            back = mid if left else 0
            same = self.hashed(s, a - back, mid) == self.hashed(t, b - back, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, s: np.ndarray, a: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix from a on of s is smaller than, or equal to, that from b on of t."""
        room_s, room_t = self.start[s + 1] - self.start[s] - a, self.start[t + 1] - self.start[t] - b
        n = self.common(s, a, t, b, np.minimum(room_s, room_t))
        ended_s, ended_t = n == room_s, n == room_t
        last = len(self.data) - 1
        x = self.data[np.minimum(self.start[s] + a + n, last)]
        y = self.data[np.minimum(self.start[t] + b + n, last)]
        return ended_s | ~ended_t & (x < y)

    def sorted_suffixes(self, group: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order of the strings by group, then by the suffix from `at` on: bottom-up mergesort, the merges of a level at once."""
        n = len(group)
        order = np.argsort(group, kind="stable")
        width = 1
        while width < n:
            run = np.arange(n) // (2 * width)
            begin = run * 2 * width
            middle, end = np.minimum(begin + width, n), np.minimum(begin + 2 * width, n)
            here = np.arange(n)
            left = here < middle
            lo, hi = np.where(left, middle, begin), np.where(left, end, middle)
            first = lo.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                mine, other = order[here[open_]], order[mid]
                # from the left, an equal other stays behind; from the right, it goes before
                other_first = group[other] < group[mine]
                tied = np.flatnonzero(group[other] == group[mine])
                if len(tied):
                    m, o, on_left = mine[tied], other[tied], left[open_[tied]]
                    s, t = np.where(on_left, m, o), np.where(on_left, o, m)
                    le = self.before(s, at[s], t, at[t])
                    other_first[tied] = np.where(on_left, ~le, le)
                lo[open_] = np.where(other_first, mid + 1, lo[open_])
                hi[open_] = np.where(other_first, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            new = np.zeros(n, np.int64)
            new[np.where(left, here, begin + here - middle) + (lo - first)] = order
            order = new
            width *= 2
        return order

    def equal(self, s: np.ndarray, a: np.ndarray, t: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes from a on of s are those from b on of t, byte by byte."""
        out = np.ones(len(s), bool)
        for i in range(0, len(s), 4096):
            j = slice(i, i + 4096)
            x, y = ragged(self.start[s[j]] + a[j], n[j]), ragged(self.start[t[j]] + b[j], n[j])
            differs = np.concatenate([[0], np.cumsum(self.data[x] != self.data[y])])
            ends = np.cumsum(n[j])
            out[j] = differs[ends] == differs[ends - n[j]]
        return out


def covered(group: np.ndarray, at: np.ndarray, strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context, how far to the left and right of its anchor strings of that length reach that it shares with another
    of its group; 0 and 0 where it shares none."""
    n = len(group)
    e = Extensions(strings)
    order = e.sorted_suffixes(group, at)
    g, p = group[order], at[order]
    room = (e.start[1:] - e.start[:-1])[order] - p
    reach_l, reach_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return reach_l, reach_r
    near = np.where(g[:-1] == g[1:], e.common(order[:-1], p[:-1], order[1:], p[1:], np.minimum(room[:-1], room[1:])), 0)
    i = np.arange(n - 1)
    right = near.copy()
    step = 1
    while True:
        # the extension of members `step` apart is the least of those in between
        keep = np.flatnonzero(right > 0)
        i, right = i[keep], right[keep]
        if not len(i):
            break
        s, t = order[i], order[i + step]
        left = e.common(s, at[s], t, at[t], np.minimum(at[s], at[t]), left=True)
        long = np.flatnonzero(left + right >= length)
        if len(long):
            s, t, l, r = s[long], t[long], left[long], right[long]
            true = e.equal(s, at[s] - l, t, at[t] - l, l + r)
            for x in (s[true], t[true]):
                np.maximum.at(reach_l, x, l[true])
                np.maximum.at(reach_r, x, r[true])
        go = i + step < n - 1
        i, right = i[go], right[go]
        right = np.minimum(right, near[i + step])
        step += 1
    return reach_l, reach_r


def keys(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("k1"), F.xxhash64(F.col("doc_id"), F.lit(2), text).alias("k2")]


def anchored(docs: DataFrame, size: Size, passages: bool) -> DataFrame:
    """docs(k1, k2, text) to k1, k2, arrays of what anchors() says, and w, what passage_anchors() says."""
    names = ("p", "lo", "hi")
    schema = "k1 bigint, k2 bigint, a array<bigint>, f array<bigint>, p array<int>, lo array<int>, hi array<int>" + ", w array<bigint>" * passages

    def run(cols: dict) -> dict:
        text, p, lo, hi, a, f = in_pieces(cols["text"], size)
        offsets = pa.array(np.searchsorted(text, np.arange(len(cols["text"]) + 1)).astype(np.int32))
        out = {"k1": cols["k1"], "k2": cols["k2"]}
        out |= {k: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for k, v in (("a", a), ("f", f))}
        out |= {k: pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32), pa.int32())) for k, v in zip(names, (p, lo, hi), strict=True)}
        return out | ({"w": passage_anchors(cols["text"])} if passages else {})

    return map_rows(docs, run, schema)


def contexts(rows: DataFrame, size: Size) -> DataFrame:
    """rows(k1, k2, text, todo) to the context bytes of every entry of todo."""

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("k1", "k2", "a", "p", "lo", "bytes")}
        for k1, k2, text, todo in zip(cols["k1"], cols["k2"], cols["text"], cols["todo"], strict=True):
            for x in todo:
                for name, value in (("k1", k1), ("k2", k2), ("a", x["a"]), ("p", x["p"]), ("lo", x["lo"]), ("bytes", text[x["lo"] : x["hi"] + size.length])):
                    out[name].append(value)
        return out

    return map_rows(rows, run, "k1 bigint, k2 bigint, a bigint, p int, lo int, bytes binary")


def sorter(size: Size):
    def sorted_blocks(batches):
        """The rows of a partition, which holds whole groups, to what covered() says."""
        import pandas as pd

        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({c: [] for c in ("k1", "k2", "a", "p", "lo", "bytes")})], ignore_index=True)
        if len(pdf):
            lo, p = pdf["lo"].to_numpy(np.int64), pdf["p"].to_numpy(np.int64)
            left, right = covered(pdf["a"].to_numpy(np.int64), p - lo, pdf["bytes"].to_list(), size.length)
            hit = right > 0
            yield pd.DataFrame({"k1": pdf["k1"][hit], "k2": pdf["k2"][hit], "start": (p - left)[hit], "end": (p + right)[hit]})

    return sorted_blocks


def cells(rows: DataFrame, size: Size) -> DataFrame:
    """rows(k1, k2, text, todo) to the cells of every entry of todo: first and last start of strings, hash of what they share, and
    128-bit hash of all of them. Cells lie at the same places around an anchor in all texts."""

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("k1", "k2", "lo", "hi", "core", "f1", "f2")}
        for k1, k2, text, todo in zip(cols["k1"], cols["k2"], cols["text"], cols["todo"], strict=True):
            for x in todo:
                base, last = x["lo"], x["hi"]
                grid = np.arange(x["p"] - size.starts + 1, x["p"] + 1, CELL)
                grid = grid[(grid + CELL - 1 >= base) & (grid <= last)]
                lo, hi = np.maximum(grid, base), np.minimum(grid + CELL - 1, last)
                data = np.frombuffer(text[base : last + size.length], np.uint8)
                tag = ((lo - grid) * CELL + (hi - grid)).astype(np.uint64)
                for name, table in (("f1", BYTE), ("f2", SECOND)):
                    sums, down = prefix_sums(data, table)
                    out[name].append(mixed((sums[hi + size.length - base] - sums[lo - base]) * down[lo - base] + tag).view(np.int64))
                    if name == "f1":
                        # where the grid's last string would start; it may lie behind the context's last one
                        a, b = grid + CELL - 1 - base, grid + size.length - base
                        out["core"].append(mixed((sums[b] - sums[a]) * down[a]).view(np.int64))
                out["lo"].append(lo)
                out["hi"].append(hi)
                out["k1"].append(np.full(len(lo), k1))
                out["k2"].append(np.full(len(lo), k2))
        return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}

    return map_rows(rows, run, "k1 bigint, k2 bigint, lo bigint, hi bigint, core bigint, f1 bigint, f2 bigint")


def windows(rows: DataFrame, size: Size) -> DataFrame:
    """rows(k1, k2, text, todo) to the 128-bit hashes of all strings of every entry of todo."""

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("k1", "k2", "start", "w1", "w2")}
        for k1, k2, text, todo in zip(cols["k1"], cols["k2"], cols["text"], cols["todo"], strict=True):
            for x in todo:
                data = np.frombuffer(text[x["lo"] : x["hi"] + size.length], np.uint8)
                n = len(data) - size.length + 1
                for name, table in (("w1", BYTE), ("w2", SECOND)):
                    sums, down = prefix_sums(data, table)
                    out[name].append(mixed((sums[size.length :] - sums[: -size.length]) * down[:n]).view(np.int64))
                out["start"].append(np.arange(x["lo"], x["lo"] + n))
                out["k1"].append(np.full(n, k1))
                out["k2"].append(np.full(n, k2))
        return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}

    return map_rows(rows, run, "k1 bigint, k2 bigint, start bigint, w1 bigint, w2 bigint")


def sorted_out(parts: DataFrame, core: str, full: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """parts with `whole` (a part with the same `full` stands elsewhere), `open` (the part is the one that stands for its kind, and
    its core has other kinds) and `kinds` (how many its core has); and the table of kinds that this reads."""
    who = F.struct("k1", "k2", "lo")
    kinds = cut(parts.groupBy(core, *full).agg(F.count("*").alias("times"), F.min(who).alias("keeper")), f"{name}-kinds")
    counts = cut(kinds.groupBy(core).agg(F.count("*").alias("kinds")), f"{name}-counts")
    both = cut(kinds.join(counts, core), f"{name}-counted-kinds")
    free(kinds, counts)
    return parts.join(both, [core, *full]).withColumn("whole", F.col("times") > 1).withColumn("open", (F.col("kinds") > 1) & (who == F.col("keeper"))), both


def shared_passages(marks: DataFrame) -> DataFrame:
    """k1, k2 and n_repeats of rows that have passages in common with others."""
    each = marks.select("k1", "k2", F.explode("w").alias("w"))
    shared = cut(each.groupBy("w").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("w"), "shared-passages")
    out = cut(each.join(shared, "w").groupBy("k1", "k2").agg(F.count_distinct("w").alias("n_repeats")), "rows-with-passages")
    free(shared)
    return out


def repeated(docs: DataFrame, size: Size, passages: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (k1, k2, text) that may lose something, intervals (k1, k2, start, end) of bytes to remove, and what shared_passages()
    says: tables, to be freed."""
    key = ["k1", "k2"]
    base = docs.select(*keys(docs), F.col("text"))
    marks = cut(anchored(base, size, passages), "anchors")
    each = marks.select(*key, F.inline(F.arrays_zip("a", "f", "p", "lo", "hi")))
    twice = cut(marks.select(F.explode("a").alias("a")).groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a"), "twice")
    found = cut(each.join(twice, "a"), "repeated-anchors")
    shared = shared_passages(marks) if passages else None
    free(twice, marks)
    met, kinds = sorted_out(found, "a", ["f"], "anchors")
    met = met.select(*key, "a", "p", "lo", "hi", "whole", "open", (F.col("kinds") > LIMIT).alias("hot"))
    met = cut(met.groupBy(*key).agg(F.collect_set(F.struct("a", "p", "lo", "hi", "whole", "open", "hot")).alias("met")), "met")
    free(found, kinds)
    rows = cut(base.join(met, key), "rows-with-repeats")
    free(met)
    whole = rows.select(*key, F.inline(F.filter("met", lambda x: x["whole"]))).select(*key, F.col("lo").cast("long").alias("start"), (F.col("hi") + size.length).cast("long").alias("end"))
    part = lambda hot: rows.select(*key, "text", F.filter("met", lambda x: x["open"] & (x["hot"] == hot)).alias("todo")).where(F.size("todo") > 0)
    cold = cut(contexts(part(False), size), "contexts")
    n = cold.agg(F.sum(F.length("bytes"))).first()[0] or 0
    tasks = max(8, -(-n // BLOCK), int(cold.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = cold.repartition(tasks, "a").mapInPandas(sorter(size), "k1 bigint, k2 bigint, start bigint, end bigint")
    part_cells = cut(cells(part(True), size), "cells")
    cell, kinds = sorted_out(part_cells, "core", ["f1", "f2"], "cells")
    cell = cut(cell.select(*key, "lo", "hi", "whole", "open"), "cells-sorted-out")
    free(part_cells, kinds)
    hot_whole = cell.where("whole").select(*key, F.col("lo").alias("start"), (F.col("hi") + size.length).alias("end"))
    todo = cell.where("open").groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("todo"))
    strings = cut(windows(rows.select(*key, "text").join(todo, key), size), "strings")
    again = cut(strings.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2"), "strings-twice")
    hot = strings.join(again, ["w1", "w2"]).select(*key, "start", (F.col("start") + size.length).alias("end"))
    intervals = cut(whole.union(sorted_).union(hot_whole).union(hot), "intervals")
    free(cold, cell, strings, again)
    return rows, intervals, shared


def cleaned(docs: DataFrame, with_text: bool, size: Size = Size(), passages: bool = False) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept_sha256 (and kept, the bytes that remain as text) of rows that lose something; with
    passages, n_repeats too, and rows that have some."""
    key = ["k1", "k2"]
    rows, intervals, shared = repeated(docs, size, passages)
    spans = intervals.groupBy(*key).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    schema = "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")} | {"k1": cols["k1"], "k2": cols["k2"]}
        for text, spans in zip(cols["text"], cols["spans"], strict=True):
            runs: list[list[int]] = []
            for a, b in sorted((x["start"], x["end"]) for x in spans):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)], strict=True))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept.decode(errors="ignore"))
        return out

    # a row that stands twice in docs is in rows twice
    out = map_rows(rows.select(*key, "text").join(spans, key), run, schema).dropDuplicates(key)
    out = cut(out.join(shared, key, "full") if passages else out, "cleaned")
    free(rows, intervals, shared)
    return out


def without_repeats(docs: DataFrame, size: Size = Size()) -> DataFrame:
    """docs without the repeated bytes in text; a sign that is cut in two goes as a whole."""
    lost = cleaned(docs, True, size).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("kept").alias("_3"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys(docs))
    out = rows.join(lost, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left")
    return out.select(F.col("row").withField("text", F.coalesce("_3", "row.text")).alias("row")).select("row.*")


def op6_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select("doc_id", *keys(docs), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    out = every.join(cleaned(docs, False, passages=True), ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("n_removed", "n_spans")]
    return out.select("doc_id", "n_bytes", *counts, F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_repeats", zero).alias("n_repeats"))


QUERIES = {"op6_suffix_sort_dedup": op6_suffix_sort_dedup}
ORACLE: dict[str, str] = {}
