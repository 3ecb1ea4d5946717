"""License scans: exact phrases, and short notices with errors.

Base labels are phrases whose words stand one after the other. Beyond these, short notices are searched with at most ERRORS
edits each: a notice is split into ERRORS + 1 parts, of which one must stand unchanged wherever the notice does (pigeonhole),
all parts are looked up at once by an Aho-Corasick automaton, and the regex library verifies the text around each hit with
bounded errors and reports the span. A match begins where a word does, and its words hold the names that tell the
notice apart from others (NAMES): those of up to three letters unchanged, longer ones with at most one edit, so "licensed under the
bsd license" is no MIT notice. What stands unchanged as a whole needs no fuzzy search.

Words are runs of ASCII letters, digits and all signs beyond ASCII, in lower case; notices are searched in the words joined by
single spaces, and spans count words. The score is 1 for a base label, else the best notice's share of letters without errors.

Defined results: null text counts as empty (no words, score 0); each row is judged by itself, whether its doc_id is null,
repeated or not; an empty table gives an empty result; extra columns are ignored. Very long texts are scanned whole, in one automaton pass; of matches of equal
errors the first one is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._arrow import map_rows

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "redistribution and use in source and binary forms with or without modification": "bsd-notice",
    "this program is free software you can redistribute it and or modify": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
    "permission to use copy modify and or distribute this software for any purpose": "isc-notice",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "licensed under the mit license": "mit-notice",
    "released under the mit license": "mit-notice",
    "under the terms of the gnu general public license": "gpl-notice",
    "gnu lesser general public license": "lgpl-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "the above copyright notice and this permission notice shall be included": "mit-notice",
}
#: Words that tell notices apart.
NAMES = {"mit", "apache", "gnu", "lesser", "mozilla", "creative", "commons"}
ERRORS = 3
#: Of a notice's letters at most a fifth may differ: short ones allow fewer errors.
SHARE = 5

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def errors_of(notice: str) -> int:
    return min(ERRORS, len(notice) // SHARE)


def parts(notice: str) -> list[tuple[int, str]]:
    """The parts of a notice, one more than its errors, with their places."""
    k = errors_of(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def one_edit_at_most(x: str, y: str) -> bool:
    if abs(len(x) - len(y)) > 1:
        return False
    n = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    return x[n + (len(x) >= len(y)) :] == y[n + (len(y) >= len(x)) :]


def holds_names(notice: str, text: str) -> bool:
    """Whether the words of text have the names of the notice."""
    words = text.split(" ")
    return all(name in words or len(name) > 3 and any(one_edit_at_most(name, w) for w in words) for name in notice.split(" ") if name in NAMES)


def every_match(pattern, text: str, a: int, b: int):
    """Matches in text[a:b]: the best first, then those before it, which finditer skips, and behind it."""
    open_parts = [(a, b)]
    while open_parts:
        a, b = open_parts.pop()
        if m := pattern.search(text, a, b):
            yield m
            open_parts += [(a, m.start()), (m.end(), b)]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        import ahocorasick
        import regex

        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.rarest = re.compile(b"|".join(re.escape(max(words, key=len)) for words, _ in self.phrases))
        self.notices = [(n, label, regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(n)}){{e<={errors_of(n)}}}")) for n, label in notices.items()]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for i, (n, *_) in enumerate(self.notices):
            for at, part in parts(n):
                found.setdefault(part, []).append((i, at))
        for part, where in found.items():
            self.seeds.add_word(part, (len(part), where))
        self.seeds.make_automaton()

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """Start and label of every place of a phrase."""
        firsts: dict[bytes, list] = {}
        for p, label in self.phrases:
            firsts.setdefault(p[0], []).append((p, label))
        out = []
        for i, w in enumerate(words):
            for p, label in firsts.get(w, ()):
                if words[i : i + len(p)] == p:
                    out.append((i, label))
        return out

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        """Label, start, end and errors of notices in text, in which words are joined by single spaces."""
        windows: dict[int, list[list[int]]] = {}
        for end, (n, where) in self.seeds.iter(text):
            for i, at in where:
                k, length = errors_of(self.notices[i][0]), len(self.notices[i][0])
                a = max(0, end + 1 - n - at - k)
                b = end + 1 - n - at + length + k
                own = windows.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        out = []
        for i, own in windows.items():
            notice, label, pattern = self.notices[i]
            for a, b in own:
                b = min(b, len(text))
                while True:
                    at = text.find(notice, a, b)
                    while at > 0 and text[at - 1] != " ":
                        at = text.find(notice, at + 1, b)
                    for m in every_match(pattern, text, a, b if at < 0 else at):
                        # a word that the match ends in counts as a whole
                        rest = text.find(" ", m.end())
                        if holds_names(notice, text[m.start() : rest if rest >= 0 else None]):
                            out.append((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                    if at < 0:
                        break
                    a = at + len(notice)
                    out.append((label, at, a, 0))
        return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, int]]]:
        """Number of words, base places, and notices (label, first word, word after the last, errors, letters)."""
        low = text.translate(LOWER)
        inside = IN_WORD[np.frombuffer(low, np.uint8)]
        n_words = int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())
        words = None
        base: list[tuple[int, str]] = []
        if self.rarest.search(low):
            words = WORDS.findall(low)
            base = self.base(words)
        # parts of a notice hold letters and single spaces: joining the words first would cost more than looking for a part's words
        words = words or WORDS.findall(low)
        joined = b" ".join(words).decode()
        notices = self.fuzzy(joined)
        if notices:
            ends = list(accumulate((len(w.decode()) + 1 for w in words), initial=0))
            notices = [(label, max(0, bisect_right(ends, a) - 1), bisect_left(ends, b), e, b - a) for label, a, b, e in notices]
        return n_words, base, notices


_scanner: list[Scanner] = []


def scanned(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, and notices with their spans in words and errors."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices array<struct<label:string,start:bigint,end:bigint,errors:bigint>>"

    def run(cols: dict) -> dict:
        if not _scanner:
            _scanner.append(Scanner())
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")
        out: dict[str, list] = {k: [] for k in names} | {key: cols[key]}
        for text in cols["text"]:
            n, base, notices = _scanner[0].scan(text)
            own = {label for _, label in base}
            found = own | {x[0] for x in notices}
            best = max([1.0] * bool(base) + [1.0 - e / max(1, letters) for *_, e, letters in notices], default=0.0)
            starts = [i for i, _ in base]
            row = (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(found)), best, [dict(zip(("label", "start", "end", "errors"), x[:4], strict=True)) for x in notices])
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        return out

    return map_rows(docs.select(key, "text"), run, schema)


def op9_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("notices")


QUERIES = {"op9_license_notices": op9_license_notices}
ORACLE: dict[str, str] = {}
