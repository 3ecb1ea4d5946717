"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text is a lattice of vocabulary pieces; a segmentation's weight is exp(ALPHA * sum of its pieces' scores). Forward sums
over the lattice are filtered once per distinct word (no piece of the vocabularies in use crosses the start of a word, which
is checked when the model is loaded, so the lattice of a text falls apart into those of its words); each occurrence is then
sampled from its end to its start with uniform numbers that depend on the row key, the seed, the place and the step alone.
The same row gives the same segmentation wherever it runs.

A character that is not a piece, and the mark of a space where the text itself has that character, is spelled in byte
pieces, so decoding gives back every text exactly.

Defined results: null text counts as empty and has no pieces; a null key counts as 0, and a key that isn't a whole number
by a hash of its text; equal rows get equal segmentations; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._arrow import map_rows, ragged

SPACE = "▁"
ALPHA = 0.0005
SEED = 1
#: Distinct words whose lattices are kept by a worker at once.
CACHE = 150_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Stands for the space mark in front of a word; a mark inside a text becomes NO_SIGN, which no piece has.
MARK, NO_SIGN = ord(SPACE), 0x10FFFF
BASE = 0x9E3779B97F4A7C15 | 1


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n values, at least twice its own if it grows."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


class Lattice(defaultdict):
    """Word (text without its leading space mark) to its number; last[number] is its last node. Node n has the edges from
    first[n] on that end there: likeliest first, with the sum of probabilities up to it (2 for the last one), the piece and the
    node where it starts (-1 at the word's start). Pieces from n_pieces on are characters spelled in bytes."""

    def __init__(self, model_file: str, alpha: float = ALPHA):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.alpha, self.bytes = alpha, [0] * 256
        self.spelled: list[bytes] = []
        pieces: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            text = b""
            if model.is_byte(i):
                text = bytes([int(piece[3:5], 16)])
                self.bytes[text[0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece[1:] and piece.strip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses the start of a word")
                text = piece.replace(SPACE, " ").encode()
                if SPACE not in piece[1:]:  # runs of marks stand between words, each of which takes one
                    pieces[piece] = (i, model.get_score(i))
            self.spelled.append(text)
        self.scores = pieces
        self.lowest = min(x for _, x in pieces.values()) - 10.0
        self.longest = max(map(len, pieces))
        self.power = np.cumprod(np.concatenate([[1], np.full(self.longest, BASE, np.uint64)]).astype(np.uint64))
        hashed = self.hashed(pieces)
        by_hash = sorted((hashed[p], i, x) for p, (i, x) in pieces.items())
        if len({h for h, _, _ in by_hash}) < len(by_hash):
            raise ValueError("pieces share a hash")
        self.table = np.array([h for h, _, _ in by_hash], np.uint64)
        self.table_id, self.table_score = np.array([i for _, i, _ in by_hash], np.int64), np.array([x for *_, x in by_hash])
        top = (self.table >> np.uint64(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int64)  # the first of the table with these top bits
        self.slot[top[::-1]] = np.arange(len(top))[::-1]
        self.widest = int(np.bincount(top).max())
        self.goes_on = np.zeros(1 << 20, bool)  # whether what has these top bits may be the start of a longer piece
        self.goes_on[np.array(list(self.hashed({p[:k] for p in pieces for k in range(1, len(p))}).values()), np.uint64) >> np.uint64(44)] = True
        single = {p for p in pieces if len(p) == 1}
        self.known = np.zeros(NO_SIGN + 1, bool)
        self.known[[ord(c) for c in single]] = True
        self.ids_of = [[i] for i in range(len(self.spelled))]
        self.n_pieces = len(self.ids_of)
        self.signs: dict[int, int] = {}
        self.spelled_at = np.concatenate([[0], np.cumsum([len(x) for x in self.spelled])]).astype(np.int64)
        self.spelled = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.tables()
        self.first, self.upto, self.source, self.piece = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.reset()

    def hashes(self, signs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Mixed polynomial hashes of the n signs from each place in at."""
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * np.uint64(BASE) + signs[at + k]
        return mixed(h + np.uint64(n))

    def hashed(self, strings) -> dict[str, int]:
        """The hash of each of strings."""
        out: dict[str, int] = {}
        for n in {len(x) for x in strings}:
            group = [x for x in strings if len(x) == n]
            signs = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).astype(np.uint64)
            out.update(zip(group, self.hashes(signs, np.arange(len(group)) * n, n).tolist(), strict=True))
        return out

    def tables(self) -> None:
        self.ids_first = np.concatenate([[0], np.cumsum([len(x) for x in self.ids_of])]).astype(np.int64)
        self.ids = np.array([i for x in self.ids_of for i in x], np.int32)

    def reset(self) -> None:
        self.clear()
        self.default_factory = count().__next__
        self.last, self.nodes, self.edges = np.zeros(0, np.int64), 0, 0

    def by_bytes(self, sign: int) -> int:
        """The number that stands for a sign spelled in bytes; tables() is due after new ones."""
        if sign not in self.signs:
            self.signs[sign] = len(self.ids_of)
            self.ids_of.append([self.bytes[b] for b in (SPACE if sign == NO_SIGN else chr(sign)).encode()])
        return self.signs[sign]

    def learn(self, words: list[str]) -> None:
        """Filter the lattices of the newest words forward, all at once."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        end = np.cumsum(lengths)
        start = end - lengths
        signs = np.frombuffer("".join([SPACE + w.replace(SPACE, chr(NO_SIGN)) if SPACE in w else SPACE + w for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(signs)
        left = np.repeat(end, lengths) - np.arange(n)  # signs from here to the word's end
        edges: list[tuple] = []
        h, at = np.zeros(n, np.uint64), np.arange(n)
        for k in range(1, self.longest + 1):
            h = h * np.uint64(BASE) + signs[at + k - 1]
            own = mixed(h + np.uint64(k))
            top = (own >> np.uint64(44)).astype(np.int64)
            where = self.slot[top]
            maybe = np.flatnonzero(where >= 0)
            where, sought = where[maybe], own[maybe]
            for _ in range(1, self.widest):
                where += (self.table[where] < sought) & (where + 1 < len(self.table))
            hit = self.table[where] == sought
            where, begins = where[hit], at[maybe[hit]]
            edges.append((begins, begins + k, self.table_id[where], self.alpha * self.table_score[where], np.full(len(begins), k)))
            on = np.flatnonzero(self.goes_on[top] & (left[at] > k))
            at, h = at[on], h[on]
            if not len(at):
                break
        odd = np.flatnonzero(~self.known[signs.astype(np.int64)])
        if len(odd):
            which, back = np.unique(signs[odd].astype(np.int64), return_inverse=True)
            known = len(self.ids_of)
            number = np.array([self.by_bytes(c) for c in which.tolist()], np.int64)[back]
            if len(self.ids_of) > known:
                self.tables()
            edges.append((odd, odd + 1, number, self.alpha * self.lowest * (self.ids_first[number + 1] - self.ids_first[number]), np.full(len(odd), self.longest + 1)))
        a, b, piece, score, rank = (np.concatenate(x) for x in zip(*edges, strict=True))
        base = np.repeat(start, lengths)  # node p ends with sign p; it belongs to the word that starts at base[p]
        node = b - 1
        step = node - base[node]
        order = np.argsort((step * n + node) * (self.longest + 2) + rank)
        a, node, piece, score, step = a[order], node[order], piece[order], score[order], step[order]
        opens = a == base[node]
        source = np.where(opens, n, a - 1)
        group = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])  # of edges that end at the same node
        size = np.diff(group, append=len(node))
        here = node[group]
        forward = np.zeros(n + 1)  # the one behind all stands for the start of any word
        cuts = np.flatnonzero(np.diff(step[group], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x, y = group[lo], group[hi] if hi < len(group) else len(node)
            forward[here[lo:hi]] = np.logaddexp.reduceat(score[x:y] + forward[source[x:y]], group[lo:hi] - x)
        log_p = score + forward[source] - forward[node]
        upto, order = np.full(len(node), 2.0), np.arange(len(node))
        for c in np.flatnonzero(np.bincount(size)).tolist():
            if c > 1:
                edge = group[size == c][:, None] + np.arange(c)
                of = np.argsort(-log_p[edge], axis=1, kind="stable")
                order[edge] = np.take_along_axis(edge, of, 1)
                upto[edge[:, :-1]] = np.cumsum(np.exp(log_p[order[edge[:, :-1]]]), axis=1)
        nodes, used = self.nodes, self.edges
        self.nodes, self.edges = nodes + n, used + len(node)
        self.first = grown(self.first, self.nodes)
        self.upto, self.source, self.piece = grown(self.upto, self.edges), grown(self.source, self.edges), grown(self.piece, self.edges)
        self.first[nodes + here] = used + group
        self.upto[used : self.edges] = upto
        self.source[used : self.edges] = np.where(opens, -1, nodes + a - 1)[order]
        self.piece[used : self.edges] = piece[order]
        self.last = np.concatenate([self.last, nodes + end - 1])

    def sample(self, texts: list[str], keys: list[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sampled segmentation of each text, and where each text's ids end."""
        if len(self) > CACHE:
            self.reset()
        known = len(self)
        words = [t.split(" ") if t else [] for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        total = int(counts.sum())
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, total)
        if len(self) > known:
            self.learn(list(islice(reversed(self), len(self) - known))[::-1])
        node = self.last[number]
        first, upto, source = self.first, self.upto, self.source
        row = np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)
        start = mixed(mixed(row + np.uint64(seed)) + np.uint64(0x9E3779B97F4A7C15))
        place = ragged(np.zeros(len(counts), np.int64), counts).astype(np.uint64)
        stream = mixed(np.repeat(start, counts) + place * np.uint64(0x9E3779B97F4A7C15))
        active, steps = np.arange(total), []
        while len(active):
            at = node[active]
            u = (mixed(stream[active] + np.uint64(len(steps))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[at]
            unsure = np.flatnonzero(u >= upto[edge])
            while len(unsure):
                edge[unsure] += 1
                unsure = unsure[u[unsure] >= upto[edge[unsure]]]
            steps.append((active, edge))
            node[active] = source[edge]
            active = active[node[active] >= 0]
        # edges were drawn from the end of each word: put them in reading order
        n_steps = np.zeros(total, np.int64)
        for a, _ in steps:
            n_steps[a] += 1
        ends = np.cumsum(n_steps)
        order = np.zeros(int(ends[-1]) if total else 0, np.int64)
        for k, (a, e) in enumerate(steps):
            order[ends[a] - 1 - k] = e
        piece = self.piece[order]
        lengths = self.ids_first[piece + 1] - self.ids_first[piece]
        out = self.ids[ragged(self.ids_first[piece], lengths)]
        upto_edge = np.concatenate([[0], np.cumsum(lengths)])
        upto_word = np.concatenate([[0], ends])
        return out, upto_edge[upto_word[np.cumsum(counts)]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell, without the space before the first word."""
        starts = self.spelled_at[ids]
        return self.spelled[ragged(starts, self.spelled_at[ids + 1] - starts)].tobytes()[1:]


_lattices: dict[tuple[str, float], Lattice] = {}


def number_of(key) -> int:
    """The whole number that a row key counts as."""
    if key is None or isinstance(key, int):
        return key or 0
    return int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=8).digest(), "little")


def segmented(docs: DataFrame, key: str = "doc_id", seed: int = SEED, alpha: float = ALPHA, model_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """key, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), text_crc32 and lossless of the decoded text, and ids."""
    path = model_file or default_model()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_pieces bigint, ids_crc32 bigint, text_crc32 bigint, lossless boolean" + ", ids array<int>" * with_ids

    def run(cols: dict) -> dict:
        if (path, alpha) not in _lattices:
            _lattices[path, alpha] = Lattice(path, alpha)
        lattice = _lattices[path, alpha]
        ids, ends = lattice.sample([t.decode() for t in cols["text"]], [number_of(k) for k in cols[key]], seed)
        out: dict[str, list] = {k: [] for k in (key, "n_pieces", "ids_crc32", "text_crc32", "lossless", "ids")}
        a = 0
        for k, text, b in zip(cols[key], cols["text"], ends.tolist(), strict=True):
            own = ids[a:b]
            a = b
            back = lattice.decode(own)
            for name, value in ((key, k), ("n_pieces", len(own)), ("ids_crc32", zlib.crc32(own.astype("<u4").tobytes())), ("text_crc32", zlib.crc32(back)), ("lossless", back == text)):
                out[name].append(value)
            if with_ids:
                out["ids"].append(own)
        return out

    return map_rows(docs.select(key, "text"), run, schema)


def op4_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


QUERIES = {"op4_sample_pieces": op4_sample_pieces}
ORACLE: dict[str, str] = {}
