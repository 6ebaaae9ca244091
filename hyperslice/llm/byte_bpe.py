"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes (letter, number, white space, other, apostrophe that
opens a contraction). Each class is a function on the states of a small automaton;
composing such functions is associative, so the state before every character of a
whole batch comes from a blocked prefix scan over composition-table look-ups. No
regular expression runs. The slices between boundaries feed pair merging by rank,
whose results are cached. The byte offsets of slices and the end of every text are
kept: decoding gathers the bytes of a whole batch of ids from the vocabulary at once and
cuts them by the retained ends.
"""

from __future__ import annotations

import base64
import hashlib
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, distinct_names, read

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Slices of up to so many bytes are cached, and so many of them.
SLICE_BYTES = 40
SLICES = 250_000
BLOCK = 512
#: Slices of up to the last of these sizes are merged together, in matrices so many bytes wide.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 28, 40, 64)
NONE, BEYOND = -1, (1 << 31) - 1

# Classes of characters. "Last" white space is followed by a character that is none.
LETTER, NUMBER, OTHER, SPACE, LAST_BLANK, LAST_WHITE, SHORT, LONG, BREAK = range(9)
# States of the automaton: what the character before belongs to.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, WANT_ONE, WANT_TWO, WANT_LAST = range(9)

#: Code points of the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character, and whether a slice begins at it."""
    if kind == BREAK:
        return START, True
    if kind == SPACE:
        return IN_SPACE, state != IN_SPACE
    if kind == LAST_BLANK:
        return AFTER_BLANK, True
    if kind == LAST_WHITE:
        return START, True
    if kind == LETTER:
        if state in (WANT_ONE, WANT_LAST):
            return START, False
        if state == WANT_TWO:
            return WANT_LAST, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if kind == OTHER or state in (IN_OTHERS, AFTER_BLANK):
        return IN_OTHERS, state not in (IN_OTHERS, AFTER_BLANK)
    return (WANT_ONE if kind == SHORT else WANT_TWO), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The function of each class, the composition table (flat), each function's image of START, and where slices begin."""
    generators = [tuple(step(s, k)[0] for s in range(9)) for k in range(9)]
    functions = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(9)), *generators]))}
    queue = list(functions)
    for f in queue:
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in functions:
                functions[h] = len(functions)
                queue.append(h)
    known = list(functions)
    table = np.array([[functions[tuple(g[s] for s in f)] for g in known] for f in known], np.int32)
    begins = np.array([[step(s, k)[1] for k in range(9)] for s in range(9)])
    return np.array([functions[g] for g in generators], np.int32), table.ravel(), np.array([f[START] for f in known], np.int32), begins


@cache
def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            kinds[c] = LETTER if major == "L" else NUMBER
    kinds[WHITE] = SPACE
    return kinds


def prefix_states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each character, by an associative scan in blocks."""
    generators, table, of_start, _ = automaton()
    n, m = len(kinds), len(of_start)
    blocks = -(-n // BLOCK)
    f = np.zeros(blocks * BLOCK, np.int32)  # function 0 is the identity
    f[:n] = generators[kinds]
    f = np.ascontiguousarray(f.reshape(blocks, BLOCK).T)
    for j in range(1, BLOCK):
        f[j] = table[f[j - 1] * m + f[j]]
    total = f[-1].copy()
    shift = 1
    while shift < blocks:  # composition doubles its reach each time
        total[shift:] = table[total[:-shift] * m + total[shift:]]
        shift *= 2
    before = np.zeros(blocks, np.int32)
    before[1:] = total[:-1]
    f = table[before * m + f]
    states = np.empty(n, np.int32)
    states[:1] = START
    states[1:] = of_start[f.T.ravel()[: n - 1]]
    return states


def boundaries(text: str, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``text``, and the positions where slices begin. ``breaks``: separators between documents."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = character_classes()[points].astype(np.int32)
    kinds[breaks] = BREAK
    following = np.append(kinds[1:], BREAK)
    last = (kinds == SPACE) & (following != SPACE) & (following != BREAK)
    apostrophe = np.flatnonzero((points == 0x27) & (kinds == OTHER))
    kinds[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_WHITE)
    if len(apostrophe):
        padded = np.append(points, [0, 0])
        padded[:-2][kinds == BREAK] = 0
        one, two = padded[apostrophe + 1], padded[apostrophe + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(one), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        kinds[apostrophe[short]] = SHORT
        kinds[apostrophe[long]] = LONG
    return points, np.flatnonzero(automaton()[3][prefix_states(kinds), kinds])


class Codec:
    """Encodes and decodes batches of texts by a file of ranks."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers

        path = vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        ranks = self.ranks
        tokens = {rank: token for token, rank in ranks.items()}
        every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.sizes = np.array([len(t) for t in every], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.vocabulary = np.frombuffer(b"".join(every), np.uint8)
        self.pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_values = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), BEYOND) for b in range(256)] for a in range(256)], np.int32)
        self.packed: dict[bytes, bytes] = {}

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short slices at once.

        In each round every slice joins its leftmost pair of the lowest rank, if it has
        one: a row of a matrix holds its ids, another the ranks of its pairs.
        """
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for high in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            if not len(rows):
                continue
            chosen = [pieces[i] for i in rows.tolist()]
            text = np.frombuffer(b"".join(p.ljust(high, b"\0") for p in chosen), np.uint8).reshape(len(rows), high)
            left = size[rows]
            columns = np.arange(high)
            ids = np.where(columns < left[:, None], self.single[text], NONE)
            costs = np.full((len(rows), high), BEYOND, np.int32)
            costs[:, :-1] = np.where(columns[1:] < left[:, None], self.of_bytes[text[:, :-1], text[:, 1:]], BEYOND)
            done = np.full((len(rows), high), NONE, np.int32)
            at = np.arange(len(rows))
            while len(at):
                j = costs.argmin(1)
                every = np.arange(len(at))
                least = costs[every, j]
                if (ended := least == BEYOND).any():
                    done[at[ended]] = ids[ended]
                    going = ~ended
                    at, ids, costs, j, least = at[going], ids[going], costs[going], j[going], least[going]
                    every = every[: len(at)]
                    if not len(at):
                        break
                take = columns + (columns > j[:, None])
                take[take == high] = high - 1
                ids[every, j] = least
                moved = np.take_along_axis(ids, take, 1)
                moved[:, -1] = NONE
                ids = moved
                costs = np.take_along_axis(costs, take, 1)  # column j is made anew below
                costs[:, -1] = BEYOND
                costs[every, j] = self.pair_ranks(least, ids[every, np.minimum(j + 1, high - 1)])
                inner = np.flatnonzero(j > 0)
                costs[inner, j[inner] - 1] = self.pair_ranks(ids[inner, j[inner] - 1], least[inner])
            n = ((done != NONE).sum(1) * 4).tolist()
            raw, wide = done.astype("<u4").tobytes(), high * 4
            for k, (i, m) in enumerate(zip(rows.tolist(), n, strict=True)):
                out[i] = raw[k * wide : k * wide + m]
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two tokens joined, or BEYOND."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right != NONE), self.pair_values[at], BEYOND)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct slices."""
        packed: dict[bytes, bytes] = {}
        hard = []
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                packed[p] = whole.to_bytes(4, "little")
            elif len(p) > WIDTHS[-1]:
                packed[p] = np.array(self.merge_long(p), "<u4").tobytes()
            else:
                hard.append(p)
        packed.update(zip(hard, self.merge_short(hard), strict=True))
        return [packed[p] for p in pieces]

    def merge_long(self, piece: bytes) -> list[int]:
        """Token ids of a slice of any length: the same rule with a heap over a linked list, in n log n."""
        import heapq

        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs

        def rank(a: int, b: int) -> int:
            return pairs.get(a << 32 | b, BEYOND)

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) < BEYOND]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (c := rank(ids[a], ids[b])) < BEYOND:
                    heapq.heappush(heap, (c, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        """For each text its ids (little-endian, 4 bytes each), and the byte offsets in it where slices begin, then that of its end."""
        if not texts:
            return [], []
        joined = "\n".join(texts)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + 1) - 1  # of each text, where its separator stands
        if not joined:
            return [b""], [np.zeros(1, np.int64)]
        points, starts = boundaries(joined, ends[:-1])
        raw = joined.encode()
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        edges = np.append(starts, len(points))
        at_edges = at[edges].tolist()
        pieces = [raw[a:b] for a, b in pairwise(at_edges)]
        if len(self.packed) > SLICES:
            self.packed.clear()
        known = self.packed
        packed = list(map(known.get, pieces))
        missed = [i for i, found in enumerate(packed) if found is None]
        new = list({pieces[i] for i in missed})
        made = dict(zip(new, self.merge_all(new), strict=True))
        known.update((k, v) for k, v in made.items() if len(k) <= SLICE_BYTES)
        for i in missed:
            packed[i] = made[pieces[i]]
        first = np.searchsorted(starts, np.append(0, ends[:-1] + 1)).tolist()
        last = np.searchsorted(starts, ends).tolist()
        begin, end = at[np.append(0, ends[:-1] + 1)], at[ends]
        offsets = [np.append(at[starts[a:b]], z) - s for a, b, s, z in zip(first, last, begin, end, strict=True)]
        return [b"".join(packed[a:b]) for a, b in zip(first, last, strict=True)], offsets

    def decode(self, ids: list[bytes], ends: list[int | None]) -> list[bytes]:
        """The bytes of each text from its ids and the retained offset of its end; ValueError where they don't fit one another.

        The bytes of all texts are gathered from the vocabulary at once. Without an end
        (None) the lengths of the ids' tokens give it.
        """
        every = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        if len(every) and (every.max() >= len(self.sizes) or not self.sizes[every].all()):
            raise ValueError("an id isn't in the vocabulary")
        sizes = self.sizes[every]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        buffer = self.vocabulary[np.repeat(self.begins[every] - after + sizes, sizes) + np.arange(total)].tobytes()
        place = np.append(0, after)[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        out, at = [], 0
        for end, (here, there) in zip(ends, pairwise(place), strict=True):
            size = there - here if end is None else end
            if size != there - here:
                raise ValueError("a text's ids don't end where its offsets say")
            out.append(buffer[at : at + size])
            at += size
        return out


_codecs: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def _mapped(docs: DataFrame, keys: list[str], source: Column, fields: list[tuple[str, str, pa.DataType]], work) -> DataFrame:
    distinct_names(keys, [n for n, _, _ in fields])
    bounded_batches(docs.sparkSession)
    chosen = docs.select(*keys, source.alias("__text"))
    head = [f"`{c}` {t}" for c, t in chosen.dtypes[: len(keys)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = work(b.column(len(keys)).to_pylist())
            made = [pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *made], [*keys, *(n for n, _, _ in fields)])

    return chosen.mapInArrow(run, ", ".join([*head, *(f"{n} {t}" for n, t, _ in fields)]))


def encode(docs: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` plus ``ids`` (ARRAY<BIGINT>) and ``offsets`` (byte offsets of slices, then of the end) of each text.

    A null text counts as empty: no ids, and the offset 0. Whole texts of any length;
    repeated rows give repeated results, an empty table none; columns not in ``keys`` are
    ignored; a key with the name of a result is refused.
    """

    def work(texts: list) -> list:
        ids, offsets = codec(vocabulary).encode([t or "" for t in texts])
        return [[np.frombuffer(i, "<u4").astype("int64") for i in ids], offsets]

    return _mapped(docs, keys, F.col(text), [("ids", "array<bigint>", pa.list_(pa.int64())), ("offsets", "array<bigint>", pa.list_(pa.int64()))], work)


def decode(encoded: DataFrame, keys: list[str], ids: str = "ids", offsets: str | None = "offsets", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` plus ``decoded`` (BINARY), the bytes that the ids stand for, a batch at a time, cut by the retained ``offsets``.

    Null ids give no bytes; null offsets, or ``offsets`` None, leave the cuts to the ids'
    tokens. Ids that aren't in the vocabulary, or don't end where the offsets say, fail
    the job: they come from another text or vocabulary. Repeated rows give repeated
    results, an empty table none; a key named ``decoded`` is refused.
    """
    end = F.lit(None).cast("bigint") if offsets is None else F.get(F.col(offsets), F.size(offsets) - 1).cast("bigint")

    def work(rows: list) -> list:
        some = [r["ids"] is not None for r in rows]
        packed = [np.array(r["ids"] or [], "<u4").tobytes() for r in rows]
        return [codec(vocabulary).decode(packed, [r["end"] if s else 0 for r, s in zip(rows, some, strict=True)])]

    return _mapped(encoded, keys, F.struct(F.col(ids).alias("ids"), end.alias("end")), [("decoded", "binary", pa.binary())], work)


def round_trip(docs: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` plus n_tokens and the digests of the ids and of the bytes they decode to, in one pass.

    Nulls, repeated rows, empty tables and names are as in ``encode``.
    """

    def work(texts: list) -> list:
        c = codec(vocabulary)
        ids, offsets = c.encode([t or "" for t in texts])
        sha = [hashlib.sha256(i).hexdigest() for i in ids]
        decoded = c.decode(ids, [int(o[-1]) for o in offsets])
        return [[len(i) // 4 for i in ids], sha, [hashlib.sha256(d).hexdigest() for d in decoded]]

    return _mapped(docs, keys, F.col(text), [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], work)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of the bytes they decode to."""
    return round_trip(read(spark, sf_dir, "documents"), ["doc_id"])
