"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its row of the pivot table once: the Hamming distances
to ``PIVOTS``, the reference fingerprints, one byte each, in native expressions. By the
triangle inequality a pair whose rows differ by more than 3 in any coordinate cannot
link, and is discarded; survivors are verified.

Comparing all rows of the table would take all pairs, so fingerprints are first dealt to
buckets in which a pair at a distance of up to 3 must meet: the 64 bits fall into 5
blocks, 3 differing bits spoil at most 3 blocks, so two blocks are equal for one of the
10 choices of two. (Cells of pivot distances would need too many copies: a distance
varies by some 4 around 32, so a cell that a pair must share keeps nearly half of all
pairs and takes nearly two copies.) A bucket returns a spanning forest of its links and
how many pairs the table discarded, never all pairs.

A bucket of over ``LARGE`` members is passed on instead: its three other blocks fall
into 9 smaller ones of which 6 must be equal, so it is dealt again by 84 finer keys,
whose buckets differ in at most 15 bits. Nothing is capped or sampled. Components
of the links come from alternating star contractions over DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import bounded_batches, fresh, join_hot, read, stored

SEED = 42
SHINGLE = 3
RADIUS = 3
#: (first bit, bits) of the blocks, and in each block those of its smaller ones.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
SMALLER = [[(at, n // 3), (at + n // 3, n // 3), (at + 2 * (n // 3), n - 2 * (n // 3))] for at, n in BLOCKS]
CHOICES = list(combinations(range(5), 2))
FINER = list(combinations(range(9), 6))
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}", seed=SEED) for i in range(16)]
#: Rows that a bucket's task returns: a link (a, b); a (finer key, member) to be dealt again; a count of (pairs, pairs that the table left).
LINK, AGAIN, TALLY = 0, 1, 2
#: Members of a bucket that are compared at once (dealing one again costs 84 rows, about as much as so many comparisons); rows that a task gathers before it compares.
LARGE = 4096
GATHER = 1 << 15

#: Rows of 16 bytes up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit number: words lower-cased in A-Z, shingles of three words, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _bits(fp: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def bucket_keys(fp: Column) -> Column:
    """The 10 keys of a fingerprint: the number of the choice, then the bits of its two blocks."""
    keys = []
    for i, choice in enumerate(CHOICES):
        key = F.lit(i).cast("bigint")
        for b in choice:
            at, n = BLOCKS[b]
            key = F.shiftleft(key, 13).bitwiseOR(_bits(fp, at, n))
        keys.append(key)
    return F.array(*keys)


def finer_keys(key: int, fps: np.ndarray) -> np.ndarray:
    """The 84 keys of each member of a large bucket; a row for each member."""
    free = [s for b in range(5) if b not in CHOICES[key >> 26] for s in SMALLER[b]]
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in free]
    out = np.empty((len(fps), len(FINER)), np.int64)
    for c, chosen in enumerate(FINER):
        made = np.full(len(fps), (key << 7) + c, np.int64)
        for s in chosen:
            made = (made << free[s][1]) | parts[s].astype(np.int64)
        out[:, c] = made
    return out


def pivot_row(fp: Column) -> list[Column]:
    """The fingerprint's distances to the pivots, a byte each, in two numbers ``p0`` and ``p1``."""
    rows = []
    for first in (0, 8):
        packed = F.lit(0).cast("bigint")
        for i, pivot in enumerate(PIVOTS[first : first + 8]):
            signed = pivot - (1 << 64) if pivot >> 63 else pivot
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed).cast("bigint"))).cast("bigint"), 8 * i))
        rows.append(packed.alias(f"p{first // 8}"))
    return rows


def forest(keys: np.ndarray, fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Links of a spanning forest of each bucket, the pairs met, and those that the table left; ``keys`` is sorted, members of a bucket stand together."""
    table = table.astype("<i8").view(np.int8).reshape(len(keys), len(PIVOTS))
    n = len(keys)
    pairs = kept = 0
    root = np.arange(n)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0

    def contract() -> None:
        nonlocal held
        if not held:
            return
        i, j = np.concatenate(left), np.concatenate(right)
        while True:
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if not (low != high).any():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root[:] = root[root]
        left.clear()
        right.clear()
        held = 0

    at = np.arange(n)
    shift = 1
    while len(at := at[at + shift < n]) and len(at := at[keys[at] == keys[at + shift]]):
        near = at[np.abs(table[at] - table[at + shift]).max(1) <= RADIUS]
        pairs += len(at)
        kept += len(near)
        near = near[np.bitwise_count(fps[near] ^ fps[near + shift]) <= RADIUS]
        left.append(near)
        right.append(near + shift)
        held += len(near)
        if held > 1 << 20:
            contract()
        shift += 1
    contract()
    linked = np.flatnonzero(root != np.arange(n))
    return fps[root[linked]], fps[linked], pairs, kept


SCHEMA = "kind int, a bigint, b bigint, p0 bigint, p1 bigint"


def _links(batches: Iterator[pa.RecordBatch], large: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of the three kinds, from rows (key, fp, p0, p1) sorted by key; with ``large`` None no bucket is dealt again."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray, table: np.ndarray | None = None) -> pa.RecordBatch:
        table = np.zeros((len(a), 2), np.int64) if table is None else table
        made = [np.full(len(a), kind, np.int32), a.astype(np.int64), b.astype(np.int64), table[:, 0], table[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["kind", "a", "b", "p0", "p1"])

    def passed(key: int, fps: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(fps), 512):
            part = fps[at : at + 512]
            yield rows(AGAIN, finer_keys(key, part).ravel(), np.repeat(part, len(FINER)), np.repeat(table[at : at + 512], len(FINER), 0))

    def whole(keys: np.ndarray, fps: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        if large is not None:
            for at, size in zip(starts[sizes > large].tolist(), sizes[sizes > large].tolist(), strict=True):
                yield from passed(int(keys[at]), fps[at : at + size], table[at : at + size])
        some = np.repeat((sizes > 1) & ((large is None) | (sizes <= (large or 0))), sizes)
        if some.any():
            a, b, pairs, kept = forest(keys[some], fps[some], table[some])
            yield rows(LINK, a, b)
            yield rows(TALLY, np.array([pairs]), np.array([kept]))

    parts, held, passing = [], 0, None
    for batch in batches:
        keys, fps, *table = (batch.column(i).to_numpy() for i in range(4))
        fps, table = fps.view(np.uint64), np.stack(table, 1)
        if passing is not None:  # the rest of a bucket whose first members have been passed on
            same = int(np.searchsorted(keys, passing, "right"))
            yield from passed(passing, fps[:same], table[:same])
            keys, fps, table = keys[same:], fps[same:], table[same:]
            if not len(keys):
                continue
            passing = None
        parts.append((keys, fps, table))
        held += len(keys)
        if held < GATHER:
            continue
        keys, fps, table = map(np.concatenate, zip(*parts, strict=True))
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from whole(keys[:last], fps[:last], table[:last])
        keys, fps, table = keys[last:], fps[last:], table[last:]
        if large is not None and len(keys) > large:
            passing = int(keys[0])
            yield from passed(passing, fps, table)
            keys, fps, table = keys[:0], fps[:0], table[:0]
        parts, held = [(keys, fps, table)], len(keys)
    if held:
        yield from whole(*map(np.concatenate, zip(*parts, strict=True)))


def compared(fingerprints: DataFrame, large: int = LARGE) -> DataFrame:
    """Rows (kind, a, b): links between the distinct fingerprints of column ``fp``, and tallies of pairs met and of pairs that the pivot table left."""
    table = fingerprints.select("fp", *pivot_row(F.col("fp")))
    dealt = table.select(F.explode(bucket_keys(F.col("fp"))).alias("key"), "fp", "p0", "p1").repartition("key").sortWithinPartitions("key")
    first = stored(dealt.mapInArrow(lambda b: _links(b, large), SCHEMA), "links")
    again = first.filter(F.col("kind") == AGAIN).select(F.col("a").alias("key"), F.col("b").alias("fp"), "p0", "p1").repartition("key").sortWithinPartitions("key")
    second = again.mapInArrow(lambda b: _links(b, None), SCHEMA)
    return first.filter(F.col("kind") != AGAIN).unionByName(second).select("kind", "a", "b")


def links(fingerprints: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (a, b) between fingerprints at a distance of up to 3; each component of links is spanned, not every pair listed.

    ``fingerprints`` has a column ``fp`` of distinct signed 64-bit numbers; without rows
    there are no links.
    """
    return compared(fingerprints, large).filter(F.col("kind") == LINK).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that isn't its component's least node, by alternating star contractions.

    Nodes of very many edges are joined apart from the others, so hubs are no hot keys.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = stored(join_hot(both.filter("v > u"), least, "u", 2 * found[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(large, least, "u", found[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")


def _identity(docs: DataFrame) -> Column:
    """128 bits of a row's whole content: equal for repeated rows only."""
    every = [v for c in docs.columns for v in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.struct(F.xxhash64(*every).alias("x"), F.xxhash64(F.lit(1), *every).alias("y"))


def _rooted(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of stored ``rows`` (key, fp, ...): (fp, n, least, root) of every fingerprint, its rows, its least key and its component's least fingerprint; and the number of rows."""
    distinct = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("key").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    of = stored(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "roots")
    return of, distinct.agg(F.sum("n")).first()[0] or 0


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component) of every row: the fingerprint, and the least key that links of up to 3 differing bits reach.

    A null or empty text has no words: fingerprint 0, linked like any other. Null keys
    never are the least; a component of null keys alone has a null component. Whole texts
    of any length. Repeated rows are linked like copies. An empty table gives an empty
    result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    marked = stored(docs.select(F.col(key).alias("key"), fingerprint_of(F.col(text)).alias("fp")), "fingerprints")
    of, total = _rooted(marked)
    least = of.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("k"))
    least = stored(least.withColumnRenamed("k", "n"), "least")
    distinct = of.agg(F.count("*")).first()[0]
    named = stored(join_hot(of.select("fp", "root", F.col("n").alias("rows")), least, "root", distinct).select("fp", "component", F.col("rows").alias("n")), "named")
    return join_hot(marked, named, "fp", total).select(F.col("key").alias(key), "fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one left of each component: that of the least key (of unlike rows with this key that of the least hash).

    A row whose key is null is left only where no other key is in its component. Unlike
    texts stay, each for itself, whether their keys are null or the same; of rows that
    are equal in every column one is left. Nulls, empty and long texts are as in
    ``near_duplicates``; all columns stay. Texts are read twice and fingerprinted once;
    what is shuffled besides the rows kept are hashes.
    """
    bounded_batches(docs.sparkSession)
    same = fresh(docs, "same")
    marked = stored(docs.select(F.col(key).alias("key"), fingerprint_of(F.col(text)).alias("fp"), _identity(docs).alias("same")), "fingerprints")
    of, total = _rooted(marked)
    # of each fingerprint, then of each component, the first row
    first = F.struct(F.col("key").isNull().alias("none"), "key", F.col("same.x").alias("x"), F.col("same.y").alias("y"))
    firsts = marked.groupBy("fp").agg(F.min(first).alias("one"))
    chosen = firsts.join(of.select("fp", "root"), "fp").groupBy("root").agg(F.min("one").alias("one")).select(F.struct("one.x", "one.y").alias("same"))
    times = marked.groupBy("same").agg(F.count("*").alias("n"))
    chosen = stored(chosen.join(times, "same").withColumnRenamed("same", same), "chosen")
    every = docs.withColumn(same, _identity(docs))
    once = every.join(chosen.filter("n = 1").select(same), same, "left_semi").drop(same)
    repeats = chosen.filter("n > 1")
    n = repeats.count()
    if not n:
        return once
    # rows that are equal in every column meet within tasks before they are shuffled
    repeated = every.join(F.broadcast(repeats.select(same)), same) if n <= BROADCAST_ROWS else join_hot(every, repeats, same, total)
    repeated = repeated.groupBy(same).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return once.unionByName(repeated)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, as ``near_duplicates`` says."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
