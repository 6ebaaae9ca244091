import re
from collections import Counter

import numpy as np
import xxhash

from hyperslice.llm import decontamination, simhash_dedup


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def groups(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_pairs(spark, fps, large):
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(df, large)).collect()}
    found: dict = {}
    for x in fps.view(np.int64).tolist():
        found.setdefault(root.get(x, x), set()).add(x)
    expected: dict = {}
    for x, g in zip(fps.view(np.int64).tolist(), groups(fps), strict=True):
        expected.setdefault(g, set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def ball(n, seed, flips):
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(n):
        x = 0x9E3779B97F4A7C15
        for b in rng.choice(64, rng.integers(0, flips), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    near_pairs(spark, np.unique(np.concatenate([rng.integers(0, 1 << 63, 500).astype(np.uint64), ball(200, 2, 8)])), 4096)


def test_large_buckets_are_dealt_again(spark):
    near_pairs(spark, ball(600, 3, 7), 16)


def test_buckets_over_many_batches():
    import pyarrow as pa

    fps = ball(900, 4, 6)
    keys = np.zeros(len(fps), np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50]), *[pa.array(fps[i : i + 50].view(np.int64))] * 3], ["key", "fp", "p0", "p1"]) for i in range(0, len(fps), 50)]
    gather, simhash_dedup.GATHER = simhash_dedup.GATHER, 100
    try:
        out = list(simhash_dedup._links(iter(batches), 60))
    finally:
        simhash_dedup.GATHER = gather
    again = [r for b in out for r in b.to_pylist() if r["kind"] == simhash_dedup.AGAIN]
    assert len(again) == len(simhash_dedup.FINER) * len(fps) and {r["b"] for r in again} == set(fps.view(np.int64).tolist())


def test_pivot_table(spark):
    from pyspark.sql import functions as F

    fps = np.unique(np.concatenate([np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64), ball(200, 2, 8)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    rows = df.select("fp", *simhash_dedup.pivot_row(F.col("fp"))).collect()
    for r in rows[::50]:
        own = [bin((r.fp ^ p) & (1 << 64) - 1).count("1") for p in simhash_dedup.PIVOTS]
        assert np.array([r.p0, r.p1], "<i8").view(np.int8).tolist() == own
    tally = simhash_dedup.compared(df).filter(f"kind = {simhash_dedup.TALLY}").agg(F.sum("a").alias("pairs"), F.sum("b").alias("kept")).first()
    near = sum(int((np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3).sum()) for i in range(len(fps)))
    assert near <= tally.kept < tally.pairs


def test_hubs_and_hot_fingerprints(spark):
    edges = spark.range(5000).selectExpr("7 AS a", "id + 10 AS b").unionByName(spark.range(5000).selectExpr("id + 10 AS a", "99999 AS b"))
    root = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    assert root == {i: 7 for i in [*range(10, 5010), 99999]}
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 > 0, 'the same text over and over', concat('text ', id, ' of its own ', id * 7)) AS text")
    found = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs).collect()}
    assert len(found) == 3000 and found[2].fp == found[1].fp and {found[i].component for i in range(3000) if i % 3} == {1}
    kept = {r.doc_id for r in simhash_dedup.one_of_each(docs).collect()}
    assert kept == {r.component for r in found.values()}


def test_repeated_and_unlike_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "y"), (None, "p q r", "x"), (None, "p q r", "x"), (2, "", "x"), (2, "other words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same string").withColumnRenamed("same", "__same")
    kept = [tuple(r) for r in simhash_dedup.one_of_each(docs).collect()]
    assert len(kept) == 4 and {r[:2] for r in kept} == {(1, "a b c"), (None, "p q r"), (2, ""), (2, "other words here")}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    root = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    assert root == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert simhash_dedup.components(edges.filter("false")).count() == 0


def test_near_duplicates_of_awkward_rows(spark, awkward, nothing):
    found = simhash_dedup.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert all(r.fp == fingerprint(texts[r.doc_id]) for r in found)
    empty = [r for r in found if r.fp == 0]
    assert {r.component for r in empty} == {0} and len(empty) == 4
    assert {r.component for r in found if r.doc_id in (5, 6)} == {5}
    kept = simhash_dedup.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component for r in found if r.component is not None})
    assert simhash_dedup.near_duplicates(nothing).count() == 0 and simhash_dedup.one_of_each(nothing).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items, window=10):
    w, places, which = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        for j in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[j : j + n]:
                    places |= set(range(p, p + n))
                    which.add(str(i))
    return len(w), len(places), sorted(which)


def test_phrases_equal_brute_force(spark, awkward, nothing, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    found = decontamination.phrase_matches(awkward, benchmark).collect()
    expected = sorted(str(hits(r.text, items)) for r in awkward.collect())
    assert sorted(str((r.n_words, r.n_hit, r["items"])) for r in found) == expected
    assert any(r.n_hit == 10 for r in found) and any(r["items"] == ["4", "5"] for r in found)
    assert decontamination.phrase_matches(nothing, benchmark).count() == 0
    none = decontamination.phrase_matches(awkward, benchmark.filter("false")).collect()
    assert len(none) == awkward.count() and all(r.n_hit == 0 and r["items"] == [] for r in none)
    kept = decontamination.clean(awkward, benchmark)
    assert kept.columns == awkward.columns and kept.count() == sum(not hits(r.text, items)[1] for r in awkward.collect())


def test_shuffled_joins_give_the_same(spark, awkward, benchmark):
    rows, decontamination.BROADCAST_ROWS = decontamination.BROADCAST_ROWS, -1
    try:
        found = decontamination.phrase_matches(awkward, benchmark).collect()
    finally:
        decontamination.BROADCAST_ROWS = rows
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert sorted(str((r.n_words, r.n_hit, r["items"])) for r in found) == sorted(str(hits(r.text, items)) for r in awkward.collect())


def test_random_windows(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["a", "b", "c", "É", "é", "d1"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 14)))) for i in range(6)] + [(9, " ".join(docs[3][1].split()[:25]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 10):
        found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.phrase_matches(df, bench, window=window).collect()}
        assert found == {i: hits(t, items, window) for i, t in docs}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "gamma " + "x " * 50 + "alpha beta"), (3, "beta gamma alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    found = {(r.doc_id, r.first_pos, r.last_pos) for r in decontamination.proximity_matches(docs, bench, span=6).collect()}
    assert found == {(1, 0, 5), (3, 0, 2)}


def near_items(docs, items, terms=3, span=30):
    """doc -> how many items have their rarest distinct terms within ``span`` words of it."""
    corpus = [(i, words(t)) for i, t in docs]
    n = Counter(w for _, ws in corpus for w in ws)
    out = dict.fromkeys([i for i, _ in docs], 0)
    for _, t in items:
        rare = sorted(set(words(t)), key=lambda w: (n[w], w))[:terms]
        if rare and all(n[w] for w in rare):
            for i, ws in corpus:
                out[i] += any(ws[p] in rare and set(rare) <= set(ws[p : p + span]) for p in range(len(ws)))
    return out


def test_near_items_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 120)))) for i in range(50)]
    items = [(i, " ".join(rng.choice([*vocabulary, "absent"], rng.integers(1, 14)))) for i in range(30)] + [(98, ""), (99, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = near_items(docs, items)
    for most in (200_000, -1):
        rows, decontamination.BROADCAST_ROWS = decontamination.BROADCAST_ROWS, most
        try:
            found = {r.doc_id: (r.n_near, r.n_hit) for r in decontamination.phrase_matches(df, bench, near=True).collect()}
        finally:
            decontamination.BROADCAST_ROWS = rows
        assert found == {i: (expected[i], hits(t, items)[1]) for i, t in docs} and len(set(expected.values())) > 2


def test_long_items_and_copies(spark):
    """An item of many windows against copies of a text that holds most of them, with both kinds of joins."""
    rng = np.random.default_rng(6)
    item = " ".join(f"w{i}" for i in rng.integers(0, 400, 3000))
    text = " ".join(item.split()[100:2900])
    docs = [(i, text if i % 3 else f"own w{i} words") for i in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (200_000, -1):
        rows, decontamination.BROADCAST_ROWS = decontamination.BROADCAST_ROWS, most
        try:
            found = {r.doc_id: r.n_hit for r in decontamination.phrase_matches(df, bench).collect()}
            kept = {r.doc_id for r in decontamination.clean(df, bench).collect()}
        finally:
            decontamination.BROADCAST_ROWS = rows
        assert found == {i: 2800 if i % 3 else 0 for i, _ in docs} and kept == {i for i, _ in docs if i % 3 == 0}


def test_rows_with_no_key_or_one_key_are_not_mixed(spark):
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")

    def prose():
        return " ".join("".join(rng.choice(letters, 6)) for _ in range(60))

    unlike = [prose() for _ in range(6)]
    leak = prose()
    kept = [(None, unlike[0]), (None, unlike[1]), (None, unlike[2]), (7, unlike[3]), (7, unlike[4]), (8, unlike[5])]
    rows = [*kept, (None, unlike[0]), (None, unlike[5]), (9, unlike[5]), (7, unlike[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, simhash_dedup.one_of_each(docs).collect())) == sorted(map(str, spark.createDataFrame(kept, docs.schema).collect()))

    bench = spark.createDataFrame([(1, " ".join(leak.split()[20:40]))], "item_id long, text string")
    leaks = spark.createDataFrame([(None, leak), (7, leak), (None, None)], docs.schema)
    clean = decontamination.clean(docs.unionByName(leaks), bench).collect()
    assert sorted(map(str, clean)) == sorted(map(str, [*docs.collect(), *leaks.filter("text is null").collect()]))
