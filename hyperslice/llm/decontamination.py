"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

1. Corpus counts of every test term rank the terms of each test window; a window with
   a term that the corpus lacks cannot occur.
2. The index: postings (term, text, sorted positions) of the terms that are among the
   rarest of some window or item are stored once, by term. A text is known by 128 bits
   of its content, so copies share their postings and results.
3. Phrases: positions adjusted by the term's place in the item are alignments of a text
   with an item; the lists of a window's rarest terms are intersected. The words of the
   windows that remain are compared, which gives exact phrases.
4. Proximity: from the same postings, all of an item's rarest terms within a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT, fresh, join_hot, read, stored

WINDOW = 10
#: Rarest terms of a window whose lists are intersected.
RARE = 2
#: Rarest distinct terms of an item that proximity matches ask for, and words in which they must stand.
NEAR_TERMS, NEAR_SPAN = 3, 30
#: Rows (of under 200 bytes) up to which a table may be broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z only; a null text has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), SEPARATORS), "")


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast where its counted rows allow it, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def test_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(k, ids, words): each distinct word sequence of the test items and the ids that have it; items without words are left out."""
    words = benchmark.select(F.col(item).cast("string").alias("id"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    grouped = words.groupBy("words").agg(F.collect_set("id").alias("ids"))
    return stored(grouped.select(F.monotonically_increasing_id().alias("k"), "ids", "words"), "items")


def text_id(text: Column) -> Column:
    """128 bits of a text's content; a null text is an empty one, as both have no words."""
    known = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(known).alias("x"), F.xxhash64(F.lit(1), known).alias("y"))


def corpus_counts(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): occurrences in the corpus of each term of the test items that occurs at all.

    Tokens meet the terms before they are counted where the terms can be broadcast, else
    after: a frequent word is never a hot key.
    """
    terms = stored(items.select(F.explode("words").alias("term")).distinct(), "terms")
    tokens = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        return stored(tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n")), "counts")
    return stored(tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term"), "counts")


def rare_terms(items: DataFrame, counts: DataFrame, window: int = WINDOW, rare: int = RARE) -> DataFrame:
    """(k, j, words, places): each window (at j of item k) whose terms all occur, and the places in the item of its rarest terms."""
    size = F.least(F.size("words"), F.lit(window))
    windows = items.select("k", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("j"))
    windows = windows.select("k", "j", F.slice("words", F.col("j") + 1, F.col("size")).alias("words"))
    first = windows.select("k", "j", "words", F.posexplode("words").alias("o", "term")).groupBy("k", "j", "words", "term").agg(F.min("o").alias("o"), F.count("*").alias("times"))
    found = first.join(sized(counts), "term").groupBy("k", "j", "words").agg(F.sum("times").alias("known"), F.array_sort(F.collect_list(F.struct("n", "term", "o"))).alias("ranked"))
    places = F.array_sort(F.transform(F.slice("ranked", 1, rare), lambda r: (F.col("j") + r["o"]).cast("int")))
    return stored(found.filter(F.col("known") == F.size("words")).select("k", "j", "words", places.alias("places")), "windows")


def rare_of_items(items: DataFrame, counts: DataFrame, terms: int = NEAR_TERMS) -> DataFrame:
    """(k, term, of): the rarest distinct terms of each item (ties by term), where all of them occur in the corpus."""
    own = items.select("k", F.explode(F.array_distinct("words")).alias("term")).join(sized(counts), "term", "left")
    ranked = own.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, terms).alias("r"))
    ranked = ranked.filter(F.forall("r", lambda r: r["n"] > 0))
    return stored(ranked.select("k", F.explode(F.col("r")["term"]).alias("term"), F.size("r").alias("of")), "rarest")


def postings(docs: DataFrame, terms: DataFrame, counts: DataFrame, text: str = "text") -> DataFrame:
    """The stored index (term, t, positions) of ``terms`` (distinct, a column ``term``): t is the text's identity, positions are sorted.

    Copies of a text have one row, made within tasks before the shuffle. Terms beyond
    ``BROADCAST_ROWS`` meet the tokens in a shuffle, very frequent ones apart.
    """
    tokens = docs.select(text_id(F.col(text)).alias("t"), F.posexplode(words_of(F.col(text))).alias("pos", "term"))
    if terms.count() <= BROADCAST_ROWS:
        found = tokens.join(F.broadcast(terms), "term")
    else:
        found = join_hot(tokens, stored(terms.join(counts, "term"), "counted"), "term", counts.agg(F.sum("n")).first()[0])
    return stored(found.groupBy("term", "t").agg(F.array_sort(F.collect_set("pos")).alias("positions")), "postings")


def aligned_windows(index: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """(t, k, j, start): windows of items that may stand at word ``start`` of a text, since their rarest terms do."""
    needs = stored(windows.select("k", "j", F.size("places").alias("of"), F.explode("places").alias("p")), "needs")
    places = needs.groupBy("k", "p").agg(F.min("of").alias("least"))
    places = places.withColumn("least", F.min("least").over(Window.partitionBy("k")))
    terms = stored(places.join(items.select("k", "words"), "k").select(F.element_at("words", F.col("p") + 1).alias("term"), "k", "p", "least"), "places")
    found = index.join(sized(terms), "term").select("t", "k", "p", "least", F.explode("positions").alias("pos"))
    listed = found.groupBy("t", "k", "least", (F.col("pos") - F.col("p")).alias("delta")).agg(F.collect_set("p").alias("there"))
    listed = listed.filter(F.size("there") >= F.col("least")).select("t", "k", "delta", F.explode("there").alias("p"))
    agreed = listed.join(sized(needs), ["k", "p"]).groupBy("t", "k", "j", "delta").agg(F.count("*").alias("n"), F.first("of").alias("of"))
    return agreed.filter("n = of AND delta + j >= 0").select("t", "k", "j", (F.col("delta") + F.col("j")).alias("start"))


def phrases(docs: DataFrame, items: DataFrame, windows: DataFrame, near: DataFrame, text: str = "text") -> DataFrame:
    """(t, n_hit, items): texts with an occurring window: their words inside one, and the ids of the items, sorted. ``near`` is compared word by word."""
    near = stored(near, "near")
    wanted = near.groupBy("t").agg(F.collect_list(F.struct("k", "j", "start")).alias("near"))
    texts = docs.select(text_id(F.col(text)).alias("t"), F.col(text).alias("text"))
    if near.count() <= BROADCAST_ROWS:  # windows, not texts: a text can have very many
        texts = texts.join(F.broadcast(wanted), "t")
    else:
        counts = texts.groupBy("t").agg(F.count("*").alias("n"))
        texts = join_hot(texts, stored(wanted.join(counts, "t"), "wanted"), "t", docs.count())
    size = windows.agg(F.max(F.size("words"))).first()[0] or 0
    cut = texts.select("t", "near", words_of(F.col("text")).alias("words")).select("t", F.explode(F.transform("near", lambda n: F.struct(n["k"].alias("k"), n["j"].alias("j"), n["start"].alias("start"), F.slice("words", n["start"] + 1, F.lit(size)).alias("there")))).alias("n"))
    cut = cut.select("t", "n.*").distinct()  # copies have the same
    equal = cut.join(sized(windows.select("k", "j", "words")), ["k", "j"]).filter(F.slice("there", F.lit(1), F.size("words")) == F.col("words"))
    spans = equal.groupBy("t").agg(F.collect_set(F.struct("start", F.size("words").alias("n"))).alias("spans"), F.collect_set("k").alias("ks"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    hit = spans.select("t", F.size(places).cast("bigint").alias("n_hit"), F.explode("ks").alias("k")).join(sized(items.select("k", "ids")), "k")
    return stored(hit.groupBy("t", "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items")), "phrases")


def near_terms(index: DataFrame, rarest: DataFrame, span: int = NEAR_SPAN) -> DataFrame:
    """(t, k, first_pos, last_pos): each place where all of an item's rarest terms stand within ``span`` words, in any order."""
    found = index.join(sized(rarest), "term")
    full = found.groupBy("t", "k").agg(F.count("*").alias("terms"), F.first("of").alias("of")).filter("terms = of").select("t", "k")
    each = found.join(full, ["t", "k"]).select("t", "k", "of", "term", F.explode("positions").alias("pos"))
    ahead = Window.partitionBy("t", "k").orderBy("pos").rangeBetween(0, span - 1)
    seen = each.withColumn("seen", F.collect_list(F.struct("term", "pos")).over(ahead))
    firsts = F.transform(F.array_distinct(F.transform("seen", lambda s: s["term"])), lambda t: F.array_min(F.transform(F.filter("seen", lambda s: s["term"] == t), lambda s: s["pos"])))
    seen = seen.withColumn("firsts", firsts).filter(F.size("firsts") == F.col("of"))
    return seen.select("t", "k", F.col("pos").alias("first_pos"), F.array_max("firsts").alias("last_pos"))


class Index:
    """The stored parts for a corpus and a benchmark: items, counts, windows, rarest terms, postings."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, terms: int = 0, text: str = "text", item: str = "item_id", item_text: str = "text") -> None:
        self.docs, self.text = docs, text
        self.items = test_items(benchmark, item, item_text)
        self.counts = corpus_counts(docs, self.items, text)
        self.windows = rare_terms(self.items, self.counts, window) if window else None
        self.rarest = rare_of_items(self.items, self.counts, terms) if terms else None
        asked = []
        if window:
            asked.append(self.windows.select(F.explode(F.transform("places", lambda p: F.get("words", p - F.col("j")))).alias("term")))
        if terms:
            asked.append(self.rarest.select("term"))
        every = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
        self.postings = postings(docs, stored(every.distinct(), "asked"), self.counts, text)

    def phrases(self) -> DataFrame:
        return phrases(self.docs, self.items, self.windows, aligned_windows(self.postings, self.items, self.windows), self.text)

    def near(self, span: int) -> DataFrame:
        return near_terms(self.postings, self.rarest, span)


def _with_results(docs: DataFrame, results: DataFrame, key: str, text: str, lists: str) -> DataFrame:
    """(key, n_words) of every row of ``docs``, and what ``results`` (stored, a row for a text) has for its text. The elements of ``lists`` count as rows for a broadcast."""
    rows = docs.select(F.col(key).alias("key"), text_id(F.col(text)).alias("t"), F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
    if (results.agg(F.sum(1 + F.size(F.coalesce(lists, F.array())))).first()[0] or 0) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(results), "t", "left").drop("t")
    rows = stored(rows, "rows")
    counted = stored(results.join(rows.groupBy("t").agg(F.count("*").alias("n")), "t"), "results")
    return join_hot(rows, counted, "t", rows.count(), "left").drop("t")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, item: str = "item_id", item_text: str = "text", near: bool = False) -> DataFrame:
    """(key, n_words, n_hit, items) of every row of ``docs``, with ``near`` also n_near.

    n_hit counts the words inside any occurrence of a test window, items lists (sorted
    as strings) the ids of the items with an occurring window. A window is ``window``
    consecutive words of an item, or a shorter item as a whole. n_near counts the items
    with a proximity match (``NEAR_TERMS`` within ``NEAR_SPAN``). Null and empty texts
    have no words and no hits, on either side; texts of any length; repeated rows give
    repeated results; null keys are matched like any other; an empty benchmark hits
    nothing; other columns are ignored.
    """
    index = Index(docs, benchmark, window, NEAR_TERMS if near else 0, text, item, item_text)
    results = index.phrases()
    if near:
        met = index.near(NEAR_SPAN).select("t", "k").distinct().join(sized(index.items.select("k", F.size("ids").alias("n"))), "k").groupBy("t").agg(F.sum("n").alias("n_near"))
        results = stored(results.join(met, "t", "full"), "results")
    found = _with_results(docs, results, key, text, "items")
    none = F.array().cast("array<string>")
    columns = [F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items")]
    return found.select(*columns, *([F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")] if near else []))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = NEAR_TERMS, span: int = NEAR_SPAN, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, first_pos, last_pos): places where all of an item's ``terms`` rarest distinct terms stand within ``span`` words, in any order.

    Each match begins at an occurrence of one of the terms and ends at the least
    position by which all have occurred. An item with a term that the corpus lacks
    among its rarest has no match; null texts and keys are as in ``phrase_matches``.
    """
    index = Index(docs, benchmark, 0, terms, text, item, item_text)
    met = index.near(span).join(sized(index.items.select("k", "ids")), "k")
    places = stored(met.groupBy("t").agg(F.collect_list(F.struct("ids", "first_pos", "last_pos")).alias("met")), "met")
    found = _with_results(docs, places, key, text, "met").select(F.col("key").alias(key), F.explode("met").alias("m"))
    return found.select(key, F.explode("m.ids").alias("item"), "m.first_pos", "m.last_pos")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose text holds no test window.

    Rows go by their text: every copy of a contaminated text goes, whatever its key; null
    and empty texts stay. An empty benchmark or table takes nothing.
    """
    t = fresh(docs, "t")
    every = docs.withColumn(t, text_id(F.col(text)))
    hit = Index(docs, benchmark, WINDOW, 0, text).phrases().select(F.col("t").alias(t))
    if hit.count() <= BROADCAST_ROWS:
        return every.join(F.broadcast(hit), t, "left_anti").drop(t)
    counts = stored(every.groupBy(t).agg(F.count("*").alias("n")), "texts")
    hot = stored(counts.filter(F.col("n") * HOT > counts.agg(F.sum("n")).first()[0]).select(t), "hot")  # at most HOT texts
    copies = every.join(F.broadcast(hot), t, "left_semi").join(F.broadcast(hit.join(F.broadcast(hot), t, "left_semi")), t, "left_anti")
    return copies.unionByName(every.join(F.broadcast(hot), t, "left_anti").join(hit, t, "left_anti")).drop(t)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase and proximity matches of the benchmark in every document, as ``phrase_matches`` says."""
    found = phrase_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), near=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bj AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS j FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS win FROM bj),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dp),
hits AS (SELECT doc_id, item_id, p, n FROM dw JOIN bw USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
seen AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
own AS (SELECT item_id, term, coalesce(n, 0) AS n FROM (SELECT DISTINCT item_id, unnest(w) AS term FROM b) LEFT JOIN seen USING (term)),
rare AS (SELECT item_id, term, n FROM own QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n, term) <= {NEAR_TERMS}),
need AS (SELECT item_id, count(*) AS k FROM rare GROUP BY item_id HAVING min(n) > 0),
occ AS (SELECT doc_id, item_id, k, term, pos FROM tok JOIN rare USING (term) JOIN need USING (item_id)),
full_ AS (SELECT doc_id, item_id FROM occ GROUP BY doc_id, item_id, k HAVING count(DISTINCT term) = k),
met AS (
  SELECT DISTINCT doc_id, item_id FROM (
    SELECT a.doc_id, a.item_id, a.pos, a.k FROM occ a JOIN full_ USING (doc_id, item_id)
      JOIN occ z ON z.doc_id = a.doc_id AND z.item_id = a.item_id AND z.pos BETWEEN a.pos AND a.pos + {NEAR_SPAN} - 1
    GROUP BY a.doc_id, a.item_id, a.pos, a.k HAVING count(DISTINCT z.term) = a.k)),
near AS (SELECT doc_id, count(*) AS n_near FROM met GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""
