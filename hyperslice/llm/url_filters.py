"""URL filters by Bloom filter cascades.

The lists' keys and the complete universe of keys that the corpus can ask for are known
before filtering. The first Bloom filter of a cascade holds the listed keys; the next
holds the keys of the universe that pass it wrongly; the next the listed keys that
pass that one; and so on until none is left. On the universe the answer is exact, and
a row is judged without a join: its candidate keys are tried against the cascades.

Each level is built for all lists at once. Keys fall to shards by hash, so many that a
shard's cascades take about ``SHARD_BITS``: rows pass shard after shard, and lists of
any length are filtered in the same way with bounded broadcasts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, stored

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Marks of tracking in a url. A host is listed where two fifths of its pages, or more, have one.
TRACKING = "[?&](utm_[a-z]+|ref)="
#: Bits of a shard's cascades (8 MB), which are broadcast.
SHARD_BITS = 1 << 26


def digest(key: str, level: int) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(key, seed=level)
    return both & 0xFFFFFFFFFFFFFFFF, both >> 64 | 1


def shard(key: str, shards: int) -> int:
    """The shard of a key, by another hash than the levels have."""
    return xxhash.xxh3_64_intdigest(key, seed=1 << 32) % shards if shards > 1 else 0


@dataclass
class Cascade:
    """Bloom filters of alternate levels: (words of 64 bits, bits, hash functions) of each."""

    levels: list[tuple[np.ndarray, int, int]] = field(default_factory=list)

    def passes(self, key: str, level: int) -> bool:
        words, bits, hashes = self.levels[level]
        a, b = digest(key, level)
        for i in range(hashes):
            at = (a + i * b) % bits
            if not int(words[at >> 6]) >> (at & 63) & 1:
                return False
        return True

    def __contains__(self, key: str) -> bool:
        """Whether the list holds ``key``; exact for keys of the universe."""
        level = 0
        while level < len(self.levels) and self.passes(key, level):
            level += 1
        return level % 2 == 1


def dimensions(n: int, others: int, level: int) -> tuple[int, int]:
    """Bits and hash functions of a level that holds ``n`` keys, tested by ``others``."""
    p = 0.5 if level else min(0.5, math.sqrt(0.5) * n / max(1, others))
    return max(64, math.ceil(n * math.log2(1 / p) / math.log(2))), max(1, round(math.log2(1 / p)))


def shards_needed(universe: DataFrame, shard_bits: int = SHARD_BITS) -> int:
    """Shards for the rows (list, key, listed) of ``universe``: the first levels' bits, and five a key for the later ones, over ``shard_bits``."""
    counts = universe.groupBy("list").agg(F.count_if("listed").alias("n"), F.count_if(~F.col("listed")).alias("others")).collect()
    return max(1, math.ceil(sum(dimensions(r.n, r.others, 0)[0] + 5 * r.n for r in counts if r.n) / shard_bits))


def build(universe: DataFrame) -> dict[str, Cascade]:
    """The cascade of each list: of the rows (list, key, listed) of ``universe`` those that are ``listed``. A list without keys has none.

    Keys are distinct within a list. Every level is built on the executors for all lists:
    tasks set bits, which are combined by word.
    """
    cascades: dict[str, Cascade] = {}
    inside, outside = (universe.filter(c).select("list", "key") for c in (F.col("listed"), ~F.col("listed")))
    counted = universe.groupBy("list").agg(F.count_if("listed").alias("n"), F.count_if(~F.col("listed")).alias("others")).collect()
    left = {r["list"]: (r.n, r.others) for r in counted if r.n}
    level = 0
    while left:
        sizes, at = {}, 0
        for name, (n, others) in sorted(left.items()):
            bits, hashes = dimensions(n, others, level)
            sizes[name] = bits, hashes, at
            at += -(-bits // 64)

        def fill(batches: Iterator[pa.RecordBatch], level: int = level, sizes: dict = sizes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words: dict[int, int] = {}
                for name, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    bits, hashes, first = sizes[name]
                    x, y = digest(k, level)
                    for i in range(hashes):
                        place = (x + i * y) % bits
                        word = first + (place >> 6)
                        words[word] = words.get(word, 0) | 1 << (place & 63)
                values = np.fromiter(words.values(), np.uint64, len(words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(values)], ["word", "value"])

        names = list(sizes)
        found = inside.filter(F.col("list").isin(names)).mapInArrow(fill, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
        every = np.zeros(at, np.uint64)
        every[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
        for name, (bits, hashes, first) in sizes.items():
            cascades.setdefault(name, Cascade()).levels.append((every[first : first - (-bits // 64)], bits, hashes))
        shared = universe.sparkSession.sparkContext.broadcast(cascades)

        def wrong(batches: Iterator[pa.RecordBatch], level: int = level, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                passed = [(n, k) for n, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if shared.value[n].passes(k, level)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in passed], pa.string()), pa.array([k for _, k in passed], pa.string())], ["list", "key"])

        inside, outside = stored(outside.filter(F.col("list").isin(names)).mapInArrow(wrong, "list string, key string"), "passed"), inside
        left = {r["list"]: (r["count"], left[r["list"]][0]) for r in inside.groupBy("list").count().collect()}
        level += 1
    return cascades


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends, default=len(rest))]
    slash = rest.find("/")
    return (rest.translate(LOWER), "") if slash < 0 else (rest[:slash].translate(LOWER), rest[slash:])


def suffixes(host: str, longest: int) -> list[str]:
    """The host and the domains it belongs to of up to ``longest`` characters, the longest first: no longer one can be listed."""
    found = []
    at = len(host)
    while (at := host.rfind(".", 0, at)) >= 0 and len(host) - at - 1 <= longest:
        found.append(host[at + 1 :])
    if len(host) <= longest:
        found.append(host)
    return found[::-1]


def candidates(host: str, path: str, lengths: list[int], longest: int) -> list[str]:
    """Keys that a rule for this url can have, the longest first; of equally long ones that with the longer host."""
    found = {(h, path[:n]) for h in suffixes(host, longest) for n in lengths if n <= len(path)}
    return [h + p for h, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def tracking_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """(host) of the hosts two fifths of whose pages, or more, carry a tracking parameter. Urls without a host count for none."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = pages.select(host.alias("host"), F.col(url).rlike(TRACKING).alias("marked")).filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if("marked").alias("marked"))
    return counted.filter("5 * marked >= 2 * n").select("host")


def judge(pages: DataFrame, rules=RULES, blocked_hosts: DataFrame | None = None, key: str = "page_id", url: str = "url", shard_bits: int = SHARD_BITS) -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``.

    The longest fitting rule decides; without one, block where the host or a domain it
    belongs to is in ``blocked_hosts`` (a column ``host``; nulls and repeats count for
    nothing), else allow. A null url or one without ``://`` has an empty host and path; no
    rule fits it. Urls and lists of any length. Repeated rows give repeated results, an
    empty table none; other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    lengths = sorted({len(p) for _, _, p in rules})
    longest_rule = max((len(h) for _, h, _ in rules), default=0)
    if blocked_hosts is None:
        blocked_hosts = spark.createDataFrame([], "host string")
    hosts = stored(blocked_hosts.select(F.col("host").alias("key")).filter("key is not null").distinct(), "hosts")
    longest_host = hosts.agg(F.max(F.char_length("key"))).first()[0] or 0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for u in b.column(0).to_pylist():
                host, path = host_and_path(u)
                found.update(("rule", k) for k in candidates(host, path, lengths, longest_rule))
                found.update(("host", h) for h in suffixes(host, longest_host))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["kind", "key"])

    asked = pages.select(url).mapInArrow(keys, "kind string, key string").distinct()
    own = {verdict: [h + p for v, h, p in rules if v == verdict] for verdict in ("allow", "block")}
    marked = asked.join(hosts.select(F.lit("host").alias("kind"), "key", F.lit(True).alias("there")), ["kind", "key"], "left")
    every = F.when(F.col("kind") == "host", F.array(F.struct(F.lit("host").alias("list"), F.coalesce("there", F.lit(False)).alias("listed"))))
    every = every.otherwise(F.array(*[F.struct(F.lit(v).alias("list"), F.col("key").isin(own[v]).alias("listed")) for v in own]))
    universe = stored(marked.select("key", F.explode(every).alias("l")).select("l.list", "key", "l.listed"), "universe")
    shards = shards_needed(universe, shard_bits)
    named = F.udf(lambda k: shard(k, shards), "int") if shards > 1 else None

    def passed(rows: DataFrame, number: int) -> DataFrame:
        """``rows`` (key, url, hits) with the hits of one shard added: each a list's name, a space and the key."""
        part = universe if named is None else universe.filter(named("key") == number)
        shared = spark.sparkContext.broadcast(build(part))  # about shard_bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                out = []
                for u, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    host, path = host_and_path(u)
                    mine = [k for k in candidates(host, path, lengths, longest_rule) if shard(k, shards) == number]
                    hits += [f"{v} {k}" for k in mine for v in ("allow", "block") if v in own and k in own[v]]
                    if "host" in own and any(h in own["host"] for h in suffixes(host, longest_host) if shard(h, shards) == number):
                        hits.append("host")
                    out.append(hits)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], ["__key", "__url", "hits"])

        return rows.mapInArrow(run, f"__key {rows.dtypes[0][1]}, __url string, hits array<string>")

    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.array().cast("array<string>").alias("hits"))
    for number in range(shards):
        rows = passed(rows, number)
        rows = stored(rows, "judged") if number + 1 < shards else rows

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                host, path = host_and_path(u)
                held = set(hits)
                best = next(((k, v) for k in candidates(host, path, lengths, longest_rule) for v in ("allow", "block") if f"{v} {k}" in held), None)
                rule, verdict = best or (None, "block" if "host" in held else "allow")
                out.append((host, path, rule, verdict))
            columns = [pa.array([r[i] for r in out], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["__key", "host", "path", "rule", "verdict"])

    made = rows.mapInArrow(decided, f"__key {rows.dtypes[0][1]}, host string, path string, rule string, verdict string")
    return made.select(F.col("__key").alias(key), "host", "path", "rule", "verdict")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by ``RULES``, and by the list of tracking hosts where none fits."""
    pages = read(spark, sf_dir, "pages")
    return judge(pages, blocked_hosts=tracking_hosts(pages))


ORACLE = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(v, h, q) AS (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in RULES)}),
blocked AS (
  SELECT host AS h FROM p WHERE host <> '' GROUP BY host HAVING 5 * count(*) FILTER (regexp_matches(url, '{TRACKING}')) >= 2 * count(*)),
fits AS (
  SELECT r, h || q AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC, length(h) DESC) AS n
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN (SELECT bool_or(p.host = h OR ends_with(p.host, '.' || h)) FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (r)
"""
