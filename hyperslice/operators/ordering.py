"""Global order without a single task: ranks and running sums over range partitions, sorts along curves."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curves


#: Rows of under 200 bytes up to which a counted table may be broadcast.
BROADCAST_ROWS = 200_000
#: A key of over one in so many rows is hot; there are at most so many hot keys.
HOT = 1000
#: Folders that this session has written intermediate tables to.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder of checkpoints.

    Only in local mode a folder of this machine serves where ``spark.checkpoint.dir`` is
    unset (in tests); on a cluster it would be lost with an executor, so that is refused.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc.getConf().get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="hyperslice-"))
    return sc._jsc.sc().getCheckpointDir().get()


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to a table in the cluster's shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of ``held``, after the results that read them are written; how many there were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def sized(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast where its counted rows allow it, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unsent(table: DataFrame) -> DataFrame:
    """``table`` for a join that must not broadcast it: its files are small beside its rows, so by their size Spark would send a table that grows with the input over the driver."""
    return table.hint("merge")


def met(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` by a sort, neither broadcast, in no fewer tasks than there are shuffle partitions: for joins that make many more rows than they read. ``table`` should have few rows for each key: those are what a task holds."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *on).join(unsent(table.repartition(n, *on)), list(on), how)


def join_hot(rows: DataFrame, table: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``: a row for each key ``on``, and ``__n``, how many of the ``total`` rows have it.

    Hot keys (at most ``HOT``, so they can be broadcast) are joined where their rows are;
    only the others are shuffled. ``table`` should be held: it is read three times.
    """
    hot = F.col("__n") * HOT > total
    cold = rows.join(F.broadcast(table.filter(hot).select(on)), on, "left_anti")
    few = F.broadcast(table.filter(hot).drop("__n"))
    return rows.join(few, on).unionByName(cold.join(unsent(table.filter(~hot).drop("__n")), on))


def order_statistics(df: DataFrame, wanted: Sequence[tuple[Column, int]], bins: int = 1024) -> list[float]:
    """Exactly the value of each rank (from 0, among values that are neither null nor NaN; it must exist), in about three scans.

    A scan counts, for each rank looked for, the values in equal parts of the interval
    that holds it; the interval shrinks to the part that does, down to one value. No task
    and no driver holds more than the parts' counts. Infinite values are refused.
    """
    values = [v.cast("double") for v, _ in wanted]
    ends = df.agg(*[f.alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("lo", F.min(F.when(~F.isnan(v), v))), ("hi", F.max(F.when(~F.isnan(v), v))))]).first()
    found = {i: (ends[f"lo{i}"], ends[f"hi{i}"], 0) for i in range(len(wanted))}  # low, high, rows below
    if any(math.isinf(x) for lo, hi, _ in found.values() for x in (lo, hi)):
        raise ValueError("infinite values have no percentiles")
    while left := [i for i, (lo, hi, _) in found.items() if lo < hi]:
        asked = []
        for i in left:
            lo, hi, _ = found[i]
            at = F.least(F.floor((values[i] / 2 - lo / 2) / (hi / 2 - lo / 2) * bins).cast("int"), F.lit(bins - 1))
            asked.append(F.when((values[i] >= lo) & (values[i] <= hi), F.struct(F.lit(i).alias("i"), at.alias("bin"), values[i].alias("v"))))
        counted = df.select(F.explode(F.array_compact(F.array(*asked))).alias("e")).groupBy("e.i", "e.bin").agg(F.count("*").alias("n"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))
        rows = sorted(counted.collect(), key=lambda r: (r.i, r.bin))  # at most ``bins`` for each rank
        for i in left:
            below = found[i][2]
            for r in rows:
                if r.i == i:
                    if wanted[i][1] < below + r.n:
                        found[i] = (r.lo, r.hi, below)
                        break
                    below += r.n
    return [found[i][0] for i in range(len(wanted))]


def quantiles(df: DataFrame, wanted: Sequence[tuple[Column, float]]) -> list[float | None]:
    """The exact percentile (share 0..1, linear between rows) of each value: nulls don't count, NaN is the greatest; None without values.

    The values are computed once and held, since several scans read them.
    """
    if not wanted:
        return []
    names = [f"__w{i}" for i in range(len(wanted))]
    df = held(df.select(*[v.cast("double").alias(n) for n, (v, _) in zip(names, wanted, strict=True)]))
    wanted = [(F.col(n), share) for n, (_, share) in zip(names, wanted, strict=True)]
    counts = df.agg(*[f.alias(f"{n}{i}") for i, (v, _) in enumerate(wanted) for n, f in (("n", F.count(v)), ("nan", F.count_if(F.isnan(v.cast("double")))))]).first()
    places, asked = [], []
    for i, (v, share) in enumerate(wanted):
        at = (counts[f"n{i}"] - 1) * share
        ranks = [r for r in (math.floor(at), math.ceil(at)) if 0 <= r < counts[f"n{i}"] - counts[f"nan{i}"]] if counts[f"n{i}"] else []
        places.append((at, len(asked), len(ranks)))
        asked += [(v, r) for r in ranks]
    values = order_statistics(df, asked) if asked else []
    out: list[float | None] = []
    for i, (at, first, n) in enumerate(places):
        low, high = math.floor(at), math.ceil(at)
        if not counts[f"n{i}"]:
            out.append(None)
        elif n < 2:
            out.append(float("nan"))
        else:
            a, b = values[first], values[first + 1]
            out.append(a if low == high else (high - at) * a + (at - low) * b)
    return out


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank", running: Column | None = None, total: str = "running") -> DataFrame:
    """``df`` with a global rank from 1 and, with ``running``, the sum of it over all rows before a row and the row itself.

    Rows are range-partitioned by ``order`` (which should have no ties), numbered within
    their partitions, and lifted by the counts and sums of the partitions before.
    """
    value = (running if running is not None else F.lit(0.0)).cast("double")
    sorted_ = df.withColumn("__v", value).repartitionByRange(*order).sortWithinPartitions(*order)
    at = held(sorted_.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s0"))
    joined = at.withColumn("__part", part).join(F.broadcast(parts), "__part")
    out = joined.withColumn(rank, F.col("__n0") + place + 1)
    if running is not None:
        within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(total, F.col("__s0") + F.sum("__v").over(within))
    return out.drop("__v", "__at", "__part", "__n0", "__s0")


def grid_codes(df: DataFrame, spatial: Sequence[str], bits: int | None = None, curve: str = "morton", out: str = "code") -> DataFrame:
    """``df`` with the curve code of its quantised spatial columns; ranges are those of the data."""
    bits = bits or curves.bits_for(len(spatial))
    ranges = df.agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate(spatial) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    joined = df.crossJoin(F.broadcast(ranges))  # one row
    coords = [curves.quantise(F.col(c), F.col(f"__lo{i}"), F.col(f"__hi{i}"), 1 << bits) for i, c in enumerate(spatial)]
    code = curves.morton(coords, bits) if curve == "morton" else curves.hilbert(coords, bits)
    return joined.withColumn(out, code).drop(*[f"__{n}{i}" for i in range(len(spatial)) for n in ("lo", "hi")])


def spatial_order(df: DataFrame, barriers: Sequence[str], spatial: Sequence[str], ties: Sequence[str], bits: int | None = None, curve: str = "morton") -> DataFrame:
    """``df`` with ``ord`` from 0: by the barrier axes, then along the curve, then by ``ties``."""
    coded = grid_codes(df, spatial, bits, curve)
    order = [F.col(c) for c in (*barriers, "code", *ties)]
    return ranked(coded, order, "ord").withColumn("ord", F.col("ord") - 1)


def depth_order(df: DataFrame, view_row: Sequence[float], axes: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Back to front: by falling depth along the view's axis."""
    depth = sum((F.col(a) * w for a, w in zip(axes, view_row, strict=True)), F.lit(0.0))
    return df.withColumn("depth", depth).orderBy(F.desc("depth"), *ties)


def top_k(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k rows of the greatest value, ties by the least key, in the keys' order."""
    return df.orderBy(F.desc(value), key).limit(k).orderBy(key)


def order_lines(vertices: DataFrame, segments: DataFrame, spatial: Sequence[str], key: str, a: str = "a", b: str = "b", barriers: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(vertices, segments), both along the curve: vertices with ``ord``, segments by their middles with ``ord`` and ends renamed to the vertices' order.

    Segments that name an absent vertex go.
    """
    placed = held(spatial_order(vertices, barriers, spatial, [key]).drop("code"))
    ends = segments.withColumn("__seg", F.monotonically_increasing_id())
    ends = held(ends)
    for side, name in ((a, "a"), (b, "b")):
        of = placed.select(F.col(key).alias(side), F.col("ord").alias(f"__o{name}"), *[F.col(c).alias(f"__{name}_{c}") for c in (*barriers, *spatial)])
        ends = ends.join(of, side)
    middle = ends.withColumns({f"__m_{c}": (F.col(f"__a_{c}") + F.col(f"__b_{c}")) / 2 for c in spatial} | {f"__m_{c}": F.col(f"__a_{c}") for c in barriers})
    sorted_ = spatial_order(held(middle), [f"__m_{c}" for c in barriers], [f"__m_{c}" for c in spatial], ["__oa", "__ob", "__seg"])
    others = [c for c in segments.columns if c not in (a, b)]
    return placed, sorted_.select("ord", F.col("__oa").alias(a), F.col("__ob").alias(b), *others)
