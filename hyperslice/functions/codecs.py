"""Column codecs: quantisers, delta coding and dictionaries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import clamp


def full(bits: int) -> int:
    return (1 << bits) - 1


def linear_encode(x: Column, low: Column, high: Column, bits: int = 8) -> Column:
    """Codes 0..2^bits-1 over low..high, halves rounded to even; a constant column has code 0."""
    t = clamp((x - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0)
    return F.coalesce(F.bround(t * full(bits)), F.lit(0.0)).cast("int")


def linear_decode(code: Column, low: Column, high: Column, bits: int = 8) -> Column:
    return low + code * ((high - low) / full(bits))


def log_encode(x: Column, max_log: Column, bits: int = 8) -> Column:
    """log1p of non-negative values, scaled by the largest."""
    return F.coalesce(F.bround(clamp(F.log1p(F.greatest(x, F.lit(0.0))) / F.nullif(max_log, F.lit(0.0)), 0.0, 1.0) * full(bits)), F.lit(0.0)).cast("int")


def log_decode(code: Column, max_log: Column, bits: int = 8) -> Column:
    return F.expm1(code * max_log / full(bits))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_log_decode(code: Column, low: Column, high: Column, bits: int = 8) -> Column:
    y = linear_decode(code, low, high, bits)
    return F.signum(y) * F.expm1(F.abs(y))


def geometric_encode(x: Column, low_log: Column, high_log: Column, bits: int = 8) -> Column:
    """Code 0 is zero alone; 1..2^bits-1 are anchored at the logs of the least and greatest positive value."""
    t = clamp((F.ln(x) - low_log) / F.nullif(high_log - low_log, F.lit(0.0)), 0.0, 1.0)
    return F.when(x > 0, 1 + F.coalesce(F.bround(t * (full(bits) - 1)), F.lit(0.0))).otherwise(0).cast("int")


def geometric_decode(code: Column, low_log: Column, high_log: Column, bits: int = 8) -> Column:
    return F.when(code == 0, 0.0).otherwise(F.exp(low_log + (code - 1) * (high_log - low_log) / (full(bits) - 1)))


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def unzigzag(x: Column) -> Column:
    return F.when(x % 2 == 0, x / 2).otherwise(-(x + 1) / 2).cast("bigint")


def delta_encode(df: DataFrame, code: str, chunk: str, order: str, bits: int = 16, out: str = "delta") -> DataFrame:
    """``df`` with the zigzag of each code's change, modulo 2^bits; the first of a chunk changes from 0."""
    half = 1 << (bits - 1)
    change = F.col(code) - F.lag(code, 1, 0).over(Window.partitionBy(chunk).orderBy(order))
    wrapped = F.pmod(change + half, F.lit(1 << bits)) - half
    return df.withColumn(out, zigzag(wrapped).cast("bigint"))


def delta_decode(df: DataFrame, delta: str, chunk: str, order: str, bits: int = 16, out: str = "code") -> DataFrame:
    running = F.sum(unzigzag(F.col(delta))).over(Window.partitionBy(chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.pmod(running, F.lit(1 << bits)).cast("bigint"))


def dictionary_encode(df: DataFrame, column: str, out: str = "code") -> tuple[DataFrame, DataFrame]:
    """(df with dense codes in the values' order, null first, dictionary). The dictionary holds a column's distinct values.

    It is broadcast where its counted rows allow it; else rows of very frequent values are joined apart from the others, so none is a hot key.
    """
    from ..operators.ordering import BROADCAST_ROWS, held, join_hot, ranked

    counted = df.groupBy(column).agg(F.count("*").alias("__n"))
    lut = held(ranked(counted, [F.col(column)], "__r").select(F.col(column), (F.col("__r") - 1).alias(out), "__n"))
    known = lut.drop("__n")
    if lut.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(known), df[column].eqNullSafe(known[column]), "left").select(df["*"], known[out]), known
    total = lut.agg(F.sum("__n")).first()[0]
    valued = join_hot(df.filter(F.col(column).isNotNull()), lut, column, total).select(*df.columns, out)
    absent = df.filter(F.col(column).isNull()).crossJoin(F.broadcast(known.filter(F.col(column).isNull()).select(out)))  # one row at most
    return valued.unionByName(absent.select(*df.columns, out)), known


def dictionary_decode(codes: DataFrame, lut: DataFrame, code: str = "code") -> DataFrame:
    return codes.join(lut, code, "left")


def log_ranges(df: DataFrame, column: str) -> DataFrame:
    """One row: the logs of the least and the greatest positive value."""
    positive = F.when(F.col(column) > 0, F.col(column))
    return df.agg(F.ln(F.min(positive)).alias("low_log"), F.ln(F.max(positive)).alias("high_log"))


#: Semantic types: what values must meet, and the codecs that may hold them, the smallest first.
SEMANTIC_TYPES: dict[str, tuple[str, tuple[str, ...]]] = {
    "coordinate": ("finite", ("constant", "linear16", "plain")),
    "color": ("unit", ("constant", "dictionary", "linear8", "plain")),
    "positive_scalar": ("not negative", ("constant", "dictionary", "geometric8", "geometric16", "plain")),
    "bounded_scalar": ("unit", ("constant", "dictionary", "linear8", "linear16", "plain")),
    "signed_scalar": ("finite", ("constant", "dictionary", "signed_log16", "plain")),
    "label": ("any", ("constant", "dictionary", "plain")),
    "index": ("integer", ("constant", "delta", "plain")),
    "extent": ("not negative", ("constant", "geometric16", "plain")),
}
_BITS = {"constant": 0, "dictionary": 8, "linear8": 8, "geometric8": 8, "linear16": 16, "geometric16": 16, "signed_log16": 16, "delta": 16, "plain": 64}


def meets(column: Column, constraint: str) -> Column:
    """Whether a value meets a semantic type's constraint; nulls don't."""
    finite = ~F.isnan(column.cast("double")) & (F.abs(column.cast("double")) < float("inf"))
    checks = {"any": F.lit(True), "finite": finite, "unit": finite & column.between(0, 1), "not negative": finite & (column >= 0), "integer": finite & (column == F.rint(column.cast("double")))}
    return F.coalesce(checks[constraint] & column.isNotNull(), F.lit(False))


def choose_codec(df: DataFrame, column: str, kind: str, tolerance: float) -> dict:
    """The smallest codec of a semantic type whose greatest error is at most ``tolerance`` (relative for geometric codes), measured on all rows in two scans.

    Returns codec, bits and error. Values that break the type's constraint raise.
    """
    constraint, family = SEMANTIC_TYPES[kind]
    x = F.col(column)
    first = df.agg(F.count("*").alias("n"), F.count_if(~meets(x, constraint)).alias("bad"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.approx_count_distinct(x, 0.01).alias("d")).first()
    if first["bad"]:
        raise ValueError(f"{first['bad']} values of {column} aren't {constraint}")
    if first["n"] == 0 or first["lo"] == first["hi"]:
        return {"codec": "constant", "bits": 0, "error": 0.0}
    trial = {}
    if kind != "label":
        v, lo, hi = x.cast("double"), F.lit(float(first["lo"])), F.lit(float(first["hi"]))
        logs = log_ranges(df, column).first()
        low, high = F.lit(logs["low_log"]).cast("double"), F.lit(logs["high_log"]).cast("double")
        s_lo, s_hi = (F.lit(df.agg(f(signed_log(v))).first()[0]) for f in (F.min, F.max)) if "signed_log16" in family else (None, None)
        for name in family:
            bits = _BITS[name]
            if name.startswith("linear"):
                trial[name] = F.max(F.abs(linear_decode(linear_encode(v, lo, hi, bits), lo, hi, bits) - v))
            elif name.startswith("geometric"):
                trial[name] = F.max(F.when(v > 0, F.abs(geometric_decode(geometric_encode(v, low, high, bits), low, high, bits) / v - 1)).otherwise(0.0))
            elif name == "signed_log16":
                trial[name] = F.max(F.abs(signed_log_decode(linear_encode(signed_log(v), s_lo, s_hi, bits), s_lo, s_hi, bits) - v))
    errors = df.agg(*[e.alias(n) for n, e in trial.items()]).first().asDict() if trial else {}
    for name in family:
        if name == "constant" or (name == "dictionary" and first["d"] > 250):
            continue
        error = errors.get(name, 0.0)
        if error is not None and error <= tolerance:
            return {"codec": name, "bits": _BITS[name], "error": error}
    return {"codec": "plain", "bits": 64, "error": 0.0}


def delta_pays(df: DataFrame, code: str, chunk: str, order: str, bits: int = 16, least: float = 1.02) -> bool:
    """Whether deltas make a column of codes at least ``least`` times smaller, by the bits that the codes and the deltas need within their chunks (their empirical entropy)."""
    coded = delta_encode(df, code, chunk, order, bits)

    def entropy(column: str) -> float:
        counts = coded.groupBy(chunk, column).agg(F.count("*").alias("n"))
        total = counts.groupBy(chunk).agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.log2("n")).alias("s"))
        return total.agg(F.sum(F.col("all_n") * F.log2("all_n") - F.col("s")).alias("e")).first()["e"] or 0.0

    plain, delta = entropy(code), entropy("delta")
    return delta > 0 and plain / delta >= least or delta == 0 and plain > 0


def constant_encode(df: DataFrame, columns: list[str]) -> dict | None:
    """The one row of values that all rows share, or None where they differ or there are no rows."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.min, "a"), (F.max, "z"))], *[F.count_if(F.col(c).isNull()).alias(f"null{i}") for i, c in enumerate(columns)], F.count("*").alias("n")).first()
    same = row["n"] and all(row[f"a{i}"] == row[f"z{i}"] and (not row[f"null{i}"] or row[f"null{i}"] == row["n"]) for i in range(len(columns)))
    return {c: row[f"a{i}"] for i, c in enumerate(columns)} if same else None


def constant_decode(df: DataFrame, values: dict) -> DataFrame:
    """Every row with the shared values."""
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def cholesky_tiers(df: DataFrame, chol: str, dims: int, tolerance: float) -> dict[str, int]:
    """Bits (8 or 16) for the diagonal (logarithmic) and the rest (linear) of packed factors: 8 where the greatest error over all rows, as a share of the diagonal, is within ``tolerance``, else 16."""
    places = [(i, j, i * (i + 1) // 2 + j) for i in range(dims) for j in range(i + 1)]
    diagonal = [F.col(chol)[k] for i, j, k in places if i == j]
    rest = [(F.col(chol)[k], F.col(chol)[i * (i + 1) // 2 + i]) for i, j, k in places if i != j]
    ends = df.agg(F.min(F.ln(F.least(*diagonal) if dims > 1 else diagonal[0])).alias("a"), F.max(F.ln(F.greatest(*diagonal) if dims > 1 else diagonal[0])).alias("b"), *[f(v).alias(f"{n}{i}") for i, (v, _) in enumerate(rest) for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    if ends["a"] is None:
        return {"diagonal": 8, "rest": 8}
    a, b = F.lit(ends["a"]), F.lit(ends["b"])
    errors = [F.max(F.abs(geometric_decode(geometric_encode(v, a, b), a, b) / v - 1)).alias(f"d{i}") for i, v in enumerate(diagonal)]
    for i, (v, scale) in enumerate(rest):
        lo, hi = F.lit(ends[f"l{i}"]), F.lit(ends[f"h{i}"])
        errors.append(F.max(F.abs(linear_decode(linear_encode(v, lo, hi), lo, hi) - v) / F.abs(scale)).alias(f"r{i}"))
    row = df.agg(*errors).first().asDict()
    worst = {p: max((v or 0.0 for n, v in row.items() if n[0] == p), default=0.0) for p in "dr"}
    return {"diagonal": 8 if worst["d"] <= tolerance else 16, "rest": 8 if worst["r"] <= tolerance else 16}
