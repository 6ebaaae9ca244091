"""Quality classifier: a support-vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are n-grams (one to three) of words and of word shapes, and marks of repeated lines. A
class's log-count ratio scales each indicator, and a linear hinge-loss model is fitted
to the scaled indicators by dual coordinate descent. Margins become scores by a
logistic curve that is fitted to labelled documents which the model hasn't seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, distinct_names, read, stored
from .quality_rules import labelled_sample

#: Labelled documents that the model is fitted on, the least by hash of their id, and the most bytes of their texts
#: (a text that the rest of the bytes can't hold is left out). A byte gives under 3 indicators of 4 bytes.
TRAIN_DOCS = 8000
TRAIN_BYTES = 64 << 20
#: Indicators that fewer training documents have are left out.
MIN_DOCS = 5
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3
CALIBRATION_SHARE = 4  # one training document in so many is kept for the logistic curve
WORDS_KNOWN = 200_000

#: Odd factors of the hashes of n-grams, and a mark of each kind.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
KINDS = {(kind, n): np.uint32(zlib.crc32(b"%s %d" % (kind, n))) for kind in (b"shape", b"word") for n in (1, 2, 3)}
AGAIN = zlib.crc32(b"the word before again")

_codes: dict[bytes, int] = {}


def shape(word: bytes) -> bytes:
    """What a word looks like: case, length, digits, and the marks at its ends."""
    text = word.decode(errors="replace")
    core, tail = (text, "") if text.isalpha() else (text[:-1], text[-1]) if text[:-1].isalpha() and not text[-1].isalnum() else (None, "")
    if core is not None:  # most words: letters, and a mark behind them at most
        case = "X" if len(core) > 1 and core.isupper() else "Xx" if core[0].isupper() else "x"
        return f"{case}{min(3, len(core) // 5)}{tail}".encode()
    core = text.strip("".join({c for c in text if not c.isalnum()}))
    tail = text[len(text.rstrip("".join({c for c in text if not c.isalnum()}))) :][:3] if core else text[:3]
    letters = [c for c in core if c.isalpha()]
    if not letters:
        case = "d" if core else ""
    elif len(letters) > 1 and all(c.isupper() for c in letters):
        case = "X"
    else:
        case = "Xx" if letters[0].isupper() else "x"
    if letters and any(c.isdigit() for c in core):
        case += "d"
    return f"{case}{min(3, len(core) // 5)}{tail}".encode()


def grams(codes: np.ndarray, kind: bytes) -> list[np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams of a sequence of codes of 32 bits."""
    out = []
    for n in (1, 2, 3):
        if len(codes) >= n:
            total = np.full(len(codes) - n + 1, KINDS[kind, n], np.uint32)
            for i in range(n):
                part = codes[i : len(codes) - n + 1 + i] * FACTORS[i]
                total = (total ^ part ^ (part >> np.uint32(15))) * FACTORS[(i + n) % 3]
            out.append(total)
    return out


def indicators(text: str) -> np.ndarray:
    """The distinct n-grams of a text, as sorted hashes of 32 bits. An empty text has none.

    A word that repeats the one before has a shape of its own.
    """
    raw = text.encode()
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint32)
    if len(_codes) > WORDS_KNOWN:
        _codes.clear()
    for w in set(words).difference(_codes):
        _codes[w] = zlib.crc32(shape(w)) << 32 | zlib.crc32(w.lower())
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    shapes = (codes >> np.uint64(32)).astype(np.uint32)
    shapes[1:][codes[1:] == codes[:-1]] = AGAIN
    found = grams(shapes, b"shape") + grams(codes.astype(np.uint32), b"word")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if len(set(lines)) < len(lines):
        found.append(np.array([zlib.crc32(b"line again"), zlib.crc32(b"lines again %d" % min(9, 10 * len(set(lines)) // len(lines)))], np.uint32))
    every = np.sort(np.concatenate(found))
    return every[np.append(True, every[1:] != every[:-1])]


@dataclass
class Model:
    """Weights of hashed indicators (sorted), a bias, and the logistic curve from margin to score."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float
    offset: float
    squares: np.ndarray

    def margin(self, found: np.ndarray) -> float:
        if not len(self.hashes):
            return self.bias
        at = np.searchsorted(self.hashes, found)
        at[at == len(self.hashes)] = 0
        at = at[self.hashes[at] == found]
        return float(self.weights[at].sum() / max(1e-12, np.sqrt(self.squares[at].sum())) + self.bias) if len(at) else self.bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(indicators(text)) + self.offset, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """log of (smoothed share of an indicator's counts in class 1 / that in class 0)."""
    counts = [np.full(n, SMOOTHING), np.full(n, SMOOTHING)]
    for row, y in zip(rows, labels.tolist(), strict=True):
        counts[y][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """The weights (the last is the bias) of a linear hinge-loss model; both classes weigh alike."""
    weights, signs = np.zeros(n + 1), np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, len(labels) / (2 * max(1, (labels == 1).sum())), len(labels) / (2 * max(1, (labels == 0).sum()))) * COST
    alpha, norm = np.zeros(len(rows)), np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(42)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)).tolist():
            row, value, y = rows[i], values[i], signs[i]
            slope = y * (weights[row] @ value + weights[n]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                move = (new - alpha[i]) * y
                weights[row] += move * value
                weights[n] += move
                alpha[i] = new
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and offset by Newton's method on smoothed targets; the scale never falls below a small positive one."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        slope = np.array([(margins * (target - p)).sum() - 1e-3 * a, (target - p).sum()])
        w = p * (1 - p) + 1e-9
        bend = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        da, db = np.linalg.solve(bend, slope)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return max(a, 0.05), b


def fit(found: list[tuple[int, np.ndarray]]) -> Model:
    """The model of (label, indicators) rows in a fixed order; without both labels every score is the share of label 1, or 0.5."""
    labels = np.array([y for y, _ in found], np.int64)
    empty = np.zeros(0)
    if len(set(labels.tolist())) < 2:
        share = 0.5 if not len(labels) else (0.99 if labels[0] else 0.01)
        return Model(empty.astype(np.uint32), empty, 0.0, 1.0, float(np.log(share / (1 - share))), empty)
    hashes, counts = np.unique(np.concatenate([x for _, x in found]), return_counts=True)
    hashes = hashes[counts >= MIN_DOCS]
    n = len(hashes)
    rows = []
    for _, x in found:
        at = np.minimum(np.searchsorted(hashes, x), max(0, n - 1))
        rows.append(at[hashes[at] == x] if n else at[:0])
    kept = np.arange(len(rows)) % CALIBRATION_SHARE == 0
    fit_on, curve_on = np.flatnonzero(~kept), np.flatnonzero(kept)
    if len(set(labels[fit_on].tolist())) < 2 or len(set(labels[curve_on].tolist())) < 2:
        fit_on = curve_on = np.arange(len(rows))
    ratios = log_count_ratios([rows[i] for i in fit_on], labels[fit_on], n)
    scaled = [ratios[r] / max(1e-12, np.sqrt((ratios[r] ** 2).sum())) for r in rows]
    weights = dual_coordinate_descent([rows[i] for i in fit_on], [scaled[i] for i in fit_on], labels[fit_on], n)
    margins = np.array([weights[rows[i]] @ scaled[i] + weights[n] for i in curve_on])
    scale, offset = logistic_curve(margins, labels[curve_on])
    return Model(hashes, weights[:n] * ratios, float(weights[n]), scale, offset, ratios**2)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``rows`` labelled documents of ``most_bytes`` in all; held-out ones (crc32 of the id mod 5 is 0) are never among them.

    So what the driver gets is bounded, whatever the texts' lengths. Null and empty texts
    count without indicators; repeated rows count once; other columns are ignored. Without
    labels of both kinds, or without documents, every score is the same.
    """
    bounded_batches(docs.sparkSession)
    sample = stored(labelled_sample(docs, labels, rows), "sample")
    sizes = sample.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("key"), "key").collect()  # ``rows`` small rows
    held, chosen = 0, []
    for r in sizes:
        if held + r["size"] <= most_bytes:
            held += r["size"]
            chosen.append((r["key"],))
    if not chosen:
        return fit([])
    chosen = docs.sparkSession.createDataFrame(chosen, sample.select("key").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [indicators(t or "").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key").cast(pa.string()), b.column("label"), pa.array(made, pa.binary())], ["key", "label", "x"])

    found = sample.join(F.broadcast(chosen), "key").mapInArrow(run, "key string, label int, x binary").toArrow().to_pylist()
    return fit([(r["label"], np.frombuffer(r["x"], np.uint32)) for r in sorted(found, key=lambda r: (r["key"], r["label"]))])


def score(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` plus ``score`` (0 to 1) of each row's whole text; a null or empty text has no indicators and scores by the bias.

    Texts of any length. Repeated rows give repeated results, an empty table none; columns
    not in ``keys`` are ignored; a key named ``score`` is refused.
    """
    distinct_names(keys, ["score"])
    bounded_batches(docs.sparkSession)
    chosen = docs.select(*keys, F.col(text).alias("__text"))
    head = [f"`{c}` {t}" for c, t in chosen.dtypes[: len(keys)]]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: at most the training rows' indicators

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t or "") for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(scores, pa.float64())], [*keys, "score"])

    return chosen.mapInArrow(run, ", ".join([*head, "score double"]))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, by a model fitted on labelled rows that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
