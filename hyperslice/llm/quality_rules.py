"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks every line of a text as content or
boilerplate, Viterbi decoding finds the likeliest marks, and the share of characters
in content lines decides retention, after rules on counts. The field is trained by
its conditional likelihood on spliced sequences: runs of lines of good and of bad
documents, from a bounded labelled sample, stand behind one another with known
borders, so the field learns what a line looks like as well as when to switch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, distinct_names, read

#: Labelled documents that the field is trained on (the least by hash of their id), and lines of each that the driver gets (6 KB).
TRAIN_DOCS = 1500
TRAIN_LINES = 64
#: Training sequences, the most runs in one, and the most lines in a run.
SPLICED = 1500
RUNS = 5
RUN_LINES = 8
STEPS = 150
PENALTY = 1e-3
MIN_WORDS = 50
MAX_REPEATED = 50
CONTENT_SHARE = 0.5

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SPACES = b" \t\n\v\f\r"
FEATURES = 12


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + n] |= twice
    return int(hit.sum())


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of each line that holds a word, its characters, and how many lines equal an earlier one."""
    rows, sizes, seen, again = [], [], set(), 0
    for line in lines:
        words = line.split()
        if not words:
            continue
        old = line in seen
        seen.add(line)
        again += old
        n, size = len(words), len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        upper = size - len(line.translate(None, UPPER))
        digits = size - len(line.translate(None, DIGITS))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        rows.append(
            (
                1.0,
                min(1.0, 8 * symbols / size),
                upper / size,
                float(n < 4),
                float(old),
                1 - len(set(words)) / n,
                same / n,
                float(line.rstrip()[-1:] in b".!?"),
                digits / size,
                sum(len(w) == 1 and not w.isalnum() for w in words) / n,
                float(n > 60),
                min(1.0, line.count(b"!") / n),
            )
        )
        sizes.append(size)
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(sizes, np.int64), again


class Field:
    """A linear-chain conditional random field with the states boilerplate (0) and content (1)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest state of each line; of equally likely ones content."""
        gains = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = 0.0, 0.0, []
        for k, g in enumerate(gains):
            if k:
                from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
                a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01) + g
                back.append((from0, from1))
            else:
                a, b = 0.0, g
        states = np.empty(len(gains), np.int8)
        now = int(b >= a)
        for k in range(len(gains) - 1, -1, -1):
            states[k] = now
            if k:
                now = int(back[k - 1][now])
        return states

    @classmethod
    def trained(cls, sequences: list[np.ndarray], labels: list[int]) -> Field:
        """Fitted by Adam on the penalised conditional log-likelihood of spliced sequences; without both labels every line is content."""
        if len(set(labels)) < 2:
            return cls(np.eye(FEATURES)[0], np.zeros((2, 2)))
        x, marks, there = spliced(sequences, labels)
        theta = np.zeros(FEATURES + 4)
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            slope = likelihood(theta, x, marks, there)[1]
            mean = 0.9 * mean + 0.1 * slope
            square = 0.99 * square + 0.01 * slope**2
            theta = theta + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return cls(theta[:FEATURES].copy(), theta[FEATURES:].reshape(2, 2).copy())


def spliced(sequences: list[np.ndarray], labels: list[int], n: int = SPLICED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (line, sequence, feature), marks and presence (line, sequence) of ``n`` sequences of runs whose labels alternate."""
    rng = np.random.default_rng(42)
    of = [[s for s, y in zip(sequences, labels, strict=True) if y == k and len(s)] for k in (0, 1)]
    made = []
    for i in range(n):
        runs = []
        for k in range(int(rng.integers(1, RUNS + 1))):
            y = (i + k) % 2
            lines = of[y][int(rng.integers(len(of[y])))]
            size = min(len(lines), int(rng.integers(1, RUN_LINES + 1)))
            at = int(rng.integers(len(lines) - size + 1))
            runs.append((lines[at : at + size], y))
        made.append(runs)
    most = max(sum(len(r) for r, _ in runs) for runs in made)
    x, marks, there = np.zeros((most, n, FEATURES)), np.zeros((most, n), np.int64), np.zeros((most, n), bool)
    for i, runs in enumerate(made):
        at = 0
        for lines, y in runs:
            x[at : at + len(lines), i], marks[at : at + len(lines), i], there[at : at + len(lines), i] = lines, y, True
            at += len(lines)
    return x, marks, there


def likelihood(theta: np.ndarray, x: np.ndarray, marks: np.ndarray, there: np.ndarray) -> tuple[float, np.ndarray]:
    """The conditional log-likelihood of the marks for each line, less the penalty, and its gradient, by the forward and backward sums."""
    weights, moves = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
    most, n = there.shape
    lines = there.sum()
    gain = np.stack([np.zeros((most, n)), x @ weights], -1)
    forward, backward = np.zeros((most, n, 2)), np.zeros((most, n, 2))
    forward[0] = gain[0]
    for t in range(1, most):
        moved = forward[t - 1][:, :, None] + moves
        forward[t] = np.where(there[t][:, None], np.logaddexp(moved[:, 0], moved[:, 1]) + gain[t], forward[t - 1])
    for t in range(most - 2, -1, -1):
        moved = (backward[t + 1] + gain[t + 1])[:, None, :] + moves
        backward[t] = np.where(there[t + 1][:, None], np.logaddexp(moved[:, :, 0], moved[:, :, 1]), 0)
    total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    content = np.where(there, np.exp(forward[..., 1] + backward[..., 1] - total), 0)
    slope = ((there * (marks - content))[..., None] * x).sum((0, 1))
    inner = there[1:]
    pair = forward[:-1][..., :, None] + moves + (gain[1:] + backward[1:])[..., None, :] - total[:, None, None]
    expected = np.exp(np.where(inner[..., None, None], pair, -np.inf)).sum((0, 1))
    seen = np.zeros((2, 2))
    np.add.at(seen, (marks[:-1][inner], marks[1:][inner]), 1)
    value = (there * marks * gain[..., 1]).sum() + (seen * moves).sum() - total.sum()
    return value / lines - PENALTY / 2 * theta @ theta, np.append(slope, (seen - expected).ravel()) / lines - PENALTY * theta


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, text, label) of at most ``rows`` labelled documents, those of the least hash; none that crc32 of the id mod 5 holds out."""
    held = F.crc32(F.col(key).cast("string")) % 5 == 0
    some = labels.filter(F.col(label).isin(0, 1) & ~held).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    some = some.orderBy(F.xxhash64("key"), "key").limit(rows)  # a bound of ``rows`` rows is proven, so it can be broadcast
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(some), "key")
    return found.groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", F.col("label").cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """The field for ``docs``, from a sample of at most ``rows`` documents that ``labels`` marks.

    Of a sampled document at most ``TRAIN_LINES`` consecutive lines (from a place that its
    key fixes) reach the driver, so what it gets is bounded whatever the texts' lengths.
    Null and empty texts have no lines; repeated rows count once; without labels of both
    kinds, or without documents, every line is content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                lines = line_features((t or "").encode().split(b"\n"))[0]
                at = zlib.crc32(str(key).encode()) % (len(lines) - TRAIN_LINES + 1) if len(lines) > TRAIN_LINES else 0
                made.append(lines[at : at + TRAIN_LINES].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key").cast(pa.string()), b.column("label"), pa.array(made, pa.binary())], ["key", "label", "x"])

    bounded_batches(docs.sparkSession)
    found = labelled_sample(docs, labels, rows).mapInArrow(run, "key string, label int, x binary").toArrow().to_pylist()
    found = sorted((r for r in found if r["x"]), key=lambda r: r["key"])
    return Field.trained([np.frombuffer(r["x"]).reshape(-1, FEATURES) for r in found], [r["label"] for r in found])


RESULT = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("content_share", "double"), ("kept", "boolean")]


def judged(text: str, field: Field) -> tuple:
    raw = text.encode()
    words = raw.split()
    features, sizes, again = line_features(raw.split(b"\n"))
    n, repeated = len(words), repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    share = float(sizes[field.viterbi(features) == 1].sum() / sizes.sum()) if len(sizes) else 0.0
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated, failed, share, not failed and share >= CONTENT_SHARE


def judge(docs: DataFrame, field: Field, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` plus counts, base_failed, content_share and kept of each row.

    A null or empty text has no words, so it fails the base rules. Whole texts of any
    length; repeated rows give repeated results; an empty table an empty one. Columns that
    aren't in ``keys`` are ignored; a key with the name of a result is refused.
    """
    distinct_names(keys, [n for n, _ in RESULT])
    bounded_batches(docs.sparkSession)
    chosen = docs.select(*keys, F.col(text).alias("__text"))
    head = [f"`{c}` {t}" for c, t in chosen.dtypes[: len(keys)]]
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judged(t or "", field) for t in b.column(len(keys)).to_pylist()]
            made = [pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(RESULT)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *made], [*keys, *(n for n, _ in RESULT)])

    return chosen.mapInArrow(run, ", ".join([*head, *(f"{n} {t}" for n, t in RESULT)]))


def keep(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Null and empty texts go; whole texts of any length are judged; repeated rows stay or
    go together; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    kept = F.pandas_udf(lambda s: s.map(lambda t: judged(t or "", field)[-1]).astype(bool), "boolean")
    return docs.filter(kept(F.col(text)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, by a field trained on the labels table; a row for each row, as ``judge`` says."""
    docs = read(spark, sf_dir, "documents")
    return judge(docs, train(docs, read(spark, sf_dir, "labels")), ["doc_id"])
