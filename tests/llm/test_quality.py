import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hyperslice.llm import quality_classifier, quality_rules
from hyperslice.llm.common import read

SF = "/root/testdata/sf0.01"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(hit)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for n in range(1, 9):
        field = quality_rules.Field(rng.normal(size=quality_rules.FEATURES), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, quality_rules.FEATURES))
        gain = x @ field.weights

        def total(s, gain=gain, field=field):
            return sum(g for g, k in zip(gain, s, strict=True) if k) + sum(field.moves[a, b] for a, b in itertools.pairwise(s))

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert tuple(field.viterbi(x)) == best
    assert len(field.viterbi(np.zeros((0, quality_rules.FEATURES)))) == 0


def test_rules_on_awkward_rows(spark, awkward, nothing):
    field = quality_rules.Field.trained([], [])
    found = quality_rules.judge(awkward, field, ["doc_id", "text"]).collect()
    assert len(found) == awkward.count()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(nothing, field, ["doc_id"]).count() == 0
    kept = quality_rules.keep(awkward, field)
    assert kept.columns == awkward.columns


def test_training_without_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(awkward, labels).weights[0] == 1.0
    model = quality_classifier.train(nothing, labels)
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(awkward, model, ["doc_id"]).collect())


def test_labels_of_one_kind_and_nulls(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_classifier.score(awkward, quality_classifier.train(awkward, labels), ["doc_id"]).collect()
    assert len(found) == awkward.count() and all(r.score > 0.5 for r in found)


def test_rules_keep_good_and_drop_bad_held_out(spark):
    found = quality_rules.op2_quality_rules(spark, SF).filter("not base_failed").join(read(spark, SF, "labels"), "doc_id").toPandas()
    held = found[[zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]]
    assert held[held.quality == 1].kept.mean() >= 0.98
    assert held[held.quality == 0].kept.mean() <= 0.2


def labelled_lines(docs, held):
    """Lines of labelled documents by label: those held out, or the others."""
    out = {0: [], 1: []}
    for r in docs.itertuples():
        if (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == held and r.text:
            lines = [x for x in r.text.split("\n") if len(x.split()) >= 8]
            if len(lines) > 1:
                out[r.quality].append(lines)
    return out


def test_spliced_texts_get_both_marks(spark):
    docs = read(spark, SF, "documents")
    labels = read(spark, SF, "labels")
    field = quality_rules.train(docs, labels)
    lines = labelled_lines(docs.join(labels, "doc_id").toPandas(), held=True)
    rng = np.random.default_rng(1)
    right = total = between = 0
    for _ in range(200):
        parts = []
        for y in rng.permutation(2).tolist():
            own = lines[y][int(rng.integers(len(lines[y])))]
            # a junk document may begin and end with ordinary lines, so junk is taken from its middle
            own = [x for x in own if any(c in x for c in "#$%&|!*")] or own[-1:] if y == 0 else own
            parts += [(x, y) for x in own[: int(rng.integers(1, 7))]]
        x, sizes, _ = quality_rules.line_features([t.encode() for t, _ in parts])
        marks = field.viterbi(x)
        right += int((marks == [y for _, y in parts]).sum())
        total += len(parts)
        between += 0 < sizes[marks == 1].sum() < sizes.sum()
    assert right / total >= 0.9 and between >= 160, (right / total, between)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    x, marks = rng.normal(size=(5, 4, quality_rules.FEATURES)), rng.integers(0, 2, (5, 4))
    there = np.arange(5)[:, None] < np.array([5, 1, 3, 4])
    x, marks = x * there[..., None], marks * there
    theta = rng.normal(size=quality_rules.FEATURES + 4)
    slope = quality_rules.likelihood(theta, x, marks, there)[1]
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        up, down = (quality_rules.likelihood(theta + d, x, marks, there)[0] for d in (step, -step))
        assert (up - down) / 2e-5 == pytest.approx(slope[i], abs=1e-6)


def test_likelihood_equals_enumeration():
    rng = np.random.default_rng(4)
    x, marks = rng.normal(size=(4, 1, quality_rules.FEATURES)), rng.integers(0, 2, (4, 1))
    theta = rng.normal(size=quality_rules.FEATURES + 4)
    moves = theta[-4:].reshape(2, 2)

    def total(s):
        return sum(x[t, 0] @ theta[:-4] * k for t, k in enumerate(s)) + sum(moves[a, b] for a, b in itertools.pairwise(s))

    every = np.logaddexp.reduce([total(s) for s in itertools.product((0, 1), repeat=4)])
    value = quality_rules.likelihood(theta, x, marks, np.ones((4, 1), bool))[0]
    assert value == pytest.approx((total(marks[:, 0]) - every) / 4 - quality_rules.PENALTY / 2 * theta @ theta)


def test_names_that_clash_are_refused(spark, awkward):
    with pytest.raises(ValueError):
        quality_rules.judge(awkward.withColumn("N_words", awkward.doc_id), quality_rules.Field.trained([], []), ["N_words"])


def test_classifier_held_out(spark):
    found = quality_classifier.op1_quality_classifier(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    found = found.join(read(spark, SF, "labels"), "doc_id").toPandas()
    held = found[found.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() >= 0.95
    assert ((held.score >= 0.3).astype(int) == held.predicted).all()
    assert (held.predicted == held.quality).mean() >= 0.95


def test_indicators():
    one = quality_classifier.indicators("Alpha beta gamma. alpha")
    assert (np.diff(one.astype(np.int64)) > 0).all() and len(quality_classifier.indicators(" \n")) == 0
    # shapes Xx1 x0 x1. x1: 4 + 3 + 2 n-grams; words alpha beta gamma. (alpha again): 3 + 3 + 2
    assert len(one) == 17
    assert set(quality_classifier.indicators("beta gamma.")) < set(one)
    assert len(set(quality_classifier.indicators("a a a")) & set(quality_classifier.indicators("a"))) == 2


def test_training_is_bounded_in_bytes(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    small = quality_classifier.train(docs, labels, most_bytes=100_000)
    whole = quality_classifier.train(docs, labels)
    assert 0 < len(small.hashes) < len(whole.hashes)
    assert not len(quality_classifier.train(docs, labels, most_bytes=0).hashes)


def plain_scores(train, texts):
    """The model in plain Python, from its definition, on dense vectors."""
    every = sorted({h for _, x in train for h in x.tolist()})
    every = [h for h in every if sum(h in set(x.tolist()) for _, x in train) >= quality_classifier.MIN_DOCS]
    at = {h: i for i, h in enumerate(every)}

    def vector(x):
        v = np.zeros(len(every))
        v[[at[h] for h in x.tolist() if h in at]] = 1
        return v

    xs, ys = np.array([vector(x) for _, x in train]), np.array([y for y, _ in train])
    curve = np.arange(len(ys)) % quality_classifier.CALIBRATION_SHARE == 0
    p, q = xs[~curve & (ys == 1)].sum(0) + 1, xs[~curve & (ys == 0)].sum(0) + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    scaled = xs * ratio
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-12)
    a, signs = scaled[~curve], np.where(ys[~curve] == 1, 1.0, -1.0)
    n = len(signs)
    cost = np.where(signs > 0, n / (2 * (signs > 0).sum()), n / (2 * (signs < 0).sum()))
    w, b, alpha, rng = np.zeros(len(every)), 0.0, np.zeros(n), np.random.default_rng(42)
    for _ in range(quality_classifier.EPOCHS):
        for i in rng.permutation(n):
            new = min(max(alpha[i] - (signs[i] * (a[i] @ w + b) - 1) / (a[i] @ a[i] + 1), 0), cost[i])
            w, b, alpha[i] = w + (new - alpha[i]) * signs[i] * a[i], b + (new - alpha[i]) * signs[i], new
    scale, offset = quality_classifier.logistic_curve(scaled[curve] @ w + b, ys[curve])
    tested = np.array([vector(quality_classifier.indicators(t)) for t in texts]) * ratio
    margins = tested / np.maximum(np.linalg.norm(tested, axis=1, keepdims=True), 1e-12) @ w + b
    return 1 / (1 + np.exp(-(scale * margins + offset)))


def test_scores_against_plain_python():
    rng = np.random.default_rng(7)
    good, bad = ["the", "of", "Cat", "dog.", "ran"], ["BUY!!", "now$$", "the", "of", "x9"]
    texts = [(int(i % 3 == 0), " ".join(rng.choice(bad if i % 3 else good, 8))) for i in range(80)]
    train = [(y, quality_classifier.indicators(t)) for y, t in texts[:60]]
    model = quality_classifier.fit(train)
    assert [model.score(t) for _, t in texts[60:]] == pytest.approx(plain_scores(train, [t for _, t in texts[60:]]).tolist(), abs=1e-9)


def test_hinge_loss_optimum():
    rows = [np.array([0]), np.array([0]), np.array([1]), np.array([1])]
    values = [np.array([1.0])] * 4
    w = quality_classifier.dual_coordinate_descent(rows, values, np.array([1, 1, 0, 0]), 2)
    assert w[0] == pytest.approx(1, abs=1e-2) and w[1] == pytest.approx(-1, abs=1e-2)
