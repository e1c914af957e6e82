"""Bilinear ranker, patience and walk-forward evaluation against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from kestrel.operators import rankers as R


def loss(d):
    return float(np.mean(np.logaddexp(0, -d)))


def pair_rows(spark, rng, n, weights):
    """Pairs whose first member has the higher noisy product score."""
    x = rng.normal(size=(n, 2, 4))
    s = (x[..., :2] @ weights[0]) * (x[..., 2:] @ weights[1]) + rng.normal(scale=0.3, size=(n, 2))
    x = np.where((s[:, 0] >= s[:, 1])[:, None, None], x, x[:, ::-1])
    names = [p + c for p in ("", "neg_") for c in ("p1", "p2", "a1", "a2")]
    return x, spark.createDataFrame([tuple(map(float, r)) for r in x.reshape(n, 8)], ", ".join(f"{c} double" for c in names))


def test_bilinear_beats_linear_on_a_product(spark):
    x, pairs = pair_rows(spark, np.random.default_rng(1), 600, (np.array([1.0, -2.0]), np.array([1.5, 0.5])))
    linear = np.zeros(4)
    diffs = R.pair_diffs(pairs, ["p1", "p2", "a1", "a2"])
    for _ in range(5):
        linear = R.newton_step(diffs, ["p1", "p2", "a1", "a2"], linear)
    d = x[:, 0] - x[:, 1]
    before = loss(d @ linear)
    assert R.mean_loss(diffs, ["p1", "p2", "a1", "a2"], linear) == pytest.approx(before)
    m = R.fit_bilinear(pairs, ["p1", "p2"], ["a1", "a2"], list(linear), rounds=6)
    one = np.ones((len(x), 2, 1))
    score = ((np.concatenate((one, x[..., :2]), 2) @ m.u.T) * (np.concatenate((one, x[..., 2:]), 2) @ m.v.T)).sum(2)
    after = loss(score[:, 0] - score[:, 1])
    assert R.pair_loss(pairs, m) == pytest.approx(after) == pytest.approx(m.losses[-1])
    assert all(b <= a + 1e-12 for a, b in zip([before, *m.losses], m.losses, strict=False)) and after < 0.6 * before


def test_newton_step_is_newtons(spark):
    x, pairs = pair_rows(spark, np.random.default_rng(2), 300, (np.array([1.0, 1.0]), np.array([0.0, 0.0])))
    cols = ["p1", "p2", "a1", "a2"]
    d, w = x[:, 0] - x[:, 1], np.array([0.1, -0.2, 0.0, 0.3])
    p = 1 / (1 + np.exp(d @ w))
    step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-6 * np.eye(4), d.T @ p / len(d) - 1e-6 * w)
    best = min(R.STEP_SIZES, key=lambda t: loss(d @ (w + t * step)))
    assert R.newton_step(R.pair_diffs(pairs, cols), cols, w) == pytest.approx(w + best * step)
    empty = pairs.where("false")
    assert list(R.newton_step(R.pair_diffs(empty, cols), cols, w)) == list(w)


def test_patience_keeps_the_best_epoch(spark):
    cols = ["f", "g"]
    names = "f double, g double, neg_f double, neg_g double"
    train = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0)] * 8 + [(0.0, 0.5, 1.0, 0.0)] * 2, names)
    # the first epochs help validation too; then g's growing weight hurts it
    valid = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0)] * 6 + [(0.0, 0.0, 1.0, 0.6)] * 4, names)
    got = R.fit_with_patience(train, valid, cols, patience=2, max_epochs=30, rate=0.3)
    losses = [v for _, _, v in got.history]
    assert got.epoch == int(np.argmin(losses)) + 1 and len(losses) == got.epoch + 2 < 30
    assert R.mean_loss(R.pair_diffs(valid, cols), cols, got.weights) == pytest.approx(min(losses))
    worse = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], names)  # the higher g loses
    stopped = R.fit_with_patience(train, worse, cols, patience=2)
    assert stopped.epoch == 1 and len(stopped.history) == 3
    assert R.fit_with_patience(train.where("false"), valid, cols).history == []


def test_rounds_are_judged_separately(spark):
    rng = np.random.default_rng(3)
    rows = [(r, 100 * r + i, int(rng.random() < 0.2), float(rng.integers(0, 12))) for r in (1, 2, 5) for i in range(57)]
    df = spark.createDataFrame(rows, "round int, post_id long, y int, score double").repartition(4)
    got = {r["round"]: r for r in R.evaluate_rounds(df, fraction=0.1).collect()}
    for r in (1, 2, 5):
        own = sorted((x for x in rows if x[0] == r), key=lambda x: (-x[3], x[1]))
        least = own[5][3]
        hit = [x[3] >= least for x in own]
        tp, pos = sum(x[2] for x, h in zip(own, hit, strict=True) if h), sum(x[2] for x in own)
        dcg = sum(x[2] / math.log2(k + 2) for k, x in enumerate(own))
        assert (got[r]["n"], got[r]["positives"], got[r]["predicted"]) == (57, pos, sum(hit))
        assert got[r]["precision"] == pytest.approx(tp / sum(hit)) and got[r]["recall"] == pytest.approx(tp / pos)
        assert got[r]["ndcg"] == pytest.approx(dcg / sum(1 / math.log2(k + 2) for k in range(pos)))


def test_registered_rankers(spark, sf):
    import __spark_entry__ as E
    q = E.queries()
    both = {r["model"]: r["mean_loss"] for r in q["bilinear_ranker"](spark, sf).collect()}
    assert both["bilinear"] <= both["linear"] <= math.log(2)
    epochs = q["early_stop_ranker"](spark, sf).collect()
    assert [r["valid_loss"] for r in epochs if r["best"]] == [min(r["valid_loss"] for r in epochs)]
    rounds = q["walk_forward"](spark, sf).collect()
    assert [r["round"] for r in sorted(rounds, key=lambda r: r["round"])] == [1, 2, 3, 4]
    assert all(0 <= r["ndcg"] <= 1 and r["mean_loss"] > 0 for r in rounds)
