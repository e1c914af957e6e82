"""Pairwise rankers beyond the linear one, their early stopping, and walk-forward
evaluation (SURVEY L8, L9, L10, G3).

A fit is a driver loop over small vectors: each step is one aggregate over the
pairs (sums of the gradient and of the Hessian's upper triangle), whatever the
number of rows.  Nulls in a feature drop the pair; without pairs the start
weights come back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import bpr_loss_col
from .ranking import global_row_number

STEP_SIZES = (1.0, 0.5, 0.25, 0.0625, 0.0)  # of a Newton step; 0 keeps the weights


def _margin(cols: list[str], w) -> Column:
    return sum((F.col(c) * F.lit(float(v)) for c, v in zip(cols, w, strict=True)), F.lit(0.0))


def _loss(margin: Column) -> Column:
    return F.avg(F.when(margin >= 0, F.log1p(F.exp(-margin))).otherwise(-margin + F.log1p(F.exp(margin))))


def newton_step(diffs: DataFrame, cols: list[str], w: np.ndarray, reg: float = 1e-6) -> np.ndarray:
    """One damped Newton step on the mean of -log σ(w·d) over the rows of `diffs`
    (columns `cols`): two aggregates, and the loss never rises."""
    m = _margin(cols, w)
    p = 1 / (1 + F.exp(m))
    both = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    sums = diffs.withColumn("_p", p).agg(
        F.count(F.lit(1)), *[F.sum(F.col(c) * F.col("_p")) for c in cols],
        *[F.sum(F.col(cols[a]) * F.col(cols[b]) * F.col("_p") * (1 - F.col("_p"))) for a, b in both]).first()
    n = sums[0]
    if not n:
        return w
    grad = np.array(sums[1:1 + len(cols)], float) / n - reg * w
    hess = np.zeros((len(cols), len(cols)))
    for (a, b), v in zip(both, sums[1 + len(cols):], strict=True):
        hess[a, b] = hess[b, a] = v / n
    step = np.linalg.lstsq(hess + reg * np.eye(len(cols)), grad, rcond=None)[0]
    losses = diffs.agg(*[_loss(_margin(cols, w + t * step)) for t in STEP_SIZES]).first()
    return w + STEP_SIZES[int(np.argmin(losses))] * step


def mean_loss(diffs: DataFrame, cols: list[str], w) -> float | None:
    return diffs.agg(_loss(_margin(cols, w))).first()[0]


def pair_diffs(pairs: DataFrame, cols: list[str], neg_prefix: str = "neg_") -> DataFrame:
    """x+ - x-, one column per feature."""
    return pairs.select(*[(F.col(c).cast("double") - F.col(neg_prefix + c).cast("double")).alias(c) for c in cols]).na.drop()


# ------------------------------------------------------------ L8, post x author


@dataclass
class BilinearRanker:
    """score = Σ_k (u_k · [1, post]) (v_k · [1, author])."""

    post: list[str]
    author: list[str]
    u: np.ndarray            # k x (1 + post features)
    v: np.ndarray            # k x (1 + author features)
    losses: list[float] = field(default_factory=list)

    def _side(self, cols: list[str], weights: np.ndarray, prefix: str) -> list[Column]:
        x = [F.lit(1.0), *[F.col(prefix + c).cast("double") for c in cols]]
        return [sum((a * F.lit(float(b)) for a, b in zip(x, row, strict=True)), F.lit(0.0)) for row in weights]

    def score(self, prefix: str = "") -> Column:
        left, right = self._side(self.post, self.u, prefix), self._side(self.author, self.v, prefix)
        return sum((a * b for a, b in zip(left, right, strict=True)), F.lit(0.0))


def fit_bilinear(pairs: DataFrame, post: list[str], author: list[str], start: list[float] | None = None,
                 rounds: int = 4, reg: float = 1e-6) -> BilinearRanker:
    """L8 with the product of a post vector and an author vector (two factors).

    With one side fixed the score is linear in the other, so each half round is
    a Newton step of the pairwise loss.  `start` are linear weights (post, then
    author features): two factors hold a linear score exactly, so the loss starts at
    the linear ranker's and never rises."""
    w = np.zeros(len(post) + len(author)) if start is None else np.array(start, float)
    u = np.zeros((2, 1 + len(post)))
    v = np.zeros((2, 1 + len(author)))
    u[0, 1:], v[0, 0] = w[:len(post)], 1.0   # post weights x 1
    u[1, 0], v[1, 1:] = 1.0, w[len(post):]   # 1 x author weights
    m = BilinearRanker(post, author, u, v)
    every = [*post, *author]
    pairs = pairs.select(*[F.col(p + c).cast("double").alias(p + c) for p in ("", "neg_") for c in every]).na.drop()

    def half(moving: list[str], fixed: list[Column], fixed_neg: list[Column], weights: np.ndarray):
        names, cols = [], []
        for k in range(2):
            for j, c in enumerate([None, *moving]):
                a = F.lit(1.0) if c is None else F.col(c)
                b = F.lit(1.0) if c is None else F.col("neg_" + c)
                names.append(f"z{k}_{j}")
                cols.append((fixed[k] * a - fixed_neg[k] * b).alias(names[-1]))
        diffs = pairs.select(*cols)
        new = newton_step(diffs, names, weights.ravel(), reg)
        m.losses.append(mean_loss(diffs, names, new))
        return new.reshape(weights.shape)

    for _ in range(rounds):
        m.u = half(post, m._side(author, m.v, ""), m._side(author, m.v, "neg_"), m.u)
        m.v = half(author, m._side(post, m.u, ""), m._side(post, m.u, "neg_"), m.v)
    return m


# ------------------------------------------------------------------ L10, patience


@dataclass
class Stopped:
    weights: list[float]     # of the best epoch
    epoch: int               # the best epoch (1-based; 0: the start weights)
    history: list[tuple[int, float, float]]  # (epoch, training loss, validation loss)


def fit_with_patience(train: DataFrame, valid: DataFrame, cols: list[str], start: list[float] | None = None, patience: int = 2,
                      max_epochs: int = 20, rate: float = 0.5, reg: float = 1e-6) -> Stopped:
    """Epochs of a pairwise linear ranker (`rate` of a Newton step each) with a
    validation pass after each; stops after `patience` epochs without a lower validation
    loss and returns the best epoch's weights."""
    t, v = pair_diffs(train, cols), pair_diffs(valid, cols)
    w = np.zeros(len(cols)) if start is None else np.array(start, float)
    best, best_loss, best_epoch, waited, history = w, np.inf, 0, 0, []
    for epoch in range(1, max_epochs + 1):
        w = w + rate * (newton_step(t, cols, w, reg) - w)
        train_loss, valid_loss = mean_loss(t, cols, w), mean_loss(v, cols, w)
        if valid_loss is None or train_loss is None:  # nothing to fit or to judge by
            break
        history.append((epoch, train_loss, valid_loss))
        if valid_loss < best_loss:
            best, best_loss, best_epoch, waited = w, valid_loss, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return Stopped([float(x) for x in best], best_epoch, history)


# -------------------------------------------------------- G3, test r + 1 after round r


def evaluate_rounds(scored: DataFrame, round_col: str = "round", label: str = "y", score: str = "score", key: str = "post_id",
                    fraction: float = 0.01) -> DataFrame:
    """One row per round: n, positives, predicted, accuracy, precision, recall, f1, ndcg.

    The first int(n * fraction) + 1 rows of a round by score, and what ties with the
    last of them, count as predicted positives; NDCG takes all rows (gain 2^y - 1,
    y 0 or 1, ties by key).  All rounds share one range sort by (round, score); ranks
    within a round come from the rounds' sizes, a table of one row per round."""
    base = scored.select(F.col(round_col).alias("round"), F.col(label).cast("int").alias("y"), F.col(score).alias("s"), F.col(key).alias("k"))
    ranked = global_row_number(base, [("round", True), ("s", False), ("k", True)], "rn")
    sizes = sorted(tuple(r) for r in base.groupBy("round").agg(F.count("*"), F.sum("y")).collect())
    spark, before, rows = scored.sparkSession, 0, []
    for r, n, positives in sizes:
        rows.append((r, before, n, positives))
        before += n
    kind = base.schema["round"].dataType.simpleString()
    sizes = F.broadcast(spark.createDataFrame(rows, f"round {kind}, before long, n long, positives long"))
    ranked = ranked.join(sizes, "round").withColumn("rank", F.col("rn") - F.col("before"))
    last = ranked.where(F.col("rank") == F.floor(F.col("n") * fraction) + 1).select("round", F.col("s").alias("least"))
    ranked = ranked.join(F.broadcast(last), "round")  # one row per round
    hit = (F.col("s") >= F.col("least")).cast("int")
    term = 1 / F.log2(F.col("rank") + 1.0)
    c = ranked.withColumn("p", hit).groupBy("round").agg(
        F.count("*").alias("n"), F.sum("y").alias("positives"), F.sum("p").alias("predicted"),
        F.sum(F.col("y") * F.col("p")).alias("tp"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"),
        F.sum(F.when(F.col("y") == 1, term).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= F.col("positives"), term).otherwise(0.0)).alias("idcg"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = zero(F.col("tp"), F.col("predicted")), zero(F.col("tp"), F.col("positives"))
    return c.select("round", "n", "positives", "predicted", "accuracy", precision.alias("precision"), recall.alias("recall"),
                    zero(2 * precision * recall, precision + recall).alias("f1"), zero(F.col("dcg"), F.col("idcg")).alias("ndcg"))


def walk_forward(pairs_by_round: dict, test_pairs_by_round: dict, test_rows: DataFrame, cols: list[str], steps: int = 3,
                 fraction: float = 0.01) -> tuple[dict, DataFrame]:
    """Train round r from the weights of round r - 1, then test on the period
    that follows.  test_rows (round, post_id, y, features) are the tested posts.
    Returns {round: weights} and evaluate_rounds' rows with mean_loss over the
    round's test pairs (null without pairs)."""
    weights, w = {}, np.zeros(len(cols))
    for r in sorted(pairs_by_round):
        diffs = pair_diffs(pairs_by_round[r], cols)
        for _ in range(steps):
            w = newton_step(diffs, cols, w)
        weights[r] = [float(x) for x in w]
    spark = test_rows.sparkSession
    losses = [(r, mean_loss(pair_diffs(test_pairs_by_round[r], cols), cols, weights[r])) for r in sorted(weights)]
    score = F.lit(0.0)
    for r, own in weights.items():
        score = F.when(F.col("round") == r, _margin(cols, own)).otherwise(score)
    scored = test_rows.where(F.col("round").isin(*weights)).select("round", "post_id", "y", score.alias("score"))
    rows = evaluate_rounds(scored, fraction=fraction)
    kind = rows.schema["round"].dataType.simpleString()
    return weights, rows.join(F.broadcast(spark.createDataFrame(losses, f"round {kind}, mean_loss double")), "round")


def pair_loss(pairs: DataFrame, model: BilinearRanker) -> float:
    """Mean pairwise loss of a bilinear ranker."""
    s = pairs.select(model.score().alias("a"), model.score("neg_").alias("b"))
    return s.agg(F.avg(bpr_loss_col("a", "b"))).first()[0]
