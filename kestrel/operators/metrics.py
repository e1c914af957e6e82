"""Classification, regression and ranking metrics.

All metrics are aggregates over the whole table (map-side partial
aggregation, one small result).  Rank-based metrics use the distributed
global rank, never an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dcg_term
from .ranking import before_or_at, global_row_number, kth_row


def _div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """M1."""
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def prf_binary(df: DataFrame, y: str = "y", p: str = "pred", positive=1) -> DataFrame:
    """M2: precision, recall, F1 of the positive class (0 when undefined)."""
    yy, pp = F.col(y) == positive, F.col(p) == positive
    c = df.agg(F.sum((yy & pp).cast("double")).alias("tp"), F.sum((~yy & pp).cast("double")).alias("fp"),
               F.sum((yy & ~pp).cast("double")).alias("fn"))
    prec, rec = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(prec.alias("precision"), rec.alias("recall"),
                    _div(2 * prec * rec, prec + rec).alias("f1"))


def confusion_matrix(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """One row per observed (true, predicted) pair."""
    return df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")) \
             .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """D12 wide form: one column per listed value of ``b``."""
    from .relational import pivot_counts
    return pivot_counts(df, a, b, values)


def per_class_counts(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """(class, support, predicted, tp) for every class seen in y or pred."""
    rows = F.explode(F.array(
        F.struct(F.col(y).cast("string").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q"),
                 (F.col(y) == F.col(p)).cast("int").alias("tp")),
        F.struct(F.col(p).cast("string").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q"),
                 F.lit(0).alias("tp"))))
    return (df.select(rows.alias("r")).groupBy(F.col("r.c").alias("label"))
              .agg(F.sum("r.t").cast("bigint").alias("support"), F.sum("r.q").cast("bigint").alias("predicted"),
                   F.sum("r.tp").cast("bigint").alias("tp")))


def classification_report(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """M4: per class precision, recall, F1, support; accuracy; macro and
    weighted averages (the averaging runs over the per-class table)."""
    pc = per_class_counts(df, y, p)
    prec = _div(F.col("tp").cast("double"), F.col("predicted"))
    rec = _div(F.col("tp").cast("double"), F.col("support"))
    cls = pc.select("label", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    cls = cls.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall")))
    every = Window.partitionBy()  # over the per-class table only
    n = F.sum("support").over(every)
    summ = cls.select(
        F.avg("precision").over(every).alias("m_p"), F.avg("recall").over(every).alias("m_r"),
        F.avg("f1").over(every).alias("m_f"),
        (F.sum(F.col("precision") * F.col("support")).over(every) / n).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")).over(every) / n).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")).over(every) / n).alias("w_f"),
        (F.sum("tp").over(every) / n).alias("acc"), n.cast("bigint").alias("n")).limit(1)
    extra = summ.select(F.expr("""stack(3,
        'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n,
        'macro avg', m_p, m_r, m_f, n,
        'weighted avg', w_p, w_r, w_f, n) AS (label, precision, recall, f1, support)"""))
    return cls.select("label", "precision", "recall", "f1", "support").unionByName(extra)


def r2(df: DataFrame, y: str, p: str) -> DataFrame:
    """M5: 1 - RSS / TSS (null when the target is constant)."""
    a = df.agg(F.sum((F.col(y) - F.col(p)) ** 2).alias("rss"),
               (F.var_pop(y) * F.count(F.lit(1))).alias("tss"), F.count(F.lit(1)).alias("n"))
    return a.select((F.lit(1.0) - F.try_divide("rss", "tss")).alias("r2"), F.col("n").cast("bigint"))


def adj_r2(df: DataFrame, y: str, p: str, n_features: int) -> DataFrame:
    """M6: 1 - (1 - R²)(n - 1)/(n - p - 1) (null when n = p + 1)."""
    r = r2(df, y, p)
    return r.select("r2", (F.lit(1.0) - (F.lit(1.0) - F.col("r2")) * F.try_divide(
        F.col("n") - 1, F.col("n") - F.lit(n_features) - 1)).alias("adj_r2"))


def mse(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean squared error and sum of squares."""
    return df.agg(F.avg((F.col(y) - F.col(p)) ** 2).alias("mse"),
                  F.sum((F.col(y) - F.col(p)) ** 2).alias("sse"))


def log_loss(df: DataFrame, y: str, prob: str, eps: float = 1e-15) -> DataFrame:
    """Two-class cross-entropy, probabilities clipped to [eps, 1 - eps]."""
    q = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    ll = F.when(F.col(y) == 1, -F.log(q)).otherwise(-F.log(F.lit(1.0) - q))
    return df.agg(F.avg(ll).alias("log_loss"))


def bpr_loss_col(pos: str, neg: str, eps: float | None = None):
    """-log σ(s⁺ - s⁻) (stable log1p form; with ``eps`` the form
    -log(σ(d) + eps) of the original)."""
    d = F.col(pos) - F.col(neg)
    if eps is not None:
        return -F.log(F.lit(1.0) / (F.lit(1.0) + F.exp(-d)) + F.lit(eps))
    return F.when(d >= 0, F.log1p(F.exp(-d))).otherwise(-d + F.log1p(F.exp(d)))


def pairwise_loss(df: DataFrame, pos: str, neg: str) -> DataFrame:
    """M9: mean and sum of the pairwise loss."""
    l = bpr_loss_col(pos, neg)
    return df.agg(F.avg(l).alias("mean_loss"), F.sum(l).alias("sum_loss"),
                  F.count(F.lit(1)).cast("bigint").alias("n_pairs"))


def outcome_code(df: DataFrame, y: str = "y", p: str = "pred", out: str = "outcome") -> DataFrame:
    """Correct 1 → 2, correct 0 → 0, missed positive → -1, false positive → 1."""
    yy, pp = F.col(y), F.col(p)
    code = (F.when((yy == 1) & (pp == 1), 2).when((yy == 0) & (pp == 0), 0)
             .when((yy == 1) & (pp == 0), -1).when((yy == 0) & (pp == 1), 1))
    return df.withColumn(out, code.cast("int"))


def _disc(rn):
    return F.lit(1.0) / F.log2(rn + F.lit(1.0))


def _cutoff(n: int, k):
    if k is None:
        return n
    if 0 < k < 1:
        return int(k * n)
    if k >= 1:
        return int(k)
    raise ValueError("k must be None, in (0, 1), or >= 1")


def _first_ranked(base: DataFrame, order, cut: int) -> DataFrame:
    """The first ``cut`` rows of an order with their row number: a threshold row
    first, then only the rows up to it are sorted."""
    row, n, k = kth_row(base, order, lambda n: cut)
    if row is not None and k < n:
        base = base.filter(before_or_at(order, row))
    return global_row_number(base, order, "_rn")


def ndcg(df: DataFrame, y: str = "y", score: str = "score", k=None, key: str = "post_id") -> DataFrame:
    """M7: DCG with gain 2^y - 1 and discount 1/log2(rank + 1) over the
    first k rows by score (ties by key), divided by the ideal DCG; 0 when the
    ideal is 0.  k: None = all rows, (0, 1) = that share of rows, >= 1 = k rows."""
    base = df.select(key, F.col(y).cast("double").alias("_y"), F.col(score).alias("_s"))
    n = base.count()
    cut = _cutoff(n, k)
    pred = _first_ranked(base, [("_s", False), (key, True)], cut)
    ideal = _first_ranked(base, [("_y", False), (key, True)], cut)
    dcg = pred.filter(F.col("_rn") <= cut).agg(F.sum(dcg_term("_y", "_rn")).alias("dcg"))
    idcg = ideal.filter(F.col("_rn") <= cut).agg(F.sum(dcg_term("_y", "_rn")).alias("idcg"))
    d, i = dcg.first()["dcg"] or 0.0, idcg.first()["idcg"] or 0.0
    spark = df.sparkSession
    return spark.createDataFrame([(float(d / i) if i > 0 else 0.0, int(cut))], "ndcg DOUBLE, k BIGINT")


def ndcg_tie_averaged(df: DataFrame, y: str = "y", score: str = "pred", k=None, key: str = "post_id") -> DataFrame:
    """M8: linear gain; rows with equal scores share the mean gain of their
    group over the ranks the group occupies.  Because the group's discounts
    are summed over its whole rank range, which row takes which rank inside
    a group does not matter, so each row contributes mean_y(group) times the
    discount at its own global rank."""
    base = df.select(key, F.col(y).cast("double").alias("_y"), F.col(score).alias("_s"))
    n = base.count()
    cut = _cutoff(n, k)
    means = base.groupBy("_s").agg(F.avg("_y").alias("_my"))
    pred = global_row_number(base, [("_s", False), (key, True)], "_rn").join(means, "_s")
    ideal = global_row_number(base, [("_y", False), (key, True)], "_rn")
    dcg = pred.filter(F.col("_rn") <= cut).agg(F.sum(F.col("_my") * _disc(F.col("_rn"))).alias("v")).first()["v"]
    idcg = ideal.filter(F.col("_rn") <= cut).agg(F.sum(F.col("_y") * _disc(F.col("_rn"))).alias("v")).first()["v"]
    dcg, idcg = dcg or 0.0, idcg or 0.0
    spark = df.sparkSession
    return spark.createDataFrame([(float(dcg / idcg) if idcg > 0 else 0.0, int(cut))], "ndcg DOUBLE, k BIGINT")
