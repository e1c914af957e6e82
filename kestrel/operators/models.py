"""Models on Spark ML.

Training data stays distributed: every fit is a Spark ML estimator
(tree-aggregated gradients / histograms), cross-validation folds are
DataFrame filters, and grid points can run in parallel (``parallelism``).
The driver only loops over grid points or elimination steps.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, StandardScaler, VectorAssembler, VectorSlicer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FOREST_GRID, GBT_GRID, LOGISTIC_CS, MAX_RANK
from . import trees as TR
from .encode import class_weights
from .ranking import label_top_fraction


#: rows up to which a single forest is Spark's own
FEW_ROWS = 100_000


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """J8.  A null feature becomes, by rule, one past the rank cap (``*_rank``
    columns) or -1 (codes and flags) before assembling."""
    fill = {c: MAX_RANK + 1 if c.endswith("_rank") else -1 for c in cols}
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df.na.fill(fill))


def param_grid(estimator, grid: dict):
    """A parameter sweep as a ParamGridBuilder grid (every listed value
    of every parameter is used)."""
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    return b.build()


def _accuracy_eval(label: str):
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")


def _folded(train: DataFrame, folds: int, seed: int) -> DataFrame:
    """A fold 0 .. folds - 1 for each row, drawn as Spark's cross validation draws it."""
    return train.withColumn("_fold", F.floor(F.rand(seed) * folds).cast("int"))


def fit_gbt_grid(train: DataFrame, label: str = "viral", features: str = "features", grid: dict | None = None,
                 folds: int = 3, parallelism: int = 4, seed: int = 42):
    """L1: boosted trees, grid searched by k-fold accuracy, best refitted.  The
    default grid is the study's (config.GBT_GRID, 3^5 = 243 points), fitted as 81 chains a fold
    (``trees.boosted_scores``); more cells than a task can hold are left to Spark's estimator."""
    grid = grid or GBT_GRID
    points = grid_points(grid)
    c = TR.cells(_folded(train, folds, seed), features, label, "_fold", folds) if set(grid) <= set(TR.GBT_DEFAULTS) else None
    if c is None:
        gbt = GBTClassifier(labelCol=label, featuresCol=features, seed=seed)
        return CrossValidator(estimator=gbt, estimatorParamMaps=param_grid(gbt, grid), evaluator=_accuracy_eval(label),
                              numFolds=folds, parallelism=parallelism, seed=seed).fit(train)
    scores = TR.boosted_scores(c, points, list(range(folds)), seed)
    means = [TR.mean_accuracy([scores[i, k] for k in range(folds)]) for i in range(len(points))]
    return TR.Searched(TR.fit_boosted(c, features, seed, **points[int(np.argmax(means))]), means, points)


def forest(label: str = "viral", features: str = "features", seed: int = 42, **params) -> RandomForestClassifier:
    """A forest estimator that keeps each row's node of every tree between levels, so that no level
    walks the rows down from the roots again or ships the trees; the fitted trees are the same."""
    return RandomForestClassifier(labelCol=label, featuresCol=features, seed=seed, cacheNodeIds=True, **params)


def fit_forest_cv(train: DataFrame, label: str = "viral", features: str = "features", grid: dict | None = None,
                  folds: int = 5, parallelism: int = 4, seed: int = 42):
    """L2: random forest with k-fold search over depth × trees (default
    config.FOREST_GRID, 15 points, which share their trees: ``trees.forest_scores``); more cells
    than a task can hold are left to Spark's estimator."""
    grid = grid or FOREST_GRID
    points = [{**TR.FOREST_DEFAULTS, **p} for p in grid_points(grid)]
    c = TR.cells(_folded(train, folds, seed), features, label, "_fold", folds) if set(grid) <= set(TR.FOREST_DEFAULTS) else None
    if c is None:
        rf = forest(label, features, seed)
        return CrossValidator(estimator=rf, estimatorParamMaps=param_grid(rf, grid), evaluator=_accuracy_eval(label),
                              numFolds=folds, parallelism=parallelism, seed=seed).fit(train)
    scores = TR.forest_scores(c, points, list(range(folds)), seed)
    means = [TR.mean_accuracy([scores[p["maxDepth"], p["numTrees"], k] for k in range(folds)]) for p in points]
    return TR.Searched(TR.fit_forest(c, features, seed, **points[int(np.argmax(means))]), means, points)


def fit_forest_fixed(train: DataFrame, label: str = "viral", features: str = "features",
                     depth: int = 20, trees: int = 80, seed: int = 42):
    """L2 final model with the hard-coded depth and size (maxDepth capped at Spark's 30).  Up to
    FEW_ROWS rows it is Spark's own forest; above, where Spark's statistics of all nodes of all
    trees for each partition take minutes a level, one on cells: same rules, other draws."""
    if train.count() > FEW_ROWS:
        c = TR.cells(train.withColumn("_fold", F.lit(0)), features, label, "_fold", 1)
        if c is not None:
            return TR.fit_forest(c, features, seed, min(depth, 30), trees)
    return forest(label, features, seed, maxDepth=min(depth, 30), numTrees=trees).fit(train)


def with_class_weights(df: DataFrame, label: str, out: str = "weight", count: str | None = None) -> DataFrame:
    """J6 weights attached to every row (join with the per-class table); a row that stands for
    ``count`` rows weighs as many times as much."""
    w = class_weights(df, label, count).select(label, F.col("weight").alias(out))
    if count:
        return df.join(F.broadcast(w), label, "left").withColumn(out, F.col(out) * F.col(count))
    return df.join(F.broadcast(w), label, "left")  # one row per class


def fit_logistic_grid(train: DataFrame, label: str = "viral", features: str = "features",
                      cs: list[float] | None = None, weighted: bool = True, folds: int = 3,
                      parallelism: int = 4, seed: int = 42):
    """L3: L2 logistic regression, C on a log grid; sklearn's C maps to
    ``regParam = 1 / (C · n)``; balanced class weights when ``weighted``."""
    n = train.count() * (folds - 1) / folds  # rows that each fit of the search sees
    cs = cs or LOGISTIC_CS
    data = with_class_weights(train, label) if weighted else train
    lr = LogisticRegression(labelCol=label, featuresCol=features, elasticNetParam=0.0, standardization=False,
                            maxIter=100, **({"weightCol": "weight"} if weighted else {}))
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * n) for c in cs]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=_accuracy_eval(label),
                        numFolds=folds, parallelism=parallelism, seed=seed)
    return cv.fit(data)


def _unit_deviation(data: DataFrame, cols: list[str], count: str) -> list[float]:
    """1 / sample deviation of each column (0 without spread), rows standing for ``count`` rows."""
    n, *means = data.agg(F.sum(count), *[F.sum(F.col(c) * F.col(count)) / F.sum(count) for c in cols]).first()
    if not n or n < 2:
        return [0.0] * len(cols)
    squares = data.agg(*[F.sum((F.col(c) - F.lit(m)) ** 2 * F.col(count)) for c, m in zip(cols, means, strict=True)]).first()
    return [1 / (q / (n - 1)) ** 0.5 if q > 0 else 0.0 for q in squares]


def rfe(df: DataFrame, feature_cols: list[str], label: str = "viral", keep: int = 5, step: int = 1, count: str | None = None):
    """L4: recursive elimination by |coefficient|; returns [(feature, rank)],
    rank 1 = kept.  Each fit is distributed; the driver only drops columns.  With ``count``
    a row stands for so many equal rows."""
    data = with_class_weights(assemble(df, feature_cols, "_raw"), label, count=count)
    # unit deviation, so that coefficient sizes can be compared
    if count:
        unit = Vectors.dense(_unit_deviation(df, feature_cols, count))
        data = ElementwiseProduct(scalingVec=unit, inputCol="_raw", outputCol="_all").transform(data)
    else:
        data = StandardScaler(inputCol="_raw", outputCol="_all").fit(data).transform(data)
    reg = 1.0 / max(1, (df.agg(F.sum(count)).first()[0] or 0) if count else df.count())
    remaining = list(range(len(feature_cols)))
    ranks = {}
    rank = len(feature_cols) - keep + 1
    while len(remaining) > keep:
        sl = VectorSlicer(inputCol="_all", outputCol="_f", indices=remaining)
        m = LogisticRegression(labelCol=label, featuresCol="_f", weightCol="weight", regParam=reg, standardization=False,
                               maxIter=50).fit(sl.transform(data))
        coefs = list(m.coefficients.toArray())
        drop = sorted(range(len(remaining)), key=lambda i: abs(coefs[i]))[:min(step, len(remaining) - keep)]
        for i in sorted(drop, reverse=True):
            ranks[feature_cols[remaining[i]]] = rank
            del remaining[i]
        rank -= 1
    for i in remaining:
        ranks[feature_cols[i]] = 1
    return sorted(ranks.items(), key=lambda kv: (kv[1], kv[0]))


def feature_importance(spark, model, cols: list[str]) -> DataFrame:
    """(feature, importance) sorted by importance descending."""
    if hasattr(model, "featureImportances"):
        imp = list(model.featureImportances.toArray())
    else:
        imp = [abs(x) for x in model.coefficients.toArray()]
    df = spark.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature STRING, importance DOUBLE")
    return df.orderBy(F.col("importance").desc(), "feature")


def fit_linear(df: DataFrame, features: str, targets: list[str], reg: float = 0.0, l1: bool = False):
    """One linear regression per target (``l1``: true lasso penalty)."""
    return {t: LinearRegression(featuresCol=features, labelCol=t, regParam=reg,
                                elasticNetParam=1.0 if l1 else 0.0).fit(df) for t in targets}


def pair_difference(pairs: DataFrame, cols: list[str], neg_prefix: str = "neg_") -> DataFrame:
    """L8 input: x⁺ − x⁻ labelled 1 and its mirror labelled 0, as columns."""
    d = [(F.col(c).cast("double") - F.col(neg_prefix + c).cast("double")).alias(f"d_{c}") for c in cols]
    pos = pairs.select(*d, F.lit(1.0).alias("label"))
    neg = pos.select(*[(-F.col(f"d_{c}")).alias(f"d_{c}") for c in cols], F.lit(0.0).alias("label"))
    return pos.unionByName(neg)


def fit_pairwise_ranker(pairs: DataFrame, cols: list[str], reg: float = 0.0, max_iter: int = 100):
    """Minimising −log σ(s⁺ − s⁻) for a linear score s = w·x is exactly a
    logistic regression without intercept on x⁺ − x⁻ (and its mirror)."""
    d = assemble(pair_difference(pairs, cols), [f"d_{c}" for c in cols])
    return LogisticRegression(featuresCol="features", labelCol="label", fitIntercept=False, regParam=reg,
                              maxIter=max_iter, standardization=False).fit(d)


def ranker_score(model, df: DataFrame, cols: list[str], out: str = "score") -> DataFrame:
    """Linear score with a fitted ranker or a list of weights."""
    w = model if isinstance(model, list) else list(model.coefficients.toArray())
    s = sum((F.col(c).cast("double") * F.lit(float(wi)) for c, wi in zip(cols, w)), F.lit(0.0))
    return df.withColumn(out, s)


def ranker_steps(pairs: DataFrame, cols: list[str], start: list[float] | None = None, steps: int = 8,
                 reg: float = 1e-6) -> list[float]:
    """``steps`` Newton steps on the mean of -log σ(w·(x⁺ − x⁻)) from weights
    ``start`` (zeros if None).  Each step is one aggregate over the pairs; the
    driver gets d + d(d+1)/2 sums and solves a d × d system."""
    d = [(F.col(c).cast("double") - F.col("neg_" + c).cast("double")) for c in cols]
    x = pairs.select(*[v.alias(f"d{k}") for k, v in enumerate(d)]).na.drop()
    w = np.zeros(len(cols)) if start is None else np.array(start, float)
    for _ in range(steps):
        margin = sum((F.col(f"d{k}") * F.lit(float(v)) for k, v in enumerate(w)), F.lit(0.0))
        p = 1 / (1 + F.exp(margin))  # derivative of the loss, up to sign
        both = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
        sums = x.withColumn("_p", p).agg(
            F.count(F.lit(1)), *[F.sum(F.col(f"d{a}") * F.col("_p")) for a in range(len(cols))],
            *[F.sum(F.col(f"d{a}") * F.col(f"d{b}") * F.col("_p") * (1 - F.col("_p"))) for a, b in both]).first()
        n = sums[0]
        if not n:
            break
        grad = np.array(sums[1:1 + len(cols)], float) / n - reg * w
        hess = np.zeros((len(cols), len(cols)))
        for (a, b), v in zip(both, sums[1 + len(cols):], strict=True):
            hess[a, b] = hess[b, a] = v / n
        w = w + np.linalg.solve(hess + reg * np.eye(len(cols)), grad)
    return [float(v) for v in w]


def train_rounds(pairs_by_round: dict, cols: list[str], steps: int = 3):
    """Continual training over walk-forward rounds.  Round r starts from the
    weights of round r-1 and takes a few steps on its own pairs only; returns
    {round: weights}."""
    weights, w = {}, None
    for r in sorted(pairs_by_round):
        w = ranker_steps(pairs_by_round[r], cols, w, steps)
        weights[r] = w
    return weights


def fit_gbt_early_stop(train: DataFrame, valid: DataFrame, label: str = "viral", features: str = "features",
                       tol: float = 0.01, max_iter: int = 100, seed: int = 42):
    """Boosting stops when the validation error stops improving by ``tol``."""
    data = train.withColumn("_is_valid", F.lit(False)).unionByName(valid.withColumn("_is_valid", F.lit(True)))
    return GBTClassifier(labelCol=label, featuresCol=features, maxIter=max_iter, validationIndicatorCol="_is_valid",
                         validationTol=tol, seed=seed).fit(data)


def contributions(df: DataFrame, cols: list[str], weights: list[float], out: str = "feature_attention") -> DataFrame:
    """Per-feature contribution wᵢ·xᵢ, softmax-normalised per row."""
    terms = [F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(cols, weights)]
    arr = F.array(*terms)
    mx = F.array_max(arr)
    ex = F.transform(arr, lambda v: F.exp(v - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    return df.withColumn(out, F.transform(ex, lambda v: v / tot)).withColumn(
        "features_list", F.array(*[F.lit(c) for c in cols]))


def score_and_report(model, test: DataFrame, cols: list[str], label: str = "viral", key: str = "post_id",
                     fraction: float = 0.01) -> DataFrame:
    """Score the test rows, label the top ``fraction`` as 1, and attach
    per-feature contributions."""
    s = ranker_score(model, test, cols)
    s = label_top_fraction(s, "score", fraction, key=key, out="pred")
    return contributions(s, cols, list(model.coefficients.toArray()))


# ---------------------------------------------------------------- text models


def n_tokens(df: DataFrame, tokens: str) -> int:
    """Number of different tokens (at least 1)."""
    return max(1, df.select(F.explode(tokens).alias("t")).agg(F.countDistinct("t")).first()[0])


def fit_embedder(df: DataFrame, tokens: str, dim: int = 64, seed: int = 42, min_count: int = 1):
    """T11 default embedder: Word2Vec, a document vector is the mean of its words."""
    return Word2Vec(vectorSize=dim, minCount=min_count, inputCol=tokens, outputCol="embedding_vec",
                    seed=seed, maxIter=1).fit(df)


def embed_text_with(df: DataFrame, make_predict_fn, input_col: str, dim: int, batch_size: int = 64,
                    out: str = "embedding"):
    """T11 pluggable encoder: a user-supplied batch model through
    ``predict_batch_udf`` (Arrow batches, model loaded once per worker)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(input_col)))


def embed_tokens(df: DataFrame, ids: str, make_encoder, length: int, batch_size: int = 64,
                 out: str = "embedding") -> DataFrame:
    """Batch inference over token ids of fixed ``length`` (see ``encode_tokens``).

    ``make_encoder`` is called once per worker and gives a function from an int array
    (batch, length) to the last hidden states (batch, length, dim); the embedding is their
    mean over all positions, padded ones included (no mask, as in the study)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    def make_predict_fn():
        encode = make_encoder()
        return lambda batch: encode(batch.astype("int64")).mean(axis=1)

    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[length]])
    return df.withColumn(out, udf(F.col(ids)))


def hashed_encoder(dim: int = 8):
    """An encoder that needs no files: the state of token id t at position p (from 0) is,
    in dimension d, ((31 t + 17 p + 1) (2 d + 1) mod 1009) / 1009."""
    def make():
        import numpy as np
        odd = 2 * np.arange(dim, dtype=np.int64) + 1

        def encode(ids):
            place = np.arange(ids.shape[1], dtype=np.int64)
            state = 31 * ids + 17 * place[None, :] + 1
            return (state[:, :, None] * odd % 1009) / 1009.0
        return encode
    return make


def fit_topic_classifier(train: DataFrame, features: str, label: str, n_in: int, n_classes: int,
                         hidden: tuple = (128, 128), max_iter: int = 100, seed: int = 42):
    """Multilayer perceptron n_in → 128 → 128 → classes."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                          layers=[n_in, *hidden, n_classes], maxIter=max_iter,
                                          seed=seed, blockSize=128).fit(train)


def fit_sentiment_labeller(train: DataFrame, tokens: str, label: str, vocab_size: int | None = None):
    """T15 default model: logistic regression on bag-of-words."""
    cv = CountVectorizer(inputCol=tokens, outputCol="bow", vocabSize=vocab_size or n_tokens(train, tokens))
    lr = LogisticRegression(featuresCol="bow", labelCol=label, maxIter=50, regParam=0.01)
    return Pipeline(stages=[cv, lr]).fit(train)


def grid_points(grid: dict):
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in product(*[grid[k] for k in keys])]
