"""Parameter search that can be resumed, and encoders fitted inside each fold
(SURVEY 2.10 L1-L4, L13; 2.8 J4-J6).

Rows get their fold by hash and are stored once.  Each (point, fold) is one Spark
fit whose result is one row in a folder of its own, written aside and renamed:
a search that was ended fits only what is missing when it is started again, and
one that gets more points fits only these.  Points of a forest are fitted together, a
fold at a time.  The driver holds the grid and one
accuracy per point.

Statistics of all folds come from two aggregates over the stored rows, whatever
the number of folds: the training side of fold k is everything less fold k.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from math import sqrt
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..sources.tables import is_complete, materialize_once
from .trees import cells, forest_scores

RESULT = "params STRING, fold INT, n BIGINT, correct BIGINT"


def with_folds(df: DataFrame, key: str, folds: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold 0 .. folds - 1 of every row by md5 of (seed, key): the same in any run."""
    return df.withColumn(out, F.pmod(hash_int(seed, F.col(key)), F.lit(folds)).cast("int"))


def point_name(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


def result_path(store: str, params: dict, fold: int) -> str:
    return f"{store}/results/{hashlib.md5(point_name(params).encode()).hexdigest()}-{fold}"


def search(rows: DataFrame, fit: Callable, points: list[dict], store: str, folds: int, label: str = "viral",
           parallelism: int = 4, count: str | None = None) -> DataFrame:
    """(params, fold, n, correct) for every point of the grid and every fold of
    ``rows`` (a column ``fold``, see ``with_folds``).  ``fit(train, params, fold)``
    gives a function from rows to rows with ``prediction``.

    ``store`` is a folder for this input, code and way of fitting; results found
    there are not computed again.  A fold without rows counts 0 of 0; an error in
    one fit ends the search and keeps the finished results.  Points named twice are
    fitted once; an empty grid gives no rows.  Where ``fit`` can score the points of a
    fold together (``shared``), what a fold lacks is fitted in one go.  With ``count`` a row
    stands for so many equal rows."""
    times = F.col(count) if count else F.lit(1)
    spark = rows.sparkSession
    todo = {(point_name(p), k): (p, k) for p in points for k in range(folds)}

    def run(job):
        params, fold = job
        path = result_path(store, params, fold)
        if not is_complete(spark, path):
            predict = fit(rows.where(F.col("fold") != fold), params, fold)
            hit = (F.col("prediction") == F.col(label)).cast("bigint") * times
            row = predict(rows.where(F.col("fold") == fold)).agg(F.coalesce(F.sum(times), F.lit(0)).alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("correct"))
            row = row.select(F.lit(point_name(params)).alias("params"), F.lit(fold).alias("fold"), "n", "correct")
            materialize_once(row.coalesce(1), path, spark)
        return path

    def kept(got):
        params, fold, n, correct = got
        row = spark.range(1, numPartitions=1).select(F.lit(point_name(params)).alias("params"), F.lit(fold).alias("fold"), F.lit(n).cast("bigint").alias("n"),
                                                     F.lit(correct).cast("bigint").alias("correct"))
        materialize_once(row, result_path(store, params, fold), spark)

    pool = ThreadPool(max(1, min(parallelism, len(todo))))
    try:
        if hasattr(fit, "shared") and not count:
            lacking = [job for job in todo.values() if not is_complete(spark, result_path(store, *job))]
            scores = fit.shared(rows, [p for i, (p, _) in enumerate(lacking) if p not in [q for q, _ in lacking[:i]]], folds, label) if lacking else None
            by_fold = [(k, [p for p, f in lacking if f == k]) for k in sorted({f for _, f in lacking})] if scores else []
            for got in pool.imap_unordered(inheritable_thread_target(spark)(lambda job: scores(job[1], job[0])), by_fold):
                pool.map(inheritable_thread_target(spark)(kept), got, chunksize=1)
        paths = pool.map(inheritable_thread_target(spark)(run), todo.values(), chunksize=1)
    finally:
        pool.close()
    if not paths:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*paths)


def point_scores(results: DataFrame) -> DataFrame:
    """(params, accuracy, folds): mean of the folds' accuracies, empty folds aside."""
    return results.groupBy("params").agg(F.avg(F.when(F.col("n") > 0, F.col("correct") / F.col("n"))).alias("accuracy"),
                                         F.count(F.lit(1)).alias("folds"))


def best_point(results: DataFrame, points: list[dict]) -> dict:
    """The point of the highest mean accuracy, the first of the grid among equals
    (one row per point reaches the driver)."""
    score = {r["params"]: -1.0 if r["accuracy"] is None else r["accuracy"] for r in point_scores(results).collect()}
    return max(points, key=lambda p: score[point_name(p)])  # max keeps the first


# ------------------------------------------------ encoders of one training side


@dataclass(frozen=True)
class Encoding:
    """What the encoders learnt from one training side."""

    stats: dict     # numeric column -> (mean, population deviation)
    levels: dict    # categorical column -> levels in order
    weights: dict   # label -> balanced class weight

    def names(self) -> list[str]:
        return [f"z_{c}" for c in self.stats] + [f"{c}_{i}" for c, v in self.levels.items() for i in range(len(v))]


def fold_moments(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """(fold, column, n, mean, m2): moments of the non-null values per fold."""
    one = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in numeric]
    long = rows.select("fold", F.explode(F.array(*one)).alias("v")).select("fold", "v.column", "v.x")
    return long.groupBy("fold", "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"),
                                              (F.var_pop("x") * F.count("x")).alias("m2"))


def fold_levels(rows: DataFrame, categorical: list[str], label: str) -> DataFrame:
    """(fold, column, level, n): level counts per fold; the label is column ''."""
    one = [F.struct(F.lit(name).alias("column"), F.col(f"`{c}`").cast("string").alias("level"))
           for name, c in [*((c, c) for c in categorical), ("", label)]]
    long = rows.select("fold", F.explode(F.array(*one)).alias("v")).select("fold", "v.column", "v.level")
    return long.where("level IS NOT NULL").groupBy("fold", "column", "level").agg(F.count(F.lit(1)).alias("n"))


def pooled(parts: list[tuple]) -> tuple[float, float]:
    """Mean and population deviation of groups given as (n, mean, m2)."""
    parts = [p for p in parts if p[0]]
    n = sum(p[0] for p in parts)
    if not n:
        return 0.0, 0.0
    mean = sum(p[0] * p[1] for p in parts) / n
    return mean, sqrt(max(0.0, sum(m2 + k * (m - mean) ** 2 for k, m, m2 in parts) / n))


def fit_encodings(rows: DataFrame, numeric: list[str], categorical: list[str], label: str, folds: int,
                  max_levels: int = 1000) -> dict:
    """{fold: Encoding of all other folds, None: Encoding of all rows}.

    Levels become columns; more than ``max_levels`` in one column is an error, not a
    cut (``reduce_to_top_n`` first).  Null values take no part."""
    counted = fold_levels(rows, categorical, label)
    wide = counted.groupBy("column").agg(F.countDistinct("level").alias("k")).where(F.col("k") > max_levels).first()
    if wide:
        raise ValueError(f"column {wide['column'] or label} has {wide['k']} levels, more than {max_levels}")
    moments = fold_moments(rows, numeric).collect() if numeric else []
    counts = counted.collect()  # at most folds x columns x max_levels rows
    out = {}
    for fold in [*range(folds), None]:
        stats = {c: pooled([(r["n"], r["mean"], r["m2"]) for r in moments if r["column"] == c and r["fold"] != fold]) for c in numeric}
        levels = {c: sorted({r["level"] for r in counts if r["column"] == c and r["fold"] != fold}) for c in categorical}
        classes = {}
        for r in counts:
            if r["column"] == "" and r["fold"] != fold:
                classes[r["level"]] = classes.get(r["level"], 0) + r["n"]
        total = sum(classes.values())
        out[fold] = Encoding(stats, levels, {c: total / (len(classes) * n) for c, n in sorted(classes.items())})
    return out


def encode(df: DataFrame, enc: Encoding, label: str, weight: str = "weight") -> DataFrame:
    """``enc`` applied: z_<numeric> (null: the mean, so 0; no spread: 0),
    <categorical>_<i> as 0/1 (null or a level the training side lacks: all 0) and the
    class weight (a class it lacks: 1).  Columns of these names are replaced."""
    new = {f"z_{c}": F.coalesce((F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s or 1.0), F.lit(0.0)) if s else F.lit(0.0)
           for c, (m, s) in enc.stats.items()}
    for c, levels in enc.levels.items():
        for i, v in enumerate(levels):
            new[f"{c}_{i}"] = F.coalesce((F.col(f"`{c}`").cast("string") == F.lit(v)).cast("double"), F.lit(0.0))
    w = F.lit(1.0)
    for c, v in enc.weights.items():
        w = F.when(F.col(f"`{label}`").cast("string") == F.lit(c), F.lit(v)).otherwise(w)
    return df.withColumns({**new, weight: w})


def counted(rows: DataFrame, cols: list[str], out: str = "_count") -> DataFrame:
    """Equal rows of ``cols`` as one row with their number: a fit that weighs rows by it sees all of them."""
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def choose_features(train: DataFrame, enc: Encoding, label: str, keep: int, step: int = 1, count: str | None = None) -> list[str]:
    """The ``keep`` encoded columns that recursive elimination leaves on one training side."""
    from .models import rfe
    names = enc.names()
    if len(names) <= keep:
        return names
    ranks = dict(rfe(encode(train, enc, label, "_w").drop("_w"), names, label, keep, step, count))
    return [n for n in names if ranks[n] == 1]


def choose_per_fold(rows: DataFrame, encodings: dict, label: str, keep: int, step: int = 1, parallelism: int = 4,
                    count: str | None = None) -> dict:
    """{fold: chosen columns}, each from the training side of its fold (None: all rows);
    the folds' fits run beside each other.  With ``count`` a row stands for so many equal rows."""
    def one(fold):
        return choose_features(rows if fold is None else rows.where(F.col("fold") != fold), encodings[fold], label, keep, step, count)

    pool = ThreadPool(max(1, min(parallelism, len(encodings))))
    try:
        return dict(zip(encodings, pool.map(inheritable_thread_target(rows.sparkSession)(one), encodings, chunksize=1), strict=True))
    finally:
        pool.close()


def logistic_fitter(encodings: dict, chosen: dict, label: str = "viral", max_iter: int = 100, count: str | None = None) -> Callable:
    """``fit`` for ``search``: balanced L2 logistic regression with C = params["C"]
    on the chosen encoded columns of the fold's own encoders (fold None: all rows).
    sklearn's C maps to regParam = 1 / (C n).  With ``count`` a row stands for so many equal rows."""
    from pyspark.ml.classification import LogisticRegression

    def fit(train, params, fold):
        enc = encodings[fold]
        vectors = VectorAssembler(inputCols=chosen[fold], outputCol="_features")
        data = vectors.transform(encode(train, enc, label, "_weight"))
        if count:
            data = data.withColumn("_weight", F.col("_weight") * F.col(count))
            n = train.agg(F.sum(count)).first()[0] or 0
        else:
            n = train.count()
        lr = LogisticRegression(labelCol=label, featuresCol="_features", weightCol="_weight", standardization=False,
                                regParam=1.0 / (params["C"] * max(1, n)), maxIter=max_iter)
        model = lr.fit(data)
        return lambda df: model.transform(vectors.transform(encode(df, enc, label, "_weight")))
    return fit


class EstimatorFitter:
    """``fit`` for ``search`` from make(**params), a Spark ML estimator."""

    def __init__(self, make: Callable):
        self.make = make

    def __call__(self, train: DataFrame, params: dict, fold) -> Callable:
        return self.make(**params).fit(train).transform

    def shared(self, rows: DataFrame, points: list[dict], folds: int, label: str) -> Callable | None:
        """scores(points, fold), which gives (point, fold, n, correct) for each of ``points``: forests
        that differ in depth and number of trees share them (``trees.forest_scores``).  None for other
        estimators and where the rows' cells are too many for a task."""
        made = [self.make(**p) for p in points]
        plain = {"labelCol", "featuresCol", "seed", "cacheNodeIds", "maxDepth", "numTrees"}
        first = made[0]
        if not all(isinstance(e, RandomForestClassifier) and {p.name for p in e.extractParamMap() if e.isSet(p)} <= plain
                   and e.getLabelCol() == label and e.getFeaturesCol() == first.getFeaturesCol() and e.getSeed() == first.getSeed() for e in made):
            return None
        c = cells(rows, first.getFeaturesCol(), label, "fold", folds)
        if c is None:
            return None
        own = {point_name(p): {"maxDepth": e.getMaxDepth(), "numTrees": e.getNumTrees()} for p, e in zip(points, made, strict=True)}

        def scores(some, fold):
            got = forest_scores(c, [own[point_name(p)] for p in some], [fold], first.getSeed())
            return [(p, fold, *got[own[point_name(p)]["maxDepth"], own[point_name(p)]["numTrees"], fold]) for p in some]
        return scores


def estimator_fitter(make: Callable) -> EstimatorFitter:
    return EstimatorFitter(make)
