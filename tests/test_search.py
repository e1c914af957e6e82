"""Resumable search and encoders fitted inside the folds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kestrel.operators import search as S


def sample(spark, n=240):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, n)
    kind = rng.choice(["a", "b", "c"], n)
    y = (x + np.where(kind == "a", 2.0, 0.0) + rng.normal(0, 1, n) > 4.5).astype(int)
    rows = [(int(i), float(x[i]), str(kind[i]), int(y[i])) for i in range(n)]
    return S.with_folds(spark.createDataFrame(rows, "id INT, x DOUBLE, kind STRING, viral INT"), "id", 3)


def majority(calls, fail=()):
    """A fit that predicts params["value"] and notes its calls."""
    def fit(train, params, fold):
        calls.append((params["value"], fold))
        if (params["value"], fold) in fail:
            raise RuntimeError("ended")
        return lambda df: df.withColumn("prediction", F.lit(params["value"]))
    return fit


def test_search_resumes(spark, tmp_path):
    rows, store, points = sample(spark), str(tmp_path / "s"), [{"value": 0}, {"value": 1}]
    calls = []
    with pytest.raises(RuntimeError):
        S.search(rows, majority(calls, fail={(1, 2)}), points, store, 3, parallelism=1)
    assert sorted(calls) == [(v, k) for v in (0, 1) for k in range(3)]
    calls = []
    got = S.search(rows, majority(calls), points, store, 3)
    assert calls == [(1, 2)]  # the one that is missing
    want = {(f, v): (n, k if v else n - k) for f, n, k in
            [(r["fold"], r["n"], r["k"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("viral").alias("k")).collect()]
            for v in (0, 1)}
    assert {(r["fold"], int(r["params"][-2])): (r["n"], r["correct"]) for r in got.collect()} == want
    calls = []
    more = S.search(rows, majority(calls), [*points, {"value": 2}, {"value": 2}], store, 3)
    assert sorted(calls) == [(2, 0), (2, 1), (2, 2)] and more.count() == 9
    ones = sum(r["viral"] for r in rows.collect())
    assert S.best_point(got, points) == {"value": int(2 * ones > 240)}


def test_unfinished_result_is_not_read(spark, tmp_path):
    rows, store = sample(spark), str(tmp_path / "s")
    path = S.result_path(store, {"value": 0}, 1)
    spark.createDataFrame([("{}", 1, 9, 9)], S.RESULT).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    calls = []
    got = S.search(rows, majority(calls), [{"value": 0}], store, 3)
    assert len(calls) == 3 and got.agg(F.sum("n")).first()[0] == 240


def test_search_of_nothing(spark, tmp_path):
    rows = sample(spark)
    assert S.search(rows, majority([]), [], str(tmp_path / "a"), 3).count() == 0
    got = S.search(rows.where("fold = 0"), majority([]), [{"value": 0}], str(tmp_path / "b"), 2)
    assert {(r["fold"], r["n"] > 0) for r in got.collect()} == {(0, True), (1, False)}
    none = S.search(rows.limit(0), majority([]), [{"value": 0}, {"value": 1}], str(tmp_path / "c"), 2)
    assert S.best_point(none, [{"value": 0}, {"value": 1}]) == {"value": 0}  # ties: the first


def test_encodings_come_from_the_other_folds(spark):
    rows = sample(spark).withColumn("kind", F.when(F.col("fold") == 1, F.lit("only here")).otherwise(F.col("kind")))
    enc = S.fit_encodings(rows, ["x"], ["kind"], "viral", 3)
    data = rows.toPandas()
    for k in (0, 1, 2, None):
        t = data[data["fold"] != k] if k is not None else data
        assert np.allclose(enc[k].stats["x"], (t["x"].mean(), t["x"].std(ddof=0)))
        assert enc[k].levels["kind"] == sorted(t["kind"].unique())
        assert np.allclose([enc[k].weights[c] for c in "01"], [len(t) / (2 * (t["viral"] == c).sum()) for c in (0, 1)])
    assert len({enc[k].stats["x"] for k in (0, 1, 2, None)}) == 4  # no fold sees the global values
    assert "only here" not in enc[1].levels["kind"] and "only here" in enc[None].levels["kind"]


def test_encode_odd_rows(spark):
    enc = S.Encoding({"x": (2.0, 4.0), "flat": (1.0, 0.0)}, {"kind": ["a", "b"]}, {"0": 0.5, "1": 3.0})
    df = spark.createDataFrame([(4.0, 1.0, "a", 1, "w"), (None, None, None, None, "w"), (0.0, 9.0, "new", 0, "w")],
                               "x DOUBLE, flat DOUBLE, kind STRING, viral INT, weight STRING")
    got = [tuple(r) for r in S.encode(df, enc, "viral").select(*enc.names(), "weight").collect()]
    assert got == [(0.5, 0.0, 1.0, 0.0, 3.0), (0.0, 0.0, 0.0, 0.0, 1.0), (-0.5, 0.0, 0.0, 0.0, 0.5)]


def test_too_many_levels_is_an_error(spark):
    with pytest.raises(ValueError):
        S.fit_encodings(sample(spark), [], ["kind"], "viral", 3, max_levels=2)
    empty = S.fit_encodings(sample(spark).limit(0), ["x"], ["kind"], "viral", 3)
    assert empty[0] == S.Encoding({"x": (0.0, 0.0)}, {"kind": []}, {})


def test_logistic_fitter_equals_its_parts(spark, tmp_path):
    rows = sample(spark)
    enc = S.fit_encodings(rows, ["x"], ["kind"], "viral", 3)
    chosen = S.choose_per_fold(rows, enc, "viral", 2)
    assert chosen[0] == S.choose_features(rows.where("fold <> 0"), enc[0], "viral", 2)
    assert all(len(c) == 2 and "z_x" in c and "kind_0" in c for c in chosen.values())  # what decides the label
    points = [{"C": c} for c in (1e-4, 1.0)]
    got = S.search(rows, S.logistic_fitter(enc, chosen), points, str(tmp_path / "s"), 3)
    for r in got.where(F.col("params") == S.point_name({"C": 1.0})).collect():
        k = r["fold"]
        data = VectorAssembler(inputCols=chosen[k], outputCol="f").transform(S.encode(rows, enc[k], "viral"))
        train = data.where(F.col("fold") != k)
        m = LogisticRegression(labelCol="viral", featuresCol="f", weightCol="weight", standardization=False, regParam=1 / train.count())
        hits = m.fit(train).transform(data.where(F.col("fold") == k)).where("prediction = viral").count()
        assert r["correct"] == hits and hits > 0.75 * r["n"]


def test_points_of_a_forest_are_fitted_together(spark, tmp_path, monkeypatch):
    from kestrel.operators import models as ML
    data = sample(spark)
    rows, store = VectorAssembler(inputCols=["x"], outputCol="features").transform(data), str(tmp_path / "s")
    points = [{"maxDepth": d, "numTrees": t} for d in (1, 6) for t in (2, 9)]
    asked, real = [], S.forest_scores
    monkeypatch.setattr(S, "forest_scores", lambda c, some, folds, seed: (asked.append((folds, len(some))), real(c, some, folds, seed))[1])
    fit = S.estimator_fitter(ML.forest)
    monkeypatch.setattr(S.EstimatorFitter, "__call__", lambda *a: pytest.fail("a fit for one point"))
    first = {(r["params"], r["fold"]): (r["n"], r["correct"]) for r in S.search(rows, fit, points[:2], store, 3).collect()}
    assert sorted(asked) == [([k], 2) for k in range(3)]
    asked.clear()
    got = {(r["params"], r["fold"]): (r["n"], r["correct"]) for r in S.search(rows, fit, points, store, 3).collect()}
    assert sorted(asked) == [([k], 2) for k in range(3)] and len(got) == 12 and first.items() <= got.items()
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    assert all(got[p, k][0] == sizes[k] and 0.6 * sizes[k] < got[p, k][1] <= sizes[k] for p, k in got)
    alone = S.search(rows, S.estimator_fitter(ML.forest), points[3:], str(tmp_path / "t"), 3).collect()
    assert {(r["params"], r["fold"]): (r["n"], r["correct"]) for r in alone}.items() <= got.items()


def test_counted_rows_weigh_as_the_rows_they_stand_for(spark, tmp_path):
    rows = sample(spark).withColumn("x", F.round(F.col("x"), 0))  # few values: many equal rows
    once = S.counted(rows, ["fold", "viral", "x", "kind"], "n")
    assert once.count() < 120 and once.agg(F.sum("n")).first()[0] == 240
    enc = S.fit_encodings(rows, ["x"], ["kind"], "viral", 3)
    plain = S.choose_per_fold(rows, enc, "viral", 2)
    assert S.choose_per_fold(once, enc, "viral", 2, count="n") == plain
    points = [{"C": c} for c in (1e-3, 1.0)]
    key = lambda r: (r["params"], r["fold"], r["n"], r["correct"])
    want = sorted(map(key, S.search(rows, S.logistic_fitter(enc, plain), points, str(tmp_path / "a"), 3).collect()))
    got = S.search(once, S.logistic_fitter(enc, plain, count="n"), points, str(tmp_path / "b"), 3, count="n")
    assert sorted(map(key, got.collect())) == want
